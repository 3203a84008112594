"""Tables and files in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a temporary one on one machine (tests); on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quadloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; removed when the driver ends."""
    path = f"{shared_folder(spark)}/quadloom-{name}-{uuid.uuid4().hex[:12]}"
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1, ..., so that none clashes with a column that an operator adds."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


#: Options of written() for tables whose rows are megabytes each: a row group for each row. By default a task's first hundred rows
#: are one row group, which the writer holds, and a reader's batch gets, as a whole.
LARGE_ROWS = {"parquet.block.row.count.limit": "1", "parquet.page.size.row.check.min": "1", "parquet.enable.dictionary": "false"}


def written(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and outlives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(*tables: DataFrame) -> None:
    """Deletes tables made by written() that no result depends on any more."""
    for t in tables:
        for f in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            remove(t.sparkSession, f)


def _clean() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # the session may be gone already, and with it the way to reach the folder
            return
