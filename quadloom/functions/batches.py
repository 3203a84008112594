"""Arrow batches of texts, bounded in bytes: texts differ in length by orders of magnitude."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def bounded() -> None:
    """Sets the session's batch settings to BATCH, unless its creator has set them."""
    spark = SparkSession.active()
    given = spark.sparkContext.getConf()
    for k, v in BATCH.items():
        if not given.contains(k):
            spark.conf.set(k, v)


def thrifty(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, giving the memory it freed back to the system as it ends: workers are reused, and glibc and Arrow keep it otherwise."""

    def end(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            return

    return end


def texts_udf(function: Callable, kind: str):
    """A function of columns: a pandas UDF that gives function's series for a series of texts, in bounded batches."""
    import pandas as pd
    from pyspark.sql import functions as F

    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from thrifty(lambda bs: map(function, bs))(batches)

    each.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    udf = F.pandas_udf(each, kind)

    def column(c):
        bounded()
        return udf(c)

    return column
