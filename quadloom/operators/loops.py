"""Fixed points over DataFrames."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def durable(df: DataFrame) -> DataFrame:
    """df, computed and with its lineage cut, kept in the folder that spark.checkpoint.dir names."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None):
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quadloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    return df.checkpoint(eager=True)


def closure(edges: DataFrame, start: DataFrame | None = None, max_rounds: int | None = None) -> DataFrame:
    """a, b: b can be reached from a over one or more of edges(a, b). Cycles end, and make a reach itself.

    start: only from these a (one column). Semi-naive: each round extends only the pairs found by the last.
    """
    edges = durable(edges.select("a", "b").where("a is not null and b is not null").distinct())
    delta = edges if start is None else edges.join(start.toDF("a").distinct(), "a", "left_semi")
    delta = durable(delta)
    total, rounds = delta, 1
    step = edges.select(F.col("a").alias("b"), F.col("b").alias("c"))
    while not delta.isEmpty() and (max_rounds is None or rounds < max_rounds):
        grown = delta.join(step, "b").select("a", F.col("c").alias("b")).distinct()
        delta = durable(grown.join(total, ["a", "b"], "left_anti"))
        total, rounds = total.unionByName(delta), rounds + 1
        if rounds % 8 == 0:
            total = durable(total)
    return total
