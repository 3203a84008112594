"""Joins in which few keys may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.operators.loops import durable

#: Rows of one side that meet those of the other in a tile, on average.
TILE = 256
#: Rows that a task of a tiled join gives, on average.
TASK_ROWS = 1 << 23


def product_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """left joined with right by columns that may repeat in both.

    Rows of a key that gives TILE x TILE rows or more are cut into blocks on both sides, and each pair of blocks is
    a group of its own, so that the result's rows, not the keys, are spread over tasks; each row is sent to as many
    tiles as the other side has blocks of its key, in all one row for some TILE of the result. Other keys are joined
    as they are. Both sides are read three times and must give the same rows each time.
    """
    count = lambda df, name: df.groupBy(*on).agg(F.count("*").alias(name))
    sizes = count(left, "_l").join(count(right, "_r"), on).withColumn("_rows", F.col("_l").cast("double") * F.col("_r"))
    blocks = lambda name: F.ceil(F.col(name) / TILE).cast("int")
    heavy = durable(sizes.where(F.col("_rows") >= TILE * TILE).select(*on, blocks("_l").alias("_m"), blocks("_r").alias("_n"), "_rows"))
    rows = heavy.agg(F.sum("_rows")).first()[0]
    if rows is None:
        return left.join(right, on)
    tasks = int(min(max(rows / TASK_ROWS, 2 * left.sparkSession.sparkContext.defaultParallelism), 20_000))

    def tiles(df: DataFrame, own: str, other: str) -> DataFrame:
        at = F.pmod(F.xxhash64(*df.columns), F.col(own)).cast("int")
        each = df.join(F.broadcast(heavy.select(*on, own, other)), on).select(*df.columns, at.alias("_" + own), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("_" + other))
        return each.repartition(tasks, *on, "__m", "__n")

    tiled = tiles(left, "_m", "_n").join(tiles(right, "_n", "_m"), [*on, "__m", "__n"]).drop("__m", "__n")
    light = left.join(F.broadcast(heavy.select(*on)), on, "left_anti").join(right, on)
    return light.unionByName(tiled)
