"""Connected components of an edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.llm.skew import lookup
from quadloom.llm.storage import drop_written, written


def _least(pairs: DataFrame) -> DataFrame:
    """v, m (its smallest neighbour), rows (how many it has) of pairs(v, u)."""
    return written(pairs.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("rows")), "least")


def connected_components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node of its component) for every node of edges(a, b); loops are ignored.

    Each round moves every node to the smallest node it knows of; rounds end when nothing moves, which
    takes a number that grows with the logarithm of the longest path. Nodes may be of any type that has an
    order. A node may have any share of all edges: smallest neighbours are aggregated before the shuffle and
    looked up with heavy nodes broadcast. Tables are written to the shared folder between rounds.
    """
    current = written(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "stars")
    while True:
        both = current.select("v", "u").unionByName(current.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = _least(both)
        large = written(lookup(both.where("u > v"), least, ["v"], "rows").select(F.col("u").alias("v"), F.least("v", "m").alias("u")).distinct(), "large")
        low = _least(large)
        small = lookup(large, low, ["v"], "rows")
        moved = small.where("u > m").select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(low.select("v", F.col("m").alias("u"))).where("v <> u").distinct()
        after = written(moved, "stars")
        # A star forest: every node hangs on one root, and no root hangs on another.
        ends = after.groupBy("v").count().where("count > 1").isEmpty() and after.join(after.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()
        drop_written(current, least, large, low)
        if ends:
            roots = after.select(F.col("u").alias("node")).distinct().select("node", F.col("node").alias("root"))
            return after.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(roots)
        current = after
