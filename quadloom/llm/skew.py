"""Joins in which one key may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy if it holds at least one in so many rows; so there are no more heavy keys than this.
HEAVY = 1000


def lookup(left: DataFrame, right: DataFrame, on: list[str], rows: str) -> DataFrame:
    """left joined with right, which has one row for each of its keys and in ``rows`` how many of left's rows have it.

    Heavy keys, at most HEAVY of them by their share of the rows, are broadcast, so that their rows stay where
    they are; all other keys are joined by a shuffle, in which none holds more than its share. Right's rows must
    be small, and its keys not null; it is read more than once and should be a table.
    """
    total = right.agg(F.sum(rows)).first()[0]
    if total is None:
        return left.join(right, on)
    heavy = right.where(F.col(rows) * HEAVY >= total)
    if heavy.isEmpty():
        return left.join(right, on)
    light = left.join(F.broadcast(heavy.select(*on)), on, "left_anti").join(right.where(F.col(rows) * HEAVY < total), on)
    return left.join(F.broadcast(heavy), on).unionByName(light)
