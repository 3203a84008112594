"""Embedding near-dedup as an exact metric range join.

Pivots, a sample of the vectors whose number follows the square root of theirs, cut space into cells:
a vector's home is the cell of its nearest pivot. By the triangle inequality a vector x with nearest
pivot p can be within eps of a vector at home in q's cell only if d(x, q) - d(x, p) <= 2 eps; in
Euclidean space x's distance to the plane between p and q must also be at most eps. x is copied to
just those cells, and of any two cells only one gets the other's copies, so that every pair meets
exactly once. Cells are joined independently; a large cell is cut into blocks that are joined pairwise,
so no task grows with a dense region.

Equal vectors (of one 128-bit hash) become one before the join and are counted afterwards, so a group of
copies costs no more than its rows. The join gives sums and smallest ids for each vector of a task, never a list of
pairs, so dense regions cost time, but no space.

Vectors of each dimension are joined among themselves, with pivots of their own; vectors of different
dimensions are not near each other.

Ids may be of any type that has an order. Nulls: a vector that is null, empty, or has a null or NaN in it is near
nothing. Rows with a null id are not reported and, as n_near and near_id tell of ids, add to neither.
Repeated rows of one id count as one if their vectors are equal; of an id with several vectors the largest n_near and
the smallest near_id are told. Ties in distance need no order. An empty table gives an empty result. Pairs at exactly
eps are in range. Other columns, of any name, are not touched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadloom.llm.arrowtext import mapped
from quadloom.llm.skew import lookup
from quadloom.llm.storage import drop_written, written

EPS = 0.2
BLOCK = 2048
MARGIN = 1e-5
STEP = 1 << 16


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _hashed(rows: DataFrame) -> DataFrame:
    """id, d (dimension), h (hash of the vector), v of those rows(id, v) that can be near anything."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            flat = lists.flatten()
            wrong = np.isnan(pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False))
            bounds = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
            bad = np.concatenate([[0], np.cumsum(wrong)])
            live = np.flatnonzero((size > 0) & (bad[bounds[1:]] == bad[bounds[:-1]]))
            at = pa.array(live)
            plain = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False) + 0.0  # no negative zeros
            h = [hashlib.blake2b(plain[bounds[k] : bounds[k + 1]].tobytes(), digest_size=16).digest() for k in live]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), pa.array(size[live].astype(np.int32)), pa.array(h, pa.binary()), lists.take(at)], names=["id", "d", "h", "v"])

    return rows.transform(mapped, run, f"id {rows.schema['id'].dataType.simpleString()}, d int, h binary, v {rows.schema['v'].dataType.simpleString()}")


def _assigned(distinct: DataFrame, eps: float) -> DataFrame:
    """cell, home, rep, n, v: every vector at home and wherever its range may reach.

    The pivots, 1/4 of the square root of the vectors, go to every task: 13 MB of them for 10^10 vectors of 64 numbers.
    """
    n = distinct.count()
    wanted = max(1, int(np.sqrt(n) / 4))
    pivots = _matrix(distinct.orderBy(F.xxhash64("rep"), "rep").select("v").limit(wanted).toArrow()["v"].combine_chunks())
    squares = (pivots**2).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(16, min(512, (1 << 21) // len(pivots)))
            for k in range(0, batch.num_rows, step):
                part = batch.slice(k, step)
                x = _matrix(part.column("v"))
                d2 = np.maximum((x**2).sum(axis=1)[:, None] + squares[None, :] - 2 * x @ pivots.T, 0)
                d = np.sqrt(d2)
                rows = np.arange(len(x))
                home = d.argmin(axis=1)
                own, back = np.unique(home, return_inverse=True)
                apart = np.sqrt(np.maximum(squares[own][:, None] + squares[None, :] - 2 * pivots[own] @ pivots.T, 0))[back]
                j = np.arange(len(pivots))[None, :]
                i = home[:, None]
                meets = ((i < j) == ((i + j) % 2 == 0)) & (i != j)
                reach = d - d[rows, home][:, None] <= 2 * eps + MARGIN
                plane = d2 - d2[rows, home][:, None] <= 2 * (eps + MARGIN) * apart + MARGIN
                row, cell = np.nonzero(meets & reach & plane)
                take = pa.array(np.concatenate([rows, row]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([home, cell]).astype(np.int32)), pa.array(np.arange(len(rows) + len(row)) < len(rows)), *(part.column(c).take(take) for c in ("rep", "n", "v"))],
                    names=["cell", "home", "rep", "n", "v"],
                )

    return distinct.transform(mapped, run, T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("home", T.BooleanType()), *(distinct.schema[c] for c in ("rep", "n", "v"))]))


def _sums_within(eps: float):
    def run(key, table):
        table = table.take(pc.sort_indices(table["rep"]))
        kind = key[1].as_py()
        same = kind == 0 and key[2].as_py() == key[3].as_py()
        side = table["side"].to_numpy(zero_copy_only=False)
        rows = np.arange(len(table))
        left, right = (rows, rows) if same else (rows[side], rows[~side])
        v, n = _matrix(table["v"].combine_chunks()), table["n"].to_numpy()
        total, low = np.zeros(len(table), dtype=np.int64), np.full(len(table), len(table))
        y = v[right]
        yy = (y**2).sum(axis=1)
        for k in range(0, len(left) if len(right) else 0, 512):
            part = v[left[k : k + 512]]
            r, c = np.nonzero((part**2).sum(axis=1)[:, None] + yy[None, :] - 2 * part @ y.T <= (eps + MARGIN) ** 2)
            if same:
                r, c = r[r + k < c], c[r + k < c]
            hit = np.concatenate([np.sqrt(((part[r[m : m + STEP]] - y[c[m : m + STEP]]) ** 2).sum(axis=1)) <= eps for m in range(0, len(r), STEP)] or [np.zeros(0, bool)])
            a, b = left[r[hit] + k], right[c[hit]]
            for one, other in ((a, b), (b, a)):
                total += np.bincount(one, weights=n[other], minlength=len(table)).astype(np.int64)
                np.minimum.at(low, one, other)
        met = np.flatnonzero(low < len(table))
        return pa.table({"rep": table["rep"].take(pa.array(met)), "near": total[met], "low": table["rep"].take(pa.array(low[met]))})

    return run


def range_sums(distinct: DataFrame, eps: float = EPS) -> DataFrame:
    """rep, near (sum of n), low (smallest rep) over the others of distinct(rep, n, v) at most eps from it; several rows a rep."""
    assigned = written(_assigned(distinct, eps), "cells")
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(c / F.lit(BLOCK)).cast("int"))
    sizes = assigned.groupBy("cell").agg(F.count("*").alias("rows"), blocks(F.sum(F.col("home").cast("int"))).alias("nh"), F.ceil(F.sum((~F.col("home")).cast("int")) / F.lit(BLOCK)).cast("int").alias("no"))
    sizes = written(sizes, "blocks")
    placed = lookup(assigned, sizes, ["cell"], "rows")
    own = lambda n: F.pmod(F.xxhash64("rep"), F.greatest(n, F.lit(1))).cast("int")
    numbers = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    at = lambda kind, i, j, side: ["cell", F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.alias("side"), "rep", "n", "v"]
    b, o = F.col("b"), F.col("o")
    home = placed.where("home").withColumn("b", own(F.col("nh")))
    inner = home.withColumn("o", F.explode(numbers(F.col("nh")))).select(*at(0, F.least(b, o), F.greatest(b, o), b <= o))
    outer_home = home.withColumn("o", F.explode(numbers(F.col("no")))).select(*at(1, o, b, F.lit(False)))
    outer = placed.where("not home").withColumn("b", own(F.col("no"))).withColumn("o", F.explode(numbers(F.col("nh")))).select(*at(1, b, o, F.lit(True)))
    tasks = inner.unionByName(outer_home).unionByName(outer)
    rep = distinct.schema["rep"].dataType.simpleString()
    sums = written(tasks.groupBy("cell", "kind", "i", "j").applyInArrow(_sums_within(eps), f"rep {rep}, near long, low {rep}"), "sums")
    drop_written(assigned, sizes)
    return sums


def near(df: DataFrame, vector: str = "embedding", key: str = "vec_id", eps: float = EPS) -> DataFrame:
    """key, n_near, near_id, keep for every id of df.

    n_near: other ids within eps; near_id: the smallest id within eps, its own included; keep: it is its own.
    """
    rows = written(_hashed(df.select(F.col(key).alias("id"), F.col(vector).alias("v")).where("id is not null")), "vectors")
    held = written(rows.select("id", "d", "h").distinct(), "held")
    sizes = held.groupBy("d", "h").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    vectors = rows.groupBy("d", "h").agg(F.first("v").alias("v"))
    copies = written(sizes.join(vectors, ["d", "h"]), "distinct")
    dimensions = [r["d"] for r in copies.select("d").distinct().orderBy("d").collect()] or [0]
    sums = reduce(DataFrame.unionByName, (range_sums(copies.where(F.col("d") == d).select("rep", "n", "v"), eps) for d in dimensions))
    around = sums.groupBy("rep").agg(F.sum("near").alias("near"), F.min("low").alias("low"))
    each = copies.select("d", "h", "rep", "n").join(around, "rep", "left").select("d", "h", "n", (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("n_near"), F.least("rep", F.coalesce("low", "rep")).alias("near_id"))
    placed = lookup(held, written(each, "classes"), ["d", "h"], "n").groupBy("id").agg(F.max("n_near").alias("n_near"), F.min("near_id").alias("near_id"))
    every = df.select(F.col(key).alias("_k")).where("_k is not null").distinct()
    out = every.join(placed, F.col("_k") == F.col("id"), "left")
    near_id = F.coalesce("near_id", "_k")
    return out.select(F.col("_k").alias(key), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), near_id.alias("near_id"), (near_id == F.col("_k")).alias("keep"))


def query(spark, sf_dir: str) -> DataFrame:
    """Near-duplicates of every embedding."""
    return near(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
pairs AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a, v b WHERE a.vec_id <> b.vec_id AND list_distance(a.e, b.e) <= {EPS}),
found AS (SELECT x, count(*) AS n, min(y) AS y FROM pairs GROUP BY x)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_near, least(vec_id, coalesce(y, vec_id)) AS near_id, coalesce(y, vec_id) >= vec_id AS keep
FROM v LEFT JOIN found ON vec_id = x"""
