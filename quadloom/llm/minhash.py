"""Near-duplicate documents by MinHash with tensored banding.

A document is the set of its shingles (runs of ``SHINGLE`` words). Instead of m x m independent table
keys of 2r minhashes each, two collections of m half keys of r minhashes are computed, and every pair
(left i, right j) forms the key of one table: m x m tables for 2 x m x r minhashes. Two documents of
similarity s meet if any left and any right half key agree, with probability (1 - (1 - s^r)^m)^2.

Groups are the connected components of verified pairs:

1. Documents of equal shingle sets become one, the one of the smallest id, before anything else.
2. Each table key's documents are a bucket; of equal buckets in several tables one is kept.
3. Every member is compared with its bucket's first; exact Jaccard similarity decides.
4. Of the buckets whose members are not in one component by then, members of different components are
   compared in an exact set-similarity join: shingles are ordered by how many of these documents have them,
   rarest first, and two sets that are similar enough share a shingle within both their prefixes. So a passage
   that many documents share does not make pairs of them all. A pair within one component can't change the result.
   Nothing is capped.

A bucket may hold any share of all documents: it is never gathered, its first and size are aggregated before
the shuffle, members are looked up with heavy keys broadcast, and the first's set is copied to as many salts as the
bucket's size asks for.

Shingle sets are sets of 64-bit hashes; that two of n different shingles have one hash has a probability
of about n^2 / 2^65, 3 in 10^10 for 100,000.

Ids may be of any type that has an order. Nulls: a document without words (null, empty, marks only) is no duplicate of
anything. Rows with a null id cannot be told apart by id: they are left out of groups() and kept by deduplicate(). Repeated
rows of one id count as one document, and deduplicate() keeps the one whose text comes first in order;
where their texts differ, the one whose shingle set has the smallest hash decides about the group. Texts of fewer words than a
shingle are one shingle. An empty table gives empty results. Columns of any name pass through deduplicate().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadloom.llm.arrowtext import distinct_in_rows, list_array, mapped, mix, span_hash, word_slices
from quadloom.llm.bloom import Bloom, build, split
from quadloom.llm.components import connected_components
from quadloom.llm.skew import lookup
from quadloom.llm.storage import drop_written, numbered, written

SHINGLE = 2
HALF_KEYS = 10
HALF_SIZE = 3
THRESHOLD = 0.6
#: Pairs of one document that are verified in one task.
SALT_ROWS = 1 << 16
_SEED = np.random.default_rng(20_240_607)
_FACTORS = _SEED.integers(1, 1 << 63, size=2 * HALF_KEYS * HALF_SIZE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _SEED.integers(1, 1 << 63, size=2 * HALF_KEYS * HALF_SIZE, dtype=np.uint64)


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, sorted distinct 64-bit shingle hashes, bounds of each row's)."""
    for i, j, data, s, e, first in word_slices(column):
        h = span_hash(data, s, e)
        n = np.diff(first)
        if not len(h):
            yield i, j, np.zeros(0, np.uint64), np.zeros(j - i + 1, np.int64)
            continue
        value = h.copy()
        row = np.repeat(np.arange(j - i), n)
        for k in range(1, SHINGLE):
            value[:-k] = value[:-k] * np.uint64(0x9E3779B97F4A7C15) + h[k:]
        short = n < SHINGLE
        last = first[1:][row]
        keep = (np.arange(len(h)) + SHINGLE <= last) | (short[row] & (np.arange(len(h)) == first[:-1][row]))
        value, row = mix(value[keep]), row[keep]
        v, _, bounds = distinct_in_rows(value, np.searchsorted(row, np.arange(j - i + 1)))
        yield i, j, v, bounds


def _half_keys(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(rows, 2 x HALF_KEYS) uint64; every row must have values."""
    x = mix(values + np.uint64(1))
    out = np.zeros((len(bounds) - 1, 2 * HALF_KEYS), dtype=np.uint64)
    for k in range(2 * HALF_KEYS):
        key = np.full(len(bounds) - 1, k + 1, dtype=np.uint64)
        for f in range(k * HALF_SIZE, (k + 1) * HALF_SIZE):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(x * _FACTORS[f] + _SHIFTS[f], bounds[:-1]))
        out[:, k] = key
    return out


def _set_hashes(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell shingle sets apart; every row must have values."""
    h = mix(values + np.uint64(7))
    return np.add.reduceat(h, bounds[:-1]), np.bitwise_xor.reduceat(mix(h), bounds[:-1])


def _typed(doc: T.StructField, fields: str) -> str:
    """A schema of doc and further fields."""
    return f"doc {doc.dataType.simpleString()}, {fields}"


def signatures(source: DataFrame) -> DataFrame:
    """doc, same (hash of the shingle set), keys (2 x HALF_KEYS half keys) of source(doc, text); documents without words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, v, bounds in shingle_sets(batch.column("text")):
                live = np.flatnonzero(np.diff(bounds))
                if not len(live):
                    continue
                edges = np.append(bounds[:-1][live], bounds[-1])
                keys = _half_keys(v, edges)
                same = _set_hashes(v, edges)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc").take(pa.array(live + i)), pa.array(same[0].view(np.int64)), pa.array(same[1].view(np.int64)), list_array(keys.ravel().view(np.int64), np.arange(len(live) + 1) * 2 * HALF_KEYS, pa.int64())],
                    names=["doc", "same_a", "same_b", "keys"],
                )

    return source.transform(mapped, run, _typed(source.schema["doc"], "same_a long, same_b long, keys array<long>"))


def _table_keys(reps: DataFrame, wanted: Bloom | None = None) -> DataFrame:
    """key, doc: all HALF_KEYS x HALF_KEYS table keys of each document, or those that may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.asarray(batch.column("keys").flatten()).view(np.uint64).reshape(-1, 2 * HALF_KEYS)
            for k in range(0, len(keys), 1024):
                left, right = keys[k : k + 1024, :HALF_KEYS], keys[k : k + 1024, HALF_KEYS:]
                table = pa.array(mix(left[:, :, None] * np.uint64(0xD6E8FEB86659FD93) + right[:, None, :]).reshape(-1).view(np.int64))
                row = np.repeat(np.arange(k, k + len(left)), HALF_KEYS * HALF_KEYS)
                if wanted is not None:
                    hit = wanted.may_hold(table)
                    table, row = table.filter(pa.array(hit)), row[hit]
                yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(row)), table], names=["doc", "key"])

    return reps.select("doc", "keys").transform(mapped, run, _typed(reps.schema["doc"], "key long"))


def _members(reps: DataFrame) -> DataFrame:
    """bucket, first, size, doc: a row per member of each distinct bucket of two documents or more."""
    keyed = _table_keys(reps)
    shared = keyed.groupBy("key").agg(F.min("doc").alias("first"), F.count("*").alias("size"), F.bit_xor(F.xxhash64("doc")).alias("x"), F.bit_xor(F.xxhash64("doc", F.lit(1))).alias("y")).where("size > 1")
    kept = written(shared.groupBy("first", "size", "x", "y").agg(F.min("key").alias("key")).select("key", "first", "size"), "buckets")
    found = lookup(_table_keys(reps, build(kept, hashed=True)), kept, ["key"], "size")
    out = written(found.select(F.col("key").alias("bucket"), "first", "size", "doc"), "members")
    drop_written(kept)
    return out


def _sets(source: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc, shingles of those rows of source(doc, text) whose doc is in wanted(doc), a row per id.

    A Bloom filter drops other rows before anything of them is shuffled; the join is exact.
    """
    bloom = build(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(bloom.may_hold(batch.column("hash"))))
            for i, j, v, bounds in shingle_sets(batch.column("text")):
                live = np.flatnonzero(np.diff(bounds))
                if len(live):
                    edges = np.append(bounds[:-1][live], bounds[-1])
                    same = [pa.array(h.view(np.int64)) for h in _set_hashes(v, edges)]
                    yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(live + i)), *same, list_array(v.view(np.int64), edges, pa.int64())], names=["doc", "same_a", "same_b", "shingles"])

    hashed = source.select("doc", "text", F.xxhash64("doc").alias("hash"))
    each = hashed.transform(mapped, run, _typed(source.schema["doc"], "same_a long, same_b long, shingles array<long>")).join(wanted, "doc", "left_semi")
    return each.groupBy("doc").agg(F.min(F.struct("same_a", "same_b", "shingles")).alias("s")).select("doc", "s.shingles")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of distinct documents whose Jaccard similarity is at least the threshold.

    An a of many pairs is spread: its set goes to one salt per SALT_ROWS of them.
    """
    spread = written(pairs.groupBy("a").agg(F.count("*").alias("rows")), "spread")
    top = F.floor(F.col("rows") / SALT_ROWS).cast("int")
    left = sets.join(spread, F.col("doc") == F.col("a")).select("a", F.explode(F.sequence(F.lit(0), top)).alias("salt"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc").alias("b"), F.col("shingles").alias("sb"))
    salted = lookup(pairs, spread, ["a"], "rows").select("a", "b", F.pmod(F.xxhash64("b"), top + 1).cast("int").alias("salt"))
    both = salted.join(right, "b").join(left, ["a", "salt"])
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(shared / (F.size("sa") + F.size("sb") - shared) >= threshold).select("a", "b")


def _crossing(members: DataFrame, roots: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of documents in different components, both from buckets that several components share, that may be similar enough.

    An exact prefix-filtered join: every such pair that is similar enough is among them.
    """
    placed = members.where("size > 2").join(roots, F.col("doc") == F.col("node"), "left").select("bucket", "doc", F.coalesce("root", "doc").alias("root"))
    placed = written(placed, "placed")
    mixed = written(placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("rows")).where("low <> high").select("bucket", "rows"), "mixed")
    docs = lookup(placed, mixed, ["bucket"], "rows").select("doc", "root").distinct()
    tokens = written(sets.join(docs, "doc").select("doc", "root", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle")), "tokens")
    held = tokens.groupBy("shingle").agg(F.count("*").alias("rows"))
    held = written(held, "held")
    order = Window.partitionBy("doc").orderBy("rows", "shingle")
    ranked = lookup(tokens, held, ["shingle"], "rows").withColumn("at", F.row_number().over(order))
    prefix = ranked.where((F.col("at") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1) & (F.col("rows") > 1)).select("shingle", "doc", "root", "n")
    prefix = written(prefix, "prefixes")
    a, b = (prefix.select("shingle", *(F.col(c).alias(c + side) for c in ("doc", "root", "n"))) for side in ("_a", "_b"))
    long_enough = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * threshold - 1e-9
    met = a.join(b, "shingle").where((F.col("doc_a") < F.col("doc_b")) & (F.col("root_a") != F.col("root_b")) & long_enough)
    out = written(met.select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b")).distinct(), "crossing")
    drop_written(placed, mixed, tokens, held, prefix)
    return out


def groups(df: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """key, group_id: a row for every id of df; group_id is the smallest id of its group."""
    source = df.select(F.col(key).alias("doc"), F.col(text).cast("string").alias("text")).where("doc is not null")
    one = written(signatures(source).groupBy("doc").agg(F.min(F.struct("same_a", "same_b", "keys")).alias("s")).select("doc", "s.*"), "signatures")
    # Equal sets have equal keys.
    equal = written(one.groupBy("same_a", "same_b").agg(F.min("doc").alias("rep"), F.first("keys").alias("keys"), F.count("*").alias("rows")), "equal")
    owned = lookup(one.select("doc", "same_a", "same_b"), equal.where("rows > 1").select("same_a", "same_b", "rep", "rows"), ["same_a", "same_b"], "rows").select("doc", "rep")
    members = _members(equal.select(F.col("rep").alias("doc"), "keys"))
    pairs = written(members.where("doc <> first").select(F.col("first").alias("a"), F.col("doc").alias("b")).distinct(), "pairs")
    wanted = written(members.select("doc").distinct(), "wanted")
    sets = written(_sets(source, wanted), "sets")
    edges = written(_verified(pairs, sets, threshold), "edges")
    roots = written(connected_components(edges), "roots")
    more = written(_verified(_crossing(members, roots, sets, threshold), sets, threshold), "edges")
    if not more.isEmpty():
        roots = written(connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).where("a <> b").unionByName(more)), "roots")
    grouped = written(one.select("doc").join(owned, "doc", "left").select("doc", F.coalesce("rep", "doc").alias("rep")).join(roots.where("node <> root"), F.col("rep") == F.col("node"), "left").select("doc", F.coalesce("root", "rep").alias("group_id")).where("doc <> group_id"), "grouped")
    drop_written(one, equal, members, pairs, wanted, sets, edges, more, roots)
    every = df.select(F.col(key).alias("_k")).where("_k is not null").distinct()
    return every.join(grouped, F.col("_k") == F.col("doc"), "left").select(F.col("_k").alias(key), F.coalesce("group_id", "_k").alias("group_id"))


def deduplicate(df: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """df with one row of each group: one of the smallest id. Rows with a null id stay.

    Only rows whose id may be dropped or repeated, by a Bloom filter, are sorted and joined.
    """
    found = groups(df, text, key, threshold)
    dropped = found.where(F.col(key) != F.col("group_id")).select(F.col(key).alias("_k"))
    repeated = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).count().where("count > 1").select("_k")
    special = written(dropped.withColumn("_gone", F.lit(True)).unionByName(repeated.withColumn("_gone", F.lit(False))), "special")
    names, at = df.columns, df.columns.index(key)
    inner, k, t = numbered(df), f"c{at}", f"c{df.columns.index(text)}"
    open_, settled = split(inner, F.col(k), build(special.select("_k")))
    first = Window.partitionBy(k).orderBy(F.col(t).asc_nulls_last())
    kept = open_.where(F.col(k).isNotNull()).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    kept = kept.join(special.where("_gone").select("_k"), F.col(k) == F.col("_k"), "left_anti")
    return settled.unionByName(kept).unionByName(open_.where(F.col(k).isNull())).toDF(*names)


def query(spark, sf_dir: str) -> DataFrame:
    """The near-duplicate group of every document."""
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
