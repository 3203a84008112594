"""Vector store: embedding slot, insert if absent, tombstones, compaction, exact nearest neighbours."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadloom.functions.batches import texts_udf
from quadloom.operators.loops import durable

DIMENSION = 384
VECTORS = "key string, embedding array<float>, metadata string, uri string"


def hash_embedding(text: str | None, dimension: int = DIMENSION) -> list[float]:
    """Deterministic bag of hashed words, signed, of unit length; zeros for no words."""
    import zlib

    v = np.zeros(dimension, dtype=np.float64)
    for word in (text or "").lower().split():
        h = zlib.crc32(word.encode())
        v[h % dimension] += 1.0 if (h >> 16) & 1 else -1.0
    n = np.linalg.norm(v)
    return (v / n if n else v).astype(np.float32).tolist()


def embedder(dimension: int = DIMENSION, function: Callable[[list[str]], list[list[float]]] | None = None):
    """A pandas UDF text -> array<float>; ``function`` (a model, a remote service) takes a batch of texts, bounded in bytes."""
    return texts_udf(lambda s: pd.Series(function([x or "" for x in s])) if function else s.map(lambda x: hash_embedding(x, dimension)), "array<float>")


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return F.sqrt(F.aggregate(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def quantised(distance: Column) -> Column:
    """Distance cut to whole millionths."""
    return F.floor(distance * 1_000_000).cast("long")


def score(distance: Column) -> Column:
    return 1.0 / (1.0 + quantised(distance) / 1_000_000.0)


def nearest(vectors: DataFrame, query: list[float], k: int, metric: str = "l2", key: str = "key", embedding: str = "embedding") -> DataFrame:
    """The k rows of vectors nearest to a vector, with distance (l2) or similarity (cosine) and score.

    Each partition keeps its own k best, so k rows a partition are all that moves.
    """
    q = F.array(*(F.lit(float(x)) for x in query))
    if metric == "cosine":
        return vectors.withColumn("score", cosine(F.col(embedding), q)).where("score is not null").orderBy(F.desc("score"), key).limit(k)
    d = vectors.withColumn("distance", l2(F.col(embedding), q))
    return d.withColumn("score", score(F.col("distance"))).orderBy(quantised(F.col("distance")), key).limit(k)


#: Numbers of query vectors that a task holds at once.
BLOCK_NUMBERS = 1 << 20


def nearest_join(queries: DataFrame, vectors: DataFrame, k: int, query_key: str, query_vector: str, key: str = "key", embedding: str = "embedding", metric: str = "l2", block: int | None = None) -> DataFrame:
    """query_key, rank, key, distance (l2) or score (cosine): the k nearest rows of vectors for every row of queries.

    Queries go to the partitions of vectors in blocks of bounded size, a pass over vectors each, whose result is kept
    before the next; each partition multiplies matrices to find who can be among the k best, compares these exactly and
    keeps k a query, which are then merged. Distances are compared in whole millionths, ties by key. Vectors of another
    dimension than the query's, null or with a null or NaN in them match nothing; queries with a null key are left out.
    """
    queries = queries.select(F.col(query_key).alias("q"), F.col(query_vector).alias("v")).where("q is not null and v is not null and size(v) > 0")
    kinds = dict(queries.dtypes)["q"], dict(vectors.dtypes)[key]
    size = queries.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    block = block or max(64, BLOCK_NUMBERS // max(size["d"] or 1, 1))
    blocks = max(1, -(-size["n"] // block))
    table = vectors.where(F.col(embedding).isNotNull()).select(F.col(key).alias("key"), F.col(embedding).alias("v"))
    value = "distance" if metric == "l2" else "score"
    out = None
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).orderBy("q").toArrow()
        for d, part in _by_dimension(rows["q"].combine_chunks(), rows["v"].combine_chunks()):
            found = table.where(F.size("v") == d).mapInArrow(_search(*part, k, metric), f"q {kinds[0]}, key {kinds[1]}, place double, {value} double")
            ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("place", "key"))).where(F.col("rank") <= k)
            ranked = ranked.select(F.col("q").alias(query_key), "rank", F.col("key").alias(key), value)
            ranked = durable(ranked) if blocks > 1 else ranked
            out = ranked if out is None else out.unionByName(ranked)
    return queries.sparkSession.createDataFrame([], f"{query_key} {kinds[0]}, rank int, {key} {kinds[1]}, {value} double") if out is None else out


def _by_dimension(ids: pa.Array, lists: pa.ListArray) -> Iterator[tuple[int, tuple[pa.Array, np.ndarray]]]:
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        x = _matrix(lists.take(pa.array(at)), int(d))
        sound = ~np.isnan(x).any(axis=1)
        if sound.any():
            yield int(d), (ids.take(pa.array(at[sound])), x[sound])


def _matrix(lists: pa.Array, d: int) -> np.ndarray:
    """Rows of d numbers each; a null number is NaN."""
    flat = pc.fill_null(lists.flatten().cast(pa.float64()), float("nan"))
    return flat.to_numpy(zero_copy_only=False).reshape(-1, d)


def _search(ids: pa.Array, q: np.ndarray, k: int, metric: str):
    """A function of batches (key, v): q, key, place (what is sorted by) and distance or score of each query's k best among them."""
    cosine_ = metric != "l2"
    norm = np.sqrt((q * q).sum(axis=1))
    qq = norm * norm

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros(0, np.int64), None, np.zeros(0), np.zeros(0)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = _matrix(part.column("v"), q.shape[1])
                sound = np.flatnonzero(~np.isnan(x).any(axis=1))
                if len(sound):
                    best = kept(best, part.column("key").take(pa.array(sound)), x[sound])
        if best[1] is not None:
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(best[0])), best[1], pa.array(best[2]), pa.array(best[3])], names=["q", "key", "place", "score" if cosine_ else "distance"])

    def kept(best: tuple, keys: pa.Array, x: np.ndarray) -> tuple:
        size = np.sqrt((x * x).sum(axis=1))
        who, what = [], []
        for i in range(0, len(q), 512):
            product = q[i : i + 512] @ x.T
            if cosine_:
                with np.errstate(divide="ignore", invalid="ignore"):
                    far = np.nan_to_num(-product / (norm[i : i + 512, None] * size[None, :]), nan=np.inf, posinf=np.inf, neginf=np.inf)
                slack = 1e-9
            else:
                far = np.sqrt(np.maximum(qq[i : i + 512, None] + (size * size)[None, :] - 2 * product, 0))
                # Where distances are small, the squares' rounding shows as its root.
                slack = 1e-6 + 1e-7 * (norm[i : i + 512, None] + size.max())
            last = np.partition(far, k - 1, axis=1)[:, k - 1 : k] if k <= len(x) else np.full((len(far), 1), np.inf)
            r, c = np.nonzero((far <= last + 2 * slack) & (far < np.inf))
            who.append(r + i)
            what.append(c)
        r, c = np.concatenate(who), np.concatenate(what)
        exact = np.concatenate([_exact(q[r[m : m + 8192]], x[c[m : m + 8192]], norm[r[m : m + 8192]] * size[c[m : m + 8192]]) for m in range(0, len(r), 8192)] or [np.zeros(0)])
        place = -exact if cosine_ else np.floor(exact * 1e6)
        keys = keys.take(pa.array(c))
        if best[1] is not None:
            r, keys, place, exact = np.concatenate([best[0], r]), pa.concat_arrays([best[1], keys]), np.concatenate([best[2], place]), np.concatenate([best[3], exact])
        order = pc.sort_indices(pa.table({"r": r, "place": place, "key": keys}), sort_keys=[("r", "ascending"), ("place", "ascending"), ("key", "ascending")]).to_numpy()
        r = r[order]
        first = np.searchsorted(r, r)
        take = order[np.arange(len(r)) - first < k]
        return r[np.arange(len(r)) - first < k], keys.take(pa.array(take)), place[take], exact[take]

    def _exact(a: np.ndarray, b: np.ndarray, norms: np.ndarray) -> np.ndarray:
        return (a * b).sum(axis=1) / norms if cosine_ else np.sqrt(((a - b) ** 2).sum(axis=1))

    return run


def triple_vectors(triples: DataFrame) -> DataFrame:
    """key s|p|o, content "s p o", metadata and uri of each triple, not yet embedded."""
    meta = F.to_json(F.struct(F.col("subject").alias("uri"), "predicate", "object", F.lit("triple").alias("type")))
    return triples.select(F.concat_ws("|", "subject", "predicate", "object").alias("key"), F.concat_ws(" ", "subject", "predicate", "object").alias("content"), meta.alias("metadata"), F.col("subject").alias("uri"))


def insert_absent(store: DataFrame, new: DataFrame, embed=None, dimension: int = DIMENSION) -> DataFrame:
    """The rows of new(key, content, metadata, uri) whose key the store lacks, embedded; known keys are not embedded again."""
    fresh = new.dropDuplicates(["key"]).join(store.select("key"), "key", "left_anti")
    return fresh.select("key", (embed or embedder(dimension))(F.col("content")).alias("embedding"), "metadata", "uri")


def of_dimension(vectors: DataFrame, dimension: int) -> DataFrame:
    return vectors.where(F.size("embedding") == dimension)


def metadata_uri(metadata: Column, key: Column) -> Column:
    return F.coalesce(F.get_json_object(metadata, "$.uri"), key)


def compacted(vectors: DataFrame, active: DataFrame) -> DataFrame:
    """The rows whose key is active; nothing is dropped where no key is."""
    return vectors if active.isEmpty() else vectors.join(active.select("key").distinct(), "key", "left_semi")


def stats(vectors: DataFrame, active: DataFrame) -> DataFrame:
    """active, stale, total: one row."""
    marked = vectors.join(active.select("key").distinct().withColumn("live", F.lit(1)), "key", "left")
    return marked.agg(F.coalesce(F.sum("live"), F.lit(0)).cast("long").alias("active"), F.count(F.when(F.col("live").isNull(), 1)).alias("stale"), F.count("*").alias("total"))


@F.pandas_udf(T.StringType())
def uuid5(s: pd.Series) -> pd.Series:
    """Deterministic point ids of an external vector store."""
    return s.map(lambda x: None if x is None else str(uuid.uuid5(uuid.NAMESPACE_DNS, x)))


def collection_name(namespace: str | None = None, prefix: str = "quadloom") -> str:
    return f"{prefix}_{namespace}" if namespace else prefix
