"""Exact top-k search with an impact-ordered index, read score at a time.

The index is built once, as a table with a row per shard of documents, and serves any number of queries. A
posting's impact (its BM25 weight but for the word's rarity) is quantised upward to one of ``LEVELS``; postings lie in
segments by word and level, the highest first. A query takes its words' segments in descending order of
quantised impact times rarity and adds up exact weights. It stops only on proof: when what the unread
segments could still add to one document is less than the k-th best sum so far, no unseen document can be in
the top k; those seen that still can be are few by then, and are looked up in the unread segments, else it reads
on to the end. So all scores are exact. Shard winners are merged by (score, id).

Scores are BM25 over distinct query words; document frequencies, the number of documents and their mean
length are taken over all whole documents. Queries are processed in blocks of ``QUERY_BLOCK``, each a pass over
the index, so that no worker holds more than one block whatever their number.

Ids may be of any type that has an order. Nulls: a null or empty query or document matches nothing. Rows with a null id
are indexed and may be returned with it, last among equals; queries with a null id are left out. Repeated rows of documents
each rank; repeated query ids are one query, of all their words. Ties in score (to 6 digits) go to the smaller id. Fewer
than k rows come back where fewer documents share a word with the query. Empty tables give an empty result. Other columns,
of any name, are not touched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadloom.llm.arrowtext import distinct_in_rows, mapped, span_hash, word_slices
from quadloom.llm.storage import LARGE_ROWS, written

K1, B = 1.2, 0.75
TOP = 10
LEVELS = 32
FEW = 512
#: A shard is a row of the index, which executors hold several copies of as it is written and read; they take their memory by it.
SHARD_BYTES = 4 << 20
QUERY_BLOCK = 4096
#: Postings read before it is first asked whether reading may stop; then twice as many each time.
FIRST_READ = 1024
_PARTS = {"length": np.int32, "words": np.uint64, "word_at": np.int32, "level": np.uint8, "segment_at": np.int32, "posting": np.int32, "tf": np.int32}


def query_words(queries: DataFrame, text: str, key: str, block: int, blocks: int) -> tuple[pa.Array, np.ndarray, list[np.ndarray]]:
    """(ids, sorted vocabulary, each query's places in it) of one block of queries."""
    rows = queries.where(F.col(key).isNotNull() & (F.pmod(F.xxhash64(F.col(key)), F.lit(blocks)) == block)).select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    got = rows.groupBy("k").agg(F.array_join(F.sort_array(F.collect_list("t")), "\n").alias("t")).orderBy("k").toArrow()
    sets: list[np.ndarray] = []
    for i, j, data, s, e, first in word_slices(got["t"].combine_chunks() if got.num_rows else pa.array([], pa.string())):
        v, _, bounds = distinct_in_rows(span_hash(data, s, e), first)
        sets += [v[bounds[k] : bounds[k + 1]] for k in range(j - i)]
    vocabulary = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]))
    return got["k"].combine_chunks(), vocabulary, [np.searchsorted(vocabulary, s) for s in sets]


def mean_length(source: DataFrame) -> tuple[int, float]:
    """(documents, mean length in words) of source(text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = total = 0
        for batch in batches:
            docs += batch.num_rows
            total += sum(int(first[-1]) for *_, first in word_slices(batch.column("text")))
        yield pa.RecordBatch.from_arrays([pa.array([docs]), pa.array([total])], names=["docs", "words"])

    got = source.select("text").transform(mapped, run, "docs long, words long").agg(F.sum("docs"), F.sum("words")).first()
    docs, total = got[0] or 0, got[1] or 0
    return docs, total / docs if total else 1.0


def tf_weight(tf: np.ndarray, length: np.ndarray, mean: float) -> np.ndarray:
    """BM25 weight but for the word's rarity; less than K1 + 1."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def _shard(row: np.ndarray, word: np.ndarray, tf: np.ndarray, length: np.ndarray, mean: float) -> dict[str, np.ndarray]:
    """The arrays of one shard: segments by word, then level from the highest, each with its rows in order."""
    level = np.clip(np.ceil(tf_weight(tf, length[row], mean) * (LEVELS / (K1 + 1)) - 1e-9), 1, LEVELS).astype(np.int64)
    order = np.lexsort((row, -level, word))
    row, word, tf, level = row[order], word[order], tf[order], level[order]
    new_word = np.append(True, word[1:] != word[:-1])[: len(word)]
    new = new_word | np.append(True, level[1:] != level[:-1])[: len(word)]
    segment = np.flatnonzero(new)
    return {
        "length": length, "words": word[new_word], "word_at": np.append(np.flatnonzero(new_word[segment]), len(segment)), "level": level[segment],
        "segment_at": np.append(segment, len(word)), "posting": row, "tf": tf,
    }


def build_index(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The index of docs, a table in the shared folder: a row per shard of about SHARD_BYTES of text, with the ids of its rows, arrays as binary, the number of all documents and their mean length."""
    source = docs.select(F.col(key).alias("doc"), F.col(text).cast("string").alias("text"))
    n, mean = mean_length(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, parts, lengths, held, rows = [], [], [], 0, 0
        for batch in batches:
            column = batch.column("text")
            for i, j, data, s, e, first in word_slices(column):
                h, tf, bounds = distinct_in_rows(span_hash(data, s, e), first)
                parts.append((np.repeat(np.arange(rows, rows + j - i), np.diff(bounds)), h, tf))
                keys.append(batch.column("doc").slice(i, j - i))
                lengths.append(np.diff(first))
                held, rows = held + len(data), rows + j - i
                if held >= SHARD_BYTES:
                    yield flush(keys, parts, lengths)
                    keys, parts, lengths, held, rows = [], [], [], 0, 0
        if rows:
            yield flush(keys, parts, lengths)

    def flush(keys: list, parts: list, lengths: list) -> pa.RecordBatch:
        arrays = _shard(*(np.concatenate(x) for x in zip(*parts)), np.concatenate(lengths), mean)
        ids = pa.concat_arrays(keys)
        packed = [pa.array([np.ascontiguousarray(arrays[c], dtype=t).tobytes()], pa.binary()) for c, t in _PARTS.items()]
        return pa.RecordBatch.from_arrays([pa.array([n]), pa.array([mean]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *packed], names=["n_docs", "mean", "ids", *_PARTS])

    kind = source.schema["doc"].dataType.simpleString()
    return written(source.transform(mapped, run, f"n_docs long, mean double, ids array<{kind}>, " + ", ".join(f"{c} binary" for c in _PARTS)), "index", LARGE_ROWS)


class Shard:
    """Impact-ordered index of some documents; read counts the postings that queries have read."""

    def __init__(self, arrays: dict[str, np.ndarray], mean: float):
        self.__dict__.update(arrays)
        self.n_docs, self.mean, self.read = len(arrays["length"]), mean, 0

    def search(self, words: np.ndarray, idf: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, exact scores): everything that can be among the k best."""
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1) if len(self.words) else np.zeros(0, np.int64)
        held = self.words[at] == words if len(at) else np.zeros(0, bool)
        at, idf = at[held], idf[: len(held)][held]
        total, seen = np.zeros(self.n_docs), np.zeros(self.n_docs, dtype=bool)
        counts = self.word_at[at + 1] - self.word_at[at] if len(at) else at
        term = np.repeat(np.arange(len(at)), counts)
        segment = np.repeat(self.word_at[at] - np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(at) else at, counts) + np.arange(len(term))
        impact = idf[term] * self.level[segment] * ((K1 + 1) / LEVELS)
        order = np.argsort(-impact, kind="stable")
        term, segment, impact = term[order], segment[order], impact[order]
        begin, size = self.segment_at[segment], self.segment_at[segment + 1] - self.segment_at[segment]
        reached = np.cumsum(size)
        done, goal = 0, FIRST_READ
        while done < len(segment):
            to = max(done + 1, int(np.searchsorted(reached, goal, side="right")))
            place, which = _ranges(begin[done:to], size[done:to])
            row = self.posting[place]
            total += np.bincount(row, weights=idf[term[done:to][which]] * tf_weight(self.tf[place], self.length[row], self.mean), minlength=self.n_docs)
            seen[row] = True
            self.read += len(row)
            done, goal = to, goal * 2
            if done < len(segment) and self.n_docs >= k:
                left, first = np.unique(term[done:], return_index=True)
                rest = float(impact[done:][first].sum())
                bound = float(np.partition(total, -k)[-k])
                if rest + SLACK < bound:
                    possible = np.flatnonzero(total + rest + SLACK >= bound)
                    if len(possible) <= FEW:
                        for t, a, n in zip(term[done:], begin[done:], size[done:]):
                            rows = self.posting[a : a + n]
                            x = np.minimum(np.searchsorted(rows, possible), n - 1)
                            hit = rows[x] == possible
                            total[possible[hit]] += idf[t] * tf_weight(self.tf[a + x[hit]], self.length[possible[hit]], self.mean)
                        return possible, total[possible]
        rows = np.flatnonzero(seen)
        return rows, total[rows]


SLACK = 2e-6


def _ranges(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(all numbers of the ranges, the range that each is of)."""
    which = np.repeat(np.arange(len(size)), size)
    return (begin - np.concatenate([[0], np.cumsum(size)[:-1]]))[which] + np.arange(len(which)), which


def document_frequencies(index: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """How many documents of the index hold each word of the vocabulary; reads only the words' places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = np.zeros(len(vocabulary), dtype=np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                words, word_at, segment_at = (np.frombuffer(row[c], _PARTS[c]) for c in ("words", "word_at", "segment_at"))
                if len(words):
                    at = np.minimum(np.searchsorted(words, vocabulary), len(words) - 1)
                    frequency += np.where(words[at] == vocabulary, segment_at[word_at[at + 1]] - segment_at[word_at[at]], 0)
        at = np.flatnonzero(frequency)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(frequency[at])], names=["term", "n"])

    got = index.select("words", "word_at", "segment_at").transform(mapped, run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(vocabulary), dtype=np.int64)
    out[got["term"].to_numpy()] = got["n"].to_numpy()
    return out


def _search_block(index: DataFrame, ids: pa.Array, vocabulary: np.ndarray, sets: list[np.ndarray], n: int, query_type: T.DataType, k: int) -> DataFrame:
    idf = np.array([math.log(1 + (n - f + 0.5) / (f + 0.5)) for f in document_frequencies(index, vocabulary).tolist()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                key = batch.column("ids").slice(i, 1).flatten()
                shard = Shard({c: np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in _PARTS.items()}, batch.column("mean")[i].as_py())
                place = np.empty(len(key), dtype=np.int64)
                place[pc.sort_indices(pa.table({"k": key}), sort_keys=[("k", "ascending")], null_placement="at_end").to_numpy()] = np.arange(len(key))
                query, doc, score = [], [], []
                for q, terms in enumerate(sets):
                    if len(terms):
                        rows, s = shard.search(vocabulary[terms], idf[terms], k)
                        s = np.round(s, 6)
                        best = np.lexsort((place[rows], -s))[:k]
                        best = best[s[best] > 0]
                        query.append(np.full(len(best), q))
                        doc.append(rows[best])
                        score.append(s[best])
                if query:
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.concatenate(query))), key.take(pa.array(np.concatenate(doc))), pa.array(np.concatenate(score))], names=["query", "doc", "score"])

    schema = T.StructType([T.StructField("query", query_type), T.StructField("doc", index.schema["ids"].dataType.elementType), T.StructField("score", T.DoubleType())])
    return index.select("mean", "ids", *_PARTS).transform(mapped, run, schema)


def search_index(index: DataFrame, queries: DataFrame, k: int = TOP, key: str = "doc_id", query_text: str = "text", query_key: str = "item_id") -> DataFrame:
    """query_key, rank (from 1), key, score: the k best documents of every query."""
    head = index.select("n_docs").first()
    kind = queries.schema[query_key].dataType
    blocks = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    found = None
    for block in range(blocks if head else 0):
        ids, vocabulary, sets = query_words(queries, query_text, query_key, block, blocks)
        if len(vocabulary):
            best = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc").asc_nulls_last())
            part = _search_block(index, ids, vocabulary, sets, head[0], kind, k).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            part = written(part, "found") if blocks > 1 else part
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = index.sparkSession.createDataFrame([], T.StructType([T.StructField("query", kind), T.StructField("doc", index.schema["ids"].dataType.elementType), T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())]))
    return found.select(F.col("query").alias(query_key), "rank", F.col("doc").alias(key), "score")


def search(docs: DataFrame, queries: DataFrame, k: int = TOP, text: str = "text", key: str = "doc_id", query_text: str = "text", query_key: str = "item_id") -> DataFrame:
    """query_key, rank (from 1), key, score: the k best documents of every query, over an index made for them."""
    return search_index(build_index(docs, text, key), queries, k, key, query_text, query_key)


def query(spark, sf_dir: str) -> DataFrame:
    """The ten documents that match each benchmark text best."""
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_SPLIT = r"[0-9a-z_\x{80}-\x{10FFFF}]+"
SQL = f"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{_SPLIT}')) AS word FROM documents),
tf AS (SELECT doc_id, word, count(*) AS tf FROM words GROUP BY doc_id, word),
dl AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY doc_id),
corpus AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(dl) FROM dl) / (SELECT count(*) FROM documents) AS mean),
df AS (SELECT word, count(*) AS df FROM tf GROUP BY word),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '{_SPLIT}')) AS word FROM benchmark),
scored AS (
  SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * {K1 + 1}) / (tf + {K1} * (1 - {B} + {B} * dl / mean))), 6) AS score
  FROM q JOIN tf USING (word) JOIN df USING (word) JOIN dl USING (doc_id), corpus GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, CAST(score AS DOUBLE) AS score FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= {TOP}"""
