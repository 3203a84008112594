"""Toxicity by lexicon induction on a word graph.

1. The documents that hold each word are counted. Words that at least ``LEAST_DOCUMENTS`` hold form
   the vocabulary, however large the corpus; it stays in a table, and only seeds and words of the graph
   reach the driver.
2. Seeds are labelled terms: words that in a bounded sample of labelled documents stand for toxic ones
   with confidence (lower Wilson bound, near-copies counted once); the opposite seeds are the words that
   most surely stand for clean ones.
3. The word graph joins words by positive pointwise mutual information of occurring in one document.
   It spans the seeds and every word that goes with them, or with words that do, at any number of steps,
   more than chance and noise explain, unless the labelled documents show it to be no more toxic than
   documents are at large.
4. Random walks over the graph between a word and the seeds of either kind give its polarity, from -1
   to 1; polarity times confidence is its weight. Confidence is the share (lower Wilson bound) of a word's
   documents that hold a bad seed, or a word reached before, at that word's confidence; where labelled
   documents hold the word, no more than they give it. It falls from step to step, and words at which it
   is too low for the lexicon lead no further.
5. A document scores the sum of the weights of its distinct lexicon words. The threshold is the one
   that does best (F1) on the labelled sample.

All counts are made over all whole documents. Only the labelled sample is bounded (``LABELLED``), by
a hash of the id, so that it is the same in every run.

Ids may be of any type that has an order. Nulls: a null or empty text scores 0 and is not toxic. A null id or label is not used for training.
Repeated rows each count. Without labels, or where no word is a seed, the lexicon is empty and nothing
is toxic. Very long texts score as any other: the sum runs over distinct words. Ties among thresholds
go to the higher one. Columns of df other than key and text are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadloom.llm.arrowtext import mapped, span_hash, word_slices
from quadloom.llm.minhash import signatures
from quadloom.llm.storage import drop_written, written

LABELLED = 50_000
LEAST_DOCUMENTS = 3
SEED_BOUND = 0.6
STEPS = 50
LEAST_WEIGHT = 0.05
#: Words, or pairs, that a task sums up before it sends them on.
HELD = 1 << 18


def labelled_sample(labels: DataFrame, label: str, kind: T.DataType, key: str = "doc_id", most: int = LABELLED) -> tuple[pa.Array, np.ndarray]:
    """(ids in order, labels) of at most ``most`` labelled rows, those with the smallest hashes of the id; an id that is labelled both ways counts as 1.

    kind: the type of the documents' ids; ids of labels that can't be of it are those of no document.
    """
    typed = F.col(key) if labels.schema[key].dataType == kind else F.col(key).try_cast(kind)
    rows = labels.select(typed.alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y is not null")
    chosen = rows.groupBy("k").agg(F.max("y").alias("y")).orderBy(F.xxhash64("k"), "k").limit(most)
    got = chosen.orderBy("k").toArrow()
    return got["k"].combine_chunks(), got["y"].to_numpy()


def _word_sets(column: pa.Array, vocabulary: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, row of each distinct word, word hash or place in the vocabulary)."""
    for i, j, data, s, e, first in word_slices(column):
        h = span_hash(data, s, e)
        row = np.repeat(np.arange(j - i), np.diff(first))
        if vocabulary is not None:
            if not len(vocabulary):
                continue
            held, at = _places(h, vocabulary)
            pair = np.unique(row[held] * len(vocabulary) + at)
            yield i, j, pair // len(vocabulary), pair % len(vocabulary)
        else:
            row, place, values = _distinct(row, h)
            yield i, j, row, values[place]


def _places(h: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of h the sorted vocabulary holds, their places in it); most others fall out by their first bits, without a search."""
    first = np.zeros(1 << 20, dtype=bool)
    first[vocabulary >> np.uint64(44)] = True
    held = np.flatnonzero(first[h >> np.uint64(44)])
    at = np.minimum(np.searchsorted(vocabulary, h[held]), len(vocabulary) - 1)
    hit = vocabulary[at] == h[held]
    return held[hit], at[hit]


def _distinct(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place of its word) of the distinct pairs, by rows, and the words; numbering words first leaves one array of plain numbers to sort."""
    coded = pc.dictionary_encode(pa.array(h))
    values = coded.dictionary.to_numpy()
    pair = np.sort(row * len(values) + coded.indices.to_numpy())
    pair = pair[np.append(True, pair[1:] != pair[:-1])[: len(pair)]]
    row = pair // max(len(values), 1)
    return row, pair - row * len(values), values


def word_counts(source: DataFrame) -> DataFrame:
    """word (hash), n: documents of source(key, text) that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, waiting, held = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0
        for batch in batches:
            for _, _, _, h in _word_sets(batch.column("text")):
                waiting.append(h)
                held += len(h)
                if held > HELD:
                    words, counts = _added(words, counts, waiting)
                    waiting, held = [], 0
                    if len(words) > HELD:
                        yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], names=["word", "n"])
                        words, counts = words[:0], counts[:0]
        words, counts = _added(words, counts, waiting)
        yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], names=["word", "n"])

    return source.select("text").transform(mapped, run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def labelled_texts(source: DataFrame, ids: pa.Array, y: np.ndarray) -> DataFrame:
    """key, text, y of the labelled sample's documents; the sample is bounded, so it can be broadcast."""
    sample = source.sparkSession.createDataFrame(pa.table({"key": ids, "y": pa.array(y, pa.int32())}))
    return source.join(F.broadcast(sample), "key").select("key", "text", "y")


def independent(source: DataFrame, ids: pa.Array, y: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The labelled sample with one of each set of near-copies, the one of the smallest id.

    A document that was copied and labelled many times says no more about its words than once. Copies are
    those that share a MinHash table key; the sample's bound keeps this small enough for the driver.
    """
    labelled = labelled_texts(source, ids, y)
    got = signatures(labelled.select(F.col("key").alias("doc"), "text")).groupBy("doc").agg(F.min("keys").alias("keys")).orderBy("doc").toArrow()
    doc = got["doc"].combine_chunks()
    if not len(doc):
        return ids[:0], y[:0]
    keys = np.asarray(got["keys"].combine_chunks().flatten()).view(np.uint64).reshape(len(doc), -1)
    half = keys.shape[1] // 2
    group = np.arange(len(doc))
    while True:
        before = group.copy()
        for i in range(half):
            for j in range(half, 2 * half):
                order = np.lexsort((group, keys[:, j], keys[:, i]))
                new = np.ones(len(doc), dtype=bool)
                same = (keys[order[1:], i] == keys[order[:-1], i]) & (keys[order[1:], j] == keys[order[:-1], j])
                new[1:] = ~same
                if same.any():
                    least = group[order][np.flatnonzero(new)][np.cumsum(new) - 1]
                    np.minimum.at(group, group[order], least)
                    group = group[group]
        if (group == before).all():
            break
    kept = doc.take(pa.array(np.flatnonzero(group == np.arange(len(doc)))))
    return kept, y[pc.index_in(kept.cast(ids.type), ids).to_numpy(zero_copy_only=False)]


def evidence(labelled: DataFrame) -> DataFrame:
    """word, toxic, clean: how many toxic, and how many clean texts of labelled(text, y) hold each word."""
    toxic = word_counts(labelled.where("y = 1")).select("word", F.col("n").alias("toxic"), F.lit(0).cast("long").alias("clean"))
    clean = word_counts(labelled.where("y <> 1")).select("word", F.lit(0).cast("long").alias("toxic"), F.col("n").alias("clean"))
    return toxic.unionByName(clean).groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def wilson(hits: np.ndarray, n: np.ndarray, z: float = 1.96) -> np.ndarray:
    """Lower bound of a share."""
    n = np.maximum(n, 1e-9)
    p = hits / n
    return (p + z * z / (2 * n) - z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def _wilson(hits: Column, n: Column, z: float = 1.96) -> Column:
    """wilson() of columns."""
    p = F.least(hits / n, F.lit(1.0))
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def _more_with_any(source: DataFrame, reached: np.ndarray, before: np.ndarray, now: np.ndarray) -> DataFrame:
    """word, n: by how much the documents that hold one of reached (sorted hashes) count more than they did, summed up for each word that they hold; for all of them together where word is null.

    A document counts as much as the highest confidence, in thousandths, of the reached words in it. before: the
    confidences as they were, 0 for words that are new; documents that hold no new word are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, words, counts = 0, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        waiting, weights, size = [], [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            both, back = np.unique(np.concatenate([words, *waiting]), return_inverse=True)
            return both, np.bincount(back, weights=np.concatenate([counts, *weights]), minlength=len(both)).astype(np.int64)

        for batch in batches:
            for i, j, data, s, e, first in word_slices(batch.column("text")):
                h, row = span_hash(data, s, e), np.repeat(np.arange(j - i), np.diff(first))
                held, at = _places(h, reached)
                old, new = np.zeros(j - i, dtype=np.int64), np.zeros(j - i, dtype=np.int64)
                np.maximum.at(old, row[held], before[at])
                np.maximum.at(new, row[held], now[at])
                more = new - old
                total += int(more.sum())
                # Only the words of documents that hold a new one are made distinct.
                live = more[row] > 0
                row, place, values = _distinct(row[live], h[live])
                waiting.append(values)
                weights.append(np.bincount(place, weights=more[row], minlength=len(values)).astype(np.int64))
                size += len(waiting[-1])
                if size > HELD:
                    words, counts = merged()
                    waiting, weights, size = [], [], 0
                    if len(words) > HELD:
                        yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], names=["word", "n"])
                        words, counts = words[:0], counts[:0]
        words, counts = merged()
        yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], names=["word", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([total])], names=["word", "n"])

    return source.select("text").transform(mapped, run, "word long, n long")


def _chance(a: np.ndarray, b: np.ndarray, m: np.ndarray, n_docs: int) -> np.ndarray:
    """Documents that would hold both a and b by chance; m: those that hold each word."""
    return m[a] * m[b] / n_docs


def _pair_counts(source: DataFrame, vocabulary: np.ndarray, m: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, n), a < b: documents that hold both words, for all pairs that more do than chance and noise explain."""
    size = len(vocabulary)

    def pairs(row: np.ndarray, word: np.ndarray) -> Iterator[np.ndarray]:
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(row)))
        # Rows of equally many words make one array of pairs.
        for m in np.unique(count[count > 1]):
            block = word[first[count == m][:, None] + np.arange(m)[None, :]]
            if m > 1000:
                yield from (one[k] * size + one[k + 1 :] for one in block for k in range(m - 1))
                continue
            x, y = np.triu_indices(m, 1)
            step = max(1, (1 << 19) // len(x))
            for k in range(0, len(block), step):
                yield (block[k : k + step][:, x] * size + block[k : k + step][:, y]).ravel()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, counts, waiting, held = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
        for batch in batches:
            for _, _, row, word in _word_sets(batch.column("text"), vocabulary):
                for cell in pairs(row, word):
                    waiting.append(cell)
                    held += len(cell)
                    if held > 2 * HELD:
                        cells, counts = _added(cells, counts, waiting)
                        waiting, held = [], 0
                        if len(cells) > 2 * HELD:
                            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(counts)], names=["cell", "n"])
                            cells, counts = cells[:0], counts[:0]
        cells, counts = _added(cells, counts, waiting)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(counts)], names=["cell", "n"])

    def real(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, n = batch.column("cell").to_numpy(), batch.column("n").to_numpy()
            chance = _chance(cell // size, cell % size, m, n_docs)
            yield batch.filter(pa.array((n > chance) & (n > chance + 3 * np.sqrt(chance))))

    counted = source.select("text").transform(mapped, run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_DOCUMENTS)
    got = counted.transform(mapped, real, "cell long, n long").toArrow()
    cell, n = got["cell"].to_numpy(), got["n"].to_numpy()
    order = np.argsort(cell)
    return cell[order] // size, cell[order] % size, n[order]


def _added(cells: np.ndarray, counts: np.ndarray, more: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not more:
        return cells, counts
    new, n = np.unique(np.concatenate(more), return_counts=True)
    every = np.concatenate([cells, new])
    both, at = np.unique(every, return_inverse=True)
    return both, np.bincount(at, weights=np.concatenate([counts, n]), minlength=len(both)).astype(np.int64)


def walk(a: np.ndarray, b: np.ndarray, weight: np.ndarray, bad: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Polarity of each word: how much likelier a random walk from it over the edges a - b ends at a bad seed than at a good one.

    The graph is undirected, so this is as likely as the walks from the seeds to the word. Seeds are where
    walks end; their polarity is 1 and -1. A word that no walk leads from to a seed has 0.
    """
    size = len(bad)
    x, y, w = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([weight, weight])
    step = w / np.maximum(np.bincount(x, weights=w, minlength=size)[x], 1e-12)
    fixed = bad.astype(float) - good.astype(float)
    seed = bad | good
    p = fixed.copy()
    for _ in range(STEPS):
        p = np.where(seed, fixed, np.bincount(x, weights=step * p[y], minlength=size))
    return p


def induce(source: DataFrame, ids: pa.Array, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted word hashes, weights) of the lexicon; source: key, text."""
    empty = np.zeros(0, np.uint64), np.zeros(0)
    if not (y == 1).any():
        return empty
    n_docs = source.count()
    counts = written(word_counts(source).where(F.col("n") >= LEAST_DOCUMENTS), "words")
    sides = evidence(written(labelled_texts(source, ids, y), "labelled"))
    seen = F.col("toxic") + F.col("clean")
    known = written(counts.join(sides, "word").withColumn("bound", _wilson(F.col("toxic"), seen)), "known")
    seeds = known.where(F.col("bound") >= SEED_BOUND).toArrow()
    if not seeds.num_rows:
        return empty
    best = known.orderBy(F.desc(_wilson(F.col("clean"), seen)), F.desc("n"), "word").limit(max(seeds.num_rows, 8)).toArrow()
    # n: documents that hold each member; sure: confidence in it.
    bad, good = (x["word"].to_numpy().view(np.uint64) for x in (seeds, best))
    new = ~np.isin(good, bad)
    good = good[new]
    members, n, sure = (np.concatenate([seeds[c].to_numpy(), best[c].to_numpy()[new]]) for c in ("word", "n", "bound"))
    members = members.view(np.uint64)
    reached, before, confidence = bad, np.zeros(len(bad), np.int64), np.full(len(bad), 1000)
    held = None
    # Words that labelled documents show to be no more toxic than documents are at large can get no weight.
    suspect = F.col("bound").isNull() | (F.col("bound") > float((y == 1).mean()))
    while True:
        order = np.argsort(reached)
        more = _more_with_any(source, reached[order], before[order], confidence[order])
        held, last = written((more if held is None else held.unionByName(more)).groupBy("word").agg(F.sum("n").alias("n")), "held"), held
        if last is not None:
            drop_written(last)
        mass = (held.where("word is null").first() or [None, 0])[1] / 1000
        with_any = held.where("word is not null").select("word", (F.col("n") / 1000).alias("held"))
        expected = F.col("n") * (mass / n_docs)
        tied = (F.col("held") >= LEAST_DOCUMENTS) & (F.col("held") - expected > 3 * F.sqrt(F.greatest(expected, F.lit(1.0)))) & (F.col("held") >= 2 * expected)
        found = with_any.join(counts, "word").where(tied).join(known.select("word", "bound"), "word", "left").where(suspect)
        got = found.select("word", "n", F.least("bound", _wilson(F.col("held"), F.col("n"))).alias("sure")).where(F.col("sure") > LEAST_WEIGHT).toArrow()
        word = got["word"].to_numpy().view(np.uint64)
        new = ~np.isin(word, members)
        if not new.any():
            break
        members, n, sure = np.concatenate([members, word[new]]), np.concatenate([n, got["n"].to_numpy()[new]]), np.concatenate([sure, got["sure"].to_numpy()[new]])
        reached, before = np.concatenate([reached, word[new]]), np.concatenate([confidence, np.zeros(int(new.sum()), np.int64)])
        confidence = np.concatenate([confidence, np.round(got["sure"].to_numpy()[new] * 1000).astype(np.int64)])
    order = np.argsort(members)
    members, m, sure = members[order], n[order].astype(np.float64), sure[order]
    a, b, together = _pair_counts(source, members, m, n_docs)
    polarity = walk(a, b, np.log(together / _chance(a, b, m, n_docs)), np.isin(members, bad), np.isin(members, good))
    weight = np.round(polarity * sure, 9)
    keep = np.flatnonzero(weight > LEAST_WEIGHT)
    return members[keep], weight[keep]


def _scored(source: DataFrame, lexicon: np.ndarray, weights: np.ndarray, columns: list[str], threshold: float | None) -> DataFrame:
    """Rows of source with n_terms, score and, where there is a threshold, toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, score = np.zeros(batch.num_rows, dtype=np.int32), np.zeros(batch.num_rows)
            for i, j, row, word in _word_sets(batch.column("text"), lexicon):
                terms[i:j] = np.bincount(row, minlength=j - i)
                score[i:j] = np.round(np.bincount(row, weights=weights[word], minlength=j - i), 9)
            out = [*(batch.column(c) for c in columns), pa.array(terms), pa.array(score)]
            yield pa.RecordBatch.from_arrays(out if threshold is None else [*out, pa.array(score >= threshold)], names=schema.names)

    fields = [*(source.schema[c] for c in columns), T.StructField("n_terms", T.IntegerType()), T.StructField("score", T.DoubleType())]
    schema = T.StructType(fields if threshold is None else [*fields, T.StructField("toxic", T.BooleanType())])
    return source.transform(mapped, run, schema)


def calibrate(source: DataFrame, ids: pa.Array, y: np.ndarray, lexicon: np.ndarray, weights: np.ndarray) -> float:
    """Threshold of the best F1 on the labelled sample; infinite where nothing can be told."""
    if not len(lexicon) or not (y == 1).any():
        return float("inf")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.zeros(batch.num_rows)
            for i, j, row, word in _word_sets(batch.column("text"), lexicon):
                score[i:j] = np.round(np.bincount(row, weights=weights[word], minlength=j - i), 9)
            yield pa.RecordBatch.from_arrays([pa.array(score), batch.column("y")], names=["score", "y"])

    scored = labelled_texts(source, ids, y).transform(mapped, run, "score double, y int")
    got = scored.groupBy("score").agg(F.sum("y").alias("bad"), F.count("*").alias("n")).orderBy(F.desc("score")).toArrow()
    score, bad, n = (got[c].to_numpy().astype(np.float64) for c in ("score", "bad", "n"))
    hits, called = np.cumsum(bad), np.cumsum(n)
    f1 = np.where(score > 0, 2 * hits / (called + bad.sum()), -1)
    return float(score[int(np.argmax(f1))]) if len(f1) and f1.max() > 0 else float("inf")


def fit(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> tuple[np.ndarray, np.ndarray, float]:
    """(word hashes, weights, threshold)."""
    source = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    ids, y = labelled_sample(labels, label, source.schema["key"].dataType)
    if len(ids):
        ids, y = independent(source, ids, y)
    lexicon, weights = induce(source, ids, y)
    return lexicon, weights, calibrate(source, ids, y, lexicon, weights)


def score(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """key, n_terms, score, toxic for every row of df."""
    lexicon, weights, threshold = fit(df, labels, text, key, label)
    source = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return _scored(source, lexicon, weights, ["key"], threshold).withColumnRenamed("key", key)


def drop_toxic(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """df without the rows found toxic."""
    lexicon, weights, threshold = fit(df, labels, text, key, label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.zeros(batch.num_rows)
            for i, j, row, word in _word_sets(batch.column(at).cast(pa.string()), lexicon):
                total[i:j] = np.round(np.bincount(row, weights=weights[word], minlength=j - i), 9)
            yield batch.filter(pa.array(total < threshold))

    at = df.columns.index(text)
    return df.transform(mapped, run, df.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
