"""Bloom filters over ids, to spare rows a shuffle that an exact join would then drop anyway.

A filter takes at most ``MOST_BITS``, however many ids there are: it gets less selective as they grow, from
``BITS`` bits an id downwards, and lets more rows through. Results never depend on it: whatever passes is
joined exactly. Ids may be of any type; a filter holds their 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.llm.arrowtext import mapped, mix

#: The largest filter, 32 MB.
MOST_BITS = 1 << 28
BITS = 16


class Bloom:
    def __init__(self, words: np.ndarray, probes: int):
        self.words, self.probes = words, probes

    def may_hold(self, hashes: pa.Array) -> np.ndarray:
        """False only for hashes that are certainly not in it."""
        where = _positions(hashes.to_numpy(zero_copy_only=False), len(self.words), self.probes)
        return ((self.words[where >> np.uint64(6)] >> (where & np.uint64(63))) & np.uint64(1)).all(axis=1)


def _positions(hashes: np.ndarray, n_words: int, probes: int) -> np.ndarray:
    h = hashes.view(np.uint64)[:, None] + np.arange(1, probes + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    return mix(mix(h)) % np.uint64(n_words * 64)


def build(ids: DataFrame, hashed: bool = False) -> Bloom:
    """A filter of the ids in the first column of ids; null is an id like any other. hashed: they are 64-bit hashes already."""
    ids = ids.select((F.col(ids.columns[0]) if hashed else F.xxhash64(ids.columns[0])).alias("id"))
    n = max(1, ids.count())
    n_words = max(1, min(n * BITS, MOST_BITS) // 64)
    probes = int(np.clip(round(n_words * 64 / n * 0.5), 1, 4))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = np.unique(_positions(batch.column(0).to_numpy(), n_words, probes).ravel())
            if len(where):
                word, bit = (where >> np.uint64(6)).astype(np.int64), np.uint64(1) << (where & np.uint64(63))
                at = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
                yield pa.RecordBatch.from_arrays([pa.array(word[at]), pa.array(np.bitwise_or.reduceat(bit, at).view(np.int64))], names=["word", "bits"])

    got = ids.transform(mapped, run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(n_words, dtype=np.uint64)
    words[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return Bloom(words, probes)


def split(df: DataFrame, key: Column, bloom: Bloom) -> tuple[DataFrame, DataFrame]:
    """(rows of df whose key the filter may hold, the others); the two make up df. df has no column _hash."""

    def part(held: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.num_columns - 1
                yield batch.filter(pa.array(bloom.may_hold(batch.column(at)) == held)).select(range(at))

        return df.withColumn("_hash", F.xxhash64(key)).transform(mapped, run, df.schema)

    return part(True), part(False)
