"""Vectorised text primitives over Arrow string columns.

Everything here works on the raw UTF-8 buffer of a column, in slices bounded by bytes, so that no
Python object is made per word and memory does not depend on how many rows an Arrow batch holds.
A word is a maximal run of ASCII letters, digits, ``_`` or any non-ASCII byte of lower-cased text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SLICE_BYTES = 1 << 20

_WORD = np.zeros(256, dtype=bool)
_WORD[128:] = True
for _lo, _hi in (("0", "9"), ("a", "z"), ("A", "Z"), ("_", "_")):
    _WORD[ord(_lo) : ord(_hi) + 1] = True

_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes; a longer row is a range of its own, never cut."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pow(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE_BYTES + 1), base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= SLICE_BYTES + 1:
            _powers[base] = have
    return have


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each data[start:end], in a constant number of passes over the bytes."""
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _pow(_BASE, n + 1)[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _pow(_INV, n + 1)[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): word spans of the rows of one slice; row i has words first[i]:first[i+1]."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    w = _WORD[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], after[-1] = False, False
    before[1:], after[:-1] = w[:-1], w[1:]
    starts = np.flatnonzero(w & (~before | cut[:n]))
    ends = np.flatnonzero(w & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lowered(column: pa.Array) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.utf8_lower(pc.fill_null(column, "") if column.null_count else column)


def word_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, data, starts, ends, first word of each row) of the lower-cased column."""
    data, off = raw(lowered(column))
    for i, j in slices(off, most):
        part, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
        yield (i, j, part, *words(part, o))


def distinct_in_rows(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, their counts and the new row bounds; first: bounds in values."""
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((values, rows))
    v, r = values[order], rows[order]
    new = np.ones(len(v), dtype=bool)
    if len(v):
        new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(v)))
    return v[at], counts, np.searchsorted(r[at], np.arange(len(first)))


def list_array(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values, type=kind))


BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """df.mapInArrow in batches that are bounded in bytes, since texts differ in length by orders of magnitude.

    The session's batch settings are set to BATCH unless its creator has set them. Workers are reused, so each
    task gives the memory it freed back to the system as it ends.
    """
    spark = df.sparkSession
    given = spark.sparkContext.getConf()
    for k, v in BATCH.items():
        if not given.contains(k):
            spark.conf.set(k, v)

    def thrifty(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return df.mapInArrow(thrifty, schema)


def release() -> None:
    """Drops what is cheap to make again and returns freed memory to the system; glibc and Arrow keep it otherwise."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return
