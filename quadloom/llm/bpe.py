"""BPE encoding and decoding by forced-boundary splitting.

Every merge result is a vocabulary token, so a byte pair that occurs inside no token can never be
joined: between two such bytes the encoding is certain to break, whatever surrounds them. Texts are
cut there, each fragment is encoded on its own, and the ids are concatenated. Equal fragments are
encoded once per worker as long as its bounded cache holds them.

A vocabulary that comes with a pre-splitting pattern adds breaks of its own. The first level of cuts
is then taken only where the pattern is certain to break too (known for DEFAULT_PATTERN; with another
pattern a whole text is one fragment of the first level); a fragment met for the first time is run through the
pattern, and each piece of a long fragment is cut again at all its forced boundaries. The ids equal those of the whole
text given to the tokenizer at once.

Nulls: a null text gives null ids. An empty text gives an empty list. Repeated rows are encoded once
per row. Other columns are kept only where named in ``keep``. Text of any length is encoded whole.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadloom.llm.arrowtext import list_array, mapped, raw, slices

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
DEFAULT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What a worker keeps of fragments it has encoded; no result depends on it.
CACHED_FRAGMENTS = 1 << 16
CACHED_IDS = 1 << 18
CACHED_BYTES = 64
SLICE_IDS = 1 << 18


def _pattern_breaks() -> np.ndarray:
    """Byte pairs between which DEFAULT_PATTERN always ends a piece, whatever surrounds them.

    ASCII only: before white space that follows anything else; between letters, digits and marks,
    but not after an apostrophe, which may open a contraction.
    """
    kind = np.zeros(256, dtype=np.int8)  # 0: unknown
    for chars, k in (("\t\n\v\f\r ", 1), ("0123456789", 3), ("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", 4), ("'", 5)):
        kind[[ord(c) for c in chars]] = k
    kind[ord("a") : ord("z") + 1] = kind[ord("A") : ord("Z") + 1] = 2
    a, b = kind[:, None], kind[None, :]
    solid = (a >= 2) & (b >= 1)
    return solid & ((b == 1) | ((a == 2) & (b >= 3)) | ((a == 3) & ((b == 2) | (b >= 4))) | ((a == 4) & ((b == 2) | (b == 3))))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class _Fragments(dict):
    """Fragment -> row of the id table; what is missing gets encoded.

    Ids are kept as numbers in one array. Fragments of at most CACHED_BYTES stay, up to CACHED_FRAGMENTS of them and
    CACHED_IDS ids; longer ones get a negative row in a table of their own, which holds one slice's.
    """

    def __init__(self, encode):
        super().__init__()
        self.encode = encode
        self.flat, self.ends = array("i"), array("q", [0])
        self.once()

    def once(self) -> None:
        self.long, self.long_ends = array("i"), array("q", [0])

    def full(self) -> bool:
        return len(self) >= CACHED_FRAGMENTS or len(self.flat) >= CACHED_IDS

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows in one array, and each row's bounds; long fragments' after the others."""
        flat = np.concatenate([np.frombuffer(self.flat, np.int32), np.frombuffer(self.long, np.int32)])
        ends = np.concatenate([np.frombuffer(self.ends, np.int64), len(self.flat) + np.frombuffer(self.long_ends, np.int64)[1:]])
        return flat, ends

    def __missing__(self, fragment: bytes) -> int:
        ids = self.encode(fragment)
        if len(fragment) > CACHED_BYTES:
            self.long.extend(ids)
            self.long_ends.append(len(self.long))
            return 1 - len(self.long_ends)
        self.flat.extend(ids)
        self.ends.append(len(self.flat))
        at = self[fragment] = len(self.ends) - 2
        return at


class ForcedBoundaryBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str | None):
        import tiktoken

        self.ranks = ranks
        self.pattern = regex.compile(pattern) if pattern else None
        self.core = tiktoken.Encoding("own", pat_str=pattern or r"(?s).+", mergeable_ranks=ranks, special_tokens={})
        seen = np.zeros((256, 256), dtype=bool)
        for token in ranks:
            b = np.frombuffer(token, dtype=np.uint8)
            seen[b[:-1], b[1:]] = True
        self.forced = ~seen
        self.first_level = self.forced if pattern is None else self.forced & _pattern_breaks() if pattern == DEFAULT_PATTERN else np.zeros_like(seen)
        self.plain = pattern == DEFAULT_PATTERN
        size = max(ranks.values()) + 1
        table = [b""] * size
        for token, rank in ranks.items():
            table[rank] = token
        self.lengths = np.array([len(t) for t in table], dtype=np.int64)
        self.places = np.concatenate([[0], np.cumsum(self.lengths)])
        self.bytes = np.frombuffer(b"".join(table), dtype=np.uint8)
        self.forget()

    def forget(self) -> None:
        """Drops the encoded fragments; workers outlive their tasks and would keep them."""
        self.fragments = _Fragments(self.encode_fragment)

    def cuts(self, data: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Positions before which a cut is certain."""
        return np.flatnonzero(table[data[:-1], data[1:]]) + 1

    def encode_piece(self, piece: bytes) -> list[int]:
        rank = self.ranks.get(piece)
        if rank is not None:
            return [rank]
        at = [0, *self.cuts(np.frombuffer(piece, dtype=np.uint8), self.forced).tolist(), len(piece)]
        out: list[int] = []
        for a, b in zip(at, at[1:]):
            rank = self.ranks.get(piece[a:b])
            out += [rank] if rank is not None else self.core._core_bpe.encode_single_piece(piece[a:b])
        return out

    def encode_fragment(self, fragment: bytes) -> list[int]:
        if self.pattern is None:
            return self.encode_piece(fragment)
        if len(fragment) <= CACHED_BYTES:
            if self.plain and len(fragment) > 1:
                body = fragment[1:] if fragment[0] == 32 else fragment
                if body.isalpha() or ((word := body.decode("utf-8", "replace")).isalpha() and max(word) < "\u02b0"):
                    return self.core._core_bpe.encode_single_piece(fragment)
            return self.core._core_bpe.encode_ordinary(fragment.decode("utf-8", "replace"))
        out: list[int] = []
        for piece in self.pattern.findall(fragment.decode("utf-8", "replace")):
            out += self.encode_piece(piece.encode())
        return out

    def encode_rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds of each row's ids) of one slice of rows."""
        cut = np.zeros(len(data) + 1, dtype=bool)
        if len(data) > 1:
            cut[self.cuts(data, self.first_level)] = True
        cut[offsets] = True
        at = np.flatnonzero(cut)
        buffer, ends = data.tobytes(), at.tolist()
        cache = self.fragments
        rows = np.fromiter((cache[buffer[a:b]] for a, b in zip(ends, ends[1:])), dtype=np.int64, count=max(len(ends) - 1, 0))
        rows = np.where(rows < 0, len(cache.ends) - 2 - rows, rows)
        out, bounds = gather(*cache.table(), rows)
        cache.once()
        if cache.full():
            self.forget()
        return out, bounds[np.searchsorted(at, offsets)]

    def decode_rows(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, bounds of each id's bytes)."""
        return gather(self.bytes, self.places, ids)


def gather(flat: np.ndarray, base: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated flat[base[r]:base[r+1]] for r in rows, with bounds."""
    sizes = base[rows + 1] - base[rows]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    place = np.int32 if max(len(flat), int(bounds[-1])) < (1 << 31) else np.int64
    where = np.arange(bounds[-1], dtype=place)
    where += np.repeat((base[rows] - bounds[:-1]).astype(place), sizes)
    return flat[where], bounds


@lru_cache(maxsize=2)
def _codec(path: str, pattern: str | None) -> ForcedBoundaryBPE:
    return ForcedBoundaryBPE(load_ranks(path), pattern)


def encode(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), vocabulary: str = DEFAULT_VOCABULARY, pattern: str | None = DEFAULT_PATTERN) -> DataFrame:
    """keep + (token_ids array<int>, n_tokens int); one pass, no shuffle.

    ``vocabulary``: a rank file readable at this path on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary, pattern)
        for batch in batches:
            column = batch.column("text")
            data, off = raw(column)
            missing = np.asarray(column.is_null())
            for i, j in slices(off):
                ids, bounds = codec.encode_rows(data[off[i] : off[j]], off[i : j + 1] - off[i])
                null = pa.array(missing[i:j])
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids), mask=null) if missing[i:j].any() else list_array(ids, bounds, pa.int32())
                counts = pa.array(np.diff(bounds).astype(np.int32), mask=missing[i:j])
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(len(keep))), lists, counts], names=[*names, "token_ids", "n_tokens"])
        codec.forget()

    names = [f"k{i}" for i in range(len(keep))]
    source = df.select(*(F.col(c).alias(n) for c, n in zip(keep, names)), F.col(text).cast("string").alias("text"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("token_ids", T.ArrayType(T.IntegerType(), True)), T.StructField("n_tokens", T.IntegerType())])
    return source.transform(mapped, run, schema).toDF(*keep, "token_ids", "n_tokens")


def _text(codec: ForcedBoundaryBPE, ids: np.ndarray, rows: np.ndarray) -> pa.Array:
    """Strings of one slice of rows; rows: bounds of each row's ids."""
    out, bounds = codec.decode_rows(ids)
    return pa.LargeStringArray.from_buffers(len(rows) - 1, pa.py_buffer(bounds[rows].astype(np.int64)), pa.py_buffer(out.tobytes())).cast(pa.string())


def decode(df: DataFrame, token_ids: str = "token_ids", keep: tuple[str, ...] = ("doc_id",), vocabulary: str = DEFAULT_VOCABULARY, pattern: str | None = DEFAULT_PATTERN) -> DataFrame:
    """keep + text. Null ids give a null text; a null or unknown id within a list is an error of the data and raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary, pattern)
        for batch in batches:
            lists = batch.column("token_ids")
            ids = np.asarray(lists.flatten())
            sizes = pa.compute.fill_null(lists.value_lengths(), 0).to_numpy()
            rows = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
            missing = lists.is_null()
            for i, j in slices(rows, SLICE_IDS):
                text = _text(codec, ids[rows[i] : rows[j]].astype(np.int64), rows[i : j + 1] - rows[i])
                if lists.null_count:
                    text = pa.compute.if_else(missing.slice(i, j - i), pa.scalar(None, pa.string()), text)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(len(keep))), text], names=[*names, "text"])

    names = [f"k{i}" for i in range(len(keep))]
    source = df.select(*(F.col(c).alias(n) for c, n in zip(keep, names)), F.col(token_ids).alias("token_ids"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("text", T.StringType())])
    return source.transform(mapped, run, schema).toDF(*keep, "text")


def round_trip(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), vocabulary: str = DEFAULT_VOCABULARY, pattern: str | None = DEFAULT_PATTERN) -> DataFrame:
    """Encodes every text, decodes the ids again and says whether the text came back: keep + (token_ids, n_tokens, lossless).

    lossless is null for a null text. Both ways are taken in one pass, so that texts cross to Python once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary, pattern)
        for batch in batches:
            column = batch.column("text")
            data, off = raw(column)
            missing = np.asarray(column.is_null())
            for i, j in slices(off):
                ids, bounds = codec.encode_rows(data[off[i] : off[j]], off[i : j + 1] - off[i])
                same = pa.compute.equal(_text(codec, ids, bounds), column.slice(i, j - i).cast(pa.string()))
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids), mask=pa.array(missing[i:j])) if missing[i:j].any() else list_array(ids, bounds, pa.int32())
                kept = (batch.column(k).slice(i, j - i) for k in range(len(keep)))
                yield pa.RecordBatch.from_arrays([*kept, lists, pa.array(np.diff(bounds).astype(np.int32), mask=missing[i:j]), same], names=schema.names)
        codec.forget()

    source = df.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(text).cast("string").alias("text"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("token_ids", T.ArrayType(T.IntegerType(), True)), T.StructField("n_tokens", T.IntegerType()), T.StructField("lossless", T.BooleanType())])
    return source.transform(mapped, run, schema).toDF(*keep, "token_ids", "n_tokens", "lossless")


def query(spark, sf_dir: str) -> DataFrame:
    """Every text of documents encoded, decoded again and compared."""
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
