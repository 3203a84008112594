"""Text to chunks and triples."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadloom.functions.batches import texts_udf
from quadloom.functions.terms import BASE


#: White space characters of more than one byte, as UTF-8: leading bytes, and the last bytes that go with them.
_WIDE_SPACE = {b"\xc2": b"\x85\xa0", b"\xe1\x9a": b"\x80", b"\xe2\x80": bytes([*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF]), b"\xe2\x81": b"\x9f", b"\xe3\x80": b"\x80"}
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


def space_ends(data: np.ndarray) -> np.ndarray:
    """Places after each white space character of UTF-8 text."""
    end = _SPACE[data]
    if (data >= 0xC2).any():
        for lead, last in _WIDE_SPACE.items():
            hit = np.isin(data, np.frombuffer(last, np.uint8))
            for k, byte in enumerate(reversed(lead)):
                back = np.zeros(len(data), dtype=bool)
                back[k + 1 :] = data[: len(data) - k - 1] == byte
                hit &= back
            end |= hit
    return np.flatnonzero(end) + 1


def word_chunk_bounds(data: np.ndarray, size: int, overlap: int) -> list[tuple[int, int]]:
    """Byte ranges of the chunks of a text, white space around them included; see chunk_words().

    Texts are cut into pieces, a word with the white space character that ends it; a chunk is a run of pieces, and
    where it ends is looked up among the places where pieces end. So the work in Python is per chunk.
    """
    at = np.concatenate([[0], space_ends(data)])
    if at[-1] != len(data):
        at = np.append(at, len(data))
    n, begin, pushed = len(at) - 1, 0, 1
    out = []
    while n:
        end = max(pushed, int(np.searchsorted(at, at[begin] + size, side="right")) - 1)
        if end >= n:
            out.append((int(at[begin]), int(at[n])))
            return out
        out.append((int(at[begin]), int(at[end])))
        begin = max(begin, int(np.searchsorted(at, at[end] - overlap)))
        pushed = end + 1
    return out


def chunk_words(text: str | None, size: int = 1000, overlap: int = 150) -> list[str]:
    """Chunks of at most ``size`` UTF-8 bytes, cut at white space, each begun with the last words of the one before that fit ``overlap``.

    White space after a word stays with it; chunks are trimmed; a longer word is a chunk of its own, and so is a word that
    does not fit beside the overlap, together with it. Null and blank give none.
    """
    raw = (text or "").encode()
    chunks = (raw[a:b].decode().strip() for a, b in word_chunk_bounds(np.frombuffer(raw, np.uint8), size, overlap))
    return [c for c in chunks if c]


def chunk_chars(text: str | None, size: int = 500, overlap: int = 50) -> list[str]:
    """Chunks of at most ``size`` characters, cut after a sentence, line or clause end that lies past their middle."""
    out: list[str] = []
    at, text = 0, text or ""
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text):
            for mark in (". ", "\n", "; "):
                cut = text.rfind(mark, at, end)
                if cut > at + size // 2:
                    end = cut + len(mark)
                    break
        chunk = text[at:end].strip()
        if chunk:
            out.append(chunk)
        if end >= len(text):
            break
        at = max(end - overlap, at + 1)
    return out


def _chunker(function, size: int, overlap: int):
    return texts_udf(lambda s: pd.Series([function(x, size, overlap) for x in s], dtype=object), "array<string>")


def with_chunks(df: DataFrame, text: str, uri: Column, size: int = 1000, overlap: int = 150, kind: str = "doc_chunk", number_single: bool = False, by_chars: bool = False) -> DataFrame:
    """doc_uri, chunk_idx, chunk_uri, text, type: a row per chunk. A single chunk keeps its document's uri unless ``number_single``."""
    split = _chunker(chunk_chars if by_chars else chunk_words, size, overlap)
    each = df.select(uri.alias("doc_uri"), split(F.col(text)).alias("chunks")).select("doc_uri", F.size("chunks").alias("n"), F.posexplode("chunks").alias("chunk_idx", "text"))
    numbered = F.concat("doc_uri", F.lit("#chunk-"), F.col("chunk_idx").cast("string"))
    return each.select("doc_uri", "chunk_idx", numbered.alias("chunk_uri") if number_single else F.when(F.col("n") > 1, numbered).otherwise(F.col("doc_uri")).alias("chunk_uri"), "text", F.lit(kind).alias("type"))


def strip_html(c: Column) -> Column:
    """Scripts, styles and tags out, white space collapsed. Names of tags in lower case only; entities stay."""
    for pattern in (r"(?s)<script.*?</script>", r"(?s)<style.*?</style>", r"(?s)<[^>]*>"):
        c = F.regexp_replace(c, pattern, " ")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def html_lines(html: str | None, width: int = 120) -> str:
    """Text of a page, block by block, folded at ``width`` columns."""
    import textwrap
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.blocks, self.skip = [""], 0

        def handle_starttag(self, tag, attrs):
            if tag in ("script", "style"):
                self.skip += 1
            elif tag in ("p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "ul", "ol", "table"):
                self.blocks.append("* " if tag == "li" else "#" * int(tag[1]) + " " if tag[0] == "h" and tag[1:].isdigit() else "")

        def handle_endtag(self, tag):
            if tag in ("script", "style"):
                self.skip = max(0, self.skip - 1)
            elif tag in ("p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li"):
                self.blocks.append("")

        def handle_data(self, data):
            if not self.skip:
                self.blocks[-1] += data

    reader = Reader()
    reader.feed(html or "")
    lines = [" ".join(b.split()) for b in reader.blocks]
    return "\n\n".join(textwrap.fill(x, width) for x in lines if x.strip("# *"))


def render_html(c: Column | str) -> Column:
    return texts_udf(lambda s: s.map(html_lines), "string")(c)


def markdown_triples(df: DataFrame, text: str, uri: Column, base: str = BASE) -> DataFrame:
    """subject, predicate, object of the lines of each document; the first rule that fits a line wins.

    A header gives contains_section, with its text; a list item under a header gives that section has_list_item;
    ``key: value`` with both sides gives a property of the section, or of the document before any header. A header
    without text ends the section. All are plain expressions over a window of each document's lines.
    """
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    lines = df.select(uri.alias("doc"), F.posexplode(F.split(F.col(text), "\n")).alias("no", "line")).withColumn("line", strip(F.col("line")))
    lines = lines.withColumn("header", F.when(F.col("line").startswith("#"), strip(F.regexp_replace("line", "^#+", ""))))
    w = Window.partitionBy("doc").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    section = F.nullif(F.col("section"), F.lit(""))
    lines = lines.withColumn("section", F.last("header", ignorenulls=True).over(w)).withColumn("section", section)
    item = F.when(F.col("line").rlike(r"^[-*] "), strip(F.expr("substring(line, 3)")))
    at = F.instr("line", ":")
    name, value = strip(F.expr("substring(line, 1, instr(line, ':') - 1)")), strip(F.expr("substring(line, instr(line, ':') + 1)"))
    rules = [
        (F.col("header") != "", F.col("doc"), F.lit(base + "contains_section"), F.col("header")),
        (item.isNotNull() & (item != "") & F.col("section").isNotNull(), F.col("section"), F.lit(base + "has_list_item"), item),
        (item.isNull() & F.col("header").isNull() & (at > 1) & (name != "") & (value != ""), F.coalesce("section", "doc"), F.concat(F.lit(base + "property/"), F.replace(name, F.lit(" "), F.lit("_"))), value),
    ]
    triple = F.lit(None)
    for test, s, p, o in reversed(rules):
        triple = F.when(test, F.struct(s.alias("subject"), p.alias("predicate"), o.alias("object"))).otherwise(triple)
    return lines.select(triple.alias("t")).where("t is not null").select("t.*")


def keyword_triples(df: DataFrame, text: str, rules: dict[str, tuple[str, str, str]]) -> DataFrame:
    """The triple of every rule whose keyword a text holds, case ignored."""
    found = F.array_compact(F.array(*(F.when(F.contains(F.lower(F.col(text)), F.lit(k.lower())), F.struct(F.lit(s).alias("subject"), F.lit(p).alias("predicate"), F.lit(o).alias("object"))) for k, (s, p, o) in rules.items())))
    return df.select(F.explode(found).alias("t")).select("t.*")


def model_triples(c: Column) -> Column:
    """Array of (s, p, o) structs written in a model's answer, as (s, p, o) or ["s", "p", "o"]."""
    strip = lambda x: F.trim(F.regexp_replace(x, r"^[\s\"']+|[\s\"']+$", ""))
    pattern = r"[(\[]\s*([^,()\[\]]+),\s*([^,()\[\]]+),\s*([^()\[\]]+?)\s*[)\]]"
    parts = [F.regexp_extract_all(c, F.lit(pattern), F.lit(k)) for k in (1, 2, 3)]
    return F.transform(F.arrays_zip(*(p.alias(n) for p, n in zip(parts, "spo"))), lambda x: F.struct(strip(x["s"]).alias("subject"), strip(x["p"]).alias("predicate"), strip(x["o"]).alias("object")))


def row_text(df: DataFrame, columns: list[str], limit: int | None = None) -> Column:
    """``name: value`` of the columns that are not null or empty, joined by `` | ``."""
    text = F.concat_ws(" | ", *(F.when(F.col(x).isNotNull() & (F.col(x).cast("string") != ""), F.concat(F.lit(f"{x}: "), F.col(x).cast("string"))) for x in columns))
    return F.substring(text, 1, limit) if limit else text


HEADER_RULES = (("family", "belongsTo"), ("type", "isA"), ("height", "hasHeight"))


def header_predicate(header: str) -> str:
    """Predicate of a column: by a word in its name, else the name with underscores."""
    low = header.lower()
    return next((p for k, p in HEADER_RULES if k in low), "_".join(header.strip().split()))


def row_triples(df: DataFrame, header_rules: bool = True, first: str | None = None) -> DataFrame:
    """subject, predicate, object: the first column is the subject, every other non-empty one a triple."""
    first = first or df.columns[0]
    names = [x for x in df.columns if x != first]
    cells = F.array(*(F.struct(F.lit(header_predicate(x) if header_rules else x).alias("predicate"), F.col(x).cast("string").alias("object")) for x in names))
    each = df.select(F.col(first).cast("string").alias("subject"), F.explode(cells).alias("t")).select("subject", "t.*")
    return each.where("subject is not null and subject <> '' and object is not null and trim(object) <> ''")
