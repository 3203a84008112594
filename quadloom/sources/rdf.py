"""Turtle, RDF/XML and N-Quads to quads. Files are parsed a file to a task; a bad file gives an error row, not an end."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.functions import terms as t
from quadloom.plans import sparql_parser as sp

XML_NS = "{http://www.w3.org/XML/1998/namespace}"
_RDF = "{" + t.RDF + "}"
EXTENSIONS = {"ttl": "turtle", "nq": "nquads", "nt": "nquads", "rdf": "xml", "owl": "xml", "xml": "xml"}

Row = tuple  # s, s_kind, p, o, o_kind, o_dt, o_lang, g


def _row(s: str, p: str, o: str, g: str | None = None) -> Row:
    """From terms in N-Triples form."""
    kind, value, dt, lang = parts(o)
    skind, subject, _, _ = parts(s)
    return subject, skind, parts(p)[1], value, kind, dt, lang, g


def parts(nt: str) -> tuple[str, str, str | None, str | None]:
    if nt.startswith("<"):
        return "iri", nt[1:-1], None, None
    if nt.startswith("_:"):
        return "bnode", nt[2:], None, None
    m = re.match(r'(?s)^"(.*)"(?:@([A-Za-z0-9-]+)|\^\^<([^<>]*)>)?$', nt)
    return "lit", sp._unescaped(m[1]), t.RDF + "langString" if m[2] else m[3] or t.XSD + "string", m[2]


class TurtleParser(sp.Parser):
    """Turtle shares its tokens and triples with SPARQL; blank nodes are scoped to the document."""

    def __init__(self, text: str, salt: str = ""):
        super().__init__(re.sub(r"(?im)^(\s*)@(prefix|base)(\s[^\n]*?)\.\s*$", r"\1\2\3", text))
        self.salt = salt

    def triples_of_document(self) -> list[Row]:
        out: list[sp.Triple] = []
        while self.kind() != "end":
            self.prologue()
            if self.kind() == "end":
                break
            if self.tokens[self.at][0] == "lang":  # a directive that shares its line
                word = self.next()[1].lower()
                if word == "@prefix":
                    name = self.next()[1]
                    self.prefixes[name[:-1]] = self.resolve(self.next()[1])
                elif word == "@base":
                    self.base = self.next()[1][1:-1]
                else:
                    raise sp.SparqlError(f"unexpected {word}")
                self.take(".")
                continue
            out += self.triples()
            self.expect(".")
        return [_row(self.nt(x.s), self.nt(x.p), self.nt(x.o)) for x in out]

    def nt(self, x) -> str:
        if isinstance(x, sp.Term):
            return x.nt
        if isinstance(x, sp.Var) and x.name.startswith("_:"):
            return f"_:{self.salt}{x.name[2:]}"
        raise sp.SparqlError("not a term of Turtle")


def parse_turtle(text: str, salt: str = "") -> list[Row]:
    return TurtleParser(text, salt).triples_of_document()


def parse_rdfxml(text: str, salt: str = "") -> list[Row]:
    root = ET.fromstring(text)
    out: list[Row] = []
    count = 0

    def name(tag: str) -> str:
        return tag[1:].replace("}", "", 1) if tag.startswith("{") else tag

    def resolve(iri: str, base: str) -> str:
        return iri if re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", iri) else base.split("#")[0] + iri if iri.startswith("#") or not iri else base + iri

    def blank() -> str:
        nonlocal count
        count += 1
        return f"_:{salt}x{count}"

    def node(e: ET.Element, base: str, lang: str | None) -> str:
        base = e.get(XML_NS + "base", base)
        lang = e.get(XML_NS + "lang", lang)
        about, ident, nid = e.get(_RDF + "about"), e.get(_RDF + "ID"), e.get(_RDF + "nodeID")
        s = f"<{resolve(about, base)}>" if about is not None else f"<{resolve('#' + ident, base)}>" if ident else f"_:{salt}{nid}" if nid else blank()
        if e.tag != _RDF + "Description":
            out.append(_row(s, f"<{t.RDF_TYPE}>", f"<{name(e.tag)}>"))
        for k, v in e.attrib.items():
            if k == _RDF + "type":
                out.append(_row(s, f"<{t.RDF_TYPE}>", f"<{resolve(v, base)}>"))
            elif not k.startswith((_RDF, XML_NS)) and k.startswith("{"):
                out.append(_row(s, f"<{name(k)}>", sp.literal(v, lang=lang.lower() if lang else None)))
        for n, child in enumerate(e):
            prop(s, child, base, lang, n + 1)
        return s

    def prop(s: str, e: ET.Element, base: str, lang: str | None, n: int) -> None:
        lang = e.get(XML_NS + "lang", lang)
        p = f"<{t.RDF}_{n}>" if e.tag == _RDF + "li" else f"<{name(e.tag)}>"
        resource, nid, dt, how = e.get(_RDF + "resource"), e.get(_RDF + "nodeID"), e.get(_RDF + "datatype"), e.get(_RDF + "parseType")
        if resource is not None:
            o = f"<{resolve(resource, base)}>"
        elif nid is not None:
            o = f"_:{salt}{nid}"
        elif how == "Collection":
            o = f"<{t.RDF}nil>"
            for item in reversed(list(e)):
                b = blank()
                out.extend([_row(b, f"<{t.RDF}first>", node(item, base, lang)), _row(b, f"<{t.RDF}rest>", o)])
                o = b
        elif how == "Resource":
            o = blank()
            for k, child in enumerate(e):
                prop(o, child, base, lang, k + 1)
        elif len(e):
            o = node(e[0], base, lang)
        else:
            o = sp.literal(e.text or "", dt, None if dt else lang.lower() if lang else None)
        out.append(_row(s, p, o))

    base = root.get(XML_NS + "base", "")
    lang = root.get(XML_NS + "lang")
    if root.tag == _RDF + "RDF":
        for e in root:
            node(e, base, lang)
    else:
        node(root, base, lang)
    return out


_NQ = re.compile(r'^\s*(<[^<>\s]*>|_:\S+)\s+(<[^<>\s]*>)\s+(<[^<>\s]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^<>\s]*>)?)\s*(<[^<>\s]*>|_:\S+)?\s*\.\s*(?:#.*)?$')


def parse_nquads(text: str, salt: str = "") -> list[Row]:
    out = []
    for k, line in enumerate(text.splitlines()):
        if line.strip() and not line.lstrip().startswith("#"):
            m = _NQ.match(line)
            if not m:
                raise ValueError(f"line {k + 1} is no quad")
            out.append(_row(m[1], m[2], m[3], parts(m[4])[1] if m[4] else None))
    return out


PARSERS = {"turtle": parse_turtle, "xml": parse_rdfxml, "nquads": parse_nquads}
PARSED = "path string, problem string, g string, s string, s_kind string, p string, o string, o_kind string, o_dt string, o_lang string"


def parse_files(spark: SparkSession, path: str, glob: str | None = "*.{owl,ttl,rdf,xml}", ns: str = "default") -> tuple[DataFrame, DataFrame]:
    """(quads, problems(path, problem)) of the files under a path, by extension; others are taken for Turtle."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "false")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        columns = [c.split()[0] for c in PARSED.split(", ")]
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                salt = hashlib.md5(path.encode()).hexdigest()[:8]
                kind = EXTENSIONS.get(path.rsplit(".", 1)[-1].lower(), "turtle")
                try:
                    rows = PARSERS[kind](bytes(content).decode("utf-8"), salt)
                    yield pd.DataFrame([(path, None, g, s, sk, p, o, ok, dt, lang) for s, sk, p, o, ok, dt, lang, g in rows], columns=columns)
                except (ValueError, ET.ParseError) as e:
                    yield pd.DataFrame([(path, f"{type(e).__name__}: {e}"[:300], *[None] * 8)], columns=columns)

    parsed = files.mapInPandas(run, PARSED)
    quads = parsed.where("problem is null").select(F.lit(ns).alias("ns"), "g", "s", "s_kind", "p", "o", "o_kind", "o_dt", F.when(F.col("o_lang") != "", F.col("o_lang")).alias("o_lang"))
    return quads, parsed.where("problem is not null").select("path", "problem")


def read_nquads(spark: SparkSession, path: str, ns: str = "default") -> DataFrame:
    """Quads of N-Quads files by expressions alone, so a large file is split among tasks; other lines are left out."""
    term = r'<[^<>\s]*>|_:\S+'
    pattern = rf'^\s*({term})\s+<([^<>\s]*)>\s+({term}|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^<>\s]*>)?)\s*(?:<([^<>\s]*)>)?\s*\.\s*$'
    lines = spark.read.text(path).where(F.col("value").rlike(pattern))
    get = lambda k: F.regexp_extract("value", pattern, k)
    s, o = get(1), get(3)
    q = lines.select(F.lit(ns).alias("ns"), F.when(get(4) != "", get(4)).alias("g"), s.alias("st"), get(2).alias("p"), o.alias("ot"))
    bare = lambda n: F.when(F.col(n).startswith("_:"), F.substring(F.col(n), 3, 2**31 - 1)).otherwise(t.lexical(F.col(n)))
    lang = t.language(F.col("ot"))
    return q.select("ns", "g", bare("st").alias("s"), t.term_kind(F.col("st")).alias("s_kind"), "p", bare("ot").alias("o"), t.term_kind(F.col("ot")).alias("o_kind"), t.datatype(F.col("ot")).alias("o_dt"), F.when(lang != "", lang).alias("o_lang"))


def to_nquads(quads: DataFrame) -> DataFrame:
    """value: a line per quad, for df.write.text."""
    graph = F.when(F.col("g").isNotNull(), F.concat(F.lit(" "), t.iri("g"))).otherwise("")
    return quads.select(F.concat(t.subject_term(), F.lit(" "), t.iri("p"), F.lit(" "), t.object_term(), graph, F.lit(" .")).alias("value"))
