"""RDF terms as columns.

A quad is a row of QUADS. A term elsewhere (a SPARQL binding, a graph node) is one string in
N-Triples form, so equality of terms is equality of strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = "http://quadloom.local/"
XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
PROV = "http://www.w3.org/ns/prov#"
RDF_TYPE = RDF + "type"

QUADS = "ns string, g string, s string, s_kind string, p string, o string, o_kind string, o_dt string, o_lang string"
KEY = ("ns", "g", "s", "s_kind", "p", "o", "o_kind", "o_dt", "o_lang")
TRIPLE = "subject string, predicate string, object string"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ensure_uri(c: Column | str, base: str = BASE) -> Column:
    """Angle brackets off; what starts with http or urn: stays, the rest is put under ``base``. Null stays null."""
    bare = F.regexp_replace(F.regexp_replace(_col(c), "^<+", ""), ">+$", "")
    return F.when(bare.startswith("http") | bare.startswith("urn:"), bare).otherwise(F.concat(F.lit(base), bare))


def is_quoted(c: Column | str) -> Column:
    """Whether a plain object string is a literal: it starts and ends with a double quote."""
    c = _col(c)
    return (F.length(c) >= 2) & c.startswith('"') & c.endswith('"')


def escape(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape(c: Column) -> Column:
    """Inverse of escape(), by way of a character that texts don't hold."""
    c = F.replace(c, F.lit("\\\\"), F.lit("\x00"))
    for a, b in (('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\x00", "\\")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def iri(c: Column | str) -> Column:
    return F.concat(F.lit("<"), _col(c), F.lit(">"))


def render(value: Column, kind: Column, datatype: Column | None = None, lang: Column | None = None) -> Column:
    """A term's N-Triples form."""
    literal = F.concat(F.lit('"'), escape(value), F.lit('"'))
    if lang is not None:
        literal = F.when(lang.isNotNull(), F.concat(literal, F.lit("@"), lang)).otherwise(literal if datatype is None else F.when(datatype.isNotNull() & (datatype != XSD + "string"), F.concat(literal, F.lit("^^<"), datatype, F.lit(">"))).otherwise(literal))
    return F.when(kind == "iri", F.concat(F.lit("<"), value, F.lit(">"))).when(kind == "bnode", F.concat(F.lit("_:"), value)).otherwise(literal)


def subject_term() -> Column:
    return F.when(F.col("s_kind") == "bnode", F.concat(F.lit("_:"), F.col("s"))).otherwise(iri("s"))


def object_term() -> Column:
    return render(F.col("o"), F.col("o_kind"), F.col("o_dt"), F.col("o_lang"))


# Parts of a term in N-Triples form.
def term_kind(t: Column) -> Column:
    return F.when(t.startswith("<"), "iri").when(t.startswith("_:"), "bnode").when(t.isNotNull(), "lit")


def lexical(t: Column) -> Column:
    """STR(): an IRI without brackets, a literal's text; null for blank nodes."""
    body = F.regexp_extract(t, r'(?s)^"(.*)"(?:@[A-Za-z0-9-]+|\^\^<[^<>]*>)?$', 1)
    text = F.when(F.instr(body, "\\") > 0, unescape(body)).otherwise(body)
    return F.when(t.startswith("<"), F.regexp_extract(t, r"(?s)^<(.*)>$", 1)).when(t.startswith('"'), text)


def datatype(t: Column) -> Column:
    dt = F.regexp_extract(t, r'(?s)^".*"\^\^<([^<>]*)>$', 1)
    lang = F.regexp_extract(t, r'(?s)^".*"@([A-Za-z0-9-]+)$', 1)
    return F.when(t.startswith('"'), F.when(dt != "", dt).when(lang != "", RDF + "langString").otherwise(XSD + "string"))


def language(t: Column) -> Column:
    return F.when(t.startswith('"'), F.regexp_extract(t, r'(?s)^".*"@([A-Za-z0-9-]+)$', 1))


def triples_to_quads(df: DataFrame, ns: str = "default", base: str = BASE, literal_values: bool = False) -> DataFrame:
    """QUADS in the default graph from subject, predicate, object strings.

    An object in double quotes is a literal; any other becomes an IRI, or a literal with ``literal_values``
    unless it looks like one. Rows with a null or empty part are left out.
    """
    whole = df.where(" and ".join(f"{c} is not null and {c} <> ''" for c in ("subject", "predicate", "object")))
    quoted = is_quoted("object")
    looks = F.regexp_replace("object", "^<+", "").rlike("^(http|urn:)")
    literal = (quoted | ~looks) if literal_values else quoted
    text = F.when(quoted, F.expr("substring(object, 2, length(object) - 2)")).when(literal, F.col("object")).otherwise(ensure_uri("object", base))
    return whole.select(
        F.lit(ns).alias("ns"), F.lit(None).cast("string").alias("g"), ensure_uri("subject", base).alias("s"), F.lit("iri").alias("s_kind"), ensure_uri("predicate", base).alias("p"),
        text.alias("o"), F.when(literal, "lit").otherwise("iri").alias("o_kind"), F.when(literal, XSD + "string").alias("o_dt"), F.lit(None).cast("string").alias("o_lang"),
    )


def label(c: Column | str) -> Column:
    """What follows the last / of an IRI; what follows the last # where it has no /."""
    bare = F.regexp_replace(F.regexp_replace(_col(c), "^<+", ""), ">+$", "")
    return F.when(F.instr(bare, "/") > 0, F.element_at(F.split(bare, "/"), -1)).when(F.instr(bare, "#") > 0, F.element_at(F.split(bare, "#"), -1)).otherwise(bare)


def local_name(c: Column | str) -> Column:
    """What follows the last # and then the last /."""
    return F.element_at(F.split(F.element_at(F.split(_col(c), "#"), -1), "/"), -1)


def similarity(a: Column | str, b: Column | str) -> Column:
    """1 - edit distance / longer length, case ignored; 1 for two empty strings, 0 for one."""
    a, b = F.lower(_col(a)), F.lower(_col(b))
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(1 - F.levenshtein(a, b) / longer)


def empty_quads(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], QUADS)


def now() -> Column:
    """The time of the query in RFC 3339, in UTC."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
