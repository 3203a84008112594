"""The star schema's tables as a graph.

A row is the node urn:csv:<table>.csv:<key>, a column the predicate urn:csv:prop:<column>. Foreign keys lead to
the other table's node, texts are plain literals, whole numbers xsd:integer, money xsd:decimal with two
digits, times xsd:dateTime. Only the columns asked for are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.functions import terms as t

NODE, PROP, CLASS = "urn:csv:", "urn:csv:prop:", "urn:csv:class:"
PREFIXES = f"PREFIX p: <{PROP}> PREFIX c: <{CLASS}> PREFIX xsd: <{t.XSD}> PREFIX rdf: <{t.RDF}> " + " ".join(f"PREFIX {x}: <{NODE}{x}.csv:>" for x in ("region", "nation", "customer", "supplier", "part", "orders"))
KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "lineitem": "l_orderkey"}
LINKS = {"n_regionkey": "region", "c_nationkey": "nation", "s_nationkey": "nation", "o_custkey": "customer", "l_partkey": "part", "l_suppkey": "supplier"}
TABLES = {"r": "region", "n": "nation", "c": "customer", "s": "supplier", "p": "part", "o": "orders", "l": "lineitem"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node(name: str, key: Column | str) -> Column:
    return F.concat(F.lit(f"{NODE}{name}.csv:"), (F.col(key) if isinstance(key, str) else key).cast("string"))


def _cell(column: str, kind: str) -> Column:
    """o, o_kind, o_dt of a column."""
    c = F.col(column)
    if column in LINKS:
        parts = node(LINKS[column], c), F.lit("iri"), F.lit(None).cast("string")
    elif kind in ("int", "bigint"):
        parts = c.cast("string"), F.lit("lit"), F.lit(t.XSD + "integer")
    elif kind == "double":
        parts = c.cast("decimal(18,2)").cast("string"), F.lit("lit"), F.lit(t.XSD + "decimal")
    elif kind.startswith("timestamp"):
        parts = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("lit"), F.lit(t.XSD + "dateTime")
    else:
        parts = c, F.lit("lit"), F.lit(t.XSD + "string")
    return F.struct(F.lit(PROP + column).alias("p"), *(x.alias(n) for x, n in zip(parts, ("o", "o_kind", "o_dt"))))


def quads(spark: SparkSession, sf_dir: str, *columns: str, typed: tuple[str, ...] = (), graph: Column | None = None, ns: str = "default") -> DataFrame:
    """QUADS of columns, and rdf:type quads of the tables in ``typed``; graph: an expression over a table's columns, else the default graph.

    A table of several columns is read once. Lineitem's columns belong to the node of its order; equal quads are one.
    """
    by: dict[str, list[str]] = {}
    for c in columns:
        by.setdefault(TABLES[c[0]], []).append(c)
    for name in typed:
        by.setdefault(name, [])
    out = []
    for name, wanted in by.items():
        df = table(spark, sf_dir, name)
        kinds = dict(df.dtypes)
        cells = [_cell(c, kinds[c]) for c in wanted]
        if name in typed:
            cells.append(F.struct(F.lit(t.RDF_TYPE).alias("p"), F.lit(CLASS + name).alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_dt")))
        g = (graph if graph is not None else F.lit(None)).cast("string")
        s = node("orders" if name == "lineitem" else name, KEYS[name])
        if len(cells) == 1:
            each = df.select(g.alias("g"), s.alias("s"), cells[0].alias("x"))
        else:
            each = df.select(g.alias("g"), s.alias("s"), F.explode(F.array(*cells)).alias("x"))
        each = each.select(F.lit(ns).alias("ns"), "g", "s", F.lit("iri").alias("s_kind"), "x.p", "x.o", "x.o_kind", "x.o_dt", F.lit(None).cast("string").alias("o_lang")).where("o is not null")
        out.append(each.distinct() if name == "lineitem" else each)
    return reduce(DataFrame.unionByName, out)


def hierarchy(spark: SparkSession, sf_dir: str, predicate: str) -> DataFrame:
    """QUADS: every order below its customer, customer below its nation, nation below its region, by one predicate."""
    return quads(spark, sf_dir, "o_custkey", "c_nationkey", "n_regionkey").withColumn("p", F.lit(predicate))


def following(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a, b: what a user did and did next, as <type>-<user>; cycles wherever a user repeats something."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    nxt = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    named = lambda kind: F.concat(kind, F.lit("-"), F.col("user_id").cast("string"))
    return e.select(named(F.col("event_type")).alias("a"), named(nxt).alias("b")).where("b is not null").distinct()
