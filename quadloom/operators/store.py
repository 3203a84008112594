"""Quad store on Parquet, a directory per namespace."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadloom.functions import terms as t
from quadloom.operators import vectors as vec
from quadloom.operators.loops import durable

PROVENANCE = "struct<source:string,timestamp:string,method:string>"
BATCH = "urn:batch:"


def new_quads(present: DataFrame, incoming: DataFrame) -> DataFrame:
    """The quads of incoming that are not present, each once; graph, datatype and language compare null-safe."""
    shadow = [f"_{c}" for c in t.KEY]
    p = present.select(*(F.col(c).alias(n) for c, n in zip(t.KEY, shadow)))
    plain = [F.col(c) == F.col(n) for c, n in zip(t.KEY, shadow) if c not in ("g", "o_dt", "o_lang")]
    nullable = [F.coalesce(F.col(c), F.lit("\0")) == F.coalesce(F.col(n), F.lit("\0")) for c, n in zip(t.KEY, shadow) if c in ("g", "o_dt", "o_lang")]
    test = plain[0]
    for x in plain[1:] + nullable:
        test = test & x
    return incoming.select(*t.KEY).distinct().join(p, test, "left_anti")


def batched(triples: DataFrame, ns: str = "default", base: str = t.BASE, direct_source: str = "mcp") -> tuple[DataFrame, DataFrame]:
    """(quads, batches) of triples(subject, predicate, object, provenance).

    Each distinct provenance gets a fresh graph and three metadata quads in the default graph, which are not
    counted as added; rows without one, or from ``direct_source``, go to the default graph themselves.
    """
    rows = triples.withColumn("_source", F.col("provenance.source")).withColumn("_ts", F.col("provenance.timestamp")).withColumn("_m", F.col("provenance.method"))
    key = ["_source", "_ts", "_m"]
    batches = durable(rows.where("provenance is not null").select(*key).distinct().withColumn("batch", F.concat(F.lit(BATCH), F.uuid())))  # uuid() must not be drawn again
    quoted = lambda c: F.concat(F.lit('"'), F.coalesce(F.col(c), F.lit("")), F.lit('"'))
    facts = F.array(*(F.struct(F.lit(t.PROV + p).alias("predicate"), quoted(c).alias("object")) for p, c in (("wasDerivedFrom", "_source"), ("generatedAtTime", "_ts"), ("wasGeneratedBy", "_m"))))
    meta = t.triples_to_quads(batches.select(F.col("batch").alias("subject"), F.explode(facts).alias("f")).select("subject", "f.*"), ns, base)
    b = batches.select(*(F.col(k).alias(k + "b") for k in key), "batch")
    joined = rows.join(b, F.col("provenance").isNotNull() & F.col("_source").eqNullSafe(F.col("_sourceb")) & F.col("_ts").eqNullSafe(F.col("_tsb")) & F.col("_m").eqNullSafe(F.col("_mb")), "left")
    graph = F.when(F.coalesce(F.col("_source"), F.lit(direct_source)) != direct_source, F.col("batch"))
    whole = joined.select("subject", "predicate", "object", graph.alias("_g")).where(" and ".join(f"{c} is not null and {c} <> ''" for c in ("subject", "predicate", "object")))
    quoted_object = t.is_quoted("object")
    quads = whole.select(
        F.lit(ns).alias("ns"), F.col("_g").alias("g"), t.ensure_uri("subject", base).alias("s"), F.lit("iri").alias("s_kind"), t.ensure_uri("predicate", base).alias("p"),
        F.when(quoted_object, F.expr("substring(object, 2, length(object) - 2)")).otherwise(t.ensure_uri("object", base)).alias("o"), F.when(quoted_object, "lit").otherwise("iri").alias("o_kind"),
        F.when(quoted_object, t.XSD + "string").alias("o_dt"), F.lit(None).cast("string").alias("o_lang"),
    )
    return quads, meta


def assign_ids(known: DataFrame, names: DataFrame) -> DataFrame:
    """uri, node_id of names(uri) that known(uri, node_id) lacks, numbered on from its largest; from 1 in an empty one.

    Numbers run on in the order of the strings: partitions sorted by range are counted first, so that no task
    has to number them all.
    """
    fresh = durable(names.select("uri").where("uri is not null").distinct().join(known.select("uri"), "uri", "left_anti").repartitionByRange("uri").withColumn("_p", F.spark_partition_id()))
    first = fresh.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    top = known.agg(F.coalesce(F.max("node_id"), F.lit(0)).alias("_top"))
    within = F.row_number().over(Window.partitionBy("_p").orderBy("uri"))
    return fresh.withColumn("_r", within).join(F.broadcast(first.select("_p", "_before")), "_p").crossJoin(F.broadcast(top)).select("uri", (F.col("_top") + F.col("_before") + F.col("_r")).cast("int").alias("node_id"))


def resolve(known: DataFrame, names: DataFrame, base: str = t.BASE) -> DataFrame:
    """content, node_id, found of names(content), normalised first; 0 where unknown."""
    n = names.withColumn("_uri", t.ensure_uri("content", base))
    return n.join(known.select(F.col("uri").alias("_uri"), "node_id"), "_uri", "left").select("content", F.coalesce("node_id", F.lit(0)).alias("node_id"), F.col("node_id").isNotNull().alias("found"))


def api_rows(quads: DataFrame) -> DataFrame:
    """subject, predicate, object (without brackets) and a constant provenance of every quad."""
    bare = lambda c: F.regexp_replace(c, "^<(.*)>$", "$1")
    prov = F.struct(F.lit("quadloom").alias("source"), F.lit("").alias("timestamp"), F.lit("storage").alias("method"))
    return quads.select(bare(t.subject_term()).alias("subject"), F.col("p").alias("predicate"), bare(t.object_term()).alias("object"), prov.alias("provenance"))


def listed(quads: DataFrame, limit: int = 100) -> DataFrame:
    """subject, predicate, object in N-Triples form, the first in order."""
    return quads.select(t.subject_term().alias("subject"), t.iri("p").alias("predicate"), t.object_term().alias("object")).orderBy("subject", "predicate", "object").limit(limit)


def sources(triples: DataFrame) -> DataFrame:
    """source: the distinct ones that triples(..., provenance) come from."""
    return triples.select(F.col("provenance.source").alias("source")).where("source is not null and source <> ''").distinct()


class QuadStore:
    """Tables quads, node_ids and vectors under a root, partitioned by namespace directory."""

    SCHEMAS = {"quads": t.QUADS, "node_ids": "uri string, node_id int", "vectors": vec.VECTORS, "removed": "key string", "seen": "hash string"}

    def __init__(self, spark: SparkSession, root: str, base: str = t.BASE, dimension: int = vec.DIMENSION, embed=None):
        self.spark, self.root, self.base, self.dimension, self.embed = spark, root.rstrip("/"), base, dimension, embed

    def path(self, table: str, ns: str) -> str:
        if not ns or "/" in ns or ns in (".", ".."):
            raise ValueError(f"bad namespace {ns!r}")
        return posixpath.join(self.root, f"ns={ns}", table)

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def read(self, table: str, ns: str = "default") -> DataFrame:
        path = self.path(table, ns)
        schema = T._parse_datatype_string(self.SCHEMAS[table])
        if not self.exists(path) and self.exists(path + ".old"):
            fs, p = self._fs(path)
            fs.rename(self._fs(path + ".old")[1], p)
        return self.spark.read.schema(schema).parquet(path) if self.exists(path) else self.spark.createDataFrame([], schema)

    def append(self, table: str, df: DataFrame, ns: str) -> None:
        df.write.mode("append").parquet(self.path(table, ns))

    def replace(self, table: str, df: DataFrame, ns: str) -> None:
        """Writes beside, then moves into place; what was there is kept aside until then, and restored by the next read if that never came."""
        path = self.path(table, ns)
        df.write.mode("overwrite").parquet(path + ".new")
        fs, p = self._fs(path)
        old = self._fs(path + ".old")[1]
        if fs.exists(p):
            fs.delete(old, True)
            fs.rename(p, old)
        fs.rename(self._fs(path + ".new")[1], p)
        fs.delete(old, True)

    def add_quads(self, quads: DataFrame, ns: str = "default") -> int:
        """Appends what is new, sorted for Parquet to skip by predicate and subject; how many that is."""
        fresh = durable(new_quads(self.read("quads", ns), quads))
        n = fresh.count()
        if n:
            self.append("quads", fresh.sortWithinPartitions("p", "s"), ns)
            names = fresh.select(F.col("s").alias("uri")).union(fresh.select("p")).union(fresh.select("o"))
            self.append("node_ids", assign_ids(self.read("node_ids", ns), names), ns)
        return n

    def ingest(self, triples: DataFrame, ns: str = "default", with_vectors: bool = True) -> int:
        """Triples with provenance; the count of new quads, metadata not counted. Vectors are made for triples that are new."""
        ns = ns or "default"
        if "provenance" not in triples.columns:
            triples = triples.withColumn("provenance", F.lit(None).cast(PROVENANCE))
        quads, meta = batched(triples.select("subject", "predicate", "object", "provenance"), ns, self.base)
        added = self.add_quads(quads, ns)
        self.add_quads(meta, ns)
        if with_vectors and added:
            whole = triples.where(" and ".join(f"{c} is not null and {c} <> ''" for c in ("subject", "predicate", "object")))
            named = whole.select(t.ensure_uri("subject", self.base).alias("subject"), t.ensure_uri("predicate", self.base).alias("predicate"), "object")
            self.add_vectors(vec.triple_vectors(named), ns)
        return added

    def add_vectors(self, rows: DataFrame, ns: str = "default") -> int:
        fresh = durable(vec.insert_absent(self.read("vectors", ns), rows, self.embed, self.dimension))
        self.append("vectors", fresh, ns)
        return fresh.count()

    def remove_vectors(self, keys: DataFrame, ns: str = "default") -> None:
        self.append("removed", keys.select("key").distinct(), ns)

    def active_keys(self, ns: str = "default") -> DataFrame:
        return self.read("vectors", ns).select("key").join(self.read("removed", ns), "key", "left_anti")

    def live_vectors(self, ns: str = "default") -> DataFrame:
        return vec.of_dimension(self.read("vectors", ns), self.dimension).join(self.read("removed", ns).distinct(), "key", "left_anti")

    def compact(self, ns: str = "default") -> int:
        """Drops removed vectors for good; how many."""
        v = self.read("vectors", ns)
        before = v.count()
        kept = durable(vec.compacted(v, self.active_keys(ns)))
        n = kept.count()
        if n < before:
            self.replace("vectors", kept, ns)
            self.replace("removed", self.spark.createDataFrame([], "key string"), ns)
        return before - n

    def namespaces(self) -> list[str]:
        fs, p = self._fs(self.root)
        return sorted(s.getPath().getName()[3:] for s in fs.listStatus(p) if s.getPath().getName().startswith("ns=")) if fs.exists(p) else []

    def delete(self, ns: str) -> bool:
        fs, p = self._fs(posixpath.dirname(self.path("quads", ns)))
        return fs.delete(p, True)
