"""Work and memory that stay spread where a few keys or texts hold most of it; the limits are made small here."""

from pyspark.sql import functions as F

from conftest import SMALL, rows
from quadloom.functions import batches
from quadloom.functions import terms as t
from quadloom.operators import joins, reason, vectors
from quadloom.plans import queries_graph, queries_service, queries_sparql, sparql


def tasks_with_rows(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_objects_that_meet_objects_are_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(joins, "TILE", 8)
    q = t.triples_to_quads(spark.range(120).select(F.concat(F.lit("http://s"), "id").alias("subject"), F.when(F.col("id") % 3 == 0, "http://p").otherwise("http://q").alias("predicate"), F.when(F.col("id") < 115, "http://one").otherwise(F.concat(F.lit("http://o"), F.col("id") % 4)).alias("object")))
    got = sparql.query(q, "SELECT ?a ?b WHERE { ?a <http://p> ?x . ?b <http://q> ?x }")
    x = lambda i: "one" if i < 115 else i % 4
    want = [(f"<http://s{i}>", f"<http://s{j}>") for i in range(0, 120, 3) for j in range(120) if j % 3 and x(i) == x(j)]
    assert rows(got) == sorted(want, key=str)
    assert tasks_with_rows(got) > 4


def test_repeated_variable_in_more_than_one_task(spark, monkeypatch):
    monkeypatch.setattr(joins, "TILE", 1)
    assert tasks_with_rows(queries_sparql.QUERIES["spq2_repeated_variable"](spark, SMALL)) > 1


def sizes_of_batches(spark, run):
    """run's settings for batches, and how many texts of 1 MB come at once."""
    for k in batches.BATCH:
        spark.conf.unset(k)
    run()
    return {k: spark.conf.get(k) for k in batches.BATCH}


def test_character_chunks_of_bounded_batches(spark):
    assert sizes_of_batches(spark, lambda: queries_graph.QUERIES["sc7_character_chunks"](spark, SMALL)) == batches.BATCH
    long = spark.range(40).coalesce(1).select(F.repeat(F.lit("word "), 200_000).alias("text"))
    most = long.select(batches.texts_udf(lambda s: s.map(lambda _: len(s)), "int")("text").alias("n")).agg(F.max("n")).first()[0]
    assert most <= 8


def test_rendered_pages_of_bounded_batches(spark):
    assert sizes_of_batches(spark, lambda: queries_graph.QUERIES["sc9_rendered_pages"](spark, SMALL)) == batches.BATCH


def test_chunks_of_other_sizes_of_bounded_batches(spark):
    assert sizes_of_batches(spark, lambda: queries_service.QUERIES["sc6_chunks_of_other_sizes"](spark, SMALL)) == batches.BATCH


def test_page_chunks_of_bounded_batches(spark):
    assert sizes_of_batches(spark, lambda: queries_graph.QUERIES["src11_page_chunks"](spark, SMALL)) == batches.BATCH


def test_remote_embeddings_of_bounded_batches(spark):
    long = spark.range(40).coalesce(1).select(F.repeat(F.lit("word "), 200_000).alias("text"))
    for k in batches.BATCH:
        spark.conf.unset(k)
    got = long.select(vectors.embedder(function=lambda texts: [[float(len(texts))] for _ in texts])("text").alias("e"))
    assert got.agg(F.max(F.col("e")[0])).first()[0] <= 8


def largest_task(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_rules_group_so_many_triples_a_task(spark, monkeypatch):
    monkeypatch.setattr(reason, "TASK_ROWS", 50)
    for name in ("rs15_extended_rules", "rs9_rs11_rs13_rules"):
        got = queries_graph.QUERIES[name](spark, SMALL)
        assert got.rdd.getNumPartitions() > 8 and largest_task(got) <= 150, name


def test_report_of_rules_that_group_so_many_triples_a_task(spark, monkeypatch):
    monkeypatch.setattr(reason, "TASK_ROWS", 50)
    triples = queries_graph.spo(queries_graph.star.quads(spark, SMALL, "c_nationkey", typed=("customer",)))
    inferred = reason.infer(triples, queries_graph._ontology(spark))
    assert inferred.rdd.getNumPartitions() > 8
    assert sum(r["inferred"] for r in reason.inference_report(triples, inferred).collect()) == inferred.count()


def test_chains_are_joined_in_parts(spark, monkeypatch):
    q = queries_graph.star.quads(spark, SMALL, "o_custkey", "c_nationkey").select("s", F.lit("urn:within").alias("p"), "o")
    assert reason.chain(q, q, ["p"], 7).rdd.getNumPartitions() == 7
    monkeypatch.setattr(reason, "SCHEMA_ROWS", 0)  # a schema too large to broadcast leads to the same rows
    some = spark.createDataFrame([("urn:within", t.RDF_TYPE, t.OWL + "SymmetricProperty")], "s string, p string, o string")
    assert reason.ext_symmetric(q, some).count() == q.count()


def test_materialising_stops_when_no_rule_concludes_more(spark, monkeypatch):
    asked = []
    whole = reason.durable
    monkeypatch.setattr(reason, "durable", lambda df: asked.append(1) or whole(df))
    q = t.triples_to_quads(spark.createDataFrame([("http://a", "http://p", "http://b"), ("http://p", reason.INVERSE, "http://q")], t.TRIPLE))
    assert rows(reason.materialise(q, "owlrl")) == [("http://b", "http://q", "http://a")]
    assert len(asked) == 4  # the triples, twice what a round concludes, and the empty round that ends it once
