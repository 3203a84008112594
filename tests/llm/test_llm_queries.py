"""Every query of the llm subpackage that SQL can express against DuckDB, and the pipeline stage by stage."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quadloom.llm import registry

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_against_sql(spark, name):
    from test_queries import compare

    compare(spark, registry.QUERIES[name], registry.ORACLE_SQL[name], SMALL)


def test_pipeline_stages(spark):
    import corpus_pipeline as c
    from quadloom.llm import minhash, secrets
    from quadloom.llm.storage import written

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before, at = docs, {}
    for name, stage in c.STAGES:
        out = written(stage(spark, before, SMALL), name)
        at[name] = (before, out)
        if name != "bpe_encoding":
            assert out.columns == docs.columns
        before = out
    a, b = at["minhash_near_dedup"]
    groups = minhash.groups(a)
    assert sorted(r[0] for r in b.select("doc_id").collect()) == sorted({r["group_id"] for r in groups.collect()})
    a, b = at["secret_scan"]
    assert a.count() == b.count() and secrets.scan(b).where("verdict = 'live'").count() == 0
    a, b = at["bpe_encoding"]
    assert a.count() == b.count() and b.where(~F.col("lossless")).count() == 0
    assert {r[0] for r in b.select("doc_id").distinct().collect()} <= {r[0] for r in docs.select("doc_id").collect()}


def test_pipeline_on_an_empty_table(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("false")
    for _, stage in c.STAGES:
        docs = stage(spark, docs, SMALL)
    assert docs.collect() == []


def test_pipeline_on_odd_rows(spark):
    """Ids of strings, nulls in every column, odd texts, repeated rows and columns of clashing names go through all stages."""
    import corpus_pipeline as c
    from test_llm_operators import KEY, ODD, clash, words

    texts = [*ODD, *(words(60, 100 + k) for k in range(60)), f"a key {KEY} here"]
    rows = [(None if k % 9 == 4 else f"d{k}", t, None if k % 7 == 3 else "en", None if k % 5 == 2 else f"s{k % 3}", None if k % 4 == 1 else len(t or "")) for k, t in enumerate(texts)]
    docs = clash(spark.createDataFrame([*rows, *rows[:5], *rows[-2:]], "doc_id string, text string, lang string, source string, n_chars long"))
    from quadloom.llm.storage import written

    out = docs
    for name, stage in c.STAGES:
        before = out
        out = written(stage(spark, out, SMALL), name)
        if name != "bpe_encoding":
            assert out.columns == docs.columns and set(map(str, out.select("doc_id").toPandas()["doc_id"])) <= set(map(str, before.select("doc_id").toPandas()["doc_id"]))
        if name == "minhash_near_dedup":
            assert out.where("doc_id is null").count() == before.where("doc_id is null").count()
            assert out.where("doc_id is not null").count() == out.where("doc_id is not null").select("doc_id").distinct().count()
    assert out.where("not lossless").count() == 0 and out.count() > 0
