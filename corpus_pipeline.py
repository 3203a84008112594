"""Corpus pipeline: toxicity, near-duplicates, secrets, source mix, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; docs has been
written as Parquet by then. All but the last return the columns of documents. Nulls, empty texts,
repeated rows and empty tables are treated as the operators state.

ORACLE_SQL is None: MinHash groups and byte-pair merges can't be put in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quadloom.llm import bpe, minhash, mixing, secrets, toxicity
from quadloom.llm.storage import written

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the induced lexicon rejects go."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return minhash.deduplicate(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live secrets are replaced in the text; documents stay."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come out with equal shares; a document drawn more than once is repeated."""
    return mixing.sample(docs, copy_no=None)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, token_ids, n_tokens, and whether decoding gives the text back."""
    return bpe.round_trip(docs, keep=("doc_id", "source"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", near_dedup),
    ("secret_scan", redact_secrets),
    ("source_mixing", mix_sources),
    ("bpe_encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over sf_dir's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
