"""Mixing sources to target weights by systematic sampling.

A source's rate is the number of copies that each of its documents is expected to get so that the
source makes up its share of the mix: weight x total size / size of the source. The documents of a
source are put in a pseudo-random order; expected copies are summed up along it, one random offset
is added per source, and a document is emitted once per integer boundary that the sum crosses at it.
So every document is emitted floor(rate) or ceil(rate) times and a source is off by less than one.

Sums are exact integers of up to 38 digits in units of 2^-32 copies, so they do not depend on the order of addition
and hold 10^18 copies of each of 10^10 documents.
A running sum over a hot source is made in two levels: a source is cut along the order into blocks,
whose number follows its size; block totals are summed up first, then rows within each block.

Nulls: a null text has size 0; it is emitted as its source's rate says. A null source is a source of
its own. Weights of sources that are absent are ignored, sources without a weight get none; the rest
is scaled to 1. A source of total size 0 gets rate 0. Repeated rows each count; ties in the order are
broken by key and text, and equal rows are alike anyway. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadloom.llm.storage import numbered, written

SEED = 20_240_601
BLOCK_ROWS = 1 << 14
UNIT = 1 << 32
EXACT = "decimal(38,0)"
#: Copies of a row that one array of copy numbers holds.
RUN = 1 << 16


def _hash32(*parts) -> F.Column:
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")


def source_rates(df: DataFrame, text: str = "text", source: str = "source", weights: Mapping[str, float] | None = None, total: float | None = None) -> DataFrame:
    """_source, step (expected copies in units), offset, bits (log2 of the number of blocks): a row per source.

    weights: None gives every source the same. total: size of the mix in characters, None for that of the input.
    """
    sizes = df.groupBy(F.col(source).alias("_source")).agg(F.sum(F.coalesce(F.length(F.col(text).cast("string")), F.lit(0)).cast("long")).alias("size"), F.count("*").alias("n"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.lit(1.0))
    else:
        given = df.sparkSession.createDataFrame([(str(k), float(v)) for k, v in weights.items()], "_name string, weight double")
        sizes = sizes.join(given, F.col("_source").cast("string") == F.col("_name"), "left").select("_source", "size", "n", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    sizes = written(sizes, "sources")
    sums = sizes.agg(F.sum("size").cast("double").alias("total"), F.sum("weight").alias("weights"))
    goal = F.lit(float(total)) if total is not None else F.col("total")
    rate = F.when((F.col("size") > 0) & (F.col("weights") > 0), F.col("weight") / F.col("weights") * goal / F.col("size").cast("double")).otherwise(0.0)
    bits = F.when(F.col("n") > BLOCK_ROWS, F.least(F.lit(31), F.ceil(F.log2(F.col("n") / BLOCK_ROWS)).cast("int"))).otherwise(0)
    # Whole copies and the fraction apart: a double holds both only up to 2^21 copies.
    step = F.floor(F.col("rate")).cast("decimal(19,0)") * UNIT + F.floor((F.col("rate") - F.floor(F.col("rate"))) * float(UNIT)).cast("decimal(10,0)")
    return sizes.crossJoin(F.broadcast(sums)).withColumn("rate", rate).select("_source", step.cast(EXACT).alias("step"), _hash32(F.lit(str(SEED)), F.coalesce(F.col("_source").cast("string"), F.lit("\0"))).alias("offset"), bits.alias("bits"))


def draws(df: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", weights: Mapping[str, float] | None = None, total: float | None = None, carry_text: bool = True) -> tuple[DataFrame, list[str]]:
    """(the rows of df that are drawn, columns numbered c0, c1, ..., with _n, how often each; names of the numbered columns)."""
    rates = written(source_rates(df, text, source, weights, total), "rates")
    at = {c: f"c{i}" for i, c in enumerate(df.columns)}
    names = [c for c in df.columns if carry_text or c != text]
    columns = [at[c] for c in names]
    df = numbered(df)
    text, key, source = at[text], at[key], at[source]
    order = [F.col("_h"), F.col(key), F.col("_t")]
    rows = df.select(*columns, _hash32(F.lit(str(SEED)), F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("_h"), F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("_t"))

    def placed(x: DataFrame) -> DataFrame:
        block = F.expr("shiftright(_h, 32 - bits)")
        return x.join(rates, x[source].eqNullSafe(rates["_source"])).withColumn("_block", block)

    light = placed(df.select(source, _hash32(F.lit(str(SEED)), F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("_h")))
    blocks = light.groupBy("_source", "_block").agg(F.sum("step").cast(EXACT).alias("_sum"))
    before = Window.partitionBy("_source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("_source").alias("_bs"), F.col("_block").alias("_bb"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).cast(EXACT).alias("_before"))
    within = Window.partitionBy("_source", "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = placed(rows)
    joined = joined.join(blocks, joined["_source"].eqNullSafe(blocks["_bs"]) & (joined["_block"] == blocks["_bb"]))
    end = (F.col("_before") + F.sum("step").over(within) + F.col("offset")).cast(EXACT)
    drawn = joined.withColumn("_end", end).withColumn("_n", F.expr(f"_end div {UNIT} - (_end - step) div {UNIT}")).where("_n > 0")
    return drawn.select(*columns, "_n"), names


def sample(df: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", weights: Mapping[str, float] | None = None, total: float | None = None, carry_text: bool = True, copy_no: str | None = "copy_no") -> DataFrame:
    """df's rows, each as often as it is drawn, with the number of the copy, from 1, in ``copy_no``; without text where carry_text is false.

    A column of df of that name gives way to the new one; others may have any name. With copy_no None the columns are df's own.
    """
    drawn, names = draws(df if copy_no is None else df.drop(copy_no), text, key, source, weights, total, carry_text)
    # No array grows with the number of copies: runs first, then the copies of each.
    runs = drawn.withColumn("_run", F.explode(F.expr(f"sequence(0L, (_n - 1) div {RUN})")))
    out = runs.select(*drawn.columns[:-1], F.explode(F.expr(f"sequence(_run * {RUN} + 1, least(_n, (_run + 1) * {RUN}))")).alias("_copy"))
    return out.drop("_copy").toDF(*names) if copy_no is None else out.toDF(*names, copy_no)


def query(spark, sf_dir: str) -> DataFrame:
    """An even mix of the sources of documents: doc_id, source, copy_no."""
    return sample(spark.read.parquet(f"{sf_dir}/documents.parquet"), carry_text=False).select("doc_id", "source", "copy_no")


SQL = f"""
WITH sizes AS (SELECT source, sum(length(coalesce(text, ''))) AS size FROM documents GROUP BY source),
sums AS (SELECT CAST(sum(size) AS DOUBLE) AS total, CAST(count(*) AS DOUBLE) AS weights FROM sizes),
rates AS (
  SELECT source, CASE WHEN size > 0 THEN CAST(1.0 AS DOUBLE) / weights * total / CAST(size AS DOUBLE) ELSE 0 END AS rate,
    CAST('0x' || substr(md5('{SEED}|' || coalesce(source, chr(0))), 1, 8) AS BIGINT) AS off
  FROM sizes, sums),
steps AS (SELECT source, off, CAST(floor(rate) AS HUGEINT) * {UNIT} + CAST(floor((rate - floor(rate)) * CAST({UNIT} AS DOUBLE)) AS HUGEINT) AS step FROM rates),
run AS (
  SELECT doc_id, source, step, sum(step) OVER (PARTITION BY source ORDER BY substr(md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8), doc_id, md5(coalesce(text, '')) ROWS UNBOUNDED PRECEDING) + off AS reach
  FROM documents JOIN steps USING (source)),
drawn AS (SELECT doc_id, source, CAST(reach // {UNIT} - (reach - step) // {UNIT} AS BIGINT) AS n FROM run)
SELECT doc_id, source, unnest(generate_series(1, n)) AS copy_no FROM drawn WHERE n > 0"""
