"""Structured Streaming forms of the incremental operators; each also runs to an end with availableNow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quadloom.operators import reason, store
from quadloom.operators.store import QuadStore
from quadloom.sources.files import SESSION


def sessions(spark, path: str) -> DataFrame:
    """A stream of session logs, a JSON object per line, as files arrive."""
    return spark.readStream.schema(SESSION).json(path)


def deduplicated(stream: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """Each key once among what arrives within ``late``; state older than that is dropped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time: str, by: list[str], width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Rows per window and group; a window comes out when the watermark has passed it."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def ingest(stream: DataFrame, to: QuadStore, ns: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Triples of a stream into a store; a batch that is run again adds nothing, since known quads are left out."""

    def each(batch: DataFrame, _: int) -> None:
        to.ingest(batch, ns, with_vectors=False)

    return _started(stream, each, checkpoint, available_now)


def infer(stream: DataFrame, ontology: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, rules: list[str] | None = None, available_now: bool = True) -> StreamingQuery:
    """Extended rules over each micro-batch of triples s, p, o."""

    def each(batch: DataFrame, n: int) -> None:
        sink(reason.infer(batch.select("s", "p", "o"), ontology, rules), n)

    return _started(stream, each, checkpoint, available_now)


def insert_new(stream: DataFrame, to: QuadStore, ns: str, checkpoint: str) -> StreamingQuery:
    """Quads of a stream, those that are new."""

    def each(batch: DataFrame, _: int) -> None:
        fresh = store.new_quads(to.read("quads", ns), batch)
        to.add_quads(fresh, ns)

    return _started(stream, each, checkpoint, True)


def _started(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs an append stream over all that is there now into Parquet; the table."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def ready(feedback: Column, least: int = 50) -> Column:
    """Aggregate: whether enough rows have feedback to train."""
    return F.count(feedback) >= least
