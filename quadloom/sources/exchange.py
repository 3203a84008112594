"""Pages and files by URL, vector and id-map files, notes."""

from __future__ import annotations

import hashlib
import json
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.functions import terms as t
from quadloom.operators import vectors as vec

Fetch = Callable[[str], bytes]


def http_get(url: str, timeout: float = 30.0) -> bytes:
    """The body of a page; only http and https."""
    if not url.lower().startswith(("http://", "https://")):
        raise ValueError(f"not a web address: {url!r}")
    with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "quadloom"}), timeout=timeout) as got:
        return got.read()


def fetch_pages(urls: DataFrame, url: str = "url", fetch: Fetch = http_get) -> DataFrame:
    """url, html, problem: every page of urls, fetched by the executors; a page that fails has a null html and says why."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for address in batch.column(0).to_pylist():
                html = problem = None
                try:
                    html = fetch(address).decode("utf-8", "replace") if address is not None else None
                except (OSError, ValueError) as e:
                    problem = f"{type(e).__name__}: {e}"[:300]
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (address, html, problem)], names=["url", "html", "problem"])

    return urls.select(F.col(url).cast("string")).mapInArrow(run, "url string, html string, problem string")


def download(url: str, folder: str, name: str | None = None, fetch: Fetch = http_get) -> str:
    """Saves what a URL holds under a plain file name, by default one made of the URL; the path."""
    from quadloom.sources.files import save_ontology

    plain = name or hashlib.md5(url.encode()).hexdigest() + "." + (url.rsplit(".", 1)[-1].lower() if url.rsplit(".", 1)[-1].lower() in ("ttl", "owl", "rdf", "xml") else "ttl")
    return save_ontology(plain, fetch(url).decode("utf-8"), folder)


def read_vectors(spark: SparkSession, path: str, dimension: int = vec.DIMENSION) -> DataFrame:
    """Vectors of a vectors.json: {"entries": [{key, embedding, metadata_json}]}; entries of another dimension are left out, a file that is no such object gives none."""
    entry = "struct<key:string,embedding:array<float>,metadata_json:string>"
    got = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"entries array<{entry}>").getField("entries")).alias("e"))
    uri = vec.metadata_uri(F.col("e.metadata_json"), F.col("e.key"))
    return vec.of_dimension(got.select(F.col("e.key").alias("key"), F.col("e.embedding").alias("embedding"), F.col("e.metadata_json").alias("metadata"), uri.alias("uri")), dimension)


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Vectors as lines of JSON objects key, embedding, metadata_json; read_vector_lines() reads them, in parallel."""
    vectors.select("key", "embedding", F.col("metadata").alias("metadata_json")).write.json(path)


def read_vector_lines(spark: SparkSession, path: str, dimension: int = vec.DIMENSION) -> DataFrame:
    got = spark.read.json(path, schema="key string, embedding array<float>, metadata_json string")
    return vec.of_dimension(got.select("key", "embedding", F.col("metadata_json").alias("metadata"), vec.metadata_uri(F.col("metadata_json"), F.col("key")).alias("uri")), dimension)


def read_ids(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """(uri, node_id; the next id) of an id map {"uri_to_id": {...}, "next_id": n}; nothing and 1 where there is no such file."""
    try:
        with open(path) as f:
            got = json.load(f)
    except FileNotFoundError:
        got = {}
    pairs = [(u, int(i)) for u, i in got.get("uri_to_id", {}).items()]
    return spark.createDataFrame(pairs, "uri string, node_id int"), int(got.get("next_id", 1))


def note_triples(notes: DataFrame, note: str = "id", title: str = "title", url: str = "url") -> DataFrame:
    """subject, predicate, object, provenance: the title and type of notes of another application; an untitled one is called so."""
    subject = F.concat(F.lit("notion:"), F.col(note).cast("string"))
    prov = F.struct(F.concat(F.lit("notion_sync:"), F.coalesce(F.col(url), F.lit(""))).alias("source"), F.lit("").alias("timestamp"), F.lit("notion_sync").alias("method"))
    name = F.concat(F.lit('"'), F.coalesce(F.nullif(F.col(title), F.lit("")), F.lit("Untitled")), F.lit('"'))
    facts = F.array(F.struct(F.lit("http://purl.org/dc/terms/title").alias("predicate"), name.alias("object")), F.struct(F.lit(t.RDF_TYPE).alias("predicate"), F.lit("http://schema.org/Note").alias("object")))
    return notes.where(F.col(note).isNotNull()).select(subject.alias("subject"), F.explode(facts).alias("f"), prov.alias("provenance")).select("subject", "f.*", "provenance")
