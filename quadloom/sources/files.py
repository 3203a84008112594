"""CSV, Markdown, JSON, text, pages, registries and scenario packages."""

from __future__ import annotations

import json
import os
import posixpath
import shutil
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.functions import text as tx
from quadloom.functions.terms import BASE, TRIPLE
from quadloom.sources import rdf

CSV_SUBJECT, CSV_PROPERTY = "urn:csv:", "urn:csv:prop:"


def encoding_of(spark: SparkSession, path: str) -> str:
    """utf-8, or latin-1 where any line is not valid UTF-8."""
    return "utf-8" if spark.read.text(path).where(~F.is_valid_utf8("value")).isEmpty() else "iso-8859-1"


def csv_triples(spark: SparkSession, path: str, encoding: str | None = None, max_rows: int | None = None) -> DataFrame:
    """subject urn:csv:<file>:<first column>, predicate urn:csv:prop:<header>, object the field; empty fields are skipped.

    Without an encoding it is UTF-8, or latin-1 where the file is not that.
    """
    encoding = encoding or encoding_of(spark, path)
    df = spark.read.option("encoding", encoding).option("multiLine", True).csv(path, header=True)
    df = df.limit(max_rows) if max_rows else df
    return unpivoted(df, posixpath.basename(path))


def unpivoted(df: DataFrame, name: str) -> DataFrame:
    """Triples of a table with a header; ``name`` goes into the subjects."""
    first, names = df.columns[0], df.columns[1:]
    if not names:
        return df.sparkSession.createDataFrame([], TRIPLE)
    cells = F.array(*(F.struct(F.lit(CSV_PROPERTY + x).alias("predicate"), F.col(f"`{x}`").cast("string").alias("object")) for x in names))
    each = df.select(F.concat(F.lit(f"{CSV_SUBJECT}{name}:"), F.col(f"`{first}`").cast("string")).alias("subject"), F.explode(cells).alias("t")).select("subject", "t.*")
    return each.where("subject is not null and object is not null and object <> ''")


def row_batches(df: DataFrame, size: int = 100) -> DataFrame:
    """df with the number of its batch; batches of ``size`` rows within each partition."""
    return df.withColumn("batch", F.concat_ws("-", F.spark_partition_id(), F.floor(F.pmod(F.monotonically_increasing_id(), F.lit(1 << 33)) / size).cast("long")))


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def markdown(spark: SparkSession, path: str, base: str = BASE) -> tuple[DataFrame, DataFrame]:
    """(triples, chunks) of Markdown files."""
    docs = _whole(spark, path)
    return tx.markdown_triples(docs, "text", F.col("path"), base), tx.with_chunks(docs, "text", F.col("path"), kind="markdown_chunk", number_single=True)


def json_triples(df: DataFrame, text: str, most: int = 100) -> DataFrame:
    """(key, hasValue, value) of the short string values of each JSON object; numbers, arrays and objects are left out, as is what is no object."""
    fields = df.select(F.explode(F.from_json(text, "map<string,variant>")).alias("subject", "v")).where(F.schema_of_variant("v") == "STRING")
    return fields.select("subject", F.lit("hasValue").alias("predicate"), F.col("v").cast("string").alias("object")).where((F.length("object") < most) & (F.col("object") != ""))


def memory_lines(df: DataFrame, text: str, base: str = BASE) -> DataFrame:
    """Triples of lines ``- YYYY-MM-DD: text``: a date and a description of each."""
    line = r"(?m)^- (\d{4}-\d{2}-\d{2}): (.+)$"
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(line), F.lit(1)).alias("d"), F.regexp_extract_all(text, F.lit(line), F.lit(2)).alias("x"))
    each = df.select(F.explode(both).alias("t")).select(F.concat(F.lit(base + "memory/"), F.md5(F.concat_ws("|", "t.d", "t.x"))).alias("subject"), F.col("t.d").alias("d"), F.col("t.x").alias("x"))
    dc = "http://purl.org/dc/elements/1.1/"
    cells = F.array(F.struct(F.lit(dc + "date").alias("predicate"), F.concat(F.lit('"'), "d", F.lit('"')).alias("object")), F.struct(F.lit(dc + "description").alias("predicate"), F.concat(F.lit('"'), "x", F.lit('"')).alias("object")))
    return each.select("subject", F.explode(cells).alias("t")).select("subject", "t.*")


def page_chunks(pages: DataFrame, html: str = "html", url: str = "url", size: int = 1000, overlap: int = 150) -> DataFrame:
    """Chunks of stripped pages."""
    plain = pages.select(F.col(url).alias("url"), tx.strip_html(F.col(html)).alias("text"))
    return tx.with_chunks(plain, "text", F.col("url"), size, overlap, kind="web_chunk", number_single=True)


def text_chunks(docs: DataFrame, text: str, uri: Column, size: int = 1000, overlap: int = 150) -> DataFrame:
    return tx.with_chunks(docs, text, uri, size, overlap, kind="text_chunk")


def jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return spark.read.json(path, schema=schema) if schema else spark.read.json(path)


SESSION = "timestamp string, input string, output string, feedback string, air_reward double, metadata map<string,string>"


def ingestable(spark: SparkSession, path: str, ns: str = "default") -> DataFrame:
    """Triples or quads of a file, by its extension; others are an error."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind in ("md", "markdown"):
        return markdown(spark, path)[0]
    if kind == "csv":
        return csv_triples(spark, path)
    if kind in ("owl", "ttl", "rdf", "xml"):
        return rdf.parse_files(spark, path, None, ns)[0]
    raise ValueError(f"unsupported file type: {kind}")


class OntologyRegistry:
    """Ontology files and whether they are in use, kept in a JSON file."""

    def __init__(self, path: str):
        self.path = path
        self.sources: list[dict] = []
        if os.path.exists(path):
            with open(path) as f:
                self.sources = json.load(f)

    def save(self) -> None:
        with open(self.path + ".tmp", "w") as f:
            json.dump(self.sources, f, indent=1)
        os.replace(self.path + ".tmp", self.path)

    def add(self, path: str, kind: str = "file", fmt: str | None = None, metadata: dict | None = None) -> None:
        self.sources = [s for s in self.sources if s["path"] != path] + [{"path": path, "type": kind, "format": fmt, "enabled": True, "metadata": metadata or {}}]
        self.save()

    def remove(self, path: str) -> None:
        self.sources = [s for s in self.sources if s["path"] != path]
        self.save()

    def toggle(self, path: str, enabled: bool) -> None:
        for s in self.sources:
            if s["path"] == path:
                s["enabled"] = enabled
        self.save()

    def load(self, spark: SparkSession, folder: str | None = None, fetch=None) -> DataFrame:
        """Quads of all sources in use; those by URL are downloaded into ``folder`` first."""
        from quadloom.functions.terms import empty_quads
        from quadloom.sources import exchange

        out = empty_quads(spark)
        for s in self.sources:
            if not s["enabled"]:
                continue
            path = s["path"]
            if s["type"] == "url":
                if folder is None:
                    raise ValueError(f"a folder is needed to download {path}")
                path = exchange.download(path, folder, fetch=fetch or exchange.http_get)
            out = out.unionByName(rdf.parse_files(spark, path, None)[0])
        return out.distinct()


def save_ontology(name: str, content: str, folder: str) -> str:
    """Saves an ontology's text under a plain file name."""
    if os.path.basename(name) != name or name in ("", ".", ".."):
        raise ValueError(f"not a plain file name: {name!r}")
    os.makedirs(folder, exist_ok=True)
    with open(to := os.path.join(folder, name), "w") as f:
        f.write(content)
    return to


def scenarios(root: str) -> list[dict]:
    """Entries of registry.json: name, description, version, location."""
    with open(os.path.join(root, "registry.json")) as f:
        got = json.load(f)
    return got["scenarios"] if isinstance(got, dict) else got


def manifest(root: str, name: str) -> dict:
    with open(os.path.join(root, name, "manifest.json")) as f:
        return json.load(f)


def install_scenario(spark: SparkSession, root: str, name: str, to: str, ns: str = "default", base_url: str | None = None, fetch=None) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Copies what a scenario's manifest lists; (quads, chunks, counts) of its ontologies, data files and documents.

    What is not under ``root`` is fetched from below ``base_url``, if there is one, and else left out. ``to`` must be a
    folder that all executors see.
    """
    from quadloom.functions.terms import empty_quads, triples_to_quads
    from quadloom.sources import exchange

    fetch = fetch or exchange.http_get
    if not os.path.exists(os.path.join(root, name, "manifest.json")) and base_url:
        os.makedirs(os.path.join(to, name), exist_ok=True)
        m = json.loads(fetch(f"{base_url}/{name}/manifest.json"))
    else:
        m = manifest(root, name)
    quads, chunks = empty_quads(spark), None
    for folder, key in (("schema", "ontologies"), ("data", "data_files"), ("docs", "docs")):
        for file in m.get(key, []):
            if os.path.isabs(file) or ".." in file.split("/"):
                raise ValueError(f"path leaves the scenario: {file!r}")
            source = next((p for p in (os.path.join(root, name, folder, file), os.path.join(root, name, file)) if os.path.exists(p)), None)
            os.makedirs(os.path.join(to, name, folder), exist_ok=True)
            place = os.path.join(to, name, folder, os.path.basename(file))
            if source is not None:
                shutil.copy(source, place)
            elif base_url:
                with open(place, "wb") as f:
                    f.write(fetch(f"{base_url}/{name}/{folder}/{file}"))
            else:
                continue
            if key == "docs":
                part = tx.with_chunks(_whole(spark, place), "text", F.col("path"), kind="doc_chunk")
                chunks = part if chunks is None else chunks.unionByName(part)
            else:
                got = ingestable(spark, place, ns)
                quads = quads.unionByName(got if "s" in got.columns else triples_to_quads(got, ns))
    return quads, chunks, {k: len(m.get(k, [])) for k in ("ontologies", "data_files", "docs")}


def iter_batches(rows: list, size: int = 500) -> Iterator[list]:
    """Rows of a client in calls of at most ``size``."""
    for k in range(0, len(rows), size):
        yield rows[k : k + size]
