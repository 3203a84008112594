"""The service: every call by namespace, with permissions checked in one place and an audit trail of inference."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.functions import arguments as checked
from quadloom.functions import cypher
from quadloom.functions import terms as t
from quadloom.operators import graph, quality, reason, store, vectors
from quadloom.operators.loops import durable
from quadloom.plans import sparql
from quadloom.sources import exchange, files

AUDIT = "timestamp timestamp, namespace string, strategy string, input_triples long, inferred_triples long, duplicates_skipped long, sample array<struct<s:string,p:string,o:string>>"


class Denied(PermissionError):
    pass


@dataclass
class Grant:
    namespaces: list[str]
    permissions: dict[str, bool] = field(default_factory=dict)


class Access:
    """Tokens and the namespaces (``*``, ``prefix*`` or exact) and operations (read, write, delete, reason) they open.

    Without a token only the namespace ``default`` is open. A permission that a token's entry leaves out is granted.
    """

    def __init__(self, tokens: str | dict | None = None, anonymous_default: bool = True):
        self.grants: dict[str, Grant] = {}
        self.anonymous_default = anonymous_default
        for token, value in (json.loads(tokens) if isinstance(tokens, str) else tokens or {}).items():
            if isinstance(value, list):
                self.grants[token] = Grant(value)
            elif isinstance(value, dict):
                self.grants[token] = Grant(value.get("namespaces") or [], value.get("permissions") or {})

    def check(self, token: str | None, ns: str, operation: str) -> None:
        if token is None and ns == "default" and self.anonymous_default:
            return
        if token is None:
            raise Denied("a token is needed")
        grant = self.grants.get(token)
        if grant is None:
            raise Denied("unknown token")
        if not any(p == "*" or (p.endswith("*") and ns.startswith(p[:-1])) or p == ns for p in grant.namespaces):
            raise Denied(f"the token does not open namespace {ns}")
        if not grant.permissions.get(operation, True):
            raise Denied(f"the token does not permit to {operation}")


class Engine:
    def __init__(self, spark: SparkSession, root: str, access: Access | None = None, dimension: int = vectors.DIMENSION, folder: str | None = None, scenario_root: str | None = None):
        """root: the store; folder: where downloads go, a path that executors see; scenario_root: the scenarios to install from."""
        self.folder, self.scenario_root = folder, scenario_root
        self.spark, self.access = spark, access or Access()
        self.store = store.QuadStore(spark, root, dimension=dimension)
        self.store.SCHEMAS = self.store.SCHEMAS | {"audit": AUDIT}
        self.dimension = dimension

    def _ns(self, ns: str | None, operation: str, token: str | None) -> str:
        ns = ns or "default"
        self.access.check(token, ns, operation)
        return ns

    def _quads(self, ns: str) -> DataFrame:
        return self.store.read("quads", ns)

    # Writing
    def ingest_triples(self, rows: list[dict] | DataFrame, ns: str | None = None, token: str | None = None, source: str | None = "mcp") -> int:
        """Rows of subject, predicate, object and, if any, provenance; the count of new quads."""
        ns = self._ns(ns, "write", token)
        if not isinstance(rows, DataFrame):
            rows = self.spark.createDataFrame([(r.get("subject"), r.get("predicate"), r.get("object"), r.get("provenance")) for r in rows], f"{t.TRIPLE}, provenance {store.PROVENANCE}")
            if source:
                given = F.struct(F.lit(source).alias("source"), F.lit("").alias("timestamp"), F.lit("api").alias("method"))
                rows = rows.withColumn("provenance", F.coalesce("provenance", given))
        return self.store.ingest(rows, ns)

    def ingest_pipeline(self, rows: DataFrame, ontology: DataFrame, source: str = "unknown", metadata: dict | None = None, skip_enrichment: bool = False, ns: str | None = None, token: str | None = None) -> dict:
        """Validates, deduplicates against all that was ever taken, enriches, adds provenance and stores; the counters, and status "empty" for no rows."""
        ns = self._ns(ns, "write", token)
        got, hashes, counts = quality.ingestion(rows, ontology, source, metadata, self.store.read("seen", ns), skip_enrichment=skip_enrichment)
        n = counts.first().asDict()
        if not n["input"]:
            return {"status": "empty", "stored": 0}
        self.store.ingest(got.drop("inferred"), ns)
        self.store.append("seen", hashes, ns)
        return n

    def ingest_url(self, url: str, ns: str | None = None, token: str | None = None, fetch=exchange.http_get) -> int:
        """A page fetched and cut into chunks; how many are new. A page that can't be fetched is an error."""
        ns = self._ns(ns, "write", token)
        page = self.spark.createDataFrame([(url, fetch(url).decode("utf-8", "replace"))], "url string, html string")
        return self._add_chunks(files.page_chunks(page), ns)

    def ingest_notes(self, notes: DataFrame, ns: str | None = None, token: str | None = None) -> int:
        return self.store.ingest(exchange.note_triples(notes), self._ns(ns, "write", token))

    def ingest_file(self, path: str, ns: str | None = None, token: str | None = None) -> int:
        ns = self._ns(ns, "write", token)
        got = files.ingestable(self.spark, path, ns)
        return self.store.add_quads(got if "s" in got.columns else t.triples_to_quads(got, ns), ns)

    def ingest_text(self, uri: str, content: str, ns: str | None = None, token: str | None = None) -> int:
        """Chunks to the vector store; how many are new."""
        ns = self._ns(ns, "write", token)
        docs = self.spark.createDataFrame([(uri, content)], "uri string, text string")
        return self._add_chunks(files.text_chunks(docs, "text", F.col("uri")), ns)

    def ingest_pages(self, pages: DataFrame, ns: str | None = None, token: str | None = None) -> int:
        """pages: url, html."""
        return self._add_chunks(files.page_chunks(pages), self._ns(ns, "write", token))

    def _add_chunks(self, chunks: DataFrame, ns: str) -> int:
        meta = F.to_json(F.struct(F.col("doc_uri").alias("uri"), "type"))
        return self.store.add_vectors(chunks.select(F.col("chunk_uri").alias("key"), F.col("text").alias("content"), meta.alias("metadata"), F.col("doc_uri").alias("uri")), ns)

    def install_ontology(self, name: str, content: str, folder: str, ns: str | None = None, token: str | None = None) -> int:
        ns = self._ns(ns, "write", token)
        return self.ingest_file(files.save_ontology(name, content, folder), ns, token)

    def install_scenario(self, root: str, name: str, to: str, ns: str | None = None, token: str | None = None) -> dict[str, int]:
        ns = self._ns(ns, "write", token)
        quads, chunks, counts = files.install_scenario(self.spark, root, name, to, ns)
        counts["quads"] = self.store.add_quads(quads, ns)
        counts["chunks"] = self._add_chunks(chunks, ns) if chunks is not None else 0
        return counts

    def delete_namespace(self, ns: str, token: str | None = None) -> bool:
        return self.store.delete(self._ns(ns, "delete", token))

    def compact_vectors(self, ns: str | None = None, token: str | None = None) -> int:
        return self.store.compact(self._ns(ns, "write", token))

    # Reading
    def sparql(self, text: str, ns: str | None = None, token: str | None = None, dataset: str = "default") -> DataFrame:
        return sparql.query(self._quads(self._ns(ns, "read", token)), text, dataset)

    def cypher(self, text: str, ns: str | None = None, token: str | None = None) -> DataFrame:
        return cypher.query(self._quads(self._ns(ns, "read", token)), text)

    def size(self, ns: str | None = None, token: str | None = None) -> int:
        """Quads of a namespace."""
        return self._quads(self._ns(ns, "read", token)).count()

    def cypher_page(self, text: str, ns: str | None = None, token: str | None = None, most: int = 20) -> DataFrame:
        return cypher.page(self.cypher(text, ns, token), most)

    def retrieve(self, text: str, ns: str | None = None, token: str | None = None, k: int = 5) -> DataFrame:
        """uri, score, metadata, predicate, neighbour: what is nearest to a text, with the edges around it (null where there are none). Callers take 3 for an answer, 5 for a search, 2 for background."""
        ns = self._ns(ns, "read", token)
        hits = vectors.nearest(self.store.live_vectors(ns), vectors.hash_embedding(text, self.dimension), k)
        named = durable(hits.select(vectors.metadata_uri(F.col("metadata"), F.col("key")).alias("uri"), "score", "metadata"))
        around = graph.directed(self._quads(ns), "both").select(F.col("node").alias("uri"), F.col("p").alias("predicate"), F.col("next").alias("neighbour"))
        return named.join(around, "uri", "left").orderBy(F.desc("score"), "uri", "predicate", "neighbour")

    def context(self, text: str, ns: str | None = None, token: str | None = None, k: int = 2, most: int = 300) -> str:
        """The descriptions of what is nearest, cut to ``most`` characters."""
        ns = self._ns(ns, "read", token)
        hits = vectors.nearest(self.store.live_vectors(ns), vectors.hash_embedding(text, self.dimension), k).select(F.coalesce(F.get_json_object("metadata", "$.description"), F.lit("")).alias("d")).collect()
        return "\n".join(r["d"] for r in hits)[:most] or "nothing found"

    def call(self, operation: str, arguments: dict | None = None, token: str | None = None):
        """An operation by name, its arguments checked first; InvalidArguments says what is wrong with them."""
        checked.check(operation, arguments)
        a = dict(arguments or {})
        ns = a.pop("namespace", None)
        run = {
            "ingest_triples": lambda: self.ingest_triples(a["triples"], ns, token), "ingest_file": lambda: self.ingest_file(a["path"], ns, token), "ingest_text": lambda: self.ingest_text(a["uri"], a["content"], ns, token),
            "ingest_url": lambda: self.ingest_url(a["url"], ns, token), "sparql_query": lambda: self.sparql(a["query"], ns, token),
            "hybrid_search": lambda: self.hybrid_search(a["query"], ns, token, a.get("vector_k", 10), a.get("graph_depth", 1), a.get("limit", 20)),
            "apply_reasoning": lambda: self.apply_reasoning(a.get("strategy", "rdfs"), a.get("materialize", False), ns, token),
            "get_neighbors": lambda: self.neighbours(a["uri"], ns, token, a.get("direction", "outgoing")), "list_triples": lambda: self.list_triples(a.get("limit", 100), ns, token),
            "delete_namespace": lambda: self.delete_namespace(ns, token), "compact_vectors": lambda: self.compact_vectors(ns, token), "vector_stats": lambda: self.vector_stats(ns, token),
            "disambiguate": lambda: self.disambiguate(ns, token, a.get("threshold", 0.8)), "get_node_degree": lambda: self.node_degree(a["uri"], ns, token),
            "install_ontology": lambda: self.ingest_file(exchange.download(a["url"], self.folder, a["name"]), ns, token),
            "list_scenarios": lambda: files.scenarios(self.scenario_root), "install_scenario": lambda: self.install_scenario(self.scenario_root, a["name"], self.folder, ns, token),
        }
        return run[operation]()

    def all_triples(self, ns: str | None = None, token: str | None = None) -> DataFrame:
        return store.api_rows(self._quads(self._ns(ns, "read", token)))

    def list_triples(self, limit: int = 100, ns: str | None = None, token: str | None = None) -> DataFrame:
        return store.listed(self._quads(self._ns(ns, "read", token)), limit)

    def neighbours(self, uri: str, ns: str | None = None, token: str | None = None, direction: str = "outgoing", depth: int = 1, **options) -> DataFrame:
        ns = self._ns(ns, "read", token)
        start = self.spark.createDataFrame([(uri,)], "uri string").select(t.ensure_uri("uri"))
        return graph.bfs(self._quads(ns), start, depth, direction, **options).orderBy(F.desc("score"), "depth", "node")

    def node_degree(self, uri: str, ns: str | None = None, token: str | None = None) -> int:
        return graph.degree(self._quads(self._ns(ns, "read", token)), uri).first()["degree"]

    def resolve(self, content: str, ns: str | None = None, token: str | None = None) -> tuple[int, bool]:
        ns = self._ns(ns, "read", token)
        r = store.resolve(self.store.read("node_ids", ns), self.spark.createDataFrame([(content,)], "content string")).first()
        return r["node_id"], r["found"]

    def hybrid_search(self, text: str, ns: str | None = None, token: str | None = None, k: int = 10, depth: int = 1, limit: int = 20, mode: str = "hybrid") -> DataFrame:
        ns = self._ns(ns, "read", token)
        return graph.hybrid(self._quads(ns), self.store.live_vectors(ns), vectors.hash_embedding(text, self.dimension), k, depth, limit, mode)

    def search(self, text: str, limit: int, ns: str | None = None, token: str | None = None) -> DataFrame:
        return graph.ranked(self.hybrid_search(text, ns, token, limit, 0, limit))

    def vector_stats(self, ns: str | None = None, token: str | None = None) -> DataFrame:
        ns = self._ns(ns, "read", token)
        return vectors.stats(self.store.read("vectors", ns), self.store.active_keys(ns))

    def disambiguate(self, ns: str | None = None, token: str | None = None, threshold: float = 0.8) -> DataFrame:
        ns = self._ns(ns, "read", token)
        return quality.disambiguation_report(quality.suggest_merges(self.store.read("node_ids", ns), "uri", threshold))

    # Inference
    def apply_reasoning(self, strategy: str = "rdfs", materialise: bool = False, ns: str | None = None, token: str | None = None) -> DataFrame:
        """What a strategy concludes: a single pass, or the fixed point, which is then stored. Either way one audit row."""
        ns = self._ns(ns, "reason", token)
        quads = self._quads(ns)
        strategy = strategy.lower() if strategy.lower() in reason.STRATEGIES else "none"
        got = durable(reason.materialise(quads, strategy) if materialise else reason.apply(quads, strategy))
        n = got.count()
        added = n
        if materialise:
            rows = got.select(F.lit(ns).alias("ns"), F.lit(None).cast("string").alias("g"), "s", F.lit("iri").alias("s_kind"), "p", "o", F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_dt"), F.lit(None).cast("string").alias("o_lang"))
            added = self.store.add_quads(rows, ns)
        sample = [tuple(r) for r in got.orderBy("s", "p", "o").limit(10).collect()]
        row = self.spark.createDataFrame([(None, ns, strategy, quads.count(), n, n - added, sample)], AUDIT).withColumn("timestamp", F.current_timestamp())
        self.store.append("audit", row, ns)
        return got

    def audit(self, ns: str | None = None, token: str | None = None, most: int = 100) -> DataFrame:
        ns = self._ns(ns, "read", token)
        return quality.keep_last(self.store.read("audit", ns), "namespace", most, "timestamp")
