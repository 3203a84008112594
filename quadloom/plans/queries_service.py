"""Cypher, streams and the service façade over the test tables."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadloom import engine
from quadloom.functions import answers, arguments, cypher
from quadloom.functions import terms as t
from quadloom.functions import text as tx
from quadloom.operators import graph, quality, store, vectors
from quadloom.operators.loops import durable
from quadloom.plans.queries_graph import CUSTOMER, NATION, PART, SUPPLIER, _vocabulary, node, word_chunks_sql
from quadloom.sources import exchange, files, rdf, star
from quadloom.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    durable(spark.range(1))  # sets the folder where it is unset
    return f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


# Cypher
@query(f"select {CUSTOMER} c, 'c_nationkey' \"type(r)\", {node('nation', 'c_nationkey')} n from customer where c_nationkey = 4")
def flt9_cypher_edge(spark, sf):
    """An edge of one relation type among two."""
    quads = star.quads(spark, sf, "c_nationkey", "n_regionkey").withColumn("p", F.concat(F.lit("http://quadloom.local/"), F.element_at(F.split("p", ":"), -1)))
    return cypher.query(quads, "MATCH (c)-[r:c_nationkey]->(n) WHERE n = 'urn:csv:nation.csv:4' RETURN c, type(r), n")


@query("select n_name as m from nation where lower(n_name) like '%nation_1%'")
def flt9_cypher_contains(spark, sf):
    return cypher.query(star.quads(spark, sf, "n_name"), "MATCH (n)-[r]->(m) WHERE m CONTAINS 'nAtion_1' RETURN m")


@query(f"select {CUSTOMER} c from customer where lower(c_mktsegment) like '%build%' or c_mktsegment = 'MACHINERY'")
def flt9_cypher_label_or(spark, sf):
    return cypher.query(star.quads(spark, sf, "c_mktsegment", typed=("customer",)), "MATCH (c:customer)-[r]->(m) WHERE m CONTAINS 'build' OR m = 'MACHINERY' RETURN c")


@query(f"select {SUPPLIER} s from supplier order by 1 limit 20")
def sc17_cypher_limit(spark, sf):
    return cypher.query(star.quads(spark, sf, "s_name", typed=("supplier",)), "MATCH (s:supplier) RETURN s LIMIT 20")


@query("""select p_partkey, k kind, case k when 0 then 'MATCH (what)-[:improves]->(it) WHERE it CONTAINS ''soil'' RETURN what' when 1 then 'MATCH (swale)-[:captures]->(it) WHERE swale CONTAINS ''swale'' RETURN swale, it'
  when 2 then 'MATCH (thing)-[link]-(other) WHERE thing = ' || chr(39) || regexp_extract(p_name, '[A-Za-z0-9_-]+$') || chr(39) || ' RETURN thing, type(link), other LIMIT 20'
  else 'MATCH (thing)-[link]->(other) WHERE thing CONTAINS ' || chr(39) || 'connections' || chr(39) || ' OR other CONTAINS ' || chr(39) || 'connections' || chr(39) || ' RETURN thing, type(link), other LIMIT 20' end as translated from part, (values (0), (1), (2), (3)) v(k)""")
def sc15_questions(spark, sf):
    """All four kinds of question, about every part."""
    p = star.table(spark, sf, "part").select("p_partkey", "p_name", F.explode(F.array(*map(F.lit, range(4)))).alias("kind"))
    text = F.when(F.col("kind") == 0, "What would improve the soil").when(F.col("kind") == 1, "show the swales that hold water").when(F.col("kind") == 2, F.concat(F.lit("What is "), "p_name")).otherwise(F.concat(F.lit("list connections of "), "p_partkey"))
    translate = F.udf(cypher.question, "string")
    return p.select("p_partkey", "kind", translate(text).alias("translated"))


@query("select 'urn:csv:region.csv:' || r_regionkey thing, x as \"type(link)\", m other from (select r_regionkey, 'urn:csv:prop:r_name' x, r_name m from region union all select n_regionkey, 'urn:csv:prop:n_regionkey', 'urn:csv:nation.csv:' || n_nationkey from nation) where r_regionkey = 1")
def sc15_question_answered(spark, sf):
    return cypher.query(star.quads(spark, sf, "r_name", "n_regionkey"), "MATCH (thing)-[link]-(other) WHERE thing = 'urn:csv:region.csv:1' RETURN thing, type(link), other")


# Streams
@query("select user_id, event_type from (select distinct user_id, event_type from events)")
def st2_stream_dedupe(spark, sf):
    schema = star.table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    got = streams.deduplicated(stream, ["user_id", "event_type"], "ts", "3650 days").select("user_id", "event_type")
    return streams.to_table(got, folder(spark, "stream"), folder(spark, "progress"))


@query("select * from (select time_bucket(interval '1 hour', ts) as start, event_type, count(*) n from events group by 1, 2) where start + interval '1 hour' <= (select max(ts) from events) - interval '1 hour'")
def st3_windowed_counts(spark, sf):
    """A stream's counts per hour; those of the last hour before the watermark are still open when it ends."""
    schema = star.table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    return streams.to_table(streams.windowed_counts(stream, "ts", ["event_type"]), folder(spark, "stream"), folder(spark, "progress"))


def _session_files(spark, sf) -> str:
    """Events as session logs, a JSON object a line, in several files."""
    path = folder(spark, "sessions")
    e = star.table(spark, sf, "events")
    kind = F.when(F.col("event_type") == "purchase", "positive").when(F.col("event_type") == "error", "negative")
    e.repartition(3).select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.col("event_type").alias("input"), F.col("event_id").cast("string").alias("output"), kind.alias("feedback"), F.col("value").alias("air_reward")).write.json(path)
    return path


@query("select event_id::varchar as output, event_type as input, case event_type when 'purchase' then 'positive' when 'error' then 'negative' end feedback from events")
def st1_session_stream(spark, sf):
    """Session logs streamed as files arrive."""
    return streams.to_table(streams.sessions(spark, _session_files(spark, sf)).select("output", "input", "feedback"), folder(spark, "stream"), folder(spark, "progress"))


@query("select event_id::varchar as output, round(value, 6) air_reward from events")
def src21_session_lines(spark, sf):
    return files.jsonl(spark, _session_files(spark, sf), files.SESSION).select("output", F.round("air_reward", 6).alias("air_reward"))


@query("select count(*) filter (event_type in ('purchase', 'error')) >= 50 as ready from events")
def st5_enough_feedback(spark, sf):
    """Whether a stream of sessions has brought enough feedback to train."""
    got = streams.to_table(streams.sessions(spark, _session_files(spark, sf)), folder(spark, "stream"), folder(spark, "progress"))
    return got.agg(streams.ready(F.col("feedback")).alias("ready"))


@query(f"select 'symmetric' rule, {node('nation', 'c_nationkey')} s, 'urn:near' p, {CUSTOMER} o from customer")
def st4_stream_inference(spark, sf):
    """Rules over each micro-batch of a stream of triples."""
    source, to = folder(spark, "triples"), folder(spark, "inferred")
    star.quads(spark, sf, "c_nationkey").repartition(2).select("s", F.lit("urn:near").alias("p"), "o").write.parquet(source)
    ontology = spark.createDataFrame([("urn:near", t.RDF_TYPE, t.OWL + "SymmetricProperty")], "s string, p string, o string")
    stream = spark.readStream.schema("s string, p string, o string").option("maxFilesPerTrigger", 1).parquet(source)
    streams.infer(stream, ontology, lambda df, n: df.write.mode("append").parquet(to), folder(spark, "progress")).awaitTermination()
    return spark.read.parquet(to)


@query(f"select {CUSTOMER} s, '{star.PROP}c_nationkey' p, {node('nation', 'c_nationkey')} o from customer")
def st4_stream_ingest(spark, sf):
    """A stream of triples into a store; each triple comes twice, and what an earlier batch brought is not added again."""
    source = folder(spark, "triples")
    rows = star.quads(spark, sf, "c_nationkey").select(F.col("s").alias("subject"), F.col("p").alias("predicate"), F.col("o").alias("object"))
    rows.repartition(2).write.parquet(source)
    rows.coalesce(1).write.mode("append").parquet(source)
    to = store.QuadStore(spark, folder(spark, "store"), dimension=16)
    stream = spark.readStream.schema(t.TRIPLE).option("maxFilesPerTrigger", 2).parquet(source)
    streams.ingest(stream, to, "default", folder(spark, "progress")).awaitTermination()
    return to.read("quads").select("s", "p", "o")


# Service
@query(f"""select '<' || {NATION} || '>' n, '"' || n_name || '"' as name from nation""")
def svc_ingest_and_sparql(spark, sf):
    e = engine.Engine(spark, folder(spark, "store"), dimension=16)
    n = star.table(spark, sf, "nation")
    rows = n.select(star.node("nation", "n_nationkey").alias("subject"), F.lit("urn:name").alias("predicate"), F.concat(F.lit('"'), "n_name", F.lit('"')).alias("object"))
    e.ingest_triples(rows)
    e.ingest_triples(rows)  # adds nothing
    return e.sparql("SELECT ?n ?name WHERE { ?n <urn:name> ?name }")


@query(f"select {node('customer', 'o_custkey')} s, 'urn:placed' p, 'urn:csv:orders.csv:' || o_orderkey o from orders")
def svc_reasoning_materialised(spark, sf):
    e = engine.Engine(spark, folder(spark, "store"), dimension=16)
    e.store.add_quads(star.quads(spark, sf, "o_custkey"), "default")
    e.ingest_triples([{"subject": "urn:csv:prop:o_custkey", "predicate": "http://www.w3.org/2002/07/owl#inverseOf", "object": "urn:placed"}])
    e.apply_reasoning("owlrl", materialise=True)
    return e.store.read("quads").where("p = 'urn:placed'").select("s", "p", "o")


@query("select 'default' namespace, 'rdfs' strategy, (select count(*) from customer) input_triples, 0::bigint inferred_triples")
def wn5_audit(spark, sf):
    e = engine.Engine(spark, folder(spark, "store"), dimension=16)
    e.store.add_quads(star.quads(spark, sf, "c_nationkey"), "default")
    e.apply_reasoning("rdfs")
    return e.audit().select("namespace", "strategy", "input_triples", "inferred_triples")


# Files
def _plain(path: str) -> str:
    return path.removeprefix("file://")


def _written(spark, sf, table: str, key: str, ending: str, text) -> str:
    """A file per row of a small table, written on the driver; the folder."""
    path = folder(spark, ending)
    os.makedirs(_plain(path), exist_ok=True)
    for r in star.table(spark, sf, table).orderBy(key).toLocalIterator():
        with open(f"{_plain(path)}/{table}-{r[key]}.{ending}", "w") as f:
            f.write(text(r))
    return path


@query("""with n as (select 'nation-' || n_nationkey || '.md' d, 'About ' || n_name h, * from nation)
select d subject, 'http://' || 'quadloom.local/contains_section' predicate, h as object from n
union all select h, 'http://' || 'quadloom.local/has_list_item', 'region ' || n_regionkey from n
union all select h, 'http://' || 'quadloom.local/property/key_no', n_nationkey::varchar from n""")
def src6_markdown_files(spark, sf):
    path = _written(spark, sf, "nation", "n_nationkey", "md", lambda r: f"# About {r['n_name']}\n\n- region {r['n_regionkey']}\nkey no: {r['n_nationkey']}\n")
    got = files.markdown(spark, path)[0]
    return got.withColumn("subject", F.regexp_replace("subject", "^file:.*/", ""))


@query("select 'nation-' || n_nationkey || '.md#chunk-0' chunk_uri, '# About ' || n_name as text, 'markdown_chunk' as type from nation")
def src6_markdown_chunks(spark, sf):
    path = _written(spark, sf, "nation", "n_nationkey", "md", lambda r: f"# About {r['n_name']}\n")
    return files.markdown(spark, path)[1].select(F.regexp_replace("chunk_uri", "^file:.*/", "").alias("chunk_uri"), "text", "type")


@query(f"""select {NATION} s, 'http://names/name' p, n_name o, 'lit' o_kind from nation union all select {NATION}, 'http://names/in', {node('region', 'n_regionkey')}, 'iri' from nation""")
def src7_rdf_xml_files(spark, sf):
    head = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:n="http://names/">'
    path = _written(spark, sf, "nation", "n_nationkey", "rdf", lambda r: f"""{head}<rdf:Description rdf:about="urn:csv:nation.csv:{r['n_nationkey']}"><n:name>{r['n_name']}</n:name><n:in rdf:resource="urn:csv:region.csv:{r['n_regionkey']}"/></rdf:Description></rdf:RDF>""")
    return rdf.parse_files(spark, path)[0].select("s", "p", "o", "o_kind")


@query("""select 'nation-' || n_nationkey || '.ttl' path, 'ok' state, 1::bigint n from nation where n_nationkey % 2 = 0 union all select 'nation-' || n_nationkey || '.ttl', 'problem', 1 from nation where n_nationkey % 2 = 1""")
def src8_damaged_files(spark, sf):
    """Every second file is damaged; the others are read all the same."""
    path = _written(spark, sf, "nation", "n_nationkey", "ttl", lambda r: f"<urn:csv:nation.csv:{r['n_nationkey']}> <urn:name> " + (f'"{r["n_name"]}" .' if r["n_nationkey"] % 2 == 0 else "<unclosed"))
    quads, bad = rdf.parse_files(spark, path)
    good = quads.select(F.concat(F.lit("nation-"), F.regexp_extract("s", "[0-9]+$", 0), F.lit(".ttl")).alias("path"), F.lit("ok").alias("state"))
    both = good.unionByName(bad.select(F.regexp_replace("path", "^.*/", "").alias("path"), F.lit("problem").alias("state")))
    return both.groupBy("path", "state").agg(F.count("*").alias("n"))


def _scenario(spark, sf) -> tuple[str, str]:
    """(root, name) of a scenario with an ontology, a data file and a document, written on the driver."""
    root = _plain(folder(spark, "scenarios"))
    for part in ("schema", "data", "docs"):
        os.makedirs(f"{root}/trade/{part}", exist_ok=True)
    nations = star.table(spark, sf, "nation").orderBy("n_nationkey").collect()  # 25 rows
    with open(f"{root}/registry.json", "w") as f:
        json.dump({"scenarios": [{"name": "trade", "description": "nations", "version": "1", "location": "trade"}]}, f)
    with open(f"{root}/trade/manifest.json", "w") as f:
        json.dump({"name": "trade", "ontologies": ["nations.ttl"], "data_files": ["nations.csv"], "docs": ["about.md"]}, f)
    with open(f"{root}/trade/schema/nations.ttl", "w") as f:
        f.writelines(f"<urn:n:{r['n_nationkey']}> <urn:in> <urn:r:{r['n_regionkey']}> .\n" for r in nations)
    with open(f"{root}/trade/data/nations.csv", "w") as f:
        f.writelines(["key,name\n", *(f"{r['n_nationkey']},{r['n_name']}\n" for r in nations)])
    with open(f"{root}/trade/docs/about.md", "w") as f:
        f.write(" ".join(r["n_name"] for r in nations))
    return root, "trade"


@query("""select 'urn:n:' || n_nationkey s, 'urn:in' p, 'urn:r:' || n_regionkey o from nation union all select 'urn:csv:nations.csv:' || n_nationkey, 'urn:csv:prop:name', 'http://' || 'quadloom.local/' || n_name from nation""")
def src15_scenario_install(spark, sf):
    root, name = _scenario(spark, sf)
    e = engine.Engine(spark, folder(spark, "store"), access=engine.Access({"t": ["trade"]}), dimension=16, folder=_plain(folder(spark, "installed")), scenario_root=root)
    counts = e.call("install_scenario", {"name": name, "namespace": "trade"}, "t")
    assert counts["chunks"] == 1 and [s["name"] for s in e.call("list_scenarios")] == [name], counts
    return e.store.read("quads", "trade").select("s", "p", "o")


@query("select 'urn:n:' || n_nationkey s, 'urn:in' p, 'urn:r:' || n_regionkey o from nation where n_nationkey % 3 <> 2")
def src22_ontology_registry(spark, sf):
    """Three sources: a file, one by URL (fetched by a function given), and one that is switched off."""
    nations = star.table(spark, sf, "nation").collect()  # 25 rows
    lines = lambda k: "".join(f"<urn:n:{r['n_nationkey']}> <urn:in> <urn:r:{r['n_regionkey']}> .\n" for r in nations if r["n_nationkey"] % 3 == k)
    at = _plain(folder(spark, "registry"))
    own = [files.save_ontology(f"part{k}.ttl", lines(k), at) for k in (0, 2)]
    registry = files.OntologyRegistry(f"{at}/registry.json")
    registry.add(own[0])
    registry.add(own[1])
    registry.add("http://names.example/part1.ttl", "url")
    registry.toggle(own[1], False)
    again = files.OntologyRegistry(f"{at}/registry.json")
    return again.load(spark, _plain(folder(spark, "downloads")), lambda url: lines(1).encode()).select("s", "p", "o")


@query("select page_id, url, case when page_id % 5 <> 0 then 'page ' || page_id end html, page_id % 5 = 0 as failed from pages")
def src11_fetched_pages(spark, sf):
    """Every page's address fetched by the executors, by a function in place of the network; every fifth fails."""

    def fetch(url: str) -> bytes:
        if int(url.rsplit("#", 1)[1]) % 5 == 0:
            raise OSError("no answer")
        return f"page {url.rsplit('#', 1)[1]}".encode()

    p = star.table(spark, sf, "pages").select("page_id", "url", F.concat("url", F.lit("#"), F.col("page_id").cast("string")).alias("address"))
    got = exchange.fetch_pages(p, "address", fetch).withColumnRenamed("url", "address")
    return p.join(got, "address").select("page_id", "url", "html", F.col("problem").isNotNull().alias("failed"))


@query("select vec_id::varchar as key, 'urn:vec:' || vec_id uri from embeddings where label <> 3")
def src16_vector_file(spark, sf):
    """Vectors written as a file and read back; those of another dimension are left out."""
    e = star.table(spark, sf, "embeddings")
    size = F.when(F.col("label") == 3, F.slice("embedding", 1, 9)).otherwise(F.col("embedding"))
    path = folder(spark, "vectors")
    exchange.write_vectors(e.select(F.col("vec_id").cast("string").alias("key"), size.alias("embedding"), F.to_json(F.struct(F.concat(F.lit("urn:vec:"), F.col("vec_id").cast("string")).alias("uri"))).alias("metadata")), path)
    return exchange.read_vector_lines(spark, path, 64).select("key", "uri")


@query(f"select {NATION} uri, n_nationkey::int + 1 node_id, 26 next_id from nation")
def src17_id_map(spark, sf):
    at = _plain(folder(spark, "ids")) + ".json"
    with open(at, "w") as f:
        json.dump({"uri_to_id": {f"urn:csv:nation.csv:{r['n_nationkey']}": r["n_nationkey"] + 1 for r in star.table(spark, sf, "nation").collect()}, "next_id": 26}, f)  # 25 rows
    got, following = exchange.read_ids(spark, at)
    return got.withColumn("next_id", F.lit(following))


@query("select ceil(count(*) / 100.0)::bigint least_batches, count(*) n, true as bounded from customer")
def src19_row_batches(spark, sf):
    """Customers in batches of at most 100: no fewer than there must be, and none larger."""
    per = files.row_batches(star.table(spark, sf, "customer").coalesce(1), 100).groupBy("batch").agg(F.count("*").alias("k"))
    return per.agg(F.count("*").alias("least_batches"), F.sum("k").alias("n"), (F.max("k") <= 100).alias("bounded"))


@query("""select 'notion:' || c_custkey subject, 'http://purl.org/dc/terms/title' predicate, '"' || case when c_custkey % 7 = 0 then 'Untitled' else c_name end || '"' as object, 'notion_sync:urn:page:' || c_custkey source from customer
union all select 'notion:' || c_custkey, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'http://schema.org/Note', 'notion_sync:urn:page:' || c_custkey from customer""")
def src25_notes(spark, sf):
    k = F.col("c_custkey").cast("string")
    notes = star.table(spark, sf, "customer").select(k.alias("id"), F.when(F.col("c_custkey") % 7 == 0, "").otherwise(F.col("c_name")).alias("title"), F.concat(F.lit("urn:page:"), k).alias("url"))
    return exchange.note_triples(notes).select("subject", "predicate", "object", F.col("provenance.source").alias("source"))


# Store and service
@query(f"select {CUSTOMER} s, '{star.PROP}c_nationkey' p, {node('nation', 'c_nationkey')} o from customer")
def snk6_export_and_load(spark, sf):
    """A namespace written as N-Quads and loaded again."""
    e = engine.Engine(spark, folder(spark, "store"), dimension=16)
    e.store.add_quads(star.quads(spark, sf, "c_nationkey"))
    path = folder(spark, "dump")
    rdf.to_nquads(e.store.read("quads")).write.text(path)
    e.store.add_quads(rdf.read_nquads(spark, path, "copy"), "copy")
    return e.store.read("quads", "copy").select("s", "p", "o")


@query(f"select 'kept' ns, count(*) n from customer union all select 'dropped', 0")
def snk8_delete_namespace(spark, sf):
    e = engine.Engine(spark, folder(spark, "store"), access=engine.Access({"t": ["*"]}), dimension=16)
    for ns in ("kept", "dropped"):
        e.store.add_quads(star.quads(spark, sf, "c_nationkey", ns=ns), ns)
    e.call("delete_namespace", {"namespace": "dropped"}, "t")
    count = lambda ns: e.store.read("quads", ns).agg(F.lit(ns).alias("ns"), F.count("*").alias("n"))
    return count("kept").unionByName(count("dropped"))


@query("select count(*) filter (p_size > 25) active, count(*) filter (p_size <= 25) stale, count(*) total, count(*) filter (p_size <= 25) compacted from part")
def snk9_removed_vectors(spark, sf):
    """Vectors of some parts removed: they are stale, are found no more, and go with the next compaction."""
    e = engine.Engine(spark, folder(spark, "store"), dimension=16)
    p = star.table(spark, sf, "part")
    key = star.node("part", "p_partkey").alias("key")
    e.store.add_vectors(p.select(key, F.col("p_name").alias("content"), F.lit("{}").alias("metadata"), key.alias("uri")))
    e.store.remove_vectors(p.where("p_size <= 25").select(key))
    stats = durable(e.vector_stats())
    return stats.withColumn("compacted", F.lit(e.compact_vectors()).cast("long"))


@query("select count(*) n from (select 1 from customer union all select 1 from nation)")
def ag2_store_size(spark, sf):
    e = engine.Engine(spark, folder(spark, "store"), dimension=16)
    e.store.add_quads(star.quads(spark, sf, "c_nationkey", "n_regionkey"))
    return spark.createDataFrame([(e.size(),)], "n long")


@query("select distinct c_mktsegment source from customer")
def ag5_sources(spark, sf):
    prov = F.struct(F.when(F.col("c_custkey") % 11 > 0, F.col("c_mktsegment")).otherwise("").alias("source"), F.lit("").alias("timestamp"), F.lit("").alias("method"))
    return store.sources(star.table(spark, sf, "customer").select(F.col("c_name").alias("subject"), F.lit("urn:p").alias("predicate"), F.col("c_name").alias("object"), F.when(F.col("c_custkey") % 13 > 0, prov).alias("provenance")))


def _partly_valid(spark, sf) -> DataFrame:
    """A size of every part twice, one property that the ontology lacks, and sizes without a number."""
    p = star.table(spark, sf, "part")
    s = star.node("part", "p_partkey").alias("subject")
    size = p.select(s, F.lit("p_size").alias("predicate"), F.col("p_size").cast("string").alias("object"))
    return size.unionByName(size).unionByName(p.select(s, F.lit("p_unknown").alias("predicate"), F.col("p_brand").alias("object"))).unionByName(p.select(s, F.lit("p_size").alias("predicate"), F.lit("large").alias("object")))


@query("select 4 * count(*) \"input\", 2 * count(*) validated, count(*) duplicates, count(*) enriched, 2 * count(*) stored, 2 * count(*) errors from part")
def dq2_ingestion_counts(spark, sf):
    ontology = _vocabulary(spark).unionByName(spark.createDataFrame([("p_size", t.RDFS + "domain", "urn:part")], "s string, p string, o string"))
    return quality.ingestion(_partly_valid(spark, sf), ontology, "parts", rules=["domain_range"])[2]


@query(f"""select {PART} subject, 'p_size' predicate, p_size::varchar as object, 'parts' source, 'load' as method, false as inferred from part
union all select {PART}, '{t.RDF_TYPE}', 'urn:part', 'parts', 'load', true from part""")
def dq2_ingested_rows(spark, sf):
    ontology = _vocabulary(spark).unionByName(spark.createDataFrame([("p_size", t.RDFS + "domain", "urn:part")], "s string, p string, o string"))
    got = quality.ingestion(_partly_valid(spark, sf), ontology, "parts", {"method": "load"}, rules=["domain_range"])[0]
    return got.select("subject", "predicate", "object", "provenance.source", "provenance.method", "inferred")


@query("select 'first' run, 4 * count(*) \"input\", count(*) duplicates, count(*) stored from part union all select 'second', 4 * count(*), 2 * count(*), 0 from part")
def dq2_ingestion_pipeline(spark, sf):
    """The same rows twice through the service: the second time all are duplicates."""
    e = engine.Engine(spark, folder(spark, "store"), dimension=16)
    counts = [(k, n["input"], n["duplicates"], n["stored"]) for k in ("first", "second") for n in (e.ingest_pipeline(_partly_valid(spark, sf), _vocabulary(spark), "parts", skip_enrichment=True),)]
    return spark.createDataFrame(counts, "run string, input long, duplicates long, stored long")


@query("""with a as (select c_custkey, case c_mktsegment when 'BUILDING' then 'default' when 'MACHINERY' then 'team-' || c_nationkey else 'other' end ns, case c_custkey % 3 when 0 then 'reader' when 1 then 'team' end token, case c_custkey % 2 when 0 then 'read' else 'write' end op from customer)
select c_custkey, coalesce(case token when 'reader' then op = 'read' when 'team' then ns like 'team-%' else ns = 'default' end, false) as allowed from a""")
def flt6_flt7_flt8_access(spark, sf):
    """Namespace patterns, permissions and the open default namespace, for a call of every customer."""
    access = engine.Access({"reader": {"namespaces": ["*"], "permissions": {"write": False}}, "team": ["team-*"]})

    def may(token, ns, operation):
        try:
            access.check(token, ns, operation)
        except engine.Denied:
            return False
        return True

    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    ns = F.when(seg == "BUILDING", "default").when(seg == "MACHINERY", F.concat(F.lit("team-"), F.col("c_nationkey").cast("string"))).otherwise("other")
    token = F.when(k % 3 == 0, "reader").when(k % 3 == 1, "team")
    return star.table(spark, sf, "customer").select("c_custkey", F.udf(may, "boolean")(token, ns, F.when(k % 2 == 0, "read").otherwise("write")).alias("allowed"))


@query("select c_custkey, case c_custkey % 4 when 0 then '' when 1 then 'uri is missing' when 2 then 'uri has the wrong type' else 'direction must be one of outgoing, incoming, both' end problems from customer")
def flt14_arguments(spark, sf):
    """The arguments of a call about every customer checked before it runs."""
    k = F.col("c_custkey") % 4
    text = F.when(k == 0, F.concat(F.lit('{"uri": "'), "c_name", F.lit('", "direction": "both"}'))).when(k == 1, "{}").when(k == 2, F.concat(F.lit('{"uri": '), F.col("c_custkey").cast("string"), F.lit("}"))).otherwise(F.concat(F.lit('{"uri": "'), "c_name", F.lit('", "direction": "up"}')))
    check = F.udf(lambda x: "; ".join(arguments.problems("get_neighbors", json.loads(x))), "string")
    return star.table(spark, sf, "customer").select("c_custkey", check(text).alias("problems"))


@query(f"select node, round(score, 9) score, (row_number() over (order by score desc, depth, node))::int rank from (select {node('region', 'n_regionkey')} node, 1.0::double score, 1 depth from nation where n_nationkey = 3 union all select {CUSTOMER}, 1.0, 1 from customer where c_nationkey = 3)")
def tk3_neighbours_by_score(spark, sf):
    e = engine.Engine(spark, folder(spark, "store"), dimension=16)
    e.store.add_quads(star.quads(spark, sf, "c_nationkey", "n_regionkey"))
    got = e.neighbours("urn:csv:nation.csv:3", direction="both")
    return got.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "depth", "node"))).select("node", F.round("score", 9).alias("score"), "rank")


@query(f"select s, count(*) over () total_matches from (select {SUPPLIER} s from supplier) order by s limit 20")
def tk8_first_rows_and_total(spark, sf):
    return cypher.page(cypher.query(star.quads(spark, sf, "s_name", typed=("supplier",)), "MATCH (s:supplier) RETURN s"))


@query(f"select {NATION} uri, 'urn:in' predicate, {node('region', 'n_regionkey')} neighbour from nation where n_nationkey = 7")
def tk9_retrieve(spark, sf):
    """A nation's own name finds it first, with the edges around it."""
    e = engine.Engine(spark, folder(spark, "store"), dimension=64)
    n = star.table(spark, sf, "nation")
    uri = star.node("nation", "n_nationkey")
    e.store.add_vectors(n.select(uri.alias("key"), F.concat_ws(" ", "n_name", F.lit("of region"), F.col("n_regionkey").cast("string")).alias("content"), F.to_json(F.struct(uri.alias("uri"), F.col("n_name").alias("description"))).alias("metadata"), uri.alias("uri")))
    e.store.add_quads(star.quads(spark, sf, "n_regionkey").withColumn("p", F.lit("urn:in")))
    seven = n.where("n_nationkey = 7").first()
    asked = f"{seven['n_name']} of region {seven['n_regionkey']}"
    assert e.context(asked).startswith(seven["n_name"])
    best = e.retrieve(asked, k=3)
    return best.where(F.col("score") == best.agg(F.max("score")).first()[0]).select("uri", "predicate", "neighbour")


@query(f"""with d as (select node, count(*) k from (select {NATION} node from nation union all select {node('region', 'n_regionkey')} from nation) group by node)
select start, x.node, round(1 / sqrt(k), 9) score from (select {node('region', 'n_regionkey')} start, {NATION} node, row_number() over (partition by n_regionkey order by {NATION}) r from nation) x join d on x.node = d.node where r <= 2""")
def gr5_limit_per_node(spark, sf):
    """At most two nodes from each that is walked from, scored by the root of their degree."""
    quads = star.quads(spark, sf, "n_regionkey")
    got = graph.bfs(quads, star.table(spark, sf, "region").select(star.node("region", "r_regionkey")), 1, "incoming", limit_per_node=2, scoring="degree_sqrt")
    return got.select("start", "node", F.round("score", 9).alias("score"))


# Text
@query(f"select doc_uri, chunk_idx, c as text from (select 'urn:doc:' || k doc_uri, chunk_idx, c from ({word_chunks_sql('documents', 'doc_id', 'text', 1000, 200)}))")
def sc6_chunks_of_other_sizes(spark, sf):
    docs = star.table(spark, sf, "documents")
    return tx.with_chunks(docs, "text", F.concat(F.lit("urn:doc:"), F.col("doc_id").cast("string")), 1000, 200).select("doc_uri", "chunk_idx", "text")


@query("select p_partkey::varchar subject, p.* from part, lateral (values ('has_p_name', p_name), ('hasCategory_p_brand', p_brand), ('hasValue_p_size', p_size::varchar)) p(predicate, object)")
def sc12_profiled_triples(spark, sf):
    p = star.table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    rows = [("p_name", False, False, []), ("p_brand", False, True, []), ("p_size", True, False, [])]
    profile = spark.createDataFrame(rows, "column string, is_numeric boolean, is_category boolean, samples array<string>")
    return quality.profile_triples(p, "p_partkey", profile)


@query("select p_partkey, 'Part ' || p_partkey subject, 'has size' predicate, p_size::varchar as object from part union all select p_partkey, p_brand, 'makes', p_name from part")
def sc14_triples_from_answers(spark, sf):
    """Both notations of a triple in a made-up answer about every part."""
    k = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("Here is what I found: (Part "), k, F.lit(", has size, "), F.col("p_size").cast("string"), F.lit(') and ["'), "p_brand", F.lit('", "makes", "'), "p_name", F.lit('"], no more.'))
    return star.table(spark, sf, "part").select("p_partkey", F.explode(tx.model_triples(text)).alias("x")).select("p_partkey", "x.*")


@query("select p_partkey, 'MATCH (a:Supplier)-[r:supplies]->(b:Part) WHERE b = ' || chr(39) || p_name || chr(39) || ' RETURN a' as repaired from part")
def sc16_repaired_queries(spark, sf):
    fix = F.udf(lambda x: cypher.repaired(x, ["supplies", "located_in"], ["Supplier", "Part", "Nation"]), "string")
    text = F.concat(F.lit("MATCH (a:Suplier)-[r:suplies]->(b:Parts) WHERE b = '"), "p_name", F.lit("' RETURN a"))
    return star.table(spark, sf, "part").select("p_partkey", fix(text).alias("repaired"))


@query("select event_id, case event_type when 'purchase' then 'disambiguate' when 'view' then 'reason' when 'error' then 'ingest' else 'hybrid_search' end operation from events")
def sc24_routed_requests(spark, sf):
    text = F.when(F.col("event_type") == "purchase", "are these a DUPLICATE").when(F.col("event_type") == "view", "infer what follows").when(F.col("event_type") == "error", "please load it").otherwise("who made it")
    return star.table(spark, sf, "events").select("event_id", F.udf(cypher.route, "string")(text).alias("operation"))


@query("select p_partkey, 'Found:' || chr(10) || '- ' || p_name || chr(10) || '- ' || p_brand || chr(10) || chr(10) || 'Inferred:' || chr(10) || '- (' || p_name || ', is, ' || p_brand || ')' || chr(10) || '- by {\"types\": 1}' as evidence from part")
def sc23_evidence(spark, sf):
    """The evidence for an answer about every part, from a search, a failed tool and an inference."""
    form = F.udf(lambda n, b: answers.evidence([{"results": [{"description": n}, {"content": b}]}, {"error": "none"}, {"inferred_triples": [(n, "is", b)], "rules_applied": {"types": 1}}]), "string")
    return star.table(spark, sf, "part").select("p_partkey", form("p_name", "p_brand").alias("evidence"))


@query("select true as well_formed, count(*) n from region")
def sc20_time(spark, sf):
    """The time in RFC 3339, the same in all rows of a query."""
    form = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}[.][0-9]{6}[+]00:00$"
    return star.table(spark, sf, "region").select(t.now().alias("t")).agg((F.bool_and(F.col("t").rlike(form)) & (F.countDistinct("t") == 1)).alias("well_formed"), F.count("*").alias("n"))


@query("select vec_id::varchar as key from embeddings where label <> 3")
def em6_dimension_guard(spark, sf):
    e = star.table(spark, sf, "embeddings").withColumn("embedding", F.when(F.col("label") == 3, F.slice("embedding", 1, 63)).otherwise(F.col("embedding")))
    return vectors.of_dimension(e, 64).select(F.col("vec_id").cast("string").alias("key"))


@query("select doc_id, length(text) as first, 1.0::double as second from documents")
def em2_remote_embeddings(spark, sf):
    """A function of a batch of texts in the embedding slot, as a client of a remote model would be."""
    embed = vectors.embedder(function=lambda texts: [[float(len(x)), 1.0] for x in texts])
    got = star.table(spark, sf, "documents").select("doc_id", embed("text").alias("e"))
    return got.select("doc_id", F.col("e")[0].cast("long").alias("first"), F.col("e")[1].cast("double").alias("second"))


@query("select 'urn:n:' || n_nationkey s, 'urn:in' p, 'urn:r:' || n_regionkey o from nation")
def src13_downloaded_ontology(spark, sf):
    """An ontology by URL, saved under a plain name and loaded; a name that leaves the folder is refused."""
    nations = star.table(spark, sf, "nation").collect()  # 25 rows
    lines = "".join(f"<urn:n:{r['n_nationkey']}> <urn:in> <urn:r:{r['n_regionkey']}> .\n" for r in nations)
    at = _plain(folder(spark, "downloads"))
    path = exchange.download("http://names.example/nations.ttl", at, "nations.ttl", lambda url: lines.encode())
    try:
        exchange.download("http://names.example/nations.ttl", at, "../nations.ttl", lambda url: lines.encode())
    except ValueError:
        return rdf.parse_files(spark, path, None)[0].select("s", "p", "o")
    raise AssertionError("a path was taken for a name")


@query("select 'urn:n:' || n_nationkey s, 'urn:in' p, 'urn:r:' || n_regionkey o from nation union all select 'urn:csv:nations.csv:' || n_nationkey, 'urn:csv:prop:name', 'http://' || 'quadloom.local/' || n_name from nation")
def src14_remote_scenario(spark, sf):
    """A scenario that is not at hand, fetched file by file from its address."""
    root, name = _scenario(spark, sf)

    def fetch(url: str) -> bytes:
        with open(url.replace("http://scenarios.example", root), "rb") as f:
            return f.read()

    to = _plain(folder(spark, "installed"))
    quads, chunks, counts = files.install_scenario(spark, _plain(folder(spark, "nothing")), name, to, base_url="http://scenarios.example", fetch=fetch)
    assert counts == {"ontologies": 1, "data_files": 1, "docs": 1} and chunks.count() == 1, counts
    return quads.select("s", "p", "o")


@query("select least(500, n - 500 * k)::bigint n from (select count(*) n from part), generate_series(0, 1000000) g(k) where 500 * k < n")
def src23_client_batches(spark, sf):
    """A client's rows in calls of at most 500."""
    keys = [r[0] for r in star.table(spark, sf, "part").select("p_partkey").collect()]  # what a client holds
    return spark.createDataFrame([(len(b),) for b in files.iter_batches(keys, 500)], "n long")
