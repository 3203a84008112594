"""Store, graph, inference, vector, text and quality operators over the test tables, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.functions import terms as t
from quadloom.functions import text as tx
from quadloom.operators import graph, quality, reason, store, vectors
from quadloom.operators.loops import closure, durable
from quadloom.sources import files, rdf, star

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
PROP, PART_OF = star.PROP, "urn:csv:prop:partOf"


def query(sql: str | None = None):
    """Registers a function under its name, with SQL for its rows."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def node(table: str, key: str) -> str:
    return f"'urn:csv:{table}.csv:' || {key}"


NATION, CUSTOMER, ORDER, SUPPLIER, PART, REGION = (node(n, k) for n, k in (("nation", "n_nationkey"), ("customer", "c_custkey"), ("orders", "o_orderkey"), ("supplier", "s_suppkey"), ("part", "p_partkey"), ("region", "r_regionkey")))
UP = {"o": (ORDER, node("customer", "o_custkey"), "orders"), "c": (CUSTOMER, node("nation", "c_nationkey"), "customer"), "n": (NATION, node("region", "n_regionkey"), "nation")}
EDGES = " union all ".join(f"select {a} s, '{PROP}{c}' p, {b} o from {tb}" for (a, b, tb), c in zip(UP.values(), ("o_custkey", "c_nationkey", "n_regionkey")))


def spo(quads: DataFrame) -> DataFrame:
    return quads.select("s", "p", "o")


# Sources
@query(f"select {NATION} s, '{PROP}n_regionkey' p, 'urn:csv:region.csv:1' o from nation where n_regionkey = 1")
def src1_pattern_scan(spark, sf):
    return spo(star.quads(spark, sf, "n_name", "n_regionkey").where((F.col("p") == PROP + "n_regionkey") & (F.col("o") == "urn:csv:region.csv:1")))


@query(f"""select {CUSTOMER} subject, '{PROP}c_name' predicate, '"' || c_name || '"' as object, 'quadloom' source from customer union all select {CUSTOMER}, '{PROP}c_nationkey', {node('nation', 'c_nationkey')}, 'quadloom' from customer""")
def src2_full_scan(spark, sf):
    return store.api_rows(star.quads(spark, sf, "c_name", "c_nationkey")).select("subject", "predicate", "object", F.col("provenance.source").alias("source"))


@query(f"select '<' || s || '>' subject, '<' || p || '>' predicate, '<' || o || '>' as object from ({EDGES}) order by 1, 2, 3 limit 100")
def src3_limited_scan(spark, sf):
    return store.listed(star.quads(spark, sf, "o_custkey", "c_nationkey", "n_regionkey"), 100)


CSV_SQL = " union all ".join(f"select 'urn:csv:customer.csv:' || c_custkey subject, 'urn:csv:prop:{c}' predicate, {x} as object from customer where {c} is not null" for c, x in (("c_name", "c_name"), ("c_nationkey", "c_nationkey::varchar"), ("c_mktsegment", "c_mktsegment"), ("c_acctbal", "c_acctbal::decimal(18,2)::varchar")))


def csv_folder(spark: SparkSession, sf: str, encoding: str = "utf-8", **columns) -> str:
    """Customers as CSV under a path that ends in customer.csv."""
    path = f"{_folder(spark, 'csv')}/customer.csv"
    c = star.table(spark, sf, "customer").withColumn("c_acctbal", F.col("c_acctbal").cast("decimal(18,2)")).withColumns(columns)
    c.write.option("header", True).option("encoding", encoding).csv(path)
    return path


@query(CSV_SQL)
def src5_csv_triples(spark, sf):
    return files.csv_triples(spark, csv_folder(spark, sf))


@query(CSV_SQL)
def src10_file_by_extension(spark, sf):
    return files.ingestable(spark, csv_folder(spark, sf))


@query("select 'urn:csv:customer.csv:' || c_custkey subject, c_name || ' é' as object from customer")
def src18_csv_encoding(spark, sf):
    """Latin-1, which is told from UTF-8 by its bytes."""
    got = files.csv_triples(spark, csv_folder(spark, sf, "iso-8859-1", c_name=F.concat("c_name", F.lit(" é"))))
    return got.where("predicate = 'urn:csv:prop:c_name'").select("subject", "object")


@query(f"select {NATION} s, '{PROP}n_name' p, n_name o, 'lit' o_kind from nation union all select {NATION}, '{PROP}n_regionkey', {node('region', 'n_regionkey')}, 'iri' from nation")
def src7_turtle_files(spark, sf):
    path = _text(spark, rdf.to_nquads(star.quads(spark, sf, "n_name", "n_regionkey")), "turtle")
    return rdf.parse_files(spark, path, "part-*")[0].select("s", "p", "o", "o_kind")


@query(f"select 'urn:segment:' || c_mktsegment g, {CUSTOMER} s, '{PROP}c_name' p, c_name o, 'lit' o_kind from customer union all select 'urn:segment:' || c_mktsegment, {CUSTOMER}, '{PROP}c_nationkey', {node('nation', 'c_nationkey')}, 'iri' from customer")
def src9_nquads_files(spark, sf):
    quads = star.quads(spark, sf, "c_name", "c_nationkey", graph=F.expr("concat('urn:segment:', c_mktsegment)"))
    return rdf.read_nquads(spark, _text(spark, rdf.to_nquads(quads), "nquads")).select("g", "s", "p", "o", "o_kind")


def _folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    import uuid

    durable(spark.range(1))  # sets the folder where it is unset
    return f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def _text(spark: SparkSession, lines: DataFrame, name: str) -> str:
    """Writes a text file in the shared folder; its path."""
    path = _folder(spark, name)
    lines.write.text(path)
    return path


@query(r"""select page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script.*?</script>', ' ', 'gs'), '<style.*?</style>', ' ', 'gs'), '<[^>]*>', ' ', 'gs'), '\s+', ' ', 'g')) as text from pages""")
def src11_page_text(spark, sf):
    return star.table(spark, sf, "pages").select("page_id", tx.strip_html(F.col("html")).alias("text"))


def word_chunks_sql(table: str, key: str, text: str, size: int = 1000, overlap: int = 150) -> str:
    """A recursive query for the rows key, n (chunks of the text), chunk_idx, chunk; table: of key and text."""
    blank = r"^\s+|\s+$"
    return rf"""with recursive pieces as (select {key} k, unnest(regexp_extract_all({text}, '\S*\s|\S+')) p, generate_subscripts(regexp_extract_all({text}, '\S*\s|\S+'), 1) i from {table}),
placed as (select k, i, p, sum(strlen(p)) over (partition by k order by i)::bigint e from pieces),
texts as (select k, list(p order by i) ps, list_prepend(0, list(e order by i)) ends, count(*) n from placed group by k),
step as (
  select k, 0 no, 0 a, least(n, greatest(1, len(list_filter(ends, lambda x: x <= {size})) - 1)) b from texts
  union all
  select k, no + 1, na, least(n, greatest(b + 1, len(list_filter(ends, lambda x: x <= ends[na + 1] + {size})) - 1)) from (
    select s.k, no, b, n, ends, greatest(a, len(list_filter(ends, lambda x: x < ends[b + 1] - {overlap}))) na from step s join texts t on s.k = t.k where b < n)),
cut as (select s.k, no, regexp_replace(array_to_string(ps[a + 1:b], ''), '{blank}', '', 'g') c from step s join texts t on s.k = t.k),
chunks as (select k, c, row_number() over (partition by k order by no) - 1 chunk_idx, count(*) over (partition by k) n from cut where c <> '')
select k, c, chunk_idx::int chunk_idx, n from chunks"""


PAGE_TEXT = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script.*?</script>', ' ', 'gs'), '<style.*?</style>', ' ', 'gs'), '<[^>]*>', ' ', 'gs'), '\s+', ' ', 'g'))"""


@query(f"select url doc_uri, chunk_idx, url || '#chunk-' || chunk_idx chunk_uri, c as text, 'web_chunk' as type from ({word_chunks_sql(f'(select page_id, {PAGE_TEXT} as body from pages)', 'page_id', 'body')}) join pages on page_id = k")
def src11_page_chunks(spark, sf):
    return files.page_chunks(star.table(spark, sf, "pages"))


@query(f"select 'urn:doc:' || k doc_uri, chunk_idx, case when n > 1 then 'urn:doc:' || k || '#chunk-' || chunk_idx else 'urn:doc:' || k end chunk_uri, c as text, 'text_chunk' as type from ({word_chunks_sql('documents', 'doc_id', 'text')})")
def src12_text_chunks(spark, sf):
    return files.text_chunks(star.table(spark, sf, "documents"), "text", F.concat(F.lit("urn:doc:"), F.col("doc_id").cast("string")))


@query("select 'event_type' subject, 'hasValue' predicate, event_type as object from events union all select 'props', 'hasValue', props from events where length(props) < 100")
def src20_json_documents(spark, sf):
    docs = star.table(spark, sf, "events").select(F.to_json(F.struct("event_id", "event_type", "value", "props")).alias("j"))
    return files.json_triples(docs, "j")


DC = "http://purl.org/dc/elements/1.1/"


@query(f"""with d as (select strftime(ts, '%Y-%m-%d') d, event_type || ' by ' || user_id x from events)
select 'http://' || 'quadloom.local/memory/' || md5(d || '|' || x) subject, '{DC}date' predicate, '"' || d || '"' as object from d union all select 'http://' || 'quadloom.local/memory/' || md5(d || '|' || x), '{DC}description', '"' || x || '"' from d""")
def src24_memory_lines(spark, sf):
    """Every event as a line of a memory file, among lines that are none."""
    line = F.concat(F.lit("# notes\n- "), F.date_format("ts", "yyyy-MM-dd"), F.lit(": "), "event_type", F.lit(" by "), F.col("user_id").cast("string"), F.lit("\n- no date\n"))
    return files.memory_lines(star.table(spark, sf, "events").select(line.alias("text")), "text")


# Store
@query(f"select {CUSTOMER} s, '{PROP}c_mktsegment' p, c_mktsegment o from customer")
def snk1_insert_if_absent(spark, sf):
    present = star.quads(spark, sf, "c_nationkey")
    incoming = star.quads(spark, sf, "c_nationkey", "c_mktsegment")
    return spo(store.new_quads(present, incoming.unionByName(incoming)))


@query(f"""select '{t.PROV}' || p as p, o, count(*) n from (select distinct c_mktsegment m from customer), lateral (values ('wasDerivedFrom', m), ('generatedAtTime', ''), ('wasGeneratedBy', 'load')) v(p, o) group by 1, 2
union all select 'in batches', null, count(*) from customer""")
def snk2_provenance_batches(spark, sf):
    c = star.table(spark, sf, "customer")
    prov = F.struct(F.col("c_mktsegment").alias("source"), F.lit("").alias("timestamp"), F.lit("load").alias("method"))
    quads, meta = store.batched(c.select(star.node("customer", "c_custkey").alias("subject"), F.lit(PROP + "c_name").alias("predicate"), F.concat(F.lit('"'), "c_name", F.lit('"')).alias("object"), prov.alias("provenance")))
    placed = quads.where(F.col("g").startswith(store.BATCH)).agg(F.lit("in batches").alias("p"), F.lit(None).cast("string").alias("o"), F.count("*").alias("n"))
    return meta.groupBy("p", "o").agg(F.count("*").alias("n")).unionByName(placed)


@query(f"select uri, row_number() over (order by uri)::int node_id from (select {CUSTOMER} uri from customer union select {NATION} from nation union select {REGION} from region)")
def snk3_assign_ids(spark, sf):
    names = reduce(DataFrame.unionByName, (star.table(spark, sf, n).select(star.node(n, star.KEYS[n]).alias("uri")) for n in ("customer", "nation", "region")))
    return store.assign_ids(spark.createDataFrame([], "uri string, node_id int"), names)


@query(f"select {PART} as key, p_name metadata, {PART} uri, 384 dimension, 1.0::double length from part where p_size > 10")
def snk4_embed_if_absent(spark, sf):
    """Parts' names embedded, but for those the store has; each comes twice."""
    p = star.table(spark, sf, "part")
    rows = lambda p: p.select(star.node("part", "p_partkey").alias("key"), F.col("p_name").alias("content"), F.col("p_name").alias("metadata"), star.node("part", "p_partkey").alias("uri"))
    there = vectors.insert_absent(spark.createDataFrame([], vectors.VECTORS), rows(p.where("p_size <= 10")))
    fresh = vectors.insert_absent(there, rows(p.unionByName(p)))
    return fresh.select("key", "metadata", "uri", F.size("embedding").alias("dimension"), F.round(F.sqrt(vectors.dot(F.col("embedding"), F.col("embedding"))), 4).alias("length"))


@query(f"""select {NATION} || '|{PROP}n_regionkey|' || {node('region', 'n_regionkey')} as key, {NATION} || ' {PROP}n_regionkey ' || {node('region', 'n_regionkey')} as content, {NATION} uri,
'{{"uri":"' || {NATION} || '","predicate":"{PROP}n_regionkey","object":"' || {node('region', 'n_regionkey')} || '","type":"triple"}}' metadata from nation""")
def snk5_triple_vectors(spark, sf):
    return vectors.triple_vectors(star.quads(spark, sf, "n_regionkey").select(F.col("s").alias("subject"), F.col("p").alias("predicate"), F.col("o").alias("object")))


def _vectors(spark, sf) -> DataFrame:
    return star.table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("key"), "embedding", F.to_json(F.struct(F.concat(F.lit("urn:vec:"), F.col("vec_id").cast("string")).alias("uri"))).alias("metadata"), F.concat(F.lit("urn:vec:"), F.col("vec_id").cast("string")).alias("uri"), "label")


@query("select vec_id::varchar as key, label from embeddings where label <> 3")
def snk10_compact(spark, sf):
    v = _vectors(spark, sf)
    return vectors.compacted(v, v.where("label <> 3").select("key")).select("key", "label")


@query("select count(*) filter (label <> 3) active, count(*) filter (label = 3) stale, count(*) total from embeddings")
def ag3_vector_stats(spark, sf):
    v = _vectors(spark, sf)
    return vectors.stats(v, v.where("label <> 3").select("key"))


@query(f"select c content, case when n is null then 0 else n end::int node_id, n is not null as found from (select {NATION} c, row_number() over (order by {NATION}) n from nation union all select 'urn:none:' || n_nationkey, null from nation)")
def gr8_resolve(spark, sf):
    n = star.table(spark, sf, "nation")
    known = store.assign_ids(spark.createDataFrame([], "uri string, node_id int"), n.select(star.node("nation", "n_nationkey").alias("uri")))
    asked = n.select(star.node("nation", "n_nationkey").alias("content")).union(n.select(F.concat(F.lit("urn:none:"), F.col("n_nationkey").cast("string"))))
    return store.resolve(known, asked)


@query("select subject, predicate, object, md5(subject || '|' || predicate || '|' || object) hash from (select distinct 'u' || user_id subject, 'did' predicate, event_type as object from events)")
def set3_hash_dedupe(spark, sf):
    e = star.table(spark, sf, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("subject"), F.lit("did").alias("predicate"), F.col("event_type").alias("object"))
    return quality.deduplicated(e)


# Terms and filters
@query(f"select p_partkey, 'http://' || 'quadloom.local/' || p_name bare, 'urn:x:' || p_partkey bracketed, 'http://' || 'quadloom.local/file://' || p_partkey file from part")
def flt4_normalised_uris(spark, sf):
    k = F.col("p_partkey").cast("string")
    return star.table(spark, sf, "part").select("p_partkey", t.ensure_uri("p_name").alias("bare"), t.ensure_uri(F.concat(F.lit("<<urn:x:"), k, F.lit(">"))).alias("bracketed"), t.ensure_uri(F.concat(F.lit("file://"), k)).alias("file"))


@query("select p_partkey, o, case when o like '\"%\"' then 'lit' else 'iri' end kind, case when o like '\"%\"' then substr(o, 2, length(o) - 2) else 'http://quadloom.local/' || o end as value from (select p_partkey, case when p_size > 25 then '\"' || p_name || '\"' else p_name end o from part)")
def flt5_literals(spark, sf):
    p = star.table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") > 25, F.concat(F.lit('"'), "p_name", F.lit('"'))).otherwise(F.col("p_name")).alias("o"))
    quads = t.triples_to_quads(p.select(F.col("p_partkey").cast("string").alias("subject"), F.lit("name").alias("predicate"), F.col("o").alias("object")))
    got = quads.select(F.regexp_extract("s", "[0-9]+$", 0).cast("long").alias("p_partkey"), F.col("o_kind").alias("kind"), F.col("o").alias("value"))
    return got.join(p, "p_partkey").select("p_partkey", "o", "kind", "value")


@query("select p_partkey, p_name || '/' || p_brand iri, p_brand label, regexp_replace(p_brand, '^.*#', '') local from part")
def sc3_labels(spark, sf):
    iri = F.concat("p_name", F.lit("/"), "p_brand")
    return star.table(spark, sf, "part").select("p_partkey", iri.alias("iri"), t.label(iri).alias("label"), t.local_name(iri).alias("local"))


@query("select a.p_partkey, round(1 - levenshtein(lower(a.p_name), lower(b.n_name))::double / greatest(length(a.p_name), length(b.n_name)), 9) similarity, b.n_nationkey from part a, nation b")
def sc2_similarity(spark, sf):
    a, b = star.table(spark, sf, "part"), star.table(spark, sf, "nation")
    return a.crossJoin(b).select("p_partkey", F.round(t.similarity("p_name", "n_name"), 9).alias("similarity"), "n_nationkey")


# Graph
@query(f"with e as ({EDGES}) select node, count(*) degree from (select s node from e union all select o from e) group by node")
def ag1_degrees(spark, sf):
    return graph.degrees(star.quads(spark, sf, "o_custkey", "c_nationkey", "n_regionkey"))


@query(f"with e as ({EDGES}) select s, p, o from e where p like '%nation%'")
def flt1_edge_filter(spark, sf):
    quads = star.quads(spark, sf, "o_custkey", "c_nationkey", "n_regionkey")
    starts = quads.select("s").distinct()
    return graph.bfs(quads, starts, 1, edge_filter="nation").select(F.col("start").alias("s"), F.col("edge_type").alias("p"), F.col("node").alias("o"))


@query(f"select 'urn:csv:nation.csv:' || n_nationkey start, {SUPPLIER} node, '{PROP}s_nationkey' edge_type, 1 depth, 1.0::double score from nation join supplier on s_nationkey = n_nationkey")
def flt2_node_type_filter(spark, sf):
    quads = star.quads(spark, sf, "c_nationkey", "s_nationkey", typed=("supplier",))
    starts = star.table(spark, sf, "nation").select(star.node("nation", "n_nationkey"))
    return graph.bfs(quads, starts, 1, "incoming", node_type=star.CLASS + "supplier").select("start", "node", "edge_type", "depth", "score")


@query(f"""with e as ({EDGES}), b as (select o a, s b from e)
select a.a start, a.b node, 1 depth, 1.0::double score from b a where a.a like 'urn:csv:region%'
union all select x.a, y.b, 2, 0.5 from b x join b y on x.b = y.a where x.a like 'urn:csv:region%'
union all select x.a, z.b, 3, 1.0 / 3 from b x join b y on x.b = y.a join b z on y.b = z.a where x.a like 'urn:csv:region%'""")
def gr1_bfs_three_hops(spark, sf):
    quads = star.quads(spark, sf, "o_custkey", "c_nationkey", "n_regionkey")
    return graph.bfs(quads, star.table(spark, sf, "region").select(star.node("region", "r_regionkey")), 3, "incoming").select("start", "node", "depth", "score")


@query(f"""with e as ({EDGES}), d as (select node, count(*) k from (select s node from e union all select o from e) group by node)
select o start, s node, round(1.0 / greatest(ln(k + 1), 0.1), 9) score from e join d on s = node where o like 'urn:csv:nation%'""")
def gr4_degree_scores(spark, sf):
    quads = star.quads(spark, sf, "o_custkey", "c_nationkey", "n_regionkey")
    got = graph.bfs(quads, star.table(spark, sf, "nation").select(star.node("nation", "n_nationkey")), 1, "incoming", scoring="degree")
    return got.select("start", "node", F.round("score", 9).alias("score"))


@query(f"select 'incoming' direction, '{PROP}c_nationkey' predicate, {CUSTOMER} uri, 1.0::double score from customer where c_nationkey = 2 union all select 'incoming', '{PROP}s_nationkey', {SUPPLIER}, 1.0 from supplier where s_nationkey = 2 union all select 'outgoing', '{PROP}n_regionkey', {node('region', 'n_regionkey')}, 1.0 from nation where n_nationkey = 2")
def gr2_neighbours_once(spark, sf):
    return graph.neighbours_once(star.quads(spark, sf, "c_nationkey", "s_nationkey", "n_regionkey"), "urn:csv:nation.csv:2", "both")


@query(f"select start, node from (select {node('region', 'n_regionkey')} start, {NATION} node, row_number() over (partition by n_regionkey order by {NATION}) r from nation) where r <= 3")
def wn1_layer_limit(spark, sf):
    quads = star.quads(spark, sf, "n_regionkey")
    return graph.bfs(quads, star.table(spark, sf, "region").select(star.node("region", "r_regionkey")), 1, "incoming", limit_per_layer=3).select("start", "node")


@query(f"select {ORDER} seed, {node('customer', 'o_custkey')} uri from orders union all select {ORDER}, {node('nation', 'c_nationkey')} from orders join customer on o_custkey = c_custkey")
def gr6_expand(spark, sf):
    return graph.expand(star.quads(spark, sf, "o_custkey", "c_nationkey"), star.table(spark, sf, "orders").select(star.node("orders", "o_orderkey")), 2)


def _asked(spark, sf) -> DataFrame:
    """q, embedding: the searches' queries, every vector whose id 20 divides."""
    return star.table(spark, sf, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), "embedding")


DISTANCE = "list_distance(a.embedding::double[], b.embedding::double[])"
KNN = f"select a.vec_id q, b.vec_id, b.label, floor({DISTANCE} * 1e6)::bigint d, row_number() over (partition by a.vec_id order by floor({DISTANCE} * 1e6), b.vec_id::varchar) r from embeddings a, embeddings b where a.vec_id % 20 = 0"
COSINE = "list_cosine_similarity(a.embedding::double[], b.embedding::double[])"


@query(f"select q, r::int rank, vec_id::varchar as key, d, round(1 / (1 + d / 1e6), 9) score from ({KNN}) where r <= 10")
def tk1_nearest(spark, sf):
    got = vectors.nearest_join(_asked(spark, sf), _vectors(spark, sf), 10, "q", "embedding")
    return got.select("q", "rank", "key", vectors.quantised(F.col("distance")).alias("d"), F.round(vectors.score(F.col("distance")), 9).alias("score"))


@query(f"select q, r::int rank, k as key, round(s, 6) score from (select a.vec_id q, b.vec_id::varchar k, {COSINE} s, row_number() over (partition by a.vec_id order by round({COSINE}, 12) desc, b.vec_id::varchar) r from embeddings a, embeddings b where a.vec_id % 20 = 0) where r <= 5")
def tk7_nearest_cosine(spark, sf):
    got = vectors.nearest_join(_asked(spark, sf), _vectors(spark, sf), 5, "q", "embedding", metric="cosine")
    return got.select("q", "rank", "key", F.round("score", 6).alias("score"))


@query(f"select vec_id::varchar as key, d, round(1 / (1 + d / 1e6), 9) score from ({KNN}) where q = 0 order by d, vec_id::varchar limit 10")
def tk2_nearest_of_one(spark, sf):
    """One vector's neighbours over all rows: what a single call of the service asks for."""
    first = list(star.table(spark, sf, "embeddings").where("vec_id = 0").first()["embedding"])
    got = vectors.nearest(_vectors(spark, sf), first, 10)
    return got.select("key", vectors.quantised(F.col("distance")).alias("d"), F.round("score", 9).alias("score"))


@query("select vec_id, rank::int rank, key, d from (select a.vec_id, b.vec_id as key, row_number() over (partition by a.vec_id order by floor(list_distance(a.embedding::double[], b.embedding::double[]) * 1e6), b.vec_id) rank, round(list_distance(a.embedding::double[], b.embedding::double[]), 5) d from embeddings a, embeddings b) where rank <= 3")
def jn12_nearest_join(spark, sf):
    e = star.table(spark, sf, "embeddings")
    got = vectors.nearest_join(e, e.select(F.col("vec_id").alias("key"), "embedding"), 3, "vec_id", "embedding")
    return got.select("vec_id", "rank", "key", F.round("distance", 5).alias("d"))


@query(f"""with h as (select q, 'urn:vec:' || vec_id uri, label, 1 / (1 + d / 1e6) score from ({KNN}) where r <= 10),
a as (select q, uri, score from h union all select q, 'urn:label:' || label, score * 0.8 from h),
m as (select q, uri, max(score) score from a group by q, uri)
select * from (select q, (row_number() over (partition by q order by score desc, uri))::int rank, uri, round(score, 9) score from m) where rank <= 20""")
def gr7_hybrid(spark, sf):
    v = _vectors(spark, sf)
    edges = v.select(F.col("uri").alias("subject"), F.lit("urn:has").alias("predicate"), F.concat(F.lit("urn:label:"), F.col("label").cast("string")).alias("object"))
    return graph.hybrid_join(t.triples_to_quads(edges), v.drop("label"), _asked(spark, sf)).withColumn("score", F.round("score", 9))


@query(f"select q, (row_number() over (partition by q order by 1 / (1 + d / 1e6) desc, 'urn:vec:' || vec_id) - 1)::int node_id, 'urn:vec:' || vec_id uri from ({KNN}) where r <= 5")
def tk6_ranked_search(spark, sf):
    v = _vectors(spark, sf)
    return graph.hybrid_join(t.empty_quads(spark), v.drop("label"), _asked(spark, sf), 5, 0, mode="vector_only").select("q", (F.col("rank") - 1).alias("node_id"), "uri")


# Inference
FOLLOWING = "select distinct event_type || '-' || user_id a, nxt || '-' || user_id b from (select *, lead(event_type) over (partition by user_id order by ts, event_id) nxt from events) where nxt is not null"


@query(f"with recursive e as ({FOLLOWING}), r(a, b) as (select a, b from e union select r.a, e.b from r join e on r.b = e.a) select a, b from r")
def rs18_cyclic_closure(spark, sf):
    return closure(star.following(spark, sf))


@query(f"""select {ORDER} s, {node('nation', 'c_nationkey')} o from orders join customer on o_custkey = c_custkey
union all select {ORDER}, {node('region', 'n_regionkey')} from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
union all select {CUSTOMER}, {node('region', 'n_regionkey')} from customer join nation on c_nationkey = n_nationkey""")
def rs2_subclass_closure(spark, sf):
    return reason.materialise(star.hierarchy(spark, sf, reason.SUBCLASS), "rdfs").select("s", "o")


@query(f"""select {ORDER} s, {node('nation', 'c_nationkey')} o from orders join customer on o_custkey = c_custkey
union all select {CUSTOMER}, {node('region', 'n_regionkey')} from customer join nation on c_nationkey = n_nationkey""")
def rs6_single_pass(spark, sf):
    return reason.apply(star.hierarchy(spark, sf, reason.SUBCLASS), "rdfs").select("s", "o")


def _declared(spark, *rows: tuple[str, str, str]) -> DataFrame:
    return t.triples_to_quads(spark.createDataFrame(list(rows), "subject string, predicate string, object string"))


@query(f"""with e as (select {CUSTOMER} s, {node('nation', 'c_nationkey')} o from customer union all select {NATION}, {node('region', 'n_regionkey')} from nation),
c as (select s, o from e union select {CUSTOMER}, {node('region', 'n_regionkey')} from customer join nation on c_nationkey = n_nationkey)
select s, '{PART_OF}' p, o from c where (s, o) not in (select s, o from e)
union all select o, 'urn:has', s from c""")
def rs3_transitive_and_inverse(spark, sf):
    edges = star.quads(spark, sf, "c_nationkey", "n_regionkey").withColumn("p", F.lit(PART_OF))
    schema = _declared(spark, (PART_OF, t.RDF_TYPE, t.OWL + "TransitiveProperty"), (PART_OF, reason.INVERSE, "urn:has"))
    return reason.materialise(edges.unionByName(schema), "owlrl")


@query(f"select {node('nation', 's_nationkey')} s, 'urn:near' p, {SUPPLIER} o from supplier")
def rs4_symmetric(spark, sf):
    edges = star.quads(spark, sf, "s_nationkey").withColumn("p", F.lit("urn:near"))
    return reason.materialise(edges.unionByName(_declared(spark, ("urn:near", t.RDF_TYPE, t.OWL + "SymmetricProperty"))), "owlrl")


@query("select 'none' strategy, 0::bigint n union all select 'rdfs', count(*) from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey union all select 'rdfs', 0 where false")
def rs1_strategies(spark, sf):
    """How much each strategy adds; orders below customers below nations, without the regions."""
    quads = star.quads(spark, sf, "o_custkey", "c_nationkey").withColumn("p", F.lit(reason.SUBCLASS))
    return reduce(DataFrame.unionByName, (reason.materialise(quads, k).agg(F.lit(k).alias("strategy"), F.count("*").alias("n")) for k in ("none", "rdfs"))).select("strategy", "n")


def _ontology(spark) -> DataFrame:
    c, r = star.CLASS, t.RDFS
    rows = [
        *((c + x, t.RDF_TYPE, t.OWL + "Class") for x in ("customer", "supplier", "party", "agent", "nation", "region", "place")),
        (c + "customer", reason.SUBCLASS, c + "party"), (c + "supplier", reason.SUBCLASS, c + "party"), (c + "party", reason.SUBCLASS, c + "agent"),
        *((PROP + p, t.RDF_TYPE, t.OWL + "ObjectProperty") for p in ("c_nationkey", "s_nationkey", "n_regionkey")),
        *((PROP + p, t.RDF_TYPE, t.OWL + "DatatypeProperty") for p in ("c_name", "p_size", "p_name")),
        (PROP + "c_nationkey", r + "domain", c + "customer"), (PROP + "c_nationkey", r + "range", c + "nation"), (PROP + "c_nationkey", reason.SUBPROPERTY, "urn:in"),
        (PROP + "c_nationkey", reason.INVERSE, "urn:hosts"), (PROP + "p_size", r + "range", t.XSD + "decimal"), (c + "party", r + "label", "Partner"),
    ]
    return spark.createDataFrame(rows, "s string, p string, o string")


def _vocabulary(spark) -> DataFrame:
    """The ontology under IRIs whose local names are plain."""
    plain = lambda c: F.regexp_replace(c, "^urn:csv:(class|prop):", "http://quadloom.local/$1/")
    return _ontology(spark).select(plain("s").alias("s"), "p", plain("o").alias("o"))


IN_NATION = f"select {CUSTOMER} s, '{PROP}c_nationkey' p, {node('nation', 'c_nationkey')} o from customer"
TYPE, CLS = t.RDF_TYPE, star.CLASS
EXTENDED = f"""select 'types' rule, {CUSTOMER} s, '{TYPE}' p, '{CLS}' || k o from customer, (values ('party'), ('agent')) v(k)
union all select 'inverse', {node('nation', 'c_nationkey')}, 'urn:hosts', {CUSTOMER} from customer
union all (select distinct 'domain_range', {node('nation', 'c_nationkey')}, '{TYPE}', '{CLS}nation' from customer)"""


@query(EXTENDED)
def rs15_extended_rules(spark, sf):
    return reason.infer(spo(star.quads(spark, sf, "c_nationkey", typed=("customer",))), _ontology(spark))


@query(f"""with o as (select {ORDER} o, {node('customer', 'o_custkey')} c, {node('nation', 'c_nationkey')} n from orders join customer on o_custkey = c_custkey)
select 'transitive' rule, o s, 'urn:within' p, n o from o
union all select 'symmetric', c, 'urn:near', o from o
union all select 'subclass', o, '{reason.SUBCLASS}', n from o""")
def rs9_rs11_rs13_rules(spark, sf):
    """Transitive, symmetric and subclass rules, each over every order."""
    edges = star.quads(spark, sf, "o_custkey", "c_nationkey").select("s", "p", "o")
    orders = edges.where(F.col("p") == PROP + "o_custkey")
    named = lambda df, p: df.select("s", F.lit(p).alias("p"), "o")
    triples = reduce(DataFrame.unionByName, (named(edges, "urn:within"), named(orders, "urn:near"), named(edges, reason.SUBCLASS)))
    ontology = spark.createDataFrame([("urn:within", t.RDF_TYPE, t.OWL + "TransitiveProperty"), ("urn:near", t.RDF_TYPE, t.OWL + "SymmetricProperty")], "s string, p string, o string")
    return reason.infer(triples, ontology, ["transitive", "symmetric", "subclass"])


@query(f"with i as ({EXTENDED}), n as (select 2 * count(*) n from customer), m as (select count(*) m from i) select rule, count(*) inferred, round((n + m) / n::double, 9) expansion_ratio from i, n, m group by rule, n, m")
def ag6_inference_report(spark, sf):
    triples = spo(star.quads(spark, sf, "c_nationkey", typed=("customer",)))
    inferred = durable(reason.infer(triples, _ontology(spark)))
    return reason.inference_report(triples, inferred).withColumn("expansion_ratio", F.round("expansion_ratio", 9))


@query(f"""{IN_NATION} union all select {CUSTOMER}, 'urn:in', {node('nation', 'c_nationkey')} from customer
union all select {CUSTOMER}, '{TYPE}', '{CLS}' || k from customer, (values ('customer'), ('party'), ('agent')) v(k)
union all (select distinct {node('nation', 'c_nationkey')}, '{TYPE}', '{CLS}nation' from customer)""")
def rs17_expand_triples(spark, sf):
    return reason.expand_triples(spo(star.quads(spark, sf, "c_nationkey")), _ontology(spark))


@query("select c_custkey, c_mktsegment, case when c_mktsegment = 'BUILDING' then 'urn:known:building' else 'http://quadloom.local/concept/' || c_mktsegment end uri from customer")
def rs16_resolve_names(spark, sf):
    known = spark.createDataFrame([("Building", "urn:known:building")], "name string, iri string")
    return reason.resolve_names(star.table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", known)


# Quality
@query("select p_partkey, 'p_size' property, true as valid from part union all select p_partkey, 'p_brandx', false from part union all select p_partkey, 'p size', false from part")
def dq1_validate(spark, sf):
    p = star.table(spark, sf, "part")
    s = star.node("part", "p_partkey").alias("subject")
    rows = p.select("p_partkey", s, F.lit("p_size").alias("predicate"), F.col("p_size").cast("string").alias("object"))
    rows = rows.union(p.select("p_partkey", s, F.lit("p_brandx"), F.col("p_brand"))).union(p.select("p_partkey", s, F.lit("p size"), F.lit("large")))
    got = quality.validate(rows.drop("p_partkey"), _vocabulary(spark))
    return got.select(F.regexp_extract("subject", "[0-9]+$", 0).cast("long").alias("p_partkey"), F.col("predicate").alias("property"), "valid")


@query("select 2 * count(*) total, count(*) valid, count(*) invalid, count(*) corrections, 0.5::double accuracy from part")
def dq1_report(spark, sf):
    p = star.table(spark, sf, "part")
    s = star.node("part", "p_partkey").alias("subject")
    rows = p.select(s, F.lit("p_size").alias("predicate"), F.col("p_size").cast("string").alias("object")).union(p.select(s, F.lit("p_sizes"), F.col("p_brand")))
    return quality.validation_report(quality.validate(rows, _vocabulary(spark)))


@query("""with n as (select distinct p_name x from part union select n_name from nation)
select a.x a, b.x b, round(1 - levenshtein(lower(a.x), lower(b.x))::double / greatest(length(a.x), length(b.x)), 9) similarity from n a join n b on a.x < b.x
where 1 - levenshtein(lower(a.x), lower(b.x))::double / greatest(length(a.x), length(b.x)) >= 0.8""")
def dq3_merge_suggestions(spark, sf):
    names = star.table(spark, sf, "part").select(F.col("p_name").alias("x")).union(star.table(spark, sf, "nation").select("n_name"))
    return quality.suggest_merges(names, "x", 0.8).select("a", "b", F.round("similarity", 9).alias("similarity"))


@query("""select c_custkey, case when c_custkey % 4 = 0 then 'http://quadloom.local/class/customer' when c_custkey % 4 = 1 then 'http://quadloom.local/class/party' when c_custkey % 4 = 2 then 'http://quadloom.local/class/nation' end as match from customer""")
def dq4_match_class(spark, sf):
    """Terms of every customer: a name, a label in another case, a name in another case, and what is neither."""
    k = F.col("c_custkey") % 4
    term = F.when(k == 0, "customer").when(k == 1, "PARTNER").when(k == 2, "nAtion").otherwise(F.col("c_mktsegment"))
    return quality.match_class(star.table(spark, sf, "customer").select("c_custkey", term.alias("x")), "x", _vocabulary(spark)).select("c_custkey", "match")


@query("select 'http://quadloom.local/class/' || k iri, k as name, lbl label from (values ('customer', null), ('supplier', null), ('party', 'Partner'), ('agent', null), ('nation', null), ('region', null), ('place', null)) v(k, lbl)")
def dq5_class_catalog(spark, sf):
    o = _vocabulary(spark)
    return quality.labelled(o, quality.classes(o))


@query("select (select count(distinct p_type) from part) classes, (select count(distinct p_brand) from part) properties, (select count(distinct p_type) + count(distinct p_brand) from part) + (select count(*) from part) triples")
def ag10_ontology_stats(spark, sf):
    """Part types as classes, brands as properties, parts as their instances."""
    p = star.table(spark, sf, "part")
    kind = lambda c, o: p.select(F.concat(F.lit(f"urn:{c}:"), c).alias("s"), F.lit(t.RDF_TYPE).alias("p"), F.lit(o).alias("o")).distinct()
    own = p.select(star.node("part", "p_partkey").alias("s"), F.lit(t.RDF_TYPE).alias("p"), F.concat(F.lit("urn:p_type:"), "p_type").alias("o"))
    return quality.ontology_stats(kind("p_type", t.OWL + "Class").unionByName(kind("p_brand", t.OWL + "ObjectProperty")).unionByName(own))


@query(f"select {CUSTOMER} iri from customer")
def dq5_instances(spark, sf):
    return quality.instances(spo(star.quads(spark, sf, "c_nationkey", typed=("customer",))), star.CLASS + "customer")


SIGNAL = "case event_type when 'purchase' then 'user_positive' when 'error' then 'error' when 'view' then 'token_usage' else event_type end"


@query(f"""with r as (select {SIGNAL} signal, case {SIGNAL} when 'user_positive' then 2.0 when 'error' then -0.5 when 'token_usage' then -0.01 * coalesce(value, 0) / 100 else 0 end r from events)
select signal, round(sum(r)::double, 4) total from r group by 1 union all select null, round(sum(r)::double, 4) from r""")
def ag8_rewards(spark, sf):
    signal = F.when(F.col("event_type") == "purchase", "user_positive").when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "token_usage").otherwise(F.col("event_type"))
    e = star.table(spark, sf, "events").withColumn("signal", signal)
    return quality.reward_breakdown(quality.reward_events(e, "signal", F.coalesce("value", F.lit(0.0))), "signal").withColumn("total", F.round("total", 4))


def _sessions(spark, sf) -> DataFrame:
    e = star.table(spark, sf, "events")
    return e.select(F.col("event_type").alias("input"), F.col("props").alias("output"), F.when(F.col("event_type") == "purchase", "positive").when(F.col("event_type") == "error", "negative").alias("feedback"), F.col("value").alias("air_reward"))


@query("select count(*) total, count(*) filter (event_type in ('purchase', 'error')) with_feedback, count(*) filter (event_type = 'purchase') positive, round(avg(value), 6) mean_reward, round(count(*) filter (event_type = 'purchase') / count(*) filter (event_type in ('purchase', 'error'))::double, 9) positive_rate from events")
def ag9_session_statistics(spark, sf):
    got = quality.session_statistics(_sessions(spark, sf))
    return got.withColumn("mean_reward", F.round("mean_reward", 6)).withColumn("positive_rate", F.round("positive_rate", 9))


@query("select event_type as text, props output, case when event_type = 'purchase' then 'positive' else 'negative' end feedback, value reward from events where event_type in ('purchase', 'error')")
def snk11_training_rows(spark, sf):
    return quality.training_rows(_sessions(spark, sf))


@query("""with h as (select * from part order by p_partkey limit 100),
c as (select k as "column", v from (select 'p_partkey' k, p_partkey::varchar v from h union all select 'p_name', p_name from h union all select 'p_brand', p_brand from h union all select 'p_type', p_type from h union all select 'p_size', p_size::varchar from h) where v <> '')
select "column", bool_and(try_cast(v as double) is not null) is_numeric, count(distinct v) < 20 is_category, array_to_string(list_sort(list(distinct v))[1:5], ',') samples from c group by 1""")
def ag11_column_profile(spark, sf):
    head = star.table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size").orderBy("p_partkey").limit(100)  # a profile is of the first rows
    return quality.column_profile(head).withColumn("samples", F.concat_ws(",", "samples"))


@query("select conv_id, turn, lag(role, 1) over w previous_1, lag(role, 2) over w previous_2, round((row_number() over w - 1) / (count(*) over (partition by conv_id))::double, 9) as position from conversations window w as (partition by conv_id order by turn)")
def wn3_row_context(spark, sf):
    got = quality.row_context(star.table(spark, sf, "conversations"), "turn", F.col("role"), by="conv_id")
    return got.select("conv_id", "turn", "previous_1", "previous_2", F.round("position", 9).alias("position"))


@query("select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) r from events) where r <= 10")
def wn2_keep_last(spark, sf):
    return quality.keep_last(star.table(spark, sf, "events"), "user_id", 10, "ts", "event_id").select("user_id", "event_id")


@query("select c_custkey, 'c_name: ' || c_name || ' | c_nationkey: ' || c_nationkey || ' | c_mktsegment: ' || c_mktsegment as text from customer")
def sc22_row_text(spark, sf):
    c = star.table(spark, sf, "customer")
    return c.select("c_custkey", tx.row_text(c, ["c_name", "c_nationkey", "c_mktsegment"]).alias("text"))


@query("select p_partkey::varchar subject, 'isA' predicate, p_type as object from part union all select p_partkey::varchar, 'p_name', p_name from part union all select p_partkey::varchar, 'p_brand', p_brand from part")
def sc13_header_rules(spark, sf):
    return tx.row_triples(star.table(spark, sf, "part").select("p_partkey", "p_type", "p_name", "p_brand"))


@query("""select 'urn:market' subject, 'has_segment' predicate, k as object from customer, (values ('building'), ('machinery'), ('customer_00')) v(k) where contains(lower(c_mktsegment || ' ' || c_name), lower(k)) union all select 'urn:market', 'has_segment', 'customer#' from customer where contains(lower(c_mktsegment || ' ' || c_name), 'customer#')""")
def sc11_keyword_rules(spark, sf):
    """Rules over every customer's segment and name; a rule fires for each text that holds its keyword."""
    rules = {k.upper(): ("urn:market", "has_segment", k) for k in ("building", "machinery", "customer_00", "customer#")}
    return tx.keyword_triples(star.table(spark, sf, "customer").select(F.concat_ws(" ", "c_mktsegment", "c_name").alias("text")), "text", rules)


@query("""with c as (select 'urn:doc:' || c_custkey d, 'About ' || c_mktsegment h, * from customer)
select d subject, 'http://quadloom.local/contains_section' predicate, h as object from c
union all select h, 'http://quadloom.local/has_list_item', 'nation ' || c_nationkey from c
union all select h, 'http://quadloom.local/property/full_name', c_name from c
union all select d, 'http://quadloom.local/property/kind', 'customer' from c""")
def sc10_markdown_triples(spark, sf):
    parts = (F.lit("kind: customer\n# About "), "c_mktsegment", F.lit("\n\n- nation "), F.col("c_nationkey").cast("string"), F.lit("\nfull name: "), "c_name", F.lit("\nplain line\n"))
    docs = star.table(spark, sf, "customer").select("c_custkey", F.concat(*parts).alias("text"))
    return tx.markdown_triples(docs, "text", F.concat(F.lit("urn:doc:"), F.col("c_custkey").cast("string")))


def _last_mark(mark: str, width: int) -> str:
    """Characters up to and with the last mark in w, if that lies past the middle, else null."""
    return f"case when strpos(reverse(w), reverse({mark})) > 0 and length(w) - strpos(reverse(w), reverse({mark})) - {width} + 1 > 250 then length(w) - strpos(reverse(w), reverse({mark})) + 1 end"


@query(rf"""with recursive step as (
  select doc_id k, text x, 0 f, 0 e, -1 no from documents where length(text) > 0
  union all
  select k, x, e0, e0 + case when e0 + 500 < length(x) then coalesce({_last_mark("'. '", 2)}, {_last_mark("chr(10)", 1)}, {_last_mark("'; '", 2)}, 500) else length(w) end, no + 1
  from (select *, substr(x, e0 + 1, 500) w from (select *, case when no < 0 then 0 else greatest(e - 50, f + 1) end e0 from step where no < 0 or e < length(x)))),
cut as (select k, no, regexp_replace(substr(x, f + 1, e - f), '^\s+|\s+$', '', 'g') c from step where no >= 0),
chunks as (select k, c, row_number() over (partition by k order by no) - 1 chunk_idx, count(*) over (partition by k) n from cut where c <> '')
select 'urn:doc:' || k doc_uri, chunk_idx::int chunk_idx, case when n > 1 then 'urn:doc:' || k || '#chunk-' || chunk_idx else 'urn:doc:' || k end chunk_uri, c as text, 'doc_chunk' as type from chunks""")
def sc7_character_chunks(spark, sf):
    return tx.with_chunks(star.table(spark, sf, "documents"), "text", F.concat(F.lit("urn:doc:"), F.col("doc_id").cast("string")), 500, 50, by_chars=True)


@query()
def sc9_rendered_pages(spark, sf):
    return star.table(spark, sf, "pages").select("page_id", tx.render_html("html").alias("text"))


@query("select c_custkey, c_mktsegment closest from customer where c_custkey % 3 <> 0 union all select c_custkey, null from customer where c_custkey % 3 = 0")
def tk10_closest_string(spark, sf):
    """Every customer's segment with a letter doubled or lost is brought back; digits are close to none."""
    c = star.table(spark, sf, "customer")
    k = F.col("c_custkey") % 3
    seg = F.col("c_mktsegment")
    wrong = F.when(k == 1, F.concat(F.substring(seg, 1, 3), F.substr(seg, F.lit(3)))).when(k == 2, F.concat(F.substring(seg, 1, 2), F.substr(seg, F.lit(4)))).otherwise(F.lit("0123456789"))
    known = [r[0] for r in c.select("c_mktsegment").distinct().collect()]  # a handful of segments
    return c.select("c_custkey", quality.closest(known)(wrong).alias("closest"))


@query("select p_partkey, (lower(p_name) like '%ring%' or lower(p_name) like '%bolt%') as known from part")
def flt11_known_entities(spark, sf):
    return star.table(spark, sf, "part").select("p_partkey", quality.known_entity(F.col("p_name"), ["Ring", "bolt"]).alias("known"))


@query("select p_partkey, round((0.1 * (p_partkey % 3) + case when p_size > 25 then 0.5 else 0 end)::double, 9) reward from part")
def ag14_extraction_reward(spark, sf):
    p = star.table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") > 25, F.array(F.lit("a"), F.lit("c"))).otherwise(F.array(F.lit("d"))).alias("got"), F.array(F.lit("a"), F.lit("b")).alias("want"), (F.col("p_partkey") % 3).alias("ok"))
    return quality.extraction_reward(p, "got", "want", "ok").select("p_partkey", F.round("reward", 9).alias("reward"))

