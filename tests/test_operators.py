"""Small fixtures for the store, traversal, inference, vectors, quality and the service."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from quadloom.engine import Access, Denied, Engine
from quadloom.functions import cypher
from quadloom.functions import terms as t
from quadloom.functions import text as tx
from quadloom.operators import graph, quality, reason, store, vectors
from quadloom.operators.loops import closure
from quadloom.plans import sparql
from quadloom.streaming import streams

P = "http://p"


def triples(spark, *items):
    return spark.createDataFrame(list(items), t.TRIPLE)


def quads(spark, *items):
    return t.triples_to_quads(triples(spark, *items))


def one(spark, x):
    return spark.createDataFrame([(x,)], "x string")


def test_depth_and_degree_scores(spark):
    q = quads(spark, ("http://a", P, "http://b"), ("http://a", P, "http://c"), ("http://c", P, "http://d"))
    got = {r["node"]: r["score"] for r in graph.bfs(q, one(spark, "http://a"), 1, scoring="degree").collect()}
    assert got == pytest.approx({"http://b": 1 / math.log(2), "http://c": 1 / math.log(3)})
    two = {r["node"]: (r["depth"], r["score"]) for r in graph.bfs(q, one(spark, "http://a"), 2).collect()}
    assert two == {"http://b": (1, 1.0), "http://c": (1, 1.0), "http://d": (2, 0.5)}


def test_hub_penalty_and_type_filter(spark):
    q = quads(spark, ("A", "to", "Hub"), ("A", "to", "Leaf"), ("Leaf", "to", "Y1"), *(("Hub", "to", f"X{i}") for i in range(10)))
    start = one(spark, t.BASE + "A")
    assert {r["score"] for r in graph.bfs(q, start).collect()} == {1.0}
    got = {r["node"][len(t.BASE) :]: r["score"] for r in graph.bfs(q, start, scoring="degree").collect()}
    assert got == pytest.approx({"Hub": 1 / math.log(12), "Leaf": 1 / math.log(3)})
    q = quads(spark, ("A", "knows", "B"), ("A", "knows", "C"), ("B", t.RDF_TYPE, "Person"), ("C", t.RDF_TYPE, "Bot"))
    assert [r["node"] for r in graph.bfs(q, start, node_type=t.BASE + "Person").collect()] == [t.BASE + "B"]
    assert graph.bfs(q, start, edge_filter="none").count() == 0


def test_cycle_leads_back_to_the_start_once(spark):
    q = quads(spark, ("A", "p", "B"), ("B", "p", "A"))
    got = graph.bfs(q, one(spark, t.BASE + "A"), 5)
    assert sorted((r["node"][-1], r["depth"]) for r in got.collect()) == [("A", 2), ("B", 1)]
    assert graph.bfs(q, one(spark, t.BASE + "A"), 5, include_start_on_cycle=False).count() == 1


def test_ingest_provenance_and_idempotence(spark, tmp_path):
    s = store.QuadStore(spark, f"file://{tmp_path}/store", dimension=8)
    rows_ = spark.createDataFrame([("http://alice", "http://knows", "http://bob", ("test_source", "2024-01-01T00:00:00Z", "manual")), ("http://x", P, '"lit"', None), ("http://y", P, None, None)], f"{t.TRIPLE}, provenance {store.PROVENANCE}")
    assert s.ingest(rows_, "a") == 2
    q = s.read("quads", "a")
    g = sparql.query(q, "SELECT ?g WHERE { GRAPH ?g { <http://alice> <http://knows> <http://bob> } }").collect()
    assert len(g) == 1 and g[0]["g"].startswith("<urn:batch:")
    assert sparql.query(q, f'SELECT ?b WHERE {{ ?b <{t.PROV}wasDerivedFrom> "test_source" }}').count() == 1
    plain = rows_.drop("provenance").where("subject = 'http://x'")
    assert s.ingest(plain, "a") == 0
    assert s.namespaces() == ["a"] and s.read("quads", "b").count() == 0
    assert s.read("vectors", "a").count() == 2
    ids = s.read("node_ids", "a").collect()
    assert sorted(r["node_id"] for r in ids) == list(range(1, len(ids) + 1)) and len({r["uri"] for r in ids}) == len(ids)
    assert s.delete("a") and s.namespaces() == []
    with pytest.raises(ValueError):
        s.path("quads", "../up")


def test_vectors_per_triple_tombstones_and_compaction(spark, tmp_path):
    s = store.QuadStore(spark, f"file://{tmp_path}/store", dimension=16)
    s.ingest(triples(spark, ("http://e/dog", "http://e/is", "http://e/animal"), ("http://e/dog", "http://e/says", '"woof"')))
    v = s.live_vectors().collect()
    assert len(v) == 2 and {r["uri"] for r in v} == {"http://e/dog"} and all("predicate" in r["metadata"] for r in v)
    s.remove_vectors(spark.createDataFrame([(v[0]["key"],)], "key string"))
    assert s.live_vectors().count() == 1 and s.read("vectors").count() == 2
    assert s.compact() == 1 and s.read("vectors").count() == 1 and s.compact() == 0


def test_nearest_is_exact(spark):
    r = np.random.default_rng(0)
    v, q = r.normal(size=(300, 6)).astype(np.float32), r.normal(size=(5, 6)).astype(np.float32)
    df = spark.createDataFrame([(str(i), x.tolist()) for i, x in enumerate(v)], "key string, embedding array<float>").repartition(3)
    asked = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "q int, v array<float>")
    got = vectors.nearest_join(asked, df, 4, "q", "v", block=2).collect()
    assert len(got) == 20
    for i in range(5):
        want = np.argsort(np.linalg.norm(v.astype(float) - q[i].astype(float), axis=1))[:4]
        assert [x["key"] for x in sorted(got, key=lambda x: x["rank"]) if x["q"] == i] == [str(k) for k in want]
    assert [x["key"] for x in vectors.nearest(df, q[0].tolist(), 4).collect()] == [str(k) for k in np.argsort(np.linalg.norm(v.astype(float) - q[0].astype(float), axis=1))[:4]]


def test_rule_strategies(spark):
    sub = reason.SUBCLASS
    q = quads(spark, ("A", sub, "B"), ("B", sub, "C"))
    assert (t.BASE + "A", sub, t.BASE + "C") in rows(reason.apply(q, "rdfs"))
    q = quads(spark, ("anc", t.RDF_TYPE, t.OWL + "TransitiveProperty"), ("g", "anc", "p"), ("p", "anc", "c"), ("spouse", t.RDF_TYPE, t.OWL + "SymmetricProperty"), ("Dave", "spouse", "Eve"))
    got = {tuple(x.removeprefix(t.BASE) for x in r) for r in rows(reason.materialise(q, "owlrl"))}
    assert got == {("g", "anc", "c"), ("Eve", "spouse", "Dave")}
    assert reason.materialise(q, "none").count() == 0
    q = quads(spark, ("Socrates", t.RDF_TYPE, "Human"), ("Human", sub, "Mortal"))
    assert reason.materialise(q, "rdfs").count() == 0
    s = reason.iri_triples(q)
    assert {r["o"] for r in reason.infer(s, s, ["types"]).collect()} == {t.BASE + "Mortal"}


def test_materialise_is_a_fixed_point_that_holds_a_single_pass(spark):
    r = np.random.default_rng(3)
    items = {(f"n{a}", "anc", f"n{b}") for a, b in r.integers(0, 7, (10, 2))}
    q = quads(spark, *items, ("anc", t.RDF_TYPE, t.OWL + "TransitiveProperty"), ("anc", reason.INVERSE, "desc"))
    added = reason.materialise(q, "owlrl")
    every = set(rows(reason.iri_triples(q))) | set(rows(added))
    assert set(rows(reason.apply(q, "owlrl"))) <= every
    more = t.triples_to_quads(spark.createDataFrame([tuple(x) for x in every], t.TRIPLE))
    assert reason.materialise(more, "owlrl").count() == 0


def test_closure_against_brute_force(spark):
    r = np.random.default_rng(8)
    edges = {(int(a), int(b)) for a, b in r.integers(0, 15, (25, 2))}
    want = set(edges)
    while True:
        more = want | {(a, d) for a, b in want for c, d in edges if b == c}
        if more == want:
            break
        want = more
    got = closure(spark.createDataFrame(sorted(edges), "a int, b int"))
    assert {tuple(x) for x in got.collect()} == want


# SPARQL in the corners
def test_three_valued_logic(spark):
    q = quads(spark, ("a", "v", '"1"'), ("b", "w", '"x"'))
    ask = lambda e: sparql.query(q, f"SELECT ?s WHERE {{ ?s ?p ?o FILTER({e}) }}").count()
    assert ask("?none = 1 || true") == 2
    assert ask("?none = 1 && false") == 0
    assert ask("!(?none = 1 && false)") == 2
    assert ask("!(?none = 1)") == 0
    assert ask("COALESCE(?none, 1) = 1") == 2
    assert ask("?o + 1 = 2") == 0  # a plain literal is no number
    assert ask('isLiteral(?o)') == 2 and ask("isIRI(?o)") == 0


def test_optional_variables_join_by_compatibility(spark):
    q = quads(spark, ("a", "p", "x"), ("b", "p", "y"), ("a", "q", "z"), ("z", "r", "w"), ("k", "r", "m"))
    got = rows(sparql.query(q, f"BASE <{t.BASE}> SELECT ?s ?z ?w WHERE {{ ?s <p> ?o OPTIONAL {{ ?s <q> ?z }} ?z <r> ?w }}"))
    cut = {tuple(x.removeprefix("<" + t.BASE).rstrip(">") for x in r) for r in got}
    assert cut == {("a", "z", "w"), ("b", "z", "w"), ("b", "k", "m")}


def test_minus_without_shared_variables_keeps_all(spark):
    q = quads(spark, ("a", "p", "x"), ("b", "q", "y"))
    assert sparql.query(q, "SELECT ?s WHERE { ?s ?p ?o MINUS { ?a ?b ?c } }").count() == 2
    with pytest.raises(ValueError):
        sparql.query(q, "SELECT ?s WHERE { ?s ?p }")


def test_paths_of_no_length(spark):
    q = quads(spark, ("a", "p", "b"), ("b", "p", "a"), ("c", "q", "d"))
    assert sparql.query(q, f"BASE <{t.BASE}> SELECT ?x ?y WHERE {{ ?x <p>* ?y }}").count() == 6
    assert sparql.query(q, f"BASE <{t.BASE}> SELECT ?x WHERE {{ <a> <p>+ ?x }}").count() == 2


# Text
def test_chunks(spark):
    assert tx.chunk_words("one two three four", 10, 0) == ["one two", "three four"]
    got = tx.chunk_words("one two three four five six seven eight nine ten", 15, 6)
    assert got[0] == "one two three" and "three" in got[1]
    assert tx.chunk_words("") == [] and tx.chunk_words(None) == [] and tx.chunk_words("x" * 50, 10, 5) == ["x" * 50]
    text = " ".join(f"wörd{k}" for k in range(300))
    for size, overlap in itertools.product((20, 100), (0, 15)):
        chunks = tx.chunk_words(text, size, overlap)
        assert all(len(c.encode()) <= size + overlap for c in chunks)
        if not overlap:
            assert " ".join(chunks).split() == text.split()
    assert tx.chunk_chars("") == [] and "".join(tx.chunk_chars("ab" * 600, 500, 0)) == "ab" * 600


def test_html_and_markdown(spark):
    df = spark.createDataFrame([("<h1>Title</h1><script>var a = '<p>';</script><p>Paragraph 1.</p>",), (None,), ("",)], "h string")
    assert [r[0] for r in df.select(tx.strip_html(F.col("h"))).collect()] == ["Title Paragraph 1.", None, ""]
    assert "Paragraph 1." in df.select(tx.render_html("h")).first()[0]
    md = spark.createDataFrame([("d", "- lost item\na: 1\n# Head\n- item\n* two\nkey two: http://x\nempty:\n#\n- gone\nb: 2"), ("e", None), ("f", "")], "u string, t string")
    got = {tuple(x.removeprefix(t.BASE) for x in r) for r in rows(tx.markdown_triples(md, "t", F.col("u")))}
    assert got == {("d", "property/a", "1"), ("d", "contains_section", "Head"), ("Head", "has_list_item", "item"), ("Head", "has_list_item", "two"), ("Head", "property/key_two", "http://x"), ("d", "property/b", "2")}


def test_terms(spark):
    df = spark.createDataFrame([("<http://a>",), ("name",), ("file://x",), (None,), ("http://w3.org/07/owl#Class",), ("urn:x",)], "u string")
    assert [r[0] for r in df.select(t.ensure_uri("u")).collect()] == ["http://a", t.BASE + "name", t.BASE + "file://x", None, "http://w3.org/07/owl#Class", "urn:x"]
    assert [r[0] for r in df.select(t.label("u")).collect()][4] == "owl#Class"
    assert [r[0] for r in df.select(t.local_name("u")).collect()][4] == "Class"
    odd = ['a"b', "back\\slash", "line\nbreak", "\\n", "tab\tx", "é"]
    e = spark.createDataFrame([(x,) for x in odd], "x string")
    assert [r[0] for r in e.select(t.lexical(t.render(F.col("x"), F.lit("lit")))).collect()] == odd


# Quality
def test_merges_against_all_pairs(spark):
    r = np.random.default_rng(6)
    names = sorted({"".join(r.choice(list("abc"), int(n))) for n in r.integers(1, 14, 120)} | {"", "http://x/abcabc", "http://y/ABCABC"})

    def sim(a, b):
        a, b = (x.split("/")[-1].lower() for x in (a, b))
        if not max(len(a), len(b)):
            return 1.0
        if not min(len(a), len(b)):
            return 0.0
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            prev, row[0] = row[0], i + 1
            for j, y in enumerate(b):
                prev, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, prev + (x != y))
        return 1 - row[-1] / max(len(a), len(b))

    want = {(a, b) for a, b in itertools.combinations(names, 2) if sim(a, b) >= 0.8 - 1e-12}
    got = quality.suggest_merges(spark.createDataFrame([(x,) for x in [*names, None, names[3]]], "x string"), "x", 0.8).collect()
    assert {(r["a"], r["b"]) for r in got} == want and len(got) == len(want)


def test_validation(spark):
    o = spark.createDataFrame([("http://o/height", t.RDF_TYPE, t.OWL + "DatatypeProperty"), ("http://o/height", t.RDFS + "range", t.XSD + "decimal"), ("http://o/belongs_to", t.RDF_TYPE, t.OWL + "ObjectProperty")], "s string, p string, o string")
    df = triples(spark, ("a", "height", "5 m"), ("a", "Height", "tall"), ("a", "belongs to", "b"), ("a", "heigth", "4"), ("a", None, "x"))
    got = {(r["predicate"], r["object"]): r for r in quality.validate(df, o).collect()}
    assert [got[k]["valid"] for k in (("height", "5 m"), ("Height", "tall"), ("belongs to", "b"), ("heigth", "4"))] == [True, False, True, False]
    assert got[("heigth", "4")]["suggestion"] == "height"


# Cypher
def test_cypher(spark):
    q = quads(spark, ("http://e/FoodForest", "http://e/has", "http://e/Soil"), ("http://e/Mulch", "http://e/improves", "http://e/Soil"), ("http://e/T", "http://e/height", '"7"'), ("http://e/U", "http://e/height", '"3"'))
    ask = lambda text: rows(cypher.query(q, text))
    assert ask(cypher.question("What improves soil?")) == [("http://e/Mulch",)]
    assert ask("MATCH (plant)-[:height]->(tall) WHERE tall > 5 RETURN plant, tall") == [("http://e/T", "7")]
    assert len(ask(cypher.question("What is Soil"))) == 2
    assert ask("MATCH (a)<-[r]-(b) WHERE a = 'Soil' AND b CONTAINS 'mulch' RETURN b, type(r)") == [("http://e/Mulch", "improves")]
    assert cypher.repaired("MATCH (a:Plnt)-[:improve]->(b) RETURN a", ["improves"], ["Plant"]) == "MATCH (a:Plant)-[:improves]->(b) RETURN a"
    assert cypher.route("find duplicates of X") == "disambiguate" and cypher.route("whatever") == "hybrid_search"
    for bad in ("RETURN x", "MATCH (a)-[r]->(b) WHERE c = 'x' RETURN a", "MATCH (a) RETURN z"):
        with pytest.raises(cypher.CypherError):
            cypher.query(q, bad)


# Service
def test_access():
    a = Access('{"all": ["*"], "team": ["team-*", "x"], "ro": {"namespaces": ["default"], "permissions": {"write": false, "reason": false}}}')
    a.check(None, "default", "write")
    a.check("all", "any", "delete")
    a.check("team", "team-1", "write")
    a.check("ro", "default", "read")
    for token, ns, op in ((None, "other", "read"), ("none", "default", "read"), ("team", "y", "read"), ("ro", "default", "write"), ("ro", "default", "reason")):
        with pytest.raises(Denied):
            a.check(token, ns, op)


def test_engine(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/e", Access({"t": ["*"]}), dimension=32)
    items = [{"subject": f"http://n/{a}", "predicate": P, "object": f"http://n/{b}"} for a, b in ("ab", "bc", "bd")]
    assert e.ingest_triples(items) == 3 and e.ingest_triples(items) == 0
    assert e.node_degree("http://n/b") == 3
    assert {r["node"] for r in e.neighbours("http://n/a", depth=2).collect()} == {"http://n/b", "http://n/c", "http://n/d"}
    assert e.resolve("http://n/a")[1] and e.resolve("http://none") == (0, False)
    assert e.ingest_text("urn:doc", "alpha beta gamma " * 200) > 1
    top = e.search("alpha beta gamma", 3).first()
    assert top["uri"] == "urn:doc" and top["node_id"] == 0
    assert e.hybrid_search("http://n/a http://p http://n/b", k=1).first()["uri"] == "http://n/a"
    e.ingest_triples([{"subject": P, "predicate": t.RDF_TYPE, "object": t.OWL + "TransitiveProperty"}])
    got = e.apply_reasoning("OWLRL", materialise=True)
    assert got.count() == 2 and e.node_degree("http://n/a") == 3
    assert e.audit().first()["inferred_triples"] == 2
    with pytest.raises(Denied):
        e.sparql("ASK { ?s ?p ?o }", "secret")
    e.ingest_triples(items, "secret", "t")
    assert e.delete_namespace("secret", "t") and e.list_triples(ns="secret", token="t").count() == 0


# Streams
def test_streams(spark, tmp_path):
    rows_ = [("a", "2024-01-01 00:10:00", 1), ("a", "2024-01-01 00:20:00", 1), ("b", "2024-01-01 01:10:00", 2), ("a", "2024-01-03 00:00:00", 3)]
    df = spark.createDataFrame(rows_, "k string, ts string, v int").select("k", F.to_timestamp("ts").alias("ts"), "v")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    got = streams.to_table(streams.deduplicated(stream(), ["k", "v"], "ts").select("k", "v"), f"{tmp_path}/out", f"{tmp_path}/progress")
    assert rows(got) == [("a", 1), ("a", 3), ("b", 2)]
    counted = streams.to_table(streams.windowed_counts(stream(), "ts", ["k"]), f"{tmp_path}/out2", f"{tmp_path}/progress2")
    assert {(r["k"], r["n"]) for r in counted.collect()} == {("a", 2), ("b", 1)}  # the last window is still open


def test_streamed_ingest_and_inference(spark, tmp_path):
    triples(spark, ("x", "p", "y"), ("y", "p", "z")).write.parquet(f"{tmp_path}/t")
    s = store.QuadStore(spark, f"file://{tmp_path}/store")
    stream = spark.readStream.schema(t.TRIPLE).parquet(f"{tmp_path}/t")
    streams.ingest(stream, s, "live", f"{tmp_path}/c1").awaitTermination()
    assert s.read("quads", "live").count() == 2
    onto = spark.createDataFrame([("p", t.RDF_TYPE, t.OWL + "TransitiveProperty")], "s string, p string, o string")
    seen = []
    renamed = stream.toDF("s", "p", "o")
    streams.infer(renamed, onto, lambda df, n: seen.extend(rows(df)), f"{tmp_path}/c2", ["transitive"]).awaitTermination()
    assert [r[1:] for r in seen] == [("x", "p", "z")]


def test_arguments_are_checked_before_a_call(spark, tmp_path):
    from quadloom.functions import arguments

    e = Engine(spark, str(tmp_path / "store"), dimension=8)
    with pytest.raises(arguments.InvalidArguments) as bad:
        e.call("get_neighbors", {"direction": "up"})
    assert bad.value.code == -32602 and len(bad.value.problems) == 2
    with pytest.raises(arguments.InvalidArguments) as none:
        e.call("fly", {})
    assert none.value.code == -32601
    assert arguments.problems("list_triples", {"limit": True}) == ["limit has the wrong type"]
    assert e.call("ingest_triples", {"triples": [{"subject": "http://a", "predicate": P, "object": "http://b"}]}) == 1
    assert e.size() == 4 and e.call("get_node_degree", {"uri": "http://a"}) == 1


def test_pages_notes_and_files_of_vectors(spark, tmp_path):
    import json

    from quadloom.sources import exchange, files

    e = Engine(spark, str(tmp_path / "store"), dimension=8)
    assert e.ingest_url("http://x", fetch=lambda url: b"<p>some words</p>") == 1
    with pytest.raises(ValueError):
        exchange.http_get("file:///etc/hosts")
    with pytest.raises(ValueError):
        files.save_ontology("../x", "", str(tmp_path))
    whole = {"entries": [{"key": "a", "embedding": [1.0, 2.0], "metadata_json": '{"uri": "u"}'}, {"key": "b", "embedding": [1.0], "metadata_json": "{}"}]}
    (tmp_path / "vectors.json").write_text(json.dumps(whole))
    assert [(r["key"], r["uri"]) for r in exchange.read_vectors(spark, str(tmp_path / "vectors.json"), 2).collect()] == [("a", "u")]
    (tmp_path / "odd.json").write_text("no json")
    assert exchange.read_vectors(spark, str(tmp_path / "odd.json"), 2).collect() == []
    assert exchange.read_ids(spark, str(tmp_path / "none.json"))[1] == 1
    notes = spark.createDataFrame([("1", None, None), (None, "x", "y")], "id string, title string, url string")
    assert [r["object"] for r in exchange.note_triples(notes).collect()] == ['"Untitled"', "http://schema.org/Note"]


def test_a_table_whose_replacement_broke_off_is_restored(spark, tmp_path):
    s = store.QuadStore(spark, str(tmp_path / "store"), dimension=8)
    s.add_quads(quads(spark, ("http://a", P, "http://b")))
    path = tmp_path / "store" / "ns=default" / "quads"
    path.rename(str(path) + ".old")
    assert s.read("quads").count() == 1 and path.exists()


def test_nearest_join_against_brute_force(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(700, 6)).astype(np.float32)
    x[100:140] = x[3]
    rows = [(f"k{i:03d}", [float(v) for v in x[i]]) for i in range(700)] + [("odd", [1.0]), ("none", None), ("nan", [float("nan")] * 6)]
    table = spark.createDataFrame(rows, "key string, embedding array<float>")
    asked = spark.createDataFrame([(i, rows[i][1]) for i in range(0, 140, 7)] + [(900, [1.0]), (None, rows[0][1]), (901, None)], "q long, embedding array<float>")
    for metric, block in (("l2", 8), ("l2", None), ("cosine", None)):
        got = {}
        for n in vectors.nearest_join(asked, table, 5, "q", "embedding", metric=metric, block=block).orderBy("q", "rank").collect():
            got.setdefault(n["q"], []).append(n["key"])
        y = x.astype(np.float64)
        for i in range(0, 140, 7):
            d = np.floor(np.sqrt(((y - y[i]) ** 2).sum(1)) * 1e6) if metric == "l2" else -np.round(y @ y[i] / np.sqrt((y * y).sum(1)) / np.sqrt((y[i] ** 2).sum()), 12)
            want = [f"k{k:03d}" for k in sorted(range(700), key=lambda k: (d[k], k))[:5]]
            assert got[i] == want or metric == "cosine" and set(got[i]) <= {f"k{k:03d}" for k in np.flatnonzero(d <= np.sort(d)[4] + 1e-9)}
        assert got[900] == ["odd"] and set(got) == {*range(0, 140, 7), 900}


def test_ingestion_of_nothing_and_of_what_is_known(spark, tmp_path):
    ontology = spark.createDataFrame([("http://p", t.RDF_TYPE, t.RDF + "Property")], "s string, p string, o string")
    e = Engine(spark, str(tmp_path / "store"), dimension=8)
    none = triples(spark, ("http://a", "http://p", "x")).where("false")
    assert e.ingest_pipeline(none, ontology) == {"status": "empty", "stored": 0}
    one_row = triples(spark, ("http://a", "http://p", "x"))
    assert e.ingest_pipeline(one_row, ontology)["stored"] == 1 and e.ingest_pipeline(one_row, ontology)["duplicates"] == 1
