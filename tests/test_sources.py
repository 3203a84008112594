"""Files of each kind to triples and quads."""

import json

import pytest
from pyspark.sql import functions as F

from conftest import rows
from quadloom.functions import terms as t
from quadloom.sources import files, rdf

TTL = """@prefix ex: <http://e/> .
@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
# a comment
ex:a a ex:Thing ; ex:name "A \\"quoted\\" name"@en , 'b' ; ex:size 5 ; ex:ratio 1.5 ; ex:on true .
ex:a ex:when "2024-01-01"^^xsd:date ; ex:next [ ex:name "inner" ] ; ex:list ( ex:x ex:y ) .
"""
XML = """<?xml version="1.0"?>
<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xml:base="http://e/">
  <owl:Class rdf:about="#A"><rdfs:subClassOf rdf:resource="#B"/><rdfs:label xml:lang="en">An A</rdfs:label></owl:Class>
  <rdf:Description rdf:ID="p"><rdf:type rdf:resource="http://www.w3.org/2002/07/owl#TransitiveProperty"/></rdf:Description>
</rdf:RDF>"""


def test_rdf_directory(spark, tmp_path):
    (tmp_path / "a.ttl").write_text(TTL)
    (tmp_path / "b.owl").write_text(XML)
    (tmp_path / "bad.owl").write_text(TTL)
    (tmp_path / "skip.txt").write_text("no")
    quads, problems = rdf.parse_files(spark, str(tmp_path))
    assert [r["path"].rsplit("/", 1)[-1] for r in problems.collect()] == ["bad.owl"]
    got = {(r["s"], r["p"], r["o"], r["o_kind"], r["o_dt"], r["o_lang"]) for r in quads.collect()}
    e = "http://e/"
    assert (e + "a", t.RDF_TYPE, e + "Thing", "iri", None, None) in got
    assert (e + "a", e + "name", 'A "quoted" name', "lit", t.RDF + "langString", "en") in got
    assert (e + "a", e + "size", "5", "lit", t.XSD + "integer", None) in got
    assert (e + "a", e + "when", "2024-01-01", "lit", t.XSD + "date", None) in got
    assert ("http://e/#A", t.RDFS + "subClassOf", "http://e/#B", "iri", None, None) in got
    assert ("http://e/#A", t.RDFS + "label", "An A", "lit", t.RDF + "langString", "en") in got
    assert ("http://e/#p", t.RDF_TYPE, t.OWL + "TransitiveProperty", "iri", None, None) in got
    assert sum(r[1] == t.RDF + "first" for r in got) == 2 and sum(r[3] == "bnode" for r in got) >= 3


def test_nquads_round_trip(spark, tmp_path):
    (tmp_path / "a.ttl").write_text(TTL)
    quads = rdf.parse_files(spark, str(tmp_path))[0].withColumn("g", F.when(F.col("o_kind") == "lit", "urn:g"))
    rdf.to_nquads(quads).write.text(str(tmp_path / "out"))
    back = rdf.read_nquads(spark, str(tmp_path / "out"))
    assert rows(back.select(*t.KEY)) == rows(quads.select(*t.KEY).withColumn("o_lang", F.when(F.col("o_lang") != "", F.col("o_lang"))))


def test_csv_json_memory_and_dispatch(spark, tmp_path):
    (tmp_path / "plants.csv").write_text("name,family,height\nRose,Rosaceae,2\nFern,,1\n")
    got = rows(files.csv_triples(spark, str(tmp_path / "plants.csv")))
    assert got == sorted([("urn:csv:plants.csv:Rose", "urn:csv:prop:family", "Rosaceae"), ("urn:csv:plants.csv:Rose", "urn:csv:prop:height", "2"), ("urn:csv:plants.csv:Fern", "urn:csv:prop:height", "1")], key=str)
    docs = spark.createDataFrame([(json.dumps({"a": "x", "n": 5, "o": {"k": "v"}, "long": "y" * 200, "num": "7"}),), ("[1]",), (None,), ("broken",)], "j string")
    assert rows(files.json_triples(docs, "j")) == [("a", "hasValue", "x"), ("num", "hasValue", "7")]
    mem = spark.createDataFrame([("- 2024-01-02: did this\nother\n- 2024-01-03: and that",), (None,)], "m string")
    assert files.memory_lines(mem, "m").count() == 4
    (tmp_path / "n.md").write_text("# H\n- i\n")
    assert files.ingestable(spark, str(tmp_path / "n.md")).count() == 2
    with pytest.raises(ValueError):
        files.ingestable(spark, "x.pdf")


def test_registry_and_scenarios(spark, tmp_path):
    (tmp_path / "a.ttl").write_text(TTL)
    reg = files.OntologyRegistry(str(tmp_path / "reg.json"))
    reg.add(str(tmp_path / "a.ttl"))
    assert files.OntologyRegistry(str(tmp_path / "reg.json")).load(spark).count() > 5
    reg.toggle(str(tmp_path / "a.ttl"), False)
    assert reg.load(spark).count() == 0
    home = tmp_path / "sc" / "demo"
    for d in ("schema", "data", "docs"):
        (home / d).mkdir(parents=True)
    (home / "schema" / "o.ttl").write_text(TTL)
    (home / "data" / "d.csv").write_text("id,v\n1,x\n")
    (home / "docs" / "g.md").write_text("hello world")
    (home / "manifest.json").write_text(json.dumps({"name": "demo", "ontologies": ["o.ttl"], "data_files": ["d.csv"], "docs": ["g.md"]}))
    (tmp_path / "sc" / "registry.json").write_text(json.dumps([{"name": "demo", "description": "", "version": "1", "location": "demo"}]))
    assert [s["name"] for s in files.scenarios(str(tmp_path / "sc"))] == ["demo"]
    quads, chunks, counts = files.install_scenario(spark, str(tmp_path / "sc"), "demo", str(tmp_path / "to"))
    assert counts == {"ontologies": 1, "data_files": 1, "docs": 1} and chunks.count() == 1 and quads.where("p = 'urn:csv:prop:v'").count() == 1
    for bad in ("../x.ttl", "a/b.ttl", ""):
        with pytest.raises(ValueError):
            files.save_ontology(bad, "", str(tmp_path))
