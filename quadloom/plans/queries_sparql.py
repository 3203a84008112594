"""SPARQL over the star schema's graph, each query with SQL for the same rows; terms are in N-Triples form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.plans import sparql
from quadloom.sources import star

XSD = "http://www.w3.org/2001/XMLSchema#"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def iri(table: str, key: str) -> str:
    return f"'<urn:csv:{table}.csv:' || {key} || '>'"


def lit(x: str) -> str:
    return f"""'"' || {x} || '"'"""


def typed(x: str, kind: str = "integer") -> str:
    return f"""'"' || ({x}) || '"^^<{XSD}{kind}>'"""


def true(x: str) -> str:
    return typed(f"case when {x} then 'true' else 'false' end", "boolean")


NATION, CUSTOMER, ORDER, REGION, SUPPLIER, PART = (iri(t, k) for t, k in (("nation", "n_nationkey"), ("customer", "c_custkey"), ("orders", "o_orderkey"), ("region", "r_regionkey"), ("supplier", "s_suppkey"), ("part", "p_partkey")))


def add(name: str, columns: str, text: str, sql: str | None, types: tuple[str, ...] = (), dataset: str = "default", graph: str | None = None) -> None:
    """columns: those of the star schema that the query's graph is made of; graph: an expression for the named graph."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        quads = star.quads(spark, sf_dir, *columns.split(), typed=types, graph=F.expr(graph) if graph else None)
        return sparql.query(quads, star.PREFIXES + text, dataset)

    QUERIES[name] = run
    if sql:
        SQL[name] = sql


add("spq1_two_patterns", "n_name n_regionkey", "SELECT ?n ?name WHERE { ?n p:n_regionkey region:1 . ?n p:n_name ?name }", f"select {NATION} n, {lit('n_name')} as name from nation where n_regionkey = 1")
add("spq1_three_patterns", "c_mktsegment c_nationkey n_regionkey", 'SELECT ?c ?r WHERE { ?c p:c_mktsegment "BUILDING" . ?c p:c_nationkey ?n . ?n p:n_regionkey ?r }', f"select {CUSTOMER} c, {iri('region', 'n_regionkey')} r from customer join nation on c_nationkey = n_nationkey where c_mktsegment = 'BUILDING'")
add("spq1_star_and_chain", "o_custkey o_orderstatus c_nationkey c_mktsegment n_name", "SELECT ?o ?seg ?name WHERE { ?o p:o_custkey ?c ; p:o_orderstatus \"F\" . ?c p:c_nationkey ?n ; p:c_mktsegment ?seg . ?n p:n_name ?name }", f"select {ORDER} o, {lit('c_mktsegment')} seg, {lit('n_name')} as name from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where o_orderstatus = 'F'")
add("spq2_repeated_variable", "c_nationkey s_nationkey", "SELECT ?c ?s WHERE { ?c p:c_nationkey ?n . ?s p:s_nationkey ?n }", f"select {CUSTOMER} c, {SUPPLIER} s from customer join supplier on c_nationkey = s_nationkey")
add("spq3_shorthand", "n_name n_regionkey", "SELECT ?n ?x ?y WHERE { ?n a c:nation ; p:n_name ?x ; p:n_regionkey ?y . }", f"select {NATION} n, {lit('n_name')} x, {iri('region', 'n_regionkey')} y from nation", ("nation",))
add("spq4_filter", "p_size p_brand", 'SELECT ?p ?z WHERE { ?p p:p_size ?z ; p:p_brand ?b . FILTER(?z > 20 && ?z <= 30 && ?b != "Brand#1") }', f"select {PART} p, {typed('p_size')} z from part where p_size > 20 and p_size <= 30 and p_brand <> 'Brand#1'")
add("spq4_error_is_false", "p_size p_brand", "SELECT ?p WHERE { ?p p:p_brand ?b ; p:p_size ?z . FILTER(?b > 3 || ?z = 7) }", f"select {PART} p from part where p_size = 7")
add("spq5_optional", "n_name s_nationkey", "SELECT ?n ?s WHERE { ?n p:n_name ?name OPTIONAL { ?s p:s_nationkey ?n } }", f"select {NATION} n, case when s_suppkey is not null then {SUPPLIER} end s from nation left join supplier on s_nationkey = n_nationkey")
add("spq5_optional_filter", "c_nationkey o_custkey o_orderstatus", 'SELECT ?c ?o WHERE { ?c p:c_nationkey ?n OPTIONAL { ?o p:o_custkey ?c ; p:o_orderstatus ?t FILTER(?t = "P") } }', f"select {CUSTOMER} c, case when o_orderkey is not null then {ORDER} end o from customer left join orders on o_custkey = c_custkey and o_orderstatus = 'P'")
add("spq6_union", "c_nationkey s_nationkey", "SELECT ?x ?c WHERE { { ?x p:c_nationkey nation:3 } UNION { ?x p:s_nationkey nation:3 . BIND(?x AS ?c) } }", f"select {CUSTOMER} x, null::varchar c from customer where c_nationkey = 3 union all select {SUPPLIER}, {SUPPLIER} from supplier where s_nationkey = 3")
add("spq7_minus", "c_mktsegment o_custkey", "SELECT ?c ?m WHERE { ?c p:c_mktsegment ?m MINUS { ?o p:o_custkey ?c } }", f"select {CUSTOMER} c, {lit('c_mktsegment')} m from customer where c_custkey not in (select o_custkey from orders)")
add("spq8_exists", "c_mktsegment o_custkey o_orderstatus", 'SELECT ?c WHERE { ?c p:c_mktsegment ?m FILTER EXISTS { ?o p:o_custkey ?c ; p:o_orderstatus "P" } }', f"select {CUSTOMER} c from customer where c_custkey in (select o_custkey from orders where o_orderstatus = 'P')")
add("spq8_not_exists", "c_mktsegment o_custkey o_orderstatus", 'SELECT ?c WHERE { ?c p:c_mktsegment ?m FILTER NOT EXISTS { ?o p:o_custkey ?c ; p:o_orderstatus "P" } }', f"select {CUSTOMER} c from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')")
BY_SEGMENT = "concat('urn:segment:', c_mktsegment)"
add("spq9_graph_iri", "c_nationkey", "SELECT ?c WHERE { GRAPH <urn:segment:BUILDING> { ?c p:c_nationkey nation:4 } }", f"select {CUSTOMER} c from customer where c_mktsegment = 'BUILDING' and c_nationkey = 4", graph=BY_SEGMENT)
add("spq9_graph_variable", "c_nationkey", "SELECT ?g (COUNT(?c) AS ?n) WHERE { GRAPH ?g { ?c p:c_nationkey ?x } } GROUP BY ?g", f"select '<urn:segment:' || c_mktsegment || '>' g, {typed('count(*)')} n from customer group by c_mktsegment", graph=BY_SEGMENT)
add("spq10_from", "c_nationkey", "SELECT ?c ?n FROM <urn:segment:BUILDING> FROM <urn:segment:MACHINERY> WHERE { ?c p:c_nationkey ?n }", f"select {CUSTOMER} c, {iri('nation', 'c_nationkey')} n from customer where c_mktsegment in ('BUILDING', 'MACHINERY')", graph=BY_SEGMENT)
add("spq10_from_named", "c_nationkey", "SELECT ?g ?c FROM NAMED <urn:segment:HOUSEHOLD> WHERE { GRAPH ?g { ?c p:c_nationkey nation:1 } }", f"select '<urn:segment:HOUSEHOLD>' g, {CUSTOMER} c from customer where c_mktsegment = 'HOUSEHOLD' and c_nationkey = 1", graph=BY_SEGMENT)
add("spq10_union_dataset", "c_nationkey", "SELECT ?c WHERE { ?c p:c_nationkey nation:5 }", f"select {CUSTOMER} c from customer where c_nationkey = 5", dataset="union", graph=BY_SEGMENT)
add("spq11_bind_values", "n_name n_regionkey", "SELECT ?n ?up ?r WHERE { VALUES ?r { region:0 region:3 } ?n p:n_regionkey ?r ; p:n_name ?name BIND(LCASE(?name) AS ?up) }", f"select {NATION} n, {lit('lower(n_name)')} up, {iri('region', 'n_regionkey')} r from nation where n_regionkey in (0, 3)")
add("spq11_values_undef", "n_name n_regionkey", "SELECT ?n ?r ?tag WHERE { ?n p:n_regionkey ?r VALUES (?r ?tag) { (region:0 \"zero\") (UNDEF \"any\") } }", f"select {NATION} n, {iri('region', 'n_regionkey')} r, tag from nation, (values ('\"zero\"', 0), ('\"any\"', null)) v(tag, k) where k is null or k = n_regionkey")
add("spq11_select_expression", "p_size", "SELECT ?p (?z * 2 + 1 AS ?w) WHERE { ?p p:p_size ?z }", f"select {PART} p, {typed('p_size * 2 + 1')} w from part")
add("spq12_select_all", "n_name n_regionkey", "SELECT * WHERE { ?n p:n_regionkey ?r . ?n p:n_name ?name }", f"select {NATION} n, {iri('region', 'n_regionkey')} r, {lit('n_name')} as name from nation")
add("spq13_distinct", "c_mktsegment c_nationkey", "SELECT DISTINCT ?m ?n WHERE { ?c p:c_mktsegment ?m ; p:c_nationkey ?n }", f"select distinct {lit('c_mktsegment')} m, {iri('nation', 'c_nationkey')} n from customer")
add("spq13_reduced", "c_mktsegment", "SELECT REDUCED ?m WHERE { ?c p:c_mktsegment ?m }", f"select distinct {lit('c_mktsegment')} m from customer")
add("spq14_order_limit", "o_totalprice o_orderstatus", "SELECT ?o ?t WHERE { ?o p:o_totalprice ?t ; p:o_orderstatus ?s } ORDER BY DESC(?t) ?o LIMIT 25", f"select {ORDER} o, {typed('o_totalprice::decimal(18,2)::varchar', 'decimal')} t from orders order by o_totalprice desc, {ORDER} limit 25")
add("spq15_offset", "n_name", "SELECT ?n ?name WHERE { ?n p:n_name ?name } ORDER BY ?name LIMIT 7 OFFSET 5", f"select {NATION} n, {lit('n_name')} as name from nation order by n_name limit 7 offset 5")
add("spq16_group_having", "c_nationkey c_mktsegment", "SELECT ?n ?m (COUNT(*) AS ?k) WHERE { ?c p:c_nationkey ?n ; p:c_mktsegment ?m } GROUP BY ?n ?m HAVING (COUNT(*) > 10)", f"select {iri('nation', 'c_nationkey')} n, {lit('c_mktsegment')} m, {typed('count(*)')} k from customer group by c_nationkey, c_mktsegment having count(*) > 10")
add("spq17_aggregates", "p_brand p_size", "SELECT ?b (COUNT(?z) AS ?n) (COUNT(DISTINCT ?z) AS ?d) (SUM(?z) AS ?s) (MIN(?z) AS ?lo) (MAX(?z) AS ?hi) WHERE { ?p p:p_brand ?b ; p:p_size ?z } GROUP BY ?b", f"select {lit('p_brand')} b, {typed('count(*)')} n, {typed('count(distinct p_size)')} d, {typed('sum(p_size)')} s, {typed('min(p_size)')} lo, {typed('max(p_size)')} hi from part group by p_brand")
add("spq17_empty_group", "n_name", "SELECT (COUNT(*) AS ?n) (SUM(?z) AS ?s) WHERE { ?x p:none ?z }", f"select {typed('0')} n, {typed('0')} s")
add("spq17_average", "p_brand p_size", "SELECT ?b (ROUND(AVG(?z) * 1000) AS ?a) WHERE { ?p p:p_brand ?b ; p:p_size ?z } GROUP BY ?b", f"select {lit('p_brand')} b, {typed('floor(avg(p_size) * 1000 + 0.5)::bigint')} a from part group by p_brand")
add("spq18_group_concat", "n_name n_regionkey", 'SELECT ?r (GROUP_CONCAT(DISTINCT ?name; SEPARATOR="|") AS ?all) WHERE { ?n p:n_regionkey ?r ; p:n_name ?name } GROUP BY ?r', f"""select {iri('region', 'n_regionkey')} r, '"' || string_agg(n_name, '|' order by n_name) || '"' as "all" from nation group by n_regionkey""")
add("spq18_sample", "n_regionkey", "SELECT ?r (COUNT(?n) AS ?k) (SAMPLE(?r) AS ?any) WHERE { ?n p:n_regionkey ?r } GROUP BY ?r", f"""select {iri('region', 'n_regionkey')} r, {typed('count(*)')} k, {iri('region', 'n_regionkey')} as "any" from nation group by n_regionkey""")
add("spq19_subselect", "c_nationkey o_custkey n_name", "SELECT ?name ?k WHERE { ?n p:n_name ?name { SELECT ?n (COUNT(?o) AS ?k) WHERE { ?c p:c_nationkey ?n . ?o p:o_custkey ?c } GROUP BY ?n } }", f"select {lit('n_name')} as name, {typed('count(*)')} k from nation join customer on c_nationkey = n_nationkey join orders on o_custkey = c_custkey group by n_name")
add("spq20_sequence_inverse", "c_nationkey n_regionkey", "SELECT ?r ?c WHERE { ?r ^p:n_regionkey/^p:c_nationkey ?c }", f"select {iri('region', 'n_regionkey')} r, {CUSTOMER} c from customer join nation on c_nationkey = n_nationkey")
add("spq20_alternative", "c_nationkey s_nationkey", "SELECT ?n (COUNT(?x) AS ?k) WHERE { ?x p:c_nationkey|p:s_nationkey ?n } GROUP BY ?n", f"select {iri('nation', 'k')} n, {typed('count(*)')} k from (select c_nationkey k from customer union all select s_nationkey from supplier) group by k")
add("spq20_negated", "n_name n_regionkey", "SELECT ?n ?x WHERE { ?n !p:n_name ?x }", f"select {NATION} n, {iri('region', 'n_regionkey')} x from nation")
add("spq21_plus", "o_custkey c_nationkey n_regionkey", "SELECT ?x WHERE { ?x (p:o_custkey|p:c_nationkey|p:n_regionkey)+ region:2 }", f"select {NATION} x from nation where n_regionkey = 2 union select {CUSTOMER} from customer join nation on c_nationkey = n_nationkey where n_regionkey = 2 union select {ORDER} from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where n_regionkey = 2")
add("spq21_star", "c_nationkey n_regionkey", "SELECT ?x WHERE { customer:7 (p:c_nationkey|p:n_regionkey)* ?x }", f"select '<urn:csv:customer.csv:7>' x union select {iri('nation', 'c_nationkey')} from customer where c_custkey = 7 union select {iri('region', 'n_regionkey')} from customer join nation on c_nationkey = n_nationkey where c_custkey = 7")
add("spq21_optional_step", "c_nationkey n_regionkey", "SELECT ?x WHERE { nation:6 p:n_regionkey? ?x }", f"select '<urn:csv:nation.csv:6>' x union select {iri('region', 'n_regionkey')} from nation where n_nationkey = 6")
add("spq21_closure_all", "c_nationkey n_regionkey", "SELECT ?x ?y WHERE { ?x (p:c_nationkey|p:n_regionkey)+ ?y }", f"select {CUSTOMER} x, {iri('nation', 'c_nationkey')} y from customer union select {NATION}, {iri('region', 'n_regionkey')} from nation union select {CUSTOMER}, {iri('region', 'n_regionkey')} from customer join nation on c_nationkey = n_nationkey")
add("spq22_ask", "n_name", 'ASK { ?n p:n_name "NATION_7" }', "select count(*) > 0 as ask from nation where n_name = 'NATION_7'")
add("spq23_construct", "c_nationkey n_regionkey", "CONSTRUCT { ?c <urn:in> ?r . ?r <urn:has> ?c } WHERE { ?c p:c_nationkey/p:n_regionkey ?r }", f"select {CUSTOMER} subject, '<urn:in>' predicate, {iri('region', 'n_regionkey')} as object from customer join nation on c_nationkey = n_nationkey union select {iri('region', 'n_regionkey')}, '<urn:has>', {CUSTOMER} from customer join nation on c_nationkey = n_nationkey")
add("spq23_describe", "n_name n_regionkey", "DESCRIBE ?n WHERE { ?n p:n_regionkey region:4 }", f"select {NATION} subject, '<urn:csv:prop:n_name>' predicate, {lit('n_name')} as object from nation where n_regionkey = 4 union all select {NATION}, '<urn:csv:prop:n_regionkey>', {iri('region', 'n_regionkey')} from nation where n_regionkey = 4")

# Functions
add("fn1_term_tests", "n_name n_regionkey p_size", "SELECT ?x ?i ?l ?k WHERE { ?n ?p ?x BIND(isIRI(?x) AS ?i) BIND(isLiteral(?x) AS ?l) BIND(isNumeric(?x) AS ?k) }", " union all ".join(f"select {x} x, {true(i)} i, {true(li)} l, {true(k)} k from {tb}" for x, i, li, k, tb in ((lit("n_name"), "true", "not true", "not true", "nation"), (iri("region", "n_regionkey"), "true = true", "not true", "not true", "nation"), (typed("p_size"), "not true", "true", "true", "part"))).replace(f"select {lit('n_name')} x, {true('true')} i, {true('not true')} l", f"select {lit('n_name')} x, {true('not true')} i, {true('true')} l"))
add("fn2_accessors", "n_name p_size", "SELECT ?x ?s ?d WHERE { ?n ?p ?x BIND(STR(?x) AS ?s) BIND(DATATYPE(?x) AS ?d) }", f"select {lit('n_name')} x, {lit('n_name')} s, '<{XSD}string>' d from nation union all select {typed('p_size')}, {lit('p_size')}, '<{XSD}integer>' from part")
add("fn2_constructors", "n_name", 'SELECT ?n ?u ?t ?l WHERE { ?n p:n_name ?x BIND(IRI(CONCAT("urn:name:", ?x)) AS ?u) BIND(STRDT(?x, <urn:code>) AS ?t) BIND(STRLANG(?x, "en") AS ?l) }', f"""select {NATION} n, '<urn:name:' || n_name || '>' u, '"' || n_name || '"^^<urn:code>' t, '"' || n_name || '"@en' l from nation""")
add("fn3_strings", "p_name", 'SELECT ?p ?a ?b ?c ?d ?e ?f WHERE { ?p p:p_name ?x BIND(STRLEN(?x) AS ?a) BIND(SUBSTR(?x, 2, 3) AS ?b) BIND(UCASE(?x) AS ?c) BIND(STRBEFORE(?x, " ") AS ?d) BIND(STRAFTER(?x, " ") AS ?e) BIND(ENCODE_FOR_URI(?x) AS ?f) }', f"select {PART} p, {typed('length(p_name)')} a, {lit('substr(p_name, 2, 3)')} b, {lit('upper(p_name)')} c, {lit('''split_part(p_name, ' ', 1)''')} d, {lit('''substr(p_name, instr(p_name, ' ') + 1)''')} e, {lit('''replace(p_name, ' ', '%20')''')} f from part")
add("fn3_string_tests", "p_name", 'SELECT ?p ?x WHERE { ?p p:p_name ?x FILTER(CONTAINS(?x, "ring") || STRSTARTS(?x, "blue") || STRENDS(?x, "bolt")) }', f"select {PART} p, {lit('p_name')} x from part where p_name like '%ring%' or p_name like 'blue%' or p_name like '%bolt'")
add("fn3_regex_replace", "p_name", 'SELECT ?p ?y WHERE { ?p p:p_name ?x FILTER(REGEX(?x, "^[A-M].*T$", "i")) BIND(REPLACE(?x, "[aeiou]", "*") AS ?y) }', f"select {PART} p, {lit('''regexp_replace(p_name, '[aeiou]', '*', 'g')''')} y from part where regexp_matches(p_name, '^[A-M].*T$', 'i')")
add("fn4_numeric", "p_size", "SELECT ?p ?a ?b ?c ?d WHERE { ?p p:p_size ?z BIND(ABS(?z - 25) AS ?a) BIND(FLOOR(?z / 4) AS ?b) BIND(CEIL(?z / 4) AS ?c) BIND(ROUND(?z / 4) AS ?d) }", f"select {PART} p, {typed('abs(p_size - 25)')} a, {typed('floor(p_size / 4.0)::bigint')} b, {typed('ceil(p_size / 4.0)::bigint')} c, {typed('floor(p_size / 4.0 + 0.5)::bigint')} d from part")
add("fn5_dates", "o_orderdate", "SELECT ?y ?m (COUNT(*) AS ?n) WHERE { ?o p:o_orderdate ?d } GROUP BY (YEAR(?d) AS ?y) (MONTH(?d) AS ?m)", f"select {typed('year(o_orderdate)')} y, {typed('month(o_orderdate)')} m, {typed('count(*)')} n from orders group by year(o_orderdate), month(o_orderdate)")
add("fn6_hashes", "n_name", "SELECT ?n ?a ?b WHERE { ?n p:n_name ?x BIND(MD5(?x) AS ?a) BIND(SHA256(?x) AS ?b) }", f"select {NATION} n, {lit('md5(n_name)')} a, {lit('sha256(n_name)')} b from nation")
add("fn7_conditional", "p_size p_brand", 'SELECT ?p ?k ?w WHERE { ?p p:p_size ?z ; p:p_brand ?b BIND(IF(?z > 25, "big", "small") AS ?k) BIND(COALESCE(?none, ?b) AS ?w) FILTER(?z IN (5, 30, 45) || ?b NOT IN ("Brand#1", "Brand#2")) }', f"select {PART} p, {lit('''case when p_size > 25 then 'big' else 'small' end''')} k, {lit('p_brand')} w from part where p_size in (5, 30, 45) or p_brand not in ('Brand#1', 'Brand#2')")
add("fn8_casts", "p_size p_brand", "SELECT ?p ?s ?i WHERE { ?p p:p_size ?z ; p:p_brand ?b BIND(xsd:string(?z) AS ?s) BIND(xsd:integer(STRAFTER(?b, \"#\")) AS ?i) }", f"select {PART} p, {lit('p_size')} s, {typed('substr(p_brand, 7)')} i from part")


def _json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparql.results_json(sparql.query(star.quads(spark, sf_dir, "n_name", "n_regionkey"), star.PREFIXES + "SELECT ?n ?name WHERE { ?n p:n_name ?name ; p:n_regionkey region:1 }"))


QUERIES["snk12_result_json"] = _json
SQL["snk12_result_json"] = """select '{"?n":"<urn:csv:nation.csv:' || n_nationkey || '>","?name":"\\"' || n_name || '\\""}' binding from nation where n_regionkey = 1"""
add("fn1_bound_and_same", "n_name n_regionkey", "SELECT ?n ?b ?s ?k WHERE { ?n p:n_name ?x OPTIONAL { ?n p:n_regionkey region:1 . BIND(?n AS ?m) } BIND(BOUND(?m) AS ?b) BIND(sameTerm(?n, nation:3) AS ?s) BIND(isBlank(?n) AS ?k) }", f"select {NATION} n, {true('n_regionkey = 1')} b, {true('n_nationkey = 3')} s, {true('false')} k from nation")
add("fn2_languages", "n_name", 'SELECT ?n ?l ?e ?m WHERE { ?n p:n_name ?x BIND(STRLANG(?x, "en-GB") AS ?t) BIND(LANG(?t) AS ?l) BIND(LANG(?x) AS ?e) BIND(langMatches(LANG(?t), "EN") AS ?m) }', f"""select {NATION} n, '"en-gb"' l, '""' e, {true('true')} m from nation""")
add("fn2_fresh_terms", "n_name", "SELECT ?n ?b ?u ?s ?d WHERE { ?n p:n_name ?x BIND(isBlank(BNODE(?x)) AS ?b) BIND(isIRI(UUID()) AS ?u) BIND(STRLEN(STRUUID()) AS ?s) BIND(sameTerm(BNODE(?x), BNODE(?x)) AS ?d) }", f"select {NATION} n, {true('true')} b, {true('true')} u, {typed('36')} s, {true('true')} d from nation")
add("fn5_times", "o_orderdate", "SELECT ?o ?d ?h ?i ?s ?z WHERE { ?o p:o_orderdate ?t BIND(DAY(?t) AS ?d) BIND(HOURS(?t) AS ?h) BIND(MINUTES(?t) AS ?i) BIND(SECONDS(?t) AS ?s) BIND(TZ(?t) AS ?z) }", f"select {ORDER} o, {typed('day(o_orderdate)')} d, {typed('hour(o_orderdate)')} h, {typed('minute(o_orderdate)')} i, {typed('second(o_orderdate)', 'decimal')} s, '\"Z\"' z from orders")
add("fn6_sha1", "n_name", "SELECT ?n ?a WHERE { ?n p:n_name ?x BIND(SHA1(?x) AS ?a) }", f"select {NATION} n, {lit('sha1(n_name)')} a from nation")
add("fn8_more_casts", "p_size", "SELECT ?p ?d ?f ?b WHERE { ?p p:p_size ?z BIND(DATATYPE(xsd:double(?z)) AS ?d) BIND(DATATYPE(xsd:decimal(?z)) AS ?f) BIND(xsd:boolean(?z - ?z) AS ?b) }", f"select {PART} p, '<{XSD}double>' d, '<{XSD}decimal>' f, {true('false')} b from part")
