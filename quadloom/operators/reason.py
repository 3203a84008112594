"""Rule-based inference as joins, and fixed points over them.

Two families. The core strategies (rdfs, owlrl) look at all graphs, keep reflexive results of cycles and
give a bag in a single pass. The extended rules take their schema from an ontology, never conclude
x p x, and give each new triple once, under the first rule that finds it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.functions.terms import OWL, RDF, RDF_TYPE, RDFS
from quadloom.operators.loops import closure, durable

SUBCLASS, SUBPROPERTY = RDFS + "subClassOf", RDFS + "subPropertyOf"
INVERSE = OWL + "inverseOf"
TRIPLE = ["s", "p", "o"]


def iri_triples(quads: DataFrame) -> DataFrame:
    """s, p, o between IRIs over all graphs, a row per quad."""
    return quads.where("s_kind = 'iri' and o_kind = 'iri'").select(*TRIPLE)


#: Up to so many rows of a schema are sent to all tasks, so that triples needn't be gathered by predicate or class.
SCHEMA_ROWS = 100_000
#: Triples that a task sorts or groups, on average.
TASK_ROWS = 250_000


def tasks(rows: int) -> int:
    """Into how many tasks to part so many triples."""
    return max(1, -(-rows // TASK_ROWS))


def small(schema: DataFrame) -> DataFrame | None:
    """schema, to be broadcast if it is as small as schemas are; None if it is empty."""
    n = schema.limit(SCHEMA_ROWS + 1).count()
    return None if not n else schema if n > SCHEMA_ROWS else F.broadcast(schema)


def kept(triples: DataFrame, properties: DataFrame | None, how: str = "left_semi") -> DataFrame:
    """triples whose predicate is among what small() gave."""
    return triples.where("false") if properties is None else triples.join(properties, "p", how)


def chain(left: DataFrame, right: DataFrame, by: list[str], parts: int | None = None) -> DataFrame:
    """x p z for x p y in left and y p z in right; joined in so many parts, else as Spark sees fit."""
    a = left.withColumnRenamed("o", "_m")
    b = right.select(F.col("s").alias("_m"), *(F.col(c) for c in by), F.col("o").alias("_z"))
    if parts:
        a, b = a.repartition(parts, "_m", *by), b.repartition(parts, "_m", *by)
    return a.join(b, ["_m", *by]).select("s", "p", F.col("_z").alias("o"))


def declared(triples: DataFrame, kind: str) -> DataFrame:
    """p: properties of an OWL class of properties."""
    return triples.where((F.col("p") == RDF_TYPE) & (F.col("o") == OWL + kind)).select(F.col("s").alias("p")).distinct()


def subclass_step(triples: DataFrame, parts: int | None = None) -> DataFrame:
    sub = triples.where(F.col("p") == SUBCLASS)
    return chain(sub, sub, ["p"], parts)


def transitive_step(triples: DataFrame) -> DataFrame:
    edges = kept(triples, small(declared(triples, "TransitiveProperty"))).select(*TRIPLE)
    return chain(edges, edges, ["p"])


def symmetric_step(triples: DataFrame) -> DataFrame:
    return kept(triples, small(declared(triples, "SymmetricProperty"))).select(F.col("o").alias("s"), "p", F.col("s").alias("o"))


def inverse_step(triples: DataFrame, both_ways: bool = False) -> DataFrame:
    pairs = triples.where(F.col("p") == INVERSE).select(F.col("s").alias("p"), F.col("o").alias("_q")).distinct()
    if both_ways:
        pairs = pairs.unionByName(pairs.select(F.col("_q").alias("p"), F.col("p").alias("_q"))).distinct()
    return inverted(triples, small(pairs))


def inverted(triples: DataFrame, pairs: DataFrame | None) -> DataFrame:
    """o q s for s p o, by pairs(p, _q) that small() gave."""
    if pairs is None:
        return triples.where("false").select(*TRIPLE)
    return triples.join(pairs, "p").select(F.col("o").alias("s"), F.col("_q").alias("p"), F.col("s").alias("o"))


STRATEGIES = {"none": [], "rdfs": [subclass_step], "owlrl": [transitive_step, symmetric_step, inverse_step]}


def apply(quads: DataFrame, strategy: str = "rdfs") -> DataFrame:
    """One pass of a strategy: the bag of what its rules conclude, known triples included; nothing is written."""
    triples = iri_triples(quads)
    rules = STRATEGIES[strategy.lower()]
    return reduce(DataFrame.unionAll, (r(triples) for r in rules)) if rules else triples.where("false")


def materialise(quads: DataFrame, strategy: str = "rdfs") -> DataFrame:
    """The triples that the strategy adds to the default graph, at the fixed point.

    rdfs: the closure of subClassOf over all graphs. owlrl: rounds over what the last round found until there
    is nothing new; a rule's two-sided joins are taken as new with all and all with new.
    """
    triples = iri_triples(quads)
    there = quads.where("g is null and s_kind = 'iri' and o_kind = 'iri'").select(*TRIPLE).distinct()
    kind = strategy.lower()
    if kind == "none":
        return triples.where("false")
    if kind == "rdfs":
        found = closure(triples.where(F.col("p") == SUBCLASS).select(F.col("s").alias("a"), F.col("o").alias("b")))
        once = chain(found.select(F.col("a").alias("s"), F.lit(SUBCLASS).alias("p"), F.col("b").alias("o")), triples.where(F.col("p") == SUBCLASS), ["p"]).distinct()
        return once.join(there, TRIPLE, "left_anti")
    # Every round's new triples are a table of their own; what was found is their union and is not written again.
    total = delta = durable(triples.distinct())
    added = there.where("false")
    while not delta.isEmpty():
        transitive, symmetric = small(declared(total, "TransitiveProperty")), small(declared(total, "SymmetricProperty"))
        edges = kept(total, transitive).select(*TRIPLE)
        new = kept(delta, transitive).select(*TRIPLE)
        schema = delta.where(((F.col("p") == RDF_TYPE) & F.col("o").isin(OWL + "TransitiveProperty", OWL + "SymmetricProperty")) | (F.col("p") == INVERSE))
        if not schema.isEmpty():  # a new declaration makes old edges count
            new, walked = edges, total
        else:
            walked = delta
        pairs = small(total.where(F.col("p") == INVERSE).select(F.col("s").alias("p"), F.col("o").alias("_q")).distinct())
        steps = [] if transitive is None else [chain(new, edges, ["p"]), chain(edges, new, ["p"])]
        steps += [] if symmetric is None else [kept(walked, symmetric).select(F.col("o").alias("s"), "p", F.col("s").alias("o"))]
        steps += [] if pairs is None else [inverted(walked, pairs)]
        if not steps:
            break
        concluded = durable(reduce(DataFrame.unionByName, steps).distinct())
        if concluded.isEmpty():
            break
        delta = durable(concluded.join(total, TRIPLE, "left_anti"))
        added = added.unionByName(concluded)
        total = total.unionByName(delta)
    return added.distinct().join(there, TRIPLE, "left_anti")


# Extended rules: triples and an ontology, both s, p, o.
def ext_subclass(triples: DataFrame, ontology: DataFrame, parts: int | None = None) -> DataFrame:
    return subclass_step(triples, parts).where("s <> o")


def superclasses(ontology: DataFrame) -> DataFrame:
    """a, b: b is a superclass of a, at any distance."""
    return closure(ontology.where(F.col("p") == SUBCLASS).select(F.col("s").alias("a"), F.col("o").alias("b"))).where("a <> b")


def ext_types(triples: DataFrame, ontology: DataFrame, parts: int | None = None) -> DataFrame:
    up = small(superclasses(ontology))
    return triples.where("false").select(*TRIPLE) if up is None else triples.where(F.col("p") == RDF_TYPE).join(up, F.col("o") == F.col("a")).select("s", "p", F.col("b").alias("o"))


def ext_transitive(triples: DataFrame, ontology: DataFrame, parts: int | None = None) -> DataFrame:
    edges = kept(triples, small(declared(ontology, "TransitiveProperty"))).select(*TRIPLE)
    return chain(edges, edges, ["p"], parts).where("s <> o")


def ext_inverse(triples: DataFrame, ontology: DataFrame, parts: int | None = None) -> DataFrame:
    pairs = ontology.where(F.col("p") == INVERSE).select(F.col("s").alias("p"), F.col("o").alias("_q"))
    pairs = pairs.unionByName(pairs.select(F.col("_q").alias("p"), F.col("p").alias("_q"))).distinct()
    return inverted(triples, small(pairs))


def ext_symmetric(triples: DataFrame, ontology: DataFrame, parts: int | None = None) -> DataFrame:
    return kept(triples, small(declared(ontology, "SymmetricProperty"))).select(F.col("o").alias("s"), "p", F.col("s").alias("o"))


def ext_domain_range(triples: DataFrame, ontology: DataFrame, parts: int | None = None) -> DataFrame:
    def typed(end: str, what: str) -> DataFrame:
        of = small(ontology.where(F.col("p") == RDFS + what).select(F.col("s").alias("p"), F.col("o").alias("_c")).distinct())
        return triples.where("false").select(*TRIPLE) if of is None else triples.join(of, "p").select(F.col(end).alias("s"), F.lit(RDF_TYPE).alias("p"), F.col("_c").alias("o"))

    return typed("s", "domain").unionByName(typed("o", "range"))


RULES = {"subclass": ext_subclass, "types": ext_types, "transitive": ext_transitive, "inverse": ext_inverse, "symmetric": ext_symmetric, "domain_range": ext_domain_range}


def infer(triples: DataFrame, ontology: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """rule, s, p, o: new triples of a single pass of the chosen rules over the input, each under its first rule.

    Known and concluded triples are grouped together, in as many parts as there are TASK_ROWS of them, since how many a
    file holds and how few bytes they take in a shuffle says little about the memory that they need.
    """
    names = list(rules or RULES)
    rows = triples.count()
    each = reduce(DataFrame.unionByName, (RULES[r](triples, ontology, tasks(2 * rows)).withColumn("_n", F.lit(k)) for k, r in enumerate(names)))
    each = each.unionByName(triples.select(*TRIPLE, F.lit(-1).alias("_n")))
    first = each.repartition(tasks(rows * (len(names) + 1)), *TRIPLE).groupBy(*TRIPLE).agg(F.min("_n").alias("_n")).where("_n >= 0")
    return first.select(F.element_at(F.array(*(F.lit(x) for x in names)), F.col("_n") + 1).alias("rule"), *TRIPLE)


def inference_report(triples: DataFrame, inferred: DataFrame) -> DataFrame:
    """rule, inferred, expansion_ratio (all inferred to the input)."""
    per = inferred.groupBy("rule").agg(F.count("*").alias("inferred"))
    sizes = triples.agg(F.count("*").alias("_in")).crossJoin(inferred.agg(F.count("*").alias("_out")))
    return per.crossJoin(F.broadcast(sizes)).select("rule", "inferred", F.when(F.col("_in") > 0, (F.col("_in") + F.col("_out")) / F.col("_in")).otherwise(1.0).alias("expansion_ratio"))


def expand_triples(triples: DataFrame, ontology: DataFrame) -> DataFrame:
    """Original and inferred triples at the fixed point of: types up the classes, super-properties, domains and ranges."""
    up = durable(superclasses(ontology).select(F.col("a").alias("_a"), F.col("b").alias("_b")))
    sup = closure(ontology.where(F.col("p") == SUBPROPERTY).select(F.col("s").alias("a"), F.col("o").alias("b"))).select(F.col("a").alias("p"), F.col("b").alias("_q"))
    base = triples.select(*TRIPLE).distinct()
    wider = base.unionByName(base.join(sup, "p").select("s", F.col("_q").alias("p"), "o")).distinct()
    typed = wider.unionByName(ext_domain_range(wider, ontology)).distinct()
    raised = typed.where(F.col("p") == RDF_TYPE).join(up, F.col("o") == F.col("_a")).select("s", "p", F.col("_b").alias("o"))
    # Types lead to no new properties, so one pass in this order is the fixed point.
    return typed.unionByName(raised).distinct()


CURIES = {"rdf": RDF, "rdfs": RDFS, "owl": OWL}
DEFAULT_NS = "http://quadloom.local/concept/"


def resolve_names(df: DataFrame, column: str, fragments: DataFrame, default_ns: str = DEFAULT_NS) -> DataFrame:
    """df with ``uri``: a URI as it is, a CURIE spelt out, a name by fragments(name, iri), else under the default namespace."""
    c = F.col(column)
    known = fragments.groupBy(F.lower("name").alias("_name")).agg(F.min("iri").alias("_iri"))
    curie = F.lit(None)
    for k, v in CURIES.items():
        curie = F.when(c.startswith(k + ":"), F.concat(F.lit(v), F.substr(c, F.lit(len(k) + 2)))).otherwise(curie)
    joined = df.join(known, F.lower(c) == F.col("_name"), "left")
    fallback = F.concat(F.lit(default_ns), F.replace(F.trim(c), F.lit(" "), F.lit("_")))
    return joined.withColumn("uri", F.when(c.startswith("http") | c.startswith("urn:"), c).otherwise(F.coalesce(curie, "_iri", fallback))).drop("_name", "_iri")
