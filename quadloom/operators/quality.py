"""Ontology validation, disambiguation, lookups, profiles, rewards."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadloom.functions import terms as t


def classes(ontology: DataFrame) -> DataFrame:
    """iri, name of classes of an ontology s, p, o."""
    own = ontology.where((F.col("p") == t.RDF_TYPE) & F.col("o").isin(t.OWL + "Class", t.RDFS + "Class")).select(F.col("s").alias("iri"))
    return own.distinct().withColumn("name", t.local_name("iri"))


def properties(ontology: DataFrame) -> DataFrame:
    kinds = [t.OWL + "ObjectProperty", t.OWL + "DatatypeProperty", t.OWL + "AnnotationProperty", t.RDF + "Property"]
    return ontology.where((F.col("p") == t.RDF_TYPE) & F.col("o").isin(kinds)).select(F.col("s").alias("iri")).distinct().withColumn("name", t.local_name("iri"))


def ontology_stats(ontology: DataFrame) -> DataFrame:
    """classes, properties, triples: one row."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(classes(ontology), "classes").crossJoin(n(properties(ontology), "properties")).crossJoin(n(ontology, "triples"))


def labelled(ontology: DataFrame, things: DataFrame) -> DataFrame:
    """iri, name, label (null where there is none)."""
    labels = ontology.where(F.col("p") == t.RDFS + "label").groupBy(F.col("s").alias("iri")).agg(F.min("o").alias("label"))
    return things.join(labels, "iri", "left")


def instances(triples: DataFrame, cls: str) -> DataFrame:
    return triples.where((F.col("p") == t.RDF_TYPE) & (F.col("o") == cls)).select(F.col("s").alias("iri")).distinct()


def match_class(terms: DataFrame, column: str, ontology: DataFrame) -> DataFrame:
    """terms with ``match``: the class whose label equals the term, else whose local name does, case ignored; the first by IRI."""
    known = labelled(ontology, classes(ontology))
    by_label = known.where("label is not null").groupBy(F.lower("label").alias("_l")).agg(F.min("iri").alias("_by_label"))
    by_name = known.groupBy(F.lower("name").alias("_n")).agg(F.min("iri").alias("_by_name"))
    low = F.lower(F.col(column))
    return terms.join(by_label, low == F.col("_l"), "left").join(by_name, low == F.col("_n"), "left").withColumn("match", F.coalesce("_by_label", "_by_name")).drop("_l", "_n", "_by_label", "_by_name")


def closest(words: list[str], cutoff: float = 0.6):
    """A pandas UDF: the word closest to a string by longest matching blocks, null below the cutoff; of equals the first in order."""
    known = sorted(words)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        seen: dict = {}
        for s in batches:
            for x in s.dropna().unique():
                if x not in seen:
                    got = difflib.get_close_matches(x, known, n=1, cutoff=cutoff)
                    seen[x] = got[0] if got else None
            yield s.map(lambda x: seen.get(x))

    return run


def normal(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"[ -]+", "_")


def validate(triples: DataFrame, ontology: DataFrame, strict: bool = True, suggest: bool = True) -> DataFrame:
    """subject, predicate, object, errors, suggestion, valid of each of triples(subject, predicate, object).

    strict: the predicate must be a property of the ontology. An object of a property with a numeric range must have
    a number in it. The suggestion for an unknown predicate is the closest property. The ontology is small
    beside the data; Spark broadcasts what it finds small enough.
    """
    props = properties(ontology)
    known = props.select(normal(F.col("name")).alias("_known")).distinct()
    ranges = ontology.where(F.col("p") == t.RDFS + "range").select(normal(t.local_name("s")).alias("_rp"), t.local_name("o").alias("_range")).groupBy("_rp").agg(F.max("_range").alias("_range"))
    name = normal(t.local_name("predicate"))
    df = triples.join(known, name == F.col("_known"), "left").join(ranges, name == F.col("_rp"), "left")
    numeric = F.lower("_range").rlike("float|decimal|integer|double")
    number = F.regexp_replace("object", "[^0-9.]", "").try_cast("double")
    errors = F.array_compact(F.array(
        F.when(F.col("_known").isNull() & F.lit(strict), F.concat(F.lit("unknown property: "), "predicate")),
        F.when(numeric & number.isNull(), F.concat(F.lit("not a number: "), "object")),
    ))
    df = df.withColumn("errors", errors)
    guess = F.lit(None).cast("string")
    if suggest:
        words = [r["name"] for r in props.select("name").distinct().collect()]  # the ontology's vocabulary
        guess = F.when(F.col("_known").isNull(), closest(words)(F.when(F.col("_known").isNull(), t.local_name("predicate"))))
    return df.select("subject", "predicate", "object", "errors", guess.alias("suggestion"), (F.size("errors") == 0).alias("valid"))


def validation_report(validated: DataFrame) -> DataFrame:
    """total, valid, invalid, corrections, accuracy: one row."""
    v = F.col("valid").cast("int")
    return validated.agg(F.count("*").alias("total"), F.coalesce(F.sum(v), F.lit(0)).alias("valid"), F.coalesce(F.sum(1 - v), F.lit(0)).alias("invalid"), F.count("suggestion").alias("corrections"), F.coalesce(F.avg(v), F.lit(0.0)).alias("accuracy"))


def known_entity(c: Column, names: list[str]) -> Column:
    """Whether a string is a class name, or holds one, case ignored."""
    low = F.lower(c)
    return F.exists(F.array(*(F.lit(x.lower()) for x in names)), lambda n: F.contains(low, n)) if names else F.lit(False)


def deduplicated(triples: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """triples with ``hash`` (md5 of s|p|o), each once, without those in seen(hash)."""
    hashed = triples.withColumn("hash", F.md5(F.concat_ws("|", "subject", "predicate", "object"))).dropDuplicates(["hash"])
    return hashed.join(seen.select("hash"), "hash", "left_anti") if seen is not None else hashed


def ingestion(triples: DataFrame, ontology: DataFrame, source: str = "unknown", metadata: dict | None = None, seen: DataFrame | None = None, rules: list[str] | None = None, skip_enrichment: bool = False, strict: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, hashes, counts) of an ingest of triples(subject, predicate, object): validated, each once, enriched, with provenance.

    rows: subject, predicate, object, provenance, inferred. hashes: those of the triples taken, to be given as ``seen``
    next time. counts: one row of input, validated, duplicates (among them and against ``seen``), enriched, stored, errors.
    metadata's source, timestamp and method go before those given.
    """
    from quadloom.operators import reason
    from quadloom.operators.loops import durable

    given = durable(validate(triples, ontology, strict, suggest=False))
    valid = given.where("valid").select("subject", "predicate", "object")
    own = durable(deduplicated(valid, seen))
    spo = own.select(F.col("subject").alias("s"), F.col("predicate").alias("p"), F.col("object").alias("o"))
    facts = own.select("subject", "predicate", "object", F.lit(False).alias("inferred"))
    if not skip_enrichment:
        more = reason.infer(spo, ontology, rules).select(F.col("s").alias("subject"), F.col("p").alias("predicate"), F.col("o").alias("object"), F.lit(True).alias("inferred"))
        facts = facts.unionByName(more)
    facts = durable(facts)
    extra = metadata or {}
    stamp = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    prov = F.struct(F.lit(extra.get("source", source)).alias("source"), (F.lit(extra["timestamp"]) if "timestamp" in extra else stamp).alias("timestamp"), F.lit(extra.get("method", "SLM")).alias("method"))
    n = lambda df, **named: df.agg(*(c.alias(k) for k, c in named.items()))
    counts = n(given, input=F.count("*"), validated=F.count_if("valid"), errors=F.count_if(~F.col("valid"))).crossJoin(n(own, _own=F.count("*"))).crossJoin(n(facts, enriched=F.count_if("inferred"), stored=F.count("*")))
    counts = counts.select("input", "validated", (F.col("validated") - F.col("_own")).alias("duplicates"), "enriched", "stored", "errors")
    return facts.select("subject", "predicate", "object", prov.alias("provenance"), "inferred"), own.select("hash"), counts


def suggest_merges(names: DataFrame, column: str, threshold: float = 0.8) -> DataFrame:
    """a, b (a < b), similarity >= threshold of the labels of distinct strings, most similar first.

    Exact: edits change a label's length by at most as much, and of d edits at most d of d + 1 pieces are
    touched. So labels are cut into pieces by their length, and only pairs that share a piece at a place
    within reach are compared. Equal labels meet as one, and are spread out again afterwards.
    """
    each = names.select(F.col(column).alias("name")).where("name is not null").distinct().withColumn("label", F.lower(t.label("name")))
    labels = each.select("label").distinct().withColumn("n", F.length("label"))
    # A pair of lengths m <= n meets the threshold only with at most (1 - threshold) n edits; m >= threshold n.
    edits = lambda n: F.floor((1 - threshold) * n + 1e-9).cast("int")
    long_ = labels.where("n > 0").withColumn("d", edits(F.col("n")))
    # The longer label's pieces: d + 1 of nearly equal length, each sought in the shorter one within d places.
    pieces = long_.select("label", "n", "d", F.explode(F.sequence(F.lit(0), F.col("d"))).alias("k"))
    begin, end = F.floor(F.col("k") * F.col("n") / (F.col("d") + 1)).cast("int"), F.floor((F.col("k") + 1) * F.col("n") / (F.col("d") + 1)).cast("int")
    pieces = pieces.select(F.col("label").alias("x"), "n", "d", F.col("k"), begin.alias("at"), F.substring(F.col("label"), begin + 1, end - begin).alias("piece"))
    # Every shape (n, d, k) of piece that labels of the lengths at hand can have.
    shapes = pieces.select("n", "d", "k", "at", F.length("piece").alias("w")).distinct()
    short = labels.where("n > 0").select(F.col("label").alias("y"), F.col("n").alias("m"))
    # Lengths, not labels, are matched by range: there are as many pairs of lengths as there are shapes, times the edits allowed.
    lengths = short.select("m").distinct()
    reach = lengths.join(shapes, (F.col("m") <= F.col("n")) & (F.col("n") - F.col("m") <= F.col("d")))
    fits = short.join(reach, "m")
    windows = fits.select("y", "m", "n", "k", "w", F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - F.col("d")), F.greatest(F.greatest(F.lit(0), F.col("at") - F.col("d")), F.least(F.col("at") + F.col("d"), F.col("m") - F.col("w"))))).alias("p"))
    windows = windows.select("y", "n", "k", F.substring(F.col("y"), F.col("p") + 1, F.col("w")).alias("piece")).distinct()
    met = pieces.select("x", "n", "k", "piece").join(windows, ["n", "k", "piece"]).select("x", "y").where("x <> y")
    met = met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    close = met.withColumn("similarity", t.similarity("x", "y")).where(F.col("similarity") >= threshold)
    same = each.select(F.col("label").alias("x"), F.col("label").alias("y")).distinct().withColumn("similarity", F.lit(1.0))
    both = close.unionByName(same)
    left, right = each.select(F.col("name").alias("_a"), F.col("label").alias("x")), each.select(F.col("name").alias("_b"), F.col("label").alias("y"))
    pairs = both.join(left, "x").join(right, "y").where("_a <> _b")
    return pairs.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"), "similarity").distinct().orderBy(F.desc("similarity"), "a", "b")


def disambiguation_report(merges: DataFrame) -> DataFrame:
    percent = F.format_string("%.1f", F.col("similarity") * 100)
    return merges.withColumn("message", F.concat("a", F.lit(" and "), "b", F.lit(" are "), percent, F.lit("% alike")))


def column_profile(df: DataFrame, sample: int = 100, categories: int = 20, samples: int = 5) -> DataFrame:
    """column, is_numeric, is_category, samples over the first rows of a table."""
    head = df.limit(sample)
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("v")) for c in df.columns))
    each = head.select(F.explode(cells).alias("t")).select("t.*").where("v is not null and v <> ''")
    return each.groupBy("column").agg(F.bool_and(F.col("v").try_cast("double").isNotNull()).alias("is_numeric"), (F.countDistinct("v") < categories).alias("is_category"), F.slice(F.sort_array(F.collect_set("v")), 1, samples).alias("samples"))


def profile_triples(df: DataFrame, key: str, profile: DataFrame) -> DataFrame:
    """subject, predicate, object of a table's cells, predicates named by what the column holds: category, number or text."""
    names = [c for c in df.columns if c != key]
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("object")) for c in names))
    each = df.select(F.col(key).cast("string").alias("subject"), F.explode(cells).alias("t")).select("subject", "t.*").where("object is not null and object <> ''").join(profile, "column")
    name = F.replace(F.lower("column"), F.lit(" "), F.lit("_"))
    predicate = F.when(F.col("is_numeric"), F.concat(F.lit("hasValue_"), name)).when(F.col("is_category"), F.concat(F.lit("hasCategory_"), name)).otherwise(F.concat(F.lit("has_"), name))
    return each.select("subject", predicate.alias("predicate"), "object")


def row_context(df: DataFrame, order: str, text: Column, by: str) -> DataFrame:
    """df with the texts of the two rows before and the relative position of each row in its document ``by``."""
    w = Window.partitionBy(by).orderBy(order)
    return df.withColumn("_t", text).withColumn("previous_1", F.lag("_t", 1).over(w)).withColumn("previous_2", F.lag("_t", 2).over(w)).withColumn("position", (F.row_number().over(w) - 1) / F.count("*").over(Window.partitionBy(by))).drop("_t")


def keep_last(df: DataFrame, by: str, most: int, *order: str) -> DataFrame:
    """The last ``most`` rows of each group; audit trails are kept so."""
    w = Window.partitionBy(by).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


REWARDS = {"valid_triple": 1.0, "invalid_triple": -0.5, "inference_success": 0.8, "user_positive": 2.0, "user_negative": -2.0, "token_usage": -0.01, "error": -0.5}


def reward_events(events: DataFrame, signal: str, amount: Column) -> DataFrame:
    """events with ``reward``: the signal's value; for tokens, per hundred of ``amount``."""
    table = F.create_map(*(F.lit(x) for kv in REWARDS.items() for x in kv))
    value = F.try_element_at(table, F.col(signal))
    return events.withColumn("reward", F.when(F.col(signal) == "token_usage", value * amount / 100).otherwise(F.coalesce(value, F.lit(0.0))))


def reward_breakdown(events: DataFrame, signal: str) -> DataFrame:
    """signal, total per signal, and of all (signal null)."""
    return events.rollup(signal).agg(F.sum("reward").alias("total"))


def session_statistics(sessions: DataFrame) -> DataFrame:
    """total, with_feedback, positive, positive_rate, mean_reward: one row."""
    f = F.col("feedback")
    pos = F.lower(f.cast("string")).isin("positive", "good", "1", "1.0")
    return sessions.agg(F.count("*").alias("total"), F.count(f).alias("with_feedback"), F.count(F.when(pos, 1)).alias("positive")).crossJoin(sessions.agg(F.coalesce(F.avg("air_reward"), F.lit(0.0)).alias("mean_reward"))).withColumn("positive_rate", F.coalesce(F.try_divide(F.col("positive"), F.col("with_feedback")), F.lit(0.0)))


def with_feedback(sessions: DataFrame, kind: str = "any") -> DataFrame:
    """Rows that have feedback: any, positive or negative."""
    f = F.lower(F.col("feedback").cast("string"))
    test = {"any": f.isNotNull(), "positive": f.isin("positive", "good", "1", "1.0"), "negative": f.isin("negative", "bad", "-1", "-1.0", "0", "0.0")}[kind]
    return sessions.where(test)


def training_rows(sessions: DataFrame) -> DataFrame:
    return with_feedback(sessions).select(F.col("input").alias("text"), "output", "feedback", F.col("air_reward").alias("reward"))


def should_train(sessions: DataFrame, least: int = 50) -> bool:
    return with_feedback(sessions).limit(least).count() >= least


def extraction_reward(df: DataFrame, predicted: str, target: str, valid: str) -> DataFrame:
    """df with ``reward``: 0.1 per valid triple and the share of the target's triples that were predicted."""
    return df.withColumn("reward", F.lit(0.1) * F.col(valid) + F.coalesce(F.try_divide(F.size(F.array_intersect(predicted, target)), F.size(target)), F.lit(0.0)))
