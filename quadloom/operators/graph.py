"""Traversal, degree, expansion and hybrid search over edges(s, p, o) of IRIs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadloom.functions.terms import RDF_TYPE
from quadloom.operators import vectors as vec
from quadloom.operators.loops import durable


def edges_of(quads: DataFrame) -> DataFrame:
    """s, p, o of quads between IRIs, over all graphs, a row per quad."""
    return quads.where("s_kind = 'iri' and o_kind = 'iri'").select("s", "p", "o")


def degrees(quads: DataFrame) -> DataFrame:
    """node, degree: quads in and out over all graphs; a self-loop counts twice."""
    out = quads.where("s_kind = 'iri'").select(F.col("s").alias("node"))
    into = quads.where("o_kind = 'iri'").select(F.col("o").alias("node"))
    return out.unionAll(into).groupBy("node").agg(F.count("*").alias("degree"))


def degree(quads: DataFrame, uri: str) -> DataFrame:
    """degree of one node: one row."""
    return quads.agg((F.count(F.when((F.col("s") == uri) & (F.col("s_kind") == "iri"), 1)) + F.count(F.when((F.col("o") == uri) & (F.col("o_kind") == "iri"), 1))).alias("degree"))


def directed(quads: DataFrame, direction: str = "outgoing") -> DataFrame:
    """node, p, next, next_kind, direction."""
    direction = direction or "outgoing"
    out = quads.where("s_kind = 'iri'").select(F.col("s").alias("node"), "p", F.col("o").alias("next"), F.col("o_kind").alias("next_kind"), F.lit("outgoing").alias("direction"))
    into = quads.where("o_kind = 'iri'").select(F.col("o").alias("node"), "p", F.col("s").alias("next"), F.col("s_kind").alias("next_kind"), F.lit("incoming").alias("direction"))
    return {"outgoing": out, "incoming": into}[direction] if direction != "both" else out.unionByName(into)


def neighbours_once(quads: DataFrame, uri: str, direction: str = "outgoing") -> DataFrame:
    """One hop without removal of repeats: direction, predicate, uri, score 1."""
    return directed(quads, direction).where(F.col("node") == uri).select("direction", F.col("p").alias("predicate"), F.col("next").alias("uri"), F.lit(1.0).alias("score"))


def degree_penalty(score: Column, degree: Column, kind: str = "log") -> Column:
    """Hub penalty: by max(ln(degree + 1), 0.1), or by sqrt(degree)."""
    return score / (F.greatest(F.log(degree + 1), F.lit(0.1)) if kind == "log" else F.sqrt(F.greatest(degree, F.lit(1))))


def bfs(quads: DataFrame, start: DataFrame, depth: int = 1, direction: str = "outgoing", edge_filter: str | None = None, node_type: str | None = None, limit_per_layer: int | None = None, limit_per_node: int | None = None, scoring: str = "path", include_start_on_cycle: bool = True) -> DataFrame:
    """start, node, edge_type, direction, depth, score: nodes reached within ``depth`` hops of each of start (of one column), each at its first depth.

    Edges must contain ``edge_filter`` in their predicate, nodes must have ``node_type``; what is filtered out is
    not walked through. A layer takes at most ``limit_per_layer`` nodes, by node and predicate; of those that a
    node leads to, at most ``limit_per_node`` are taken. scoring: path is
    1 / depth; degree and degree_sqrt divide it by a hub penalty. A cycle may lead back to the start once.
    """
    step = directed(quads, direction)
    if edge_filter:
        step = step.where(F.col("p").contains(edge_filter))
    if node_type:
        typed = quads.where((F.col("p") == RDF_TYPE) & (F.col("o") == node_type)).select(F.col("s").alias("next")).distinct()
        step = step.where("next_kind = 'iri'").join(typed, "next", "left_semi")
    step = step.select("node", "p", "next", "direction")
    frontier = start.toDF("start").distinct().withColumn("node", F.col("start"))
    visited = frontier.where("false") if include_start_on_cycle else frontier
    layers = None
    for d in range(1, depth + 1):
        reached = frontier.join(step, "node").select("start", F.col("node").alias("_from"), F.col("next").alias("node"), "p", "direction")
        fresh = reached.join(visited, ["start", "node"], "left_anti")
        if limit_per_node:
            fresh = fresh.withColumn("_r", F.row_number().over(Window.partitionBy("start", "_from").orderBy("node", "p"))).where(F.col("_r") <= limit_per_node).drop("_r")
        fresh = fresh.drop("_from")
        first = Window.partitionBy("start", "node").orderBy("p", "direction")
        fresh = fresh.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
        if limit_per_layer:
            fresh = fresh.withColumn("_r", F.row_number().over(Window.partitionBy("start").orderBy("node", "p"))).where(F.col("_r") <= limit_per_layer).drop("_r")
        fresh = durable(fresh)
        layer = fresh.select("start", "node", F.col("p").alias("edge_type"), "direction", F.lit(d).alias("depth"))
        layers = layer if layers is None else layers.unionByName(layer)
        visited = visited.unionByName(fresh.select("start", "node"))
        frontier = fresh.select("start", "node")
    score = F.lit(1.0) / F.col("depth")
    if scoring.startswith("degree"):
        layers = layers.join(degrees(quads), "node", "left")
        score = degree_penalty(score, F.coalesce("degree", F.lit(0)), "sqrt" if scoring == "degree_sqrt" else "log")
    return layers.select("start", "node", "edge_type", "direction", "depth", score.alias("score"))


def expand(quads: DataFrame, seeds: DataFrame, depth: int = 1) -> DataFrame:
    """seed, uri: objects reached over outgoing edges within ``depth`` hops."""
    return bfs(quads, seeds, depth).select(F.col("start").alias("seed"), F.col("node").alias("uri"))


def hybrid(quads: DataFrame, store: DataFrame, query: list[float], k: int = 10, depth: int = 1, limit: int = 20, mode: str = "hybrid", metric: str = "l2") -> DataFrame:
    """uri, score: nearest vectors, and what the graph holds around them at 0.8 of their score; the best score of each uri.

    mode: hybrid; vector_only does not expand; graph_only has nothing to start from and is empty.
    """
    hits = vec.nearest(store, query, k, metric).select(vec.metadata_uri(F.col("metadata"), F.col("key")).alias("uri"), "score")
    if mode == "graph_only":
        hits = hits.where("false")
    every = hits
    if depth > 0 and mode == "hybrid":
        hits = durable(hits)
        around = expand(quads, hits.select("uri"), depth).join(hits.groupBy(F.col("uri").alias("seed")).agg(F.max("score").alias("score")), "seed").select("uri", (F.col("score") * 0.8).alias("score"))
        every = hits.unionByName(around)
    return every.groupBy("uri").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "uri").limit(limit)


def hybrid_join(quads: DataFrame, store: DataFrame, queries: DataFrame, k: int = 10, depth: int = 1, limit: int = 20, mode: str = "hybrid", metric: str = "l2") -> DataFrame:
    """q, rank (from 1), uri, score: hybrid() for every row of queries(q, embedding); the vectors are searched in blocks of queries, and the graph is walked once from all hits."""
    hits = vec.nearest_join(queries, store, k, "q", "embedding", metric=metric)
    score = F.col("score") if metric == "cosine" else vec.score(F.col("distance"))
    named = store.select("key", vec.metadata_uri(F.col("metadata"), F.col("key")).alias("uri"))
    hits = durable(hits.select("q", "key", score.alias("score")).join(named, "key").groupBy("q", "uri").agg(F.max("score").alias("score")))
    if mode == "graph_only":
        hits = hits.where("false")
    every = hits
    if depth > 0 and mode == "hybrid":
        around = expand(quads, hits.select("uri").distinct(), depth).select(F.col("seed").alias("uri"), F.col("uri").alias("found"))
        every = hits.unionByName(hits.join(around, "uri").select("q", F.col("found").alias("uri"), (F.col("score") * 0.8).alias("score")))
    best = every.groupBy("q", "uri").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "uri"))).where(F.col("rank") <= limit).select("q", "rank", "uri", "score")


def ranked(results: DataFrame) -> DataFrame:
    """node_id (rank from 0), score, content, uri: the older search's form."""
    return results.withColumn("node_id", F.row_number().over(Window.orderBy(F.desc("score"), "uri")) - 1).select("node_id", "score", F.col("uri").alias("content"), "uri")
