"""Quality classifier with hierarchical empirical Bayes over sites.

A logistic model on a few surface features gives each document its own probability of being good; it
is trained on a bounded sample of the labelled rows. Those probabilities are then averaged, over all
documents, by host and by path, and pulled toward what lies above: a host toward the corpus, a path
toward its host, the more the fewer documents they have. How strongly is estimated from the data, by
the method of moments, at each level. The log odds of a document's path, relative to the corpus, are added to the
document's own. They are taken without the document, in its path as in its host: a site says nothing of a
document that it has from that document alone.

A host is a ``source`` and a path is a source's documents in one language, unless ``host`` and
``path`` are given; url_host() and url_path() take both from URLs.

Ids may be of any type that has an order. Nulls: a null or empty text has features 0. A null host or path is a site of its
own. Repeated rows each count; of several labelled texts of one id the model is fitted on the one of the smallest features.
Without labels of both kinds every document's own probability is 0.5. An empty table gives
an empty result. Texts are read whole, however long. Other columns, of any name, are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadloom.llm.arrowtext import distinct_in_rows, mapped, raw, span_hash, word_slices
from quadloom.llm.skew import lookup
from quadloom.llm.storage import written
from quadloom.llm.toxicity import labelled_sample, labelled_texts

LABELLED = 50_000
THRESHOLD = 0.5
FEATURES = ("words", "word_length", "distinct", "top_word", "repeated_next", "marks", "digits", "upper", "lines", "distinct_lines")
_MARK = np.zeros(128, dtype=bool)
_MARK[[ord(c) for c in "#$%&*<>=|{}[]\\^~@+_/"]] = True
_BYTES = {"marks": lambda d: (d < 128) & _MARK[np.minimum(d, 127)], "digits": lambda d: (d >= 48) & (d <= 57), "upper": lambda d: (d >= 65) & (d <= 90)}


def features(column: pa.Array) -> np.ndarray:
    """A row of FEATURES per text."""
    out = np.zeros((len(column), len(FEATURES)))
    original, off = raw(column)
    for i, j, data, s, e, first in word_slices(column):
        rows = j - i
        n = np.diff(first)
        some = np.maximum(n, 1)
        h = span_hash(data, s, e)
        row = np.repeat(np.arange(rows), n)
        _, counts, bounds = distinct_in_rows(h, first)
        distinct = np.diff(bounds)
        top = np.zeros(rows)
        live = np.flatnonzero(distinct)
        if len(live):
            top[live] = np.maximum.reduceat(counts, bounds[:-1][live])
        again = np.flatnonzero((h[1:] == h[:-1]) & (row[1:] == row[:-1]))
        part = original[off[i] : off[j]]
        at = off[i : j + 1] - off[i]
        size = np.maximum(np.diff(at), 1)
        f = {
            "words": np.log1p(n),
            "word_length": np.bincount(row, weights=e - s, minlength=rows) / some,
            "distinct": distinct / some,
            "top_word": top / some,
            "repeated_next": np.bincount(row[again], minlength=rows) / some,
        }
        for name, test in _BYTES.items():
            f[name] = (lambda c: c[at[1:]] - c[at[:-1]])(np.concatenate([[0], np.cumsum(test(part))])) / size
        cut = np.zeros(len(part) + 1, dtype=bool)
        cut[np.flatnonzero(part == 10) + 1] = True
        cut[at] = True
        edge = np.flatnonzero(cut)
        begin, end = edge[:-1], edge[1:]
        line_row = np.searchsorted(at, begin, side="right") - 1
        line_first = np.searchsorted(line_row, np.arange(rows + 1))
        lines = np.maximum(np.diff(line_first), 1)
        _, _, line_bounds = distinct_in_rows(span_hash(part, begin, end), line_first)
        f["lines"] = np.log1p(lines)
        f["distinct_lines"] = np.diff(line_bounds) / lines
        out[i:j] = np.stack([f[k] for k in FEATURES], axis=1)
    return np.round(out, 9)


def _expand(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised features with squares, so that too little and too much can both be bad."""
    z = np.clip((x - mean) / scale, -6, 6)
    return np.concatenate([np.ones((len(z), 1)), z, z * z], axis=1)


def fit(source: DataFrame, labels: DataFrame, label: str = "quality", most: int = LABELLED) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(mean, scale, coefficients), or None without labels of both kinds; source: key, text."""
    ids, y = labelled_sample(labels, label, source.schema["key"].dataType, most=most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("y"), *(pa.array(x[:, k]) for k in range(len(FEATURES)))], names=["key", "y", *FEATURES])

    labelled = labelled_texts(source, ids, y)
    seen = labelled.transform(mapped, run, f"key {source.schema['key'].dataType.simpleString()}, y int, " + ", ".join(f"{f} double" for f in FEATURES))
    got = seen.groupBy("key").agg(F.min(F.struct("y", *FEATURES)).alias("x")).orderBy("key").select("x.*").toArrow()
    target = got["y"].to_numpy().astype(np.float64)
    if len(np.unique(target)) < 2:
        return None
    x = np.stack([got[f].to_numpy() for f in FEATURES], axis=1)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = _expand(x, mean, scale)
    w = np.zeros(z.shape[1])
    ridge = np.diag([1e-6, *np.full(z.shape[1] - 1, 1.0)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z.T * np.maximum(p * (1 - p), 1e-6)) @ z + ridge, z.T @ (target - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return mean, scale, w


def evidence(df: DataFrame, model, text: str = "text", key: str = "doc_id", host: Column | None = None, path: Column | None = None) -> DataFrame:
    """key, host, path, p: each document's own probability of being good."""
    host = (host if host is not None else F.col("source")).cast("string")
    path = (path if path is not None else F.col("lang")).cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if model is None:
                p = np.full(batch.num_rows, 0.5)
            else:
                mean, scale, w = model
                p = 1 / (1 + np.exp(-np.clip(_expand(features(batch.column("text")), mean, scale) @ w, -30, 30)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "host", "path")), pa.array(np.clip(p, 1e-6, 1 - 1e-6))], names=schema.names)

    source = df.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("p", T.DoubleType())])
    return source.transform(mapped, run, schema)


def _strength(table: DataFrame, above: str) -> DataFrame:
    """One row: how many documents' worth the level above counts (kappa); table: n, mean, above.

    Method of moments: the variance of site means beyond what sampling explains, per n.
    """
    inner = F.col(above) * (1 - F.col(above))
    spread = F.sum(F.col("n") * (F.pow(F.col("mean") - F.col(above), 2)))
    t = table.agg(spread.alias("ss"), F.sum("within").alias("within"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.count("*").alias("k"), F.avg(inner).alias("inner"))
    free = F.col("n") - F.col("nn") / F.col("n")
    noise = F.col("within") / F.greatest(F.col("n") - F.col("k"), F.lit(1))
    between = (F.col("ss") - (F.col("k") - 1) * noise) / F.greatest(free, F.lit(1.0))
    return t.select(F.coalesce(F.least(F.lit(1e6), F.greatest(F.lit(1.0), noise / F.greatest(between, F.lit(1e-9)))), F.lit(1e6)).alias("kappa"))


def url_host(url: Column) -> Column:
    """The host of a URL in lower case, without user, port and leading www; null where there is none."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def url_path(url: Column) -> Column:
    """The first folder of a URL's path, "/" where there is none."""
    return F.concat(F.lit("/"), F.regexp_extract(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), r"^/([^/]+)/", 1))


def posteriors(documents: DataFrame) -> DataFrame:
    """A row per path of documents(host, path, p): host, path, n and s (how many, sum of p), kappa, host_n, host_s, host_kappa, host_mean, corpus."""
    paths = written(documents.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    corpus = F.broadcast(paths.agg((F.sum("s") / F.sum("n")).alias("corpus")))
    shape = lambda t: t.withColumn("mean", F.col("s") / F.col("n")).withColumn("within", F.greatest(F.lit(0.0), F.col("q") - F.col("s") * F.col("s") / F.col("n")))
    hosts = shape(hosts).crossJoin(corpus)
    hosts = hosts.crossJoin(F.broadcast(_strength(hosts, "corpus")))
    hosts = hosts.select(F.col("host").alias("h"), "corpus", F.col("n").alias("host_n"), F.col("s").alias("host_s"), F.col("kappa").alias("host_kappa"), ((F.col("s") + F.col("kappa") * F.col("corpus")) / (F.col("n") + F.col("kappa"))).alias("host_mean"))
    paths = written(shape(paths).join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h"), "sites")
    return paths.crossJoin(F.broadcast(_strength(paths, "host_mean"))).select("host", "path", "n", "s", "kappa", "host_n", "host_s", "host_kappa", "host_mean", "corpus")


def classify(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", host: Column | None = None, path: Column | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """key, p_document, p_host, p_path, p_good, keep for every row of df; p_host and p_path are the sites' posterior means over all their documents."""
    source = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    documents = written(evidence(df, fit(source, labels), text, key, host, path), "evidence")
    named = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit(""))
    sites = posteriors(documents).select(named(F.col("host")).alias("h"), named(F.col("path")).alias("l"), "n", "s", "kappa", "host_n", "host_s", "host_kappa", "host_mean", "corpus")
    joined = lookup(documents.select("key", "p", named(F.col("host")).alias("h"), named(F.col("path")).alias("l")), written(sites, "posteriors"), ["h", "l"], "n")
    p, corpus = F.col("p"), F.col("corpus")
    shrunk = lambda s, n, kappa, above: (s + kappa * above) / (n + kappa)
    host_others = shrunk(F.col("host_s") - p, F.col("host_n") - 1, F.col("host_kappa"), corpus)
    others = shrunk(F.col("s") - p, F.col("n") - 1, F.col("kappa"), host_others)
    logit = lambda c: F.log(c / (1 - c))
    safe = lambda c: F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), c))
    good = 1 / (1 + F.exp(-(logit(p) + logit(safe(others)) - logit(safe(corpus)))))
    return joined.select(F.col("key").alias(key), p.alias("p_document"), F.col("host_mean").alias("p_host"), shrunk(F.col("s"), F.col("n"), F.col("kappa"), F.col("host_mean")).alias("p_path"), good.alias("p_good"), (good >= threshold).alias("keep"))


def query(spark, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
