"""Secret scan with corpus-wide ownership frequency.

Candidate strings are found by pattern in every whole text; the secret is the value alone, without the name it is
assigned to, quotes, or marks that end a sentence, so that one credential is one secret however it is written. For
each secret's hash the distinct documents, repositories and owners that hold it are counted over the whole corpus: a
string that many owners have is an example that was copied around, one that few have looks live if it looks random.

``documents`` has no repository column; by default the owner is ``source`` and a repository is a
source's documents in one language. Both are parameters.

Ids may be of any type. Nulls: a null text has no candidates; a null owner or repository counts as one value, "". Repeated
rows count once in documents, repositories and owners. Rows with a null doc_id are scanned and
reported with a null id. Ties cannot arise: a verdict depends on counts alone. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.llm.bloom import build, split
from quadloom.llm.skew import lookup
from quadloom.llm.storage import numbered, written

#: What stands before the value of an assignment.
NAMED = r"(?i:password|passwd|secret|token|api_key|apikey)[\"']?[ \t]{0,8}[=:][ \t]{0,8}[\"']?"
#: name, pattern of the value; the first that matches names the kind.
PATTERNS: tuple[tuple[str, str], ...] = (
    ("aws_access_key", r"AKIA[0-9A-Z]{16}"),
    ("github_token", r"gh[pousr]_[A-Za-z0-9]{36}"),
    ("slack_token", r"xox[baprs]-[A-Za-z0-9-]{10,}"),
    ("google_api_key", r"AIza[0-9A-Za-z_-]{35}"),
    ("json_web_token", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\n]{16,}"),
)
HEX = r"[0-9a-f]{40}"
SPECIFIC = "|".join(p for _, p in PATTERNS)
ANY = f"{SPECIFIC}|[\"']{HEX}[\"']|{NAMED}[^\\s\"',;]{{8,}}"
#: What is not the secret around an assigned or quoted value.
AROUND = r"^[\"']|[\"']$|[.!?:)\]}>]+$"
#: A string that at least so many owners have is a copied example.
EXAMPLE_OWNERS = 3
#: A live secret has at least so many different characters; an assigned one also something that words have not.
LEAST_DISTINCT = 8
LEAST_LENGTH = 8
UNLIKE_WORDS = r"[0-9]|[a-z][A-Z]|[^A-Za-z0-9]"


def _value(found: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(found, f"^{NAMED}", ""), AROUND, "")
    own = F.regexp_extract(bare, SPECIFIC, 0)
    return F.when(found.rlike(f"^(?:{SPECIFIC})$"), found).when(own != "", own).otherwise(bare)


def _kind(secret: Column) -> Column:
    kind = F.when(secret.rlike(f"^{HEX}$"), "hex_token").otherwise("assigned")
    for name, pattern in reversed(PATTERNS):
        kind = F.when(secret.rlike(f"^(?:{pattern})$"), name).otherwise(kind)
    return kind


def candidates(df: DataFrame, text: str = "text", key: str = "doc_id", owner: Column | None = None, repository: Column | None = None) -> DataFrame:
    """key, owner, repository, secret, kind, secret_hash, n_in_doc: a row per row of df and distinct candidate."""
    owner = F.coalesce((owner if owner is not None else F.col("source")).cast("string"), F.lit(""))
    repository = F.coalesce((repository if repository is not None else F.concat_ws("/", "source", "lang")).cast("string"), F.lit(""))
    found = df.select(F.col(key).alias("key"), owner.alias("owner"), repository.alias("repository"), F.regexp_extract_all(F.col(text).cast("string"), F.lit(ANY), F.lit(0)).alias("found"))
    each = found.where(F.size("found") > 0).select("key", "owner", "repository", F.explode("found").alias("found")).select("key", "owner", "repository", _value(F.col("found")).alias("secret")).where(F.length("secret") >= LEAST_LENGTH)
    counted = each.groupBy("key", "owner", "repository", "secret").agg(F.count("*").alias("n_in_doc"))
    return counted.select(F.col("key").alias(key), "owner", "repository", "secret", _kind(F.col("secret")).alias("kind"), F.sha2("secret", 256).alias("secret_hash"), "n_in_doc")


def ownership(found: DataFrame, key: str = "doc_id", example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """secret_hash, n_docs, n_repositories, n_owners, verdict, rows (how many of found's are its)."""
    secret = F.col("secret")
    random = (F.size(F.array_distinct(F.split(secret, ""))) >= LEAST_DISTINCT) & ((F.col("kind") != "assigned") | secret.rlike(UNLIKE_WORDS))
    counts = found.groupBy("secret_hash").agg(F.countDistinct(key).alias("n_docs"), F.countDistinct("repository").alias("n_repositories"), F.countDistinct("owner").alias("n_owners"), F.bool_or(random).alias("random"), F.count("*").alias("rows"))
    verdict = F.when(F.col("n_owners") >= example_owners, "copied_example").when(F.col("random"), "live").otherwise("placeholder")
    return counts.select("secret_hash", "n_docs", "n_repositories", "n_owners", verdict.alias("verdict"), "rows")


def scan(df: DataFrame, text: str = "text", key: str = "doc_id", owner: Column | None = None, repository: Column | None = None, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """A row per document and candidate: key, secret, kind, secret_hash, n_in_doc, n_docs, n_repositories, n_owners, verdict.

    The candidates, a sliver of the text, are written once to the shared folder; the text is read once.
    """
    found = written(candidates(df, text, key, owner, repository), "secrets")
    merged = found.groupBy(key, "secret", "kind", "secret_hash").agg(F.sum("n_in_doc").alias("n_in_doc"))
    return lookup(merged, written(ownership(found, key, example_owners), "owners"), ["secret_hash"], "rows").select(key, "secret", "kind", "secret_hash", "n_in_doc", "n_docs", "n_repositories", "n_owners", "verdict")


def redact(df: DataFrame, text: str = "text", key: str = "doc_id", placeholder: str = "[SECRET]", owner: Column | None = None, repository: Column | None = None, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """df with every live secret in its text replaced; copied examples stay. No row is dropped.

    An n_chars column follows the text. Rows with a null key are told apart by their texts. Only rows that may
    hold a live secret, by a Bloom filter of their keys, are joined; the others' texts stay where they are.
    """
    owner = owner if owner is not None else F.col("source")
    repository = repository if repository is not None else F.concat_ws("/", "source", "lang")
    identity = lambda k, t: F.when(k.isNull(), F.concat(F.lit("t"), F.sha2(F.coalesce(t.cast("string"), F.lit("")), 256))).otherwise(F.concat(F.lit("k"), k.cast("string")))
    slim = df.select(identity(F.col(key), F.col(text)).alias("row"), F.col(text).alias("text"), owner.alias("owner"), repository.alias("repository"))
    found = scan(slim, "text", "row", F.col("owner"), F.col("repository"), example_owners).where("verdict = 'live'")
    live = written(found.groupBy(F.col("row").alias("_row")).agg(F.sort_array(F.collect_set(F.struct(F.length("secret").alias("n"), F.col("secret"))), asc=False).alias("_live")), "live")
    names, kinds, at = df.columns, df.schema, {c: f"c{i}" for i, c in enumerate(df.columns)}
    row, body = identity(F.col(at[key]), F.col(at[text])), F.col(at[text])
    open_, settled = split(numbered(df), row, build(live.select("_row")))
    joined = open_.withColumn("_key", row).join(live, F.col("_key") == F.col("_row"), "left")
    clean = F.when(F.col("_live").isNull(), body).otherwise(F.aggregate("_live", body.cast("string"), lambda t, s: F.replace(t, s["secret"], F.lit(placeholder))))
    out = joined.withColumn(at[text], clean)
    if "n_chars" in at:
        out = out.withColumn(at["n_chars"], F.when(F.col("_live").isNull(), F.col(at["n_chars"])).otherwise(F.length(at[text]).cast(kinds["n_chars"].dataType)))
    return settled.unionByName(out.select(*at.values())).toDF(*names)


def query(spark, sf_dir: str) -> DataFrame:
    """All candidates in documents with their ownership counts; the secrets themselves are not reported."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("secret")


def _sql() -> str:
    q = lambda s: s.replace("'", "''")
    kinds = "\n".join(f"WHEN regexp_full_match(secret, '{q(p)}') THEN '{n}'" for n, p in (*PATTERNS, ("hex_token", HEX)))
    return f"""
WITH found AS (
  SELECT doc_id, coalesce(source, '') AS owner, concat_ws('/', source, lang) AS repository, unnest(regexp_extract_all(text, '{q(ANY)}')) AS found
  FROM documents),
bare AS (SELECT *, regexp_replace(regexp_replace(found, '^{q(NAMED)}', ''), '{q(AROUND)}', '', 'g') AS bare FROM found),
valued AS (
  SELECT doc_id, owner, repository, CASE WHEN regexp_full_match(found, '{q(SPECIFIC)}') THEN found WHEN regexp_extract(bare, '{q(SPECIFIC)}') <> '' THEN regexp_extract(bare, '{q(SPECIFIC)}') ELSE bare END AS secret
  FROM bare),
kinds AS (SELECT *, CASE {kinds} ELSE 'assigned' END AS kind FROM valued WHERE length(secret) >= {LEAST_LENGTH}),
each AS (SELECT doc_id, secret, kind, count(*) AS n_in_doc FROM kinds GROUP BY doc_id, secret, kind),
counts AS (
  SELECT secret, count(DISTINCT doc_id) AS n_docs, count(DISTINCT repository) AS n_repositories, count(DISTINCT owner) AS n_owners,
    len(list_distinct(string_split(secret, ''))) >= {LEAST_DISTINCT} AND (any_value(kind) <> 'assigned' OR regexp_matches(secret, '{q(UNLIKE_WORDS)}')) AS random
  FROM kinds GROUP BY secret)
SELECT doc_id, kind, sha256(secret) AS secret_hash, n_in_doc, n_docs, n_repositories, n_owners,
  CASE WHEN n_owners >= {EXAMPLE_OWNERS} THEN 'copied_example' WHEN random THEN 'live' ELSE 'placeholder' END AS verdict
FROM each JOIN counts USING (secret)"""


SQL = _sql()
