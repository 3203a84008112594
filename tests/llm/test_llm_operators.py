"""The ten operators against brute force, and on nulls, empty and long texts, ties, repeats, empty tables and clashing names."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quadloom.llm import bpe, embeddings, licenses, minhash, mixing, quality, secrets, topk, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside, on extra columns of the input.
CLASHING = ["_k", "_n", "_h", "_t", "_key", "_live", "step", "offset", "key", "doc", "p", "host", "path", "owner", "secret", "score", "k0", "c0", "root", "group_id", "copy_no"]


def docs(spark, texts, extra=False):
    rows = [(i, t, "en" if i % 2 else "de", f"s{i % 3}", len(t) if t else 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    return clash(df) if extra else df


def named(spark, texts, ids):
    """Documents whose ids are strings; ids may repeat or be null."""
    return clash(spark.createDataFrame([(k, t, "en", "s", len(t) if t else 0) for k, t in zip(ids, texts)], DOCS.replace("doc_id long", "doc_id string")))


def clash(df):
    from pyspark.sql import functions as F

    return df.select("*", *(F.lit(f"x{c}").alias(c) for c in CLASHING if c not in df.columns))


def words(n, seed):
    r = np.random.default_rng(seed)
    return " ".join("".join(chr(97 + int(c)) for c in r.integers(0, 26, int(k))) for k in r.integers(3, 9, n))


ODD = [None, "", "   ", "\n\n", "é" * 3, "word", "!!! ???", words(30_000, 1), "a" * 100_000, "x y z " * 5, "x y z " * 5]


# 1 BPE
def _tiktoken():
    import tiktoken

    return tiktoken.Encoding("whole", pat_str=bpe.DEFAULT_PATTERN, mergeable_ranks=bpe.load_ranks(bpe.DEFAULT_VOCABULARY), special_tokens={})


def test_bpe_equals_whole_text_encoding_and_decodes(spark):
    r = np.random.default_rng(3)
    alphabet = list("abcdeé ñ中1 2.,'!\n\t  　😀Zß-_") + ["'s", " the", "ing"]
    texts = [*ODD, *("".join(r.choice(alphabet, int(n))) for n in r.integers(1, 300, 150)), "it's 12345 o'clock <|endoftext|>"]
    core = _tiktoken()
    got = {x["doc_id"]: x for x in bpe.round_trip(docs(spark, texts, extra=True)).collect()}
    for i, t in enumerate(texts):
        if t is None:
            assert got[i]["token_ids"] is None and got[i]["lossless"] is None and got[i]["n_tokens"] is None
        else:
            assert got[i]["token_ids"] == core.encode_ordinary(t), t[:60]
            assert got[i]["lossless"] is True and got[i]["n_tokens"] == len(got[i]["token_ids"])
    back = {x["doc_id"]: x["text"] for x in bpe.decode(bpe.encode(docs(spark, texts))).collect()}
    assert back == dict(enumerate(texts))
    assert bpe.round_trip(docs(spark, [])).collect() == []


def test_bpe_other_vocabulary_without_pattern(spark):
    path = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
    import tiktoken

    core = tiktoken.Encoding("whole", pat_str=r"(?s).+", mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    texts = ["", "Hallo Welt, wie geht's?", "año niño 中文 text"]
    got = {x["doc_id"]: x["token_ids"] for x in bpe.encode(docs(spark, texts), vocabulary=path, pattern=None).collect()}
    assert got == {i: core._core_bpe.encode_single_piece(t.encode()) if t else [] for i, t in enumerate(texts)}


# 2 embeddings
def test_embeddings_against_brute_force(spark):
    r = np.random.default_rng(5)
    v = r.normal(size=(300, 8)) * 0.3
    v[100:150] = v[0]
    v[150:200] = v[:50] + r.normal(size=(50, 8)) * 0.02
    rows = [(i, [float(np.float32(x)) for x in v[i]], 1) for i in range(300)] + [(300, None, 1), (301, [], 1), (302, [float("nan")] * 8, 1), (303, [1.0, None] * 4, 1), (304, [1.0, 2.0], 1), (None, rows_of(v[0]), 1), (0, rows_of(v[0]), 1)]
    df = clash(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    got = {x["vec_id"]: x for x in embeddings.near(df, eps=0.2).collect()}
    x = np.array([np.float32(a) for a in v], dtype=np.float64)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    assert len(got) == 305
    for i in range(300):
        near = [j for j in range(300) if j != i and d[i, j] <= 0.2]
        assert (got[i]["near_id"], got[i]["keep"]) == (min([i, *near]), min([i, *near]) == i)
        assert got[i]["n_near"] == len(near), i
    assert all(got[i]["n_near"] == 0 and got[i]["keep"] for i in range(300, 305))
    assert embeddings.near(df.where("false")).collect() == []


def test_embeddings_of_every_dimension(spark):
    r = np.random.default_rng(6)
    v = [*(r.normal(size=(60, 8)) * 0.1), *(r.normal(size=(40, 3)) * 0.1), *(r.normal(size=(20, 5)) * 0.1)]
    v[99] = v[60]
    v = [np.float64(rows_of(x)) for x in v]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = {x["vec_id"]: x for x in embeddings.near(df, eps=0.2).collect()}
    for i in range(len(v)):
        near = [j for j in range(len(v)) if j != i and len(v[i]) == len(v[j]) and np.sqrt(((v[i] - v[j]) ** 2).sum()) <= 0.2]
        assert (got[i]["n_near"], got[i]["near_id"], got[i]["keep"]) == (len(near), min([i, *near]), min([i, *near]) == i), i
    assert got[99]["n_near"] > 0 and not got[99]["keep"]


def test_embeddings_with_ids_of_strings_and_dense_regions(spark):
    r = np.random.default_rng(8)
    v = [rows_of(x) for x in np.concatenate([r.normal(size=(3000, 4)) * 0.02, r.normal(size=(300, 4))])]
    v[50:70] = [v[0]] * 20
    ids = [f"v{i}" for i in range(len(v))]
    df = spark.createDataFrame([*zip(ids, v), ("v5", v[5]), ("v5", v[1]), (None, v[5])], "vec_id string, embedding array<float>")
    got = {x["vec_id"]: x for x in embeddings.near(df, eps=0.05).collect()}
    x = np.array(v)
    order = np.argsort(ids)
    for i in [*range(0, 5), *range(6, 3300, 37)]:
        near = np.flatnonzero(np.sqrt(((x - x[i]) ** 2).sum(1)) <= 0.05)
        extra = int(np.sqrt(((x[1] - x[i]) ** 2).sum()) <= 0.05 and 5 not in near)
        assert got[ids[i]]["n_near"] >= len(near) - 1 + extra and (extra or got[ids[i]]["near_id"] == min(ids[k] for k in near)), i
    assert len(got) == len(ids) and order is not None


def rows_of(v):
    return [float(np.float32(x)) for x in v]


# 3 WARC
def test_warc_members_and_damage(spark, tmp_path):
    import gzip

    pages = clash(spark.createDataFrame([(1, "http://a/ b", "<p>é</p>"), (2, None, None), (None, "u", ""), (4, "long", "x" * 2_000_000), (4, "long", "x" * 2_000_000)], "page_id long, url string, html string"))
    manifest = warc.pack(pages, f"file://{tmp_path}/in").cache()
    assert sum(r["n_records"] for r in manifest.collect()) == 5
    index = warc.normalise(manifest, f"file://{tmp_path}/out").collect()
    assert not [r for r in index if r["problem"]] and sum(r["record_type"] == "response" for r in index) == 5
    for r in index:
        one = warc.read_record(f"{tmp_path}/out/{r['file']}", r["offset"], r["length"])
        assert r["file"].endswith("-" + r["source"].rsplit("/", 1)[1])
        assert one.startswith(b"WARC/1.0") and one.endswith(b"\r\n\r\n")
        head, _, content = one.partition(b"\r\n\r\n")
        assert len(content) - 4 == r["content_length"]
    for name in {r["file"] for r in index}:  # all members together are the stream that came in
        assert gzip.open(tmp_path / "out" / name).read() == gzip.open(tmp_path / "in" / name.split("-", 1)[1]).read()
    assert all(r["readable"] for r in warc.checked(spark.createDataFrame(index, warc.INDEX), f"file://{tmp_path}/out").collect())
    wrong = spark.createDataFrame([(*r[:3], r["offset"], r["length"] - 9, *r[5:]) for r in index[:1]], warc.INDEX)
    assert [r["readable"] for r in warc.checked(wrong, f"file://{tmp_path}/out").collect()] == [False]
    whole = next((tmp_path / "in").glob("*.gz")).read_bytes()
    (tmp_path / "cut.warc.gz").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "empty.warc.gz").write_bytes(b"")
    bad = spark.createDataFrame([(f"{tmp_path}/cut.warc.gz",), (f"{tmp_path}/empty.warc.gz",)], "path string")
    got = warc.normalise(bad, f"file://{tmp_path}/out2").collect()
    assert [r["source"] for r in got if r["record_type"] == "error"] == [f"{tmp_path}/cut.warc.gz"]
    assert warc.normalise(bad.where("false"), f"file://{tmp_path}/out3").collect() == []


def test_warc_equal_names_long_lines_and_repeated_paths(spark, tmp_path):
    import gzip

    record = lambda body: b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)
    for folder, content in (("a", record(b"of a")), ("b", record(b"of b, longer")), ("c", b"WARC/1.0" + b"x" * 3_000_000), ("d", b"WARC/1.0\r\n" + b"k: v\r\n" * 400_000)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.warc.gz").write_bytes(gzip.compress(content))
    paths = [(f"{tmp_path}/{f}/x.warc.gz", 1) for f in "aabcd"] + [(None, 2)]
    got = warc.normalise(spark.createDataFrame(paths, "path string, offset int"), f"file://{tmp_path}/out").collect()
    by = defaultdict(list)
    for r in got:
        by[r["source"].split("/")[-2]].append(r)
    assert {k: len(v) for k, v in by.items()} == {"a": 2, "b": 1, "c": 1, "d": 1} and by["a"][0] == by["a"][1]
    for f, body in (("a", b"of a"), ("b", b"of b, longer")):
        assert warc.read_record(f"{tmp_path}/out/{by[f][0]['file']}", by[f][0]["offset"], by[f][0]["length"]).split(b"\r\n\r\n")[1] == body
    assert "too long" in by["c"][0]["problem"] and "too long" in by["d"][0]["problem"]
    assert not list((tmp_path / "out").glob("*.tmp"))


# 4 licenses
def _license_blocks(text):
    """(kind, number of first line, text) of lines and of paragraphs of two lines or more."""
    lines, run = (text or "").split("\n"), []
    for i, line in enumerate([*lines, ""]):
        if i < len(lines):
            yield "line", i, line
        if line.strip(" \t\x0b\x0c\r"):
            run.append(i)
        else:
            if len(run) > 1:
                yield "paragraph", run[0], "\n".join(lines[k] for k in run)
            run = []


def test_licenses_against_brute_force(spark):
    import textwrap

    wrapped = ["\n".join(textwrap.wrap(t, 48, break_on_hyphens=False)) for t in licenses.TEMPLATES.values()]
    texts = [*ODD, "x\nLicensed under the Apache License, Version 2.0.\ny", "licensed UNDER apache version 2 0", *("\n".join(w for w in words(60, k).split()) for k in range(5))]
    texts += wrapped + [f"\n \t\ncode here\n\n{w}\n\nmore" for w in wrapped] + ["\n".join("# " + x for x in w.split("\n")) for w in wrapped]
    r = np.random.default_rng(1)
    pool = re.findall(r"[0-9a-z_]+", " ".join(licenses.TEMPLATES.values()).lower())
    texts += ["\n".join(" ".join(r.choice(pool, int(n))) for n in r.integers(0, 40, 20)) for _ in range(20)]
    split = lambda s: set(re.findall(r"[0-9a-z_\x80-\U0010ffff]+", s.lower()))
    want = set()
    for i, t in enumerate(texts):
        for kind, b, block in _license_blocks(t):
            for name, body in licenses.TEMPLATES.items():
                tw = split(body)
                o = len(split(block) & tw)
                if o and o >= math.ceil(licenses.THRESHOLD * len(tw) - 1e-9):
                    want.add((i, kind, b, name, o, round(o / len(tw), 9)))
    got = [(x["doc_id"], x["kind"], x["block_no"], x["license"], x["overlap"], round(x["containment"], 9)) for x in licenses.scan(docs(spark, texts, extra=True)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {k[3] for k in want if k[1] == "paragraph" and k[5] == 1} == set(licenses.TEMPLATES)
    assert licenses.scan(docs(spark, [])).collect() == []
    same = named(spark, ["MIT\nReleased under the MIT License."] * 2, ["a", "a"])
    assert [(x["doc_id"], x["kind"]) for x in licenses.scan(same).orderBy("kind").collect()] == [("a", "line"), ("a", "line"), ("a", "paragraph"), ("a", "paragraph")]


# 5 MinHash
def _shingles(t):
    w = re.findall(r"[0-9a-z_\x80-\U0010ffff]+", (t or "").lower())
    return {tuple(w[i : i + minhash.SHINGLE]) for i in range(max(1, len(w) - minhash.SHINGLE + 1))} if w else set()


def _components(texts, threshold):
    s = [_shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if s[i] and s[j] and len(s[i] & s[j]) / len(s[i] | s[j]) >= threshold:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def near_copies(n=60, seed=2):
    r = np.random.default_rng(seed)
    out = []
    for g in range(n):
        base = words(int(r.integers(60, 200)), g).split()
        out.append(" ".join(base))
        for _ in range(int(r.integers(0, 4))):
            copy = list(base)
            for at in r.integers(0, len(copy), int(r.integers(0, 5))):
                copy[at] = "changed" + str(at)
            out.append(" ".join(copy))
    return out


def test_minhash_groups_against_brute_force(spark):
    texts = [*ODD, *near_copies()]
    got = {x["doc_id"]: x["group_id"] for x in minhash.groups(docs(spark, texts, extra=True)).collect()}
    want = dict(enumerate(_components(texts, minhash.THRESHOLD)))
    assert set(got) == set(want)
    assert sum(got[i] == want[i] for i in got) >= 0.98 * len(got)
    assert all(got[i] == want[i] for i in range(len(ODD)))  # exact copies and what is empty


def test_minhash_deduplicate_keeps_one_of_each_group(spark):
    texts = [*ODD, *near_copies(10)]
    df = docs(spark, texts, extra=True)
    out = minhash.deduplicate(df)
    groups = {x["doc_id"]: x["group_id"] for x in minhash.groups(df).collect()}
    assert out.columns == df.columns
    assert sorted(x["doc_id"] for x in out.collect()) == sorted(set(groups.values()))
    twice = df.unionByName(df)
    assert sorted(x["doc_id"] for x in minhash.deduplicate(twice).collect()) == sorted(set(groups.values()))
    lost = spark.createDataFrame([(None, "a b c", "en", "s", 5), (None, "a b c", "en", "s", 5), (1, None, None, None, None)], DOCS)
    assert minhash.deduplicate(lost).count() == 3
    assert minhash.groups(df.where("false")).collect() == [] and minhash.deduplicate(df.where("false")).collect() == []


def test_minhash_one_bucket_of_many_and_a_shared_passage(spark):
    base, passage = words(80, 50), words(60, 51)
    cluster = [base + " end" + str(k) for k in range(3000)]
    sharing = [passage + " " + words(90, 1000 + k) for k in range(400)]
    texts = cluster + sharing
    ids = [f"d{k:05d}" for k in range(len(texts))] + [None, "d00003"]
    df = named(spark, [*texts, base, base], ids)
    got = {x["doc_id"]: x["group_id"] for x in minhash.groups(df).collect()}
    assert len(got) == len(texts)
    assert {got[k] for k in ids[:3000]} == {"d00000"}
    assert all(got[k] == k for k in ids[3000:3400])
    kept = minhash.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted(str(x["doc_id"]) for x in kept.collect()) == sorted(["None", "d00000", *ids[3000:3400]])


def test_minhash_compares_across_components_of_a_bucket(spark):
    members = spark.createDataFrame([(1, "a", 4, x) for x in "abcd"] + [(2, "a", 3, x) for x in "abe"], "bucket long, first string, size long, doc string")
    roots = spark.createDataFrame([("a", "a"), ("b", "a"), ("e", "a")], "node string, root string")
    r = np.random.default_rng(9)
    b = sorted(int(x) for x in r.integers(-(1 << 40), 1 << 40, 50))
    sets = {"a": list(range(40)), "b": b, "c": b[:45], "d": b[:20] + list(range(100, 130)), "e": b}
    table = spark.createDataFrame(list(sets.items()), "doc string, shingles array<long>")
    pairs = minhash._crossing(members, roots, table, 0.6)
    assert {tuple(x) for x in minhash._verified(pairs, table, 0.6).collect()} == {("b", "c")}


# 6 secrets
KEY, SHARED = "AKIA" + "QWERTYUIOPASDFGH", "AKIA" + "EXAMPLEEXAMPLE12"


def test_secrets_ownership_and_redaction(spark):
    texts = [f"my key {KEY} and {KEY}", f"docs {SHARED}", f"docs {SHARED}", f"docs {SHARED}", *ODD, "password: aaaaaaaaaaaa", words(20_000, 4) + " " + KEY]
    df = docs(spark, texts, extra=True)
    got = secrets.scan(df).collect()
    by = defaultdict(list)
    for x in got:
        by[x["secret"]].append(x)
    assert {x["verdict"] for x in by[SHARED]} == {"copied_example"} and by[SHARED][0]["n_owners"] == 3 and by[SHARED][0]["n_docs"] == 3
    assert {x["verdict"] for x in by[KEY]} == {"live"} and sorted(x["n_in_doc"] for x in by[KEY]) == [1, 2]
    assert [x["verdict"] for k, v in by.items() if "aaaa" in k for x in v] == ["placeholder"]
    out = secrets.redact(df)
    assert out.columns == df.columns and out.count() == len(texts)
    clean = {x["doc_id"]: x for x in out.collect()}
    assert clean[0]["text"] == "my key [SECRET] and [SECRET]" and clean[0]["n_chars"] == len(clean[0]["text"])
    assert [clean[i]["text"] for i in range(1, len(texts) - 1)] == texts[1:-1]
    assert clean[len(texts) - 1]["text"].endswith(" [SECRET]")
    nulls = spark.createDataFrame([(None, f"k {KEY}", None, None, None), (3, None, None, None, None)], DOCS)
    assert sorted(str(x["text"]) for x in secrets.redact(nulls).collect()) == ["None", "k [SECRET]"]
    assert secrets.scan(df.where("false")).collect() == [] and secrets.redact(df.where("false")).collect() == []


def test_one_secret_however_it_is_written(spark):
    hex40 = "0123456789abcdef0123456789abcdef01234567"
    texts = [f"see {SHARED} here", f"token={SHARED}.", f'"api_key" : "{SHARED}",', "password = hunter2abc", '{"password": "hunter2abc"}', "passwd:\thunter2abc.", f"'{hex40}'", f"SECRET={hex40}", "the secret: understanding matters", "token: 'Understandingly'"]
    rows = spark.createDataFrame([(f"k{i}", t, "en", f"s{i}", 1) for i, t in enumerate(texts)], DOCS.replace("doc_id long", "doc_id string"))
    got = {(x["secret"], x["kind"]): x for x in secrets.scan(rows.unionByName(rows)).collect()}
    assert {k: (v["n_docs"], v["n_owners"], v["verdict"]) for k, v in got.items()} == {
        (SHARED, "aws_access_key"): (3, 3, "copied_example"), ("hunter2abc", "assigned"): (3, 3, "copied_example"), (hex40, "hex_token"): (2, 2, "live"),
        ("understanding", "assigned"): (1, 1, "placeholder"), ("Understandingly", "assigned"): (1, 1, "placeholder"),
    }
    out = {x["doc_id"]: x["text"] for x in secrets.redact(rows).collect()}
    assert out["k6"] == "'[SECRET]'" and out["k7"] == "SECRET=[SECRET]" and out["k3"] == texts[3] and out["k8"] == texts[8]
    assert secrets.scan(secrets.redact(rows)).where("verdict = 'live'").count() == 0


# 7 top-k
def test_topk_against_brute_force(spark):
    texts = [*ODD, *(words(50, k % 40) + " common rare" + str(k % 7) for k in range(200))]
    queries = [(1, "common rare3 " + words(5, 3)), (2, None), (3, ""), (4, "nowhere"), (5, "x y common"), (6, "common"), (6, "rare1"), (None, "common")]
    q = clash(spark.createDataFrame(queries, "item_id long, text string"))
    got = defaultdict(list)
    for x in topk.search(docs(spark, texts, extra=True), q).orderBy("item_id", "rank").collect():
        got[x["item_id"]].append((x["doc_id"], round(x["score"], 5)))
    split = lambda s: re.findall(r"[0-9a-z_\x80-\U0010ffff]+", (s or "").lower())
    tf = [Counter(split(t)) for t in texts]
    length = [sum(c.values()) for c in tf]
    mean, n = sum(length) / len(texts), len(texts)
    df = Counter(w for c in tf for w in c)
    for item, text in ((1, queries[0][1]), (4, "nowhere"), (5, "x y common"), (6, "common\nrare1")):
        scores = []
        for i, c in enumerate(tf):
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * (topk.K1 + 1) / (c[w] + topk.K1 * (1 - topk.B + topk.B * length[i] / mean)) for w in set(split(text)) if c[w])
            if s > 0:
                scores.append((-round(s, 6), i))
        assert got[item] == [(i, round(-s, 5)) for s, i in sorted(scores)[: topk.TOP]]
    assert {k for k, v in got.items() if v} == {1, 5, 6}
    assert topk.search(docs(spark, []), q).collect() == [] and topk.search(docs(spark, texts), q.where("false")).collect() == []


def test_topk_stops_early_and_reads_on_where_it_must(spark):
    r = np.random.default_rng(2)
    n = 20_000
    row, word, tf = [], [], []
    for t, share in enumerate((0.9, 0.8, 0.001)):
        held = np.flatnonzero(r.random(n) < share)
        row.append(held)
        word.append(np.full(len(held), t + 1, dtype=np.uint64))
        tf.append(r.integers(1, 4, len(held)))
    tf[2][:] = 9
    length = r.integers(30, 60, n)
    shard = topk.Shard(topk._shard(*(np.concatenate(x) for x in (row, word, tf)), length, 45.0), 45.0)
    idf = np.array([0.1, 0.2, 7.0])
    dense = np.zeros(n)
    for t in range(3):
        dense[row[t]] += idf[t] * topk.tf_weight(tf[t], length[row[t]], 45.0)
    rows, s = shard.search(np.array([1, 2, 3], dtype=np.uint64), idf, 5)
    assert np.allclose(np.sort(s)[-5:], np.sort(dense)[-5:]) and shard.read < 0.2 * sum(map(len, row))
    every = topk.Shard(topk._shard(*(np.concatenate(x) for x in (row, word, tf)), length, 45.0), 45.0)
    rows, s = every.search(np.array([1, 2], dtype=np.uint64), np.array([1.0, 1.0]), n)
    assert every.read == len(row[0]) + len(row[1]) and len(rows) == len(set(row[0]) | set(row[1]))


def test_topk_with_ids_of_strings_and_nulls(spark):
    df = named(spark, ["rare one", "rare one", "rare", "rare", None, "other"], ["b", "a", None, "a", "c", "d"])
    index = topk.build_index(df)
    q = spark.createDataFrame([("q1", "rare"), ("q2", "other word"), (None, "rare")], "item_id string, text string")
    got = [(x["item_id"], x["rank"], x["doc_id"]) for x in topk.search_index(index, q, 3).orderBy("item_id", "rank").collect()]
    assert got == [("q1", 1, "a"), ("q1", 2, None), ("q1", 3, "a"), ("q2", 1, "d")]


def test_topk_index_is_written_and_read_in_small_pieces(spark):
    """A task's shards do not lie in one row group, which its writer and its readers would hold as a whole."""
    import glob

    import pyarrow.parquet as pq

    r = np.random.default_rng(7)
    texts = [" ".join(map(str, r.integers(0, 10**9, 20_000))) for _ in range(60)]
    index = topk.build_index(docs(spark, texts).coalesce(1))
    assert sorted(i for x in index.select("ids").collect() for i in x["ids"]) == list(range(60))
    files = [pq.ParquetFile(f) for x in index.inputFiles() for f in glob.glob(x.removeprefix("file://"))]
    groups = [f.metadata.row_group(g) for f in files for g in range(f.num_row_groups)]
    assert sum(g.total_byte_size for g in groups) > 24 << 20
    assert all(g.num_rows == 1 and g.total_byte_size < 16 << 20 for g in groups)
    q = spark.createDataFrame([(1, " ".join(texts[59].split()[:50]))], "item_id long, text string")
    assert topk.search_index(index, q, 1).first()["doc_id"] == 59


# 8 mixing
def test_mixing_counts_follow_rates(spark):
    texts = [*ODD[:7], *(words(20, k) for k in range(300))]
    df = docs(spark, texts, extra=True)
    weights = {"s0": 0.7, "s1": 0.2, "s2": 0.1, "absent": 5.0}
    out = mixing.sample(df, weights=weights)
    assert out.columns == [*(c for c in df.columns if c != "copy_no"), "copy_no"]
    size = defaultdict(int)
    for i, t in enumerate(texts):
        size[f"s{i % 3}"] += len(t or "")
    total = sum(size.values())
    n, each = Counter(), Counter()
    for x in out.collect():
        n[x["source"]] += 1
        each[x["doc_id"]] += 1
    for s, w in (("s0", 0.7), ("s1", 0.2), ("s2", 0.1)):
        rate = w * total / size[s]
        members = [i for i in range(len(texts)) if f"s{i % 3}" == s]
        assert abs(n[s] - rate * len(members)) < 1
        assert all(math.floor(rate) <= each[i] <= math.ceil(rate) for i in members)
    assert mixing.sample(df.where("false")).collect() == []
    nulls = spark.createDataFrame([(1, "ab", None, None, 2), (2, "cd", None, "s", 2), (None, None, None, "s", 0)], DOCS)
    assert {x["source"] for x in mixing.sample(nulls).collect()} == {None, "s"}
    assert {x["source"] for x in mixing.sample(nulls, weights={"s": 1}).collect()} == {"s"}


def test_mixing_is_exact_for_many_copies(spark):
    df = spark.createDataFrame([(i, "x", "en", "a", 1) for i in range(6)] + [(9, "y" * 1000, "en", "b", 1000)], DOCS)
    each = 10**12
    drawn, names = mixing.draws(df, weights={"a": 1.0}, total=6.0 * each)
    got = {x["c0"]: x["_n"] for x in drawn.collect()}
    assert set(got) == set(range(6)) and all(n == each for n in got.values())
    some = mixing.sample(df, weights={"a": 1.0}, total=600_000.0).groupBy("doc_id").count().collect()
    assert [x["count"] for x in some] == [100_000] * 6
    twice = df.unionByName(df)  # repeated rows each count; ties in the order do not matter
    assert mixing.sample(twice, weights={"a": 1.0, "b": 1.0}).groupBy("source").count().where("source = 'a'").first()["count"] in (1005, 1006, 1007)


# 9 quality
def test_quality_orders_sites_and_documents(spark):
    from pyspark.sql import functions as F

    r = np.random.default_rng(7)
    good = ["The " + words(int(n), k) + ". And so it ends." for k, n in enumerate(r.integers(40, 90, 120))]
    bad = ["### $$ 99 " * int(n) for n in r.integers(5, 20, 120)]
    rows = [(i, t, "en", "clean" if t in good[:100] else "dirty" if i >= 140 else "even", len(t)) for i, t in enumerate(good + bad)]
    df = clash(spark.createDataFrame(rows, DOCS))
    labels = spark.createDataFrame([(i, int(i < 120), 0) for i in range(0, 240, 2)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x for x in quality.classify(df, labels).collect()}
    held_out = [i for i in range(1, 240, 2)]
    assert np.mean([got[i]["keep"] == (i < 120) for i in held_out]) > 0.95
    host = {r[3]: got[r[0]]["p_host"] for r in rows}
    assert host["clean"] > host["even"] > host["dirty"]
    # sparse sites are drawn toward the corpus
    few = df.where("doc_id < 3").withColumn("source", F.lit("tiny")).unionByName(df.where("doc_id >= 3"))
    tiny = next(x for x in quality.classify(few, labels).collect() if x["doc_id"] == 0)
    corpus = np.mean([x["p_document"] for x in got.values()])
    assert corpus < tiny["p_host"] < 1
    assert {x["p_document"] for x in quality.classify(df, labels.where("false")).collect()} == {0.5}
    assert quality.classify(df.where("false"), labels).collect() == []
    odd = quality.classify(docs(spark, ODD, extra=True), labels).collect()
    assert len(odd) == len(ODD) and all(x["p_good"] == x["p_good"] for x in odd)


def test_quality_posteriors_against_brute_force(spark):
    r = np.random.default_rng(3)
    rows = [(f"d{i}", None if i % 17 == 0 else f"h{i % 5}", None if i % 19 == 0 else f"p{i % 3}", float(r.uniform(0.05, 0.95))) for i in range(200)] + [("alone", "single", "p", 0.99)]
    p = np.array([x[3] for x in rows])
    corpus = p.mean()

    def kappa(groups, above):
        n = np.array([len(g) for g in groups], float)
        mean = np.array([p[g].mean() for g in groups])
        noise = sum(((p[g] - p[g].mean()) ** 2).sum() for g in groups) / max(n.sum() - len(groups), 1)
        ss = (n * (mean - np.array(above)) ** 2).sum()
        between = (ss - (len(groups) - 1) * noise) / max(n.sum() - (n * n).sum() / n.sum(), 1)
        return min(1e6, max(1, noise / max(between, 1e-9)))

    def by(key):
        out = defaultdict(list)
        for i, x in enumerate(rows):
            out[key(x)].append(i)
        return out

    hosts, paths = by(lambda x: x[1]), by(lambda x: (x[1], x[2]))
    kh = kappa(list(hosts.values()), [corpus] * len(hosts))
    host_mean = {h: (p[g].sum() + kh * corpus) / (len(g) + kh) for h, g in hosts.items()}
    kp = kappa(list(paths.values()), [host_mean[h] for h, _ in paths])
    got = {(x["host"], x["path"]): x for x in quality.posteriors(spark.createDataFrame(rows, "key string, host string, path string, p double")).collect()}
    assert set(got) == set(paths)
    for (h, l), g in paths.items():
        x = got[h, l]
        assert (x["n"], x["host_n"]) == (len(g), len(hosts[h]))
        assert np.allclose([x["s"], x["kappa"], x["host_s"], x["host_kappa"], x["host_mean"], x["corpus"]], [p[g].sum(), kp, p[hosts[h]].sum(), kh, host_mean[h], corpus])


def test_quality_leaves_the_document_out_of_its_site(spark):
    texts = ["The " + words(60, k) + ". And so it ends." for k in range(40)] + ["### $$ 99 " * 9] * 40
    ids = [f"d{k}" for k in range(80)]
    df = named(spark, [*texts, *ODD, texts[0]], [*ids, *[None] * len(ODD), "d0"])
    from pyspark.sql import functions as F

    df = df.withColumn("source", F.when(F.col("doc_id") == "d1", "single").otherwise(F.col("source")))
    labels = spark.createDataFrame([(k, int(i < 40)) for i, k in enumerate(ids)], "doc_id string, quality int")
    got = quality.classify(df, labels).collect()
    assert len(got) == df.count()
    one = next(x for x in got if x["doc_id"] == "d1")
    assert abs(one["p_good"] - one["p_document"]) < 1e-6 and one["p_host"] > np.mean([x["p_document"] for x in got])
    assert all(x["keep"] == (x["doc_id"] in ids[:40]) for x in got if x["doc_id"])
    urls = spark.createDataFrame([("https://u:p@www.A.example:8080/en/x?q=1",), ("http://b.example/x",), ("not a url",), (None,)], "u string")
    assert [tuple(x) for x in urls.select(quality.url_host(F.col("u")), quality.url_path(F.col("u"))).collect()] == [("a.example", "/en"), ("b.example", "/"), (None, "/"), (None, "/")]


# 10 toxicity
def test_toxicity_finds_unlabelled_bad_words(spark):
    r = np.random.default_rng(11)
    neutral = [f"plain{k}" for k in range(200)]
    bad = ["vilea", "vileb", "vilec", "viled"]
    texts, y = [], []
    for i in range(600):
        t = list(r.choice(neutral, 30))
        toxic = i % 6 == 0
        if toxic:
            t[5:5] = list(r.choice(bad, 3, replace=False))
        texts.append(" ".join(t))
        y.append(int(toxic))
    df = docs(spark, texts, extra=True)
    labels = spark.createDataFrame([(i, 1, y[i]) for i in range(300)] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x for x in toxicity.score(df, labels).collect()}
    held = range(300, 600)
    assert sum(got[i]["toxic"] for i in held if y[i]) >= 0.95 * sum(y[300:])
    assert sum(got[i]["toxic"] for i in held if not y[i]) <= 3
    kept = toxicity.drop_toxic(df, labels)
    assert kept.columns == df.columns and sorted(x["doc_id"] for x in kept.collect()) == [i for i in range(600) if not got[i]["toxic"]]
    assert not any(x["toxic"] for x in toxicity.score(df, labels.where("false")).collect())
    assert toxicity.score(df.where("false"), labels).collect() == [] and toxicity.drop_toxic(df.where("false"), labels).collect() == []
    odd = toxicity.score(docs(spark, ODD, extra=True), labels).collect()
    assert len(odd) == len(ODD)


def test_toxicity_reaches_words_that_no_labelled_document_holds(spark):
    r = np.random.default_rng(12)
    neutral = [f"plain{k}" for k in range(200)]
    bad, near, far = ([f"{x}{k}" for k in range(n)] for x, n in (("vile", 4), ("near", 6), ("far", 6)))
    kinds = {i: ("none" if i % 10 < 5 else "both") if i < 420 else "step" if i < 460 else "near only" if i < 480 else "far only" if i < 500 else "clean" for i in range(300, 1500)}
    held = {"none": [], "both": [*bad[:2], *near], "step": [*near, *far], "near only": near, "far only": far, "clean": []}
    texts = []
    for i in range(1500):
        t = list(r.choice(neutral, 30))
        t[5:5] = held[kinds[i]] if i in kinds else list(r.choice(bad, 3, replace=False)) if i % 6 == 0 else []
        texts.append(" ".join(t))
    labels = spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x for x in toxicity.score(docs(spark, texts), labels).collect()}
    of = lambda kind: [got[i] for i in kinds if kinds[i] == kind]
    assert all(x["n_terms"] == len(near) and x["score"] > 0 for x in of("near only"))
    assert all(x["n_terms"] == len(far) and x["score"] > 0 for x in of("far only"))
    assert all(x["toxic"] for x in of("step"))
    assert not any(x["toxic"] for x in of("clean"))


def test_toxicity_keeps_rare_words_of_a_large_corpus(spark):
    r = np.random.default_rng(13)
    neutral = np.array([f"plain{k}" for k in range(300)])
    texts = [" ".join(r.choice(neutral, 12)) + (" vile" if i < 7 else "") for i in range(8000)]
    labels = spark.createDataFrame([(i, 1, int(i < 6)) for i in [*range(6), *range(100, 300)]], "doc_id long, quality int, toxic int")
    got = {x["doc_id"] for x in toxicity.score(docs(spark, texts), labels).where("toxic").collect()}
    assert got == set(range(7))


def _lexicon(texts, labels):
    """({word: weight}, threshold) by plain loops over sets of words."""
    from quadloom.llm.arrowtext import span_hash

    def wilson(hits, n, z=1.96):
        q = min(hits / n, 1.0)
        return (q + z * z / (2 * n) - z * math.sqrt(q * (1 - q) / n + z * z / (4 * n * n))) / (1 + z * z / n)

    hashed = lambda w: int(span_hash(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())])).view(np.int64)[0])
    sets = [set(re.findall(r"[0-9a-z_]+", t)) for t in texts]
    n = {w: c for w, c in Counter(w for s in sets for w in s).items() if c >= toxicity.LEAST_DOCUMENTS}
    toxic, clean = Counter(w for i, y in labels.items() if y for w in sets[i]), Counter(w for i, y in labels.items() if not y for w in sets[i])
    known = [w for w in n if toxic[w] + clean[w]]
    bound = {w: wilson(toxic[w], toxic[w] + clean[w]) for w in known}
    bad = {w for w in known if bound[w] >= toxicity.SEED_BOUND}
    best = sorted(known, key=lambda w: (-round(wilson(clean[w], toxic[w] + clean[w]), 12), -n[w], hashed(w)))[: max(len(bad), 8)]
    good = set(best) - bad
    sure = {w: bound[w] for w in bad | good}
    reached = dict.fromkeys(bad, 1.0)
    base = sum(labels.values()) / len(labels)
    while True:
        mass = [round(max((reached[w] for w in s if w in reached), default=0) * 1000) for s in sets]
        held = Counter()
        for s, m in zip(sets, mass):
            for w in s:
                held[w] += m
        new = {}
        for w in n:
            h, e = held[w] / 1000, n[w] * sum(mass) / 1000 / len(texts)
            if w not in sure and h >= toxicity.LEAST_DOCUMENTS and h - e > 3 * math.sqrt(max(e, 1)) and h >= 2 * e and (w not in bound or bound[w] > base):
                c = min(bound.get(w, 9), wilson(h, n[w]))
                if c > toxicity.LEAST_WEIGHT:
                    new[w] = c
        if not new:
            break
        sure |= new
        reached |= new
    edges = {}
    members = sorted(sure)
    for i, a in enumerate(members):
        for b in members[i + 1 :]:
            both, chance = sum(a in s and b in s for s in sets), n[a] * n[b] / len(texts)
            if both >= toxicity.LEAST_DOCUMENTS and both > chance + 3 * math.sqrt(chance):
                edges[a, b] = edges[b, a] = math.log(both / chance)
    polarity = {w: float(w in bad) - float(w in good) for w in members}
    for _ in range(toxicity.STEPS):
        after = dict(polarity)
        for w in members:
            if w not in bad and w not in good:
                around = {x: edges[w, x] for x in members if (w, x) in edges}
                after[w] = sum(e * polarity[x] for x, e in around.items()) / max(sum(around.values()), 1e-12)
        polarity = after
    weight = {w: round(polarity[w] * sure[w], 9) for w in members}
    weight = {w: x for w, x in weight.items() if x > toxicity.LEAST_WEIGHT}
    score = {i: round(sum(weight.get(w, 0) for w in sets[i]), 9) for i in labels}
    f1 = lambda t: 2 * sum(labels[i] for i in labels if score[i] >= t) / (sum(x >= t for x in score.values()) + sum(labels.values()))
    return {hashed(w): x for w, x in weight.items()}, max(sorted({x for x in score.values() if x > 0}, reverse=True), key=f1)


def test_toxicity_lexicon_against_brute_force(spark):
    r = np.random.default_rng(21)
    neutral, kind = [f"plain{k}" for k in range(120)], [f"kind{k}" for k in range(6)]
    bad, near = [f"vile{k}" for k in range(5)], [f"near{k}" for k in range(4)]
    texts, y = [], []
    for i in range(700):
        toxic = i % 5 == 0
        t = [*r.choice(neutral, 20), *(r.choice(bad, 2) if toxic else r.choice(kind, 2)), *(r.choice(near, 2) if toxic and i >= 250 else [])]
        texts.append(" ".join(t))
        y.append(int(toxic) if i % 31 else 1 - int(toxic))
    texts += ["", "once only", *texts[:2]]
    ids = [f"d{i}" for i in range(len(texts))]
    labels = {i: y[i] for i in range(250)}
    table = spark.createDataFrame([(ids[i], v) for i, v in labels.items()], "doc_id string, toxic int")
    lexicon, weights, threshold = toxicity.fit(named(spark, texts, ids), table)
    want, at = _lexicon(texts, labels)
    got = dict(zip(lexicon.view(np.int64).tolist(), weights.tolist()))
    assert set(got) == set(want) and len(got) > 5
    assert all(abs(got[w] - want[w]) < 1e-6 for w in want) and abs(threshold - at) < 1e-6


def test_random_walk_against_dense_solution():
    r = np.random.default_rng(4)
    n = 12
    w = np.triu(r.random((n, n)) * (r.random((n, n)) > 0.4), 1)
    a, b = np.nonzero(w)
    bad, good = np.zeros(n, bool), np.zeros(n, bool)
    bad[:2], good[2:4] = True, True
    full = w + w.T
    p = full / np.maximum(full.sum(1, keepdims=True), 1e-12)
    free = ~(bad | good)
    fixed = bad.astype(float) - good
    x = np.linalg.solve(np.eye(free.sum()) - p[np.ix_(free, free)], p[np.ix_(free, ~free)] @ fixed[~free])
    assert np.allclose(toxicity.walk(a, b, w[a, b], bad, good)[free], x, atol=1e-3)


def test_toxicity_rounds_leave_out_what_no_new_word_is_with(monkeypatch):
    """A round sorts only the words of documents that hold a new one, and sums up the rest of none."""
    import pyarrow as pa

    from quadloom.llm.arrowtext import span_hash

    hashed = lambda w: span_hash(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)]))[0]
    texts = ["new a a b", None, "old " + "c d " * 9, "old new b", "", "e " * 50]
    plans, sizes = [], []
    monkeypatch.setattr(toxicity, "_distinct", lambda row, h, f=toxicity._distinct: sizes.append(len(h)) or f(row, h))
    source = type("Source", (), {"select": lambda s, *c: s, "transform": lambda s, f, run, schema: plans.append(run)})()
    reached = np.sort(np.array([hashed("new"), hashed("old")], dtype=np.uint64))
    is_new = reached == hashed("new")
    toxicity._more_with_any(source, reached, np.where(is_new, 0, 400), np.where(is_new, 900, 400))
    got = Counter()
    for batch in plans[0](iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])])):
        got.update(dict(zip(batch["word"].to_pylist(), batch["n"].to_pylist())))
    want = {"new": 900 + 500, "a": 900, "b": 900 + 500, "old": 500}
    assert got == {None: 1400} | {int(np.uint64(hashed(w)).view(np.int64)): n for w, n in want.items()}
    assert sum(sizes) == 7


@pytest.mark.parametrize("name", ["op1_bpe_round_trip", "op3_warc_normaliser", "op5_minhash_groups", "op9_quality_sites", "op10_toxicity_lexicon"])
def test_whole_tables_without_sql(spark, name):
    from quadloom.llm import registry

    sf = "/root/testdata/sf0.001"
    got = registry.QUERIES[name](spark, sf).collect()
    table, key = ("pages", "page_id") if name.startswith("op3") else ("documents", "doc_id")
    want = {r[0] for r in spark.read.parquet(f"{sf}/{table}.parquet").select(key).collect()}
    assert {r[key] for r in got if r[key] is not None} == want
    if name.startswith("op1_"):
        assert all(r["lossless"] for r in got)
    if name.startswith("op5_"):
        texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
        ids = sorted(texts)
        root = _components([texts[i] for i in ids], minhash.THRESHOLD)
        brute = {ids[k]: ids[r] for k, r in enumerate(root)}
        assert sum(brute[r["doc_id"]] == r["group_id"] for r in got) >= 0.98 * len(ids)


def test_lookup_of_heavy_and_light_keys(spark):
    from pyspark.sql import functions as F

    from quadloom.llm.skew import lookup

    keys = [0] * 3000 + [1] * 2 + list(range(2, 2500))
    left = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, v long")
    right = left.groupBy("k").agg(F.count("*").alias("rows"), F.min("v").alias("low")).where("k <> 7")
    got = lookup(left, right, ["k"], "rows")
    want = left.join(right, "k")
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert lookup(left.where("false"), right, ["k"], "rows").collect() == [] and lookup(left, right.where("false"), ["k"], "rows").collect() == []


def test_results_do_not_depend_on_the_size_of_a_filter(spark, monkeypatch):
    import pyarrow as pa

    from quadloom.llm import bloom

    df = docs(spark, near_copies(12))
    want = sorted(x["doc_id"] for x in minhash.deduplicate(df).collect())
    monkeypatch.setattr(bloom, "MOST_BITS", 64)
    ids = spark.range(5000).selectExpr("xxhash64(id) id")
    full = bloom.build(ids, hashed=True)
    assert len(full.words) == 1 and full.may_hold(pa.array([x["id"] for x in ids.collect()])).all()
    assert sorted(x["doc_id"] for x in minhash.deduplicate(df).collect()) == want
