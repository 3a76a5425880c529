"""Operators 1, 5, 6, 7 against brute force and DuckDB, and on odd rows."""

import hashlib
import random
import re
import unicodedata
from collections import Counter

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from quarrygraph.llm import common, decontamination, fingerprints, lines, mixing
from quarrygraph.llm.registry import ORACLE_SQL, QUERIES

from .helpers import DATA, ODD, docs, prose


def canon(t):
    t = unicodedata.normalize("NFKC", t or "").lower()
    return re.sub(r"[\s\x85  ]+", " ", t).strip(" ")


def edited_brute(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t) // 3
        e = t[: len(t) - n] + nxt[:n]
        out[i] = (len(t), hashlib.sha256(e.encode()).hexdigest(), float(canon(e) == canon(t)), float(canon(nxt) == canon(t)))
    return out


@pytest.mark.parametrize("near", [2, 1024])
def test_edited_texts(spark, monkeypatch, near):
    monkeypatch.setattr(fingerprints, "NEIGHBOUR_ROWS", near)
    rng = random.Random(1)
    texts = ODD + [prose(rng, rng.randint(1, 40)) for _ in range(60)]
    ids = rng.sample(range(-50, 10**15, 7), len(texts))
    got = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(docs(spark, texts, ids)).collect()}
    want = edited_brute(list(zip(ids, texts, strict=True)))
    assert {i: (r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for i, r in got.items()} == want
    by = {}
    for i, t in zip(ids, texts, strict=True):
        by.setdefault(canon(t), set()).add(got[i]["fingerprint"])
    assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)


def test_edited_texts_of_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in common.table(spark, DATA, "documents").select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in QUERIES["op1_fingerprints"](spark, DATA).collect()}
    assert got == edited_brute(rows)


def test_edited_texts_of_few_rows(spark):
    assert fingerprints.edited_fingerprints(docs(spark, [])).count() == 0
    r = fingerprints.edited_fingerprints(docs(spark, ["abc def"], [5])).first()
    assert r["edited_sha256"] == hashlib.sha256(b"abc dab").hexdigest() and r["near_next"] == 1.0
    assert fingerprints.edited_fingerprints(docs(spark, ["a", "b", "b"], [None, 1, 1])).count() == 3


@pytest.mark.parametrize("near", [2, 1024])
def test_edited_texts_of_string_ids(spark, monkeypatch, near):
    monkeypatch.setattr(fingerprints, "NEIGHBOUR_ROWS", near)
    rng = random.Random(2)
    texts = ODD + [prose(rng, rng.randint(1, 40)) for _ in range(60)]
    ids = [f"doc {i}" for i in rng.sample(range(10**6), len(texts))]
    got = fingerprints.edited_fingerprints(docs(spark, texts, range(len(texts))).withColumn("doc_id", F.array(*map(F.lit, ids))[F.col("doc_id").cast("int")])).collect()
    want = {}
    order = sorted(zip(ids, texts, strict=True), reverse=True)
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t) // 3
        want[i] = hashlib.sha256((t[: len(t) - n] + nxt[:n]).encode()).hexdigest()
    assert {r["doc_id"]: r["edited_sha256"] for r in got} == want
    nulls = docs(spark, ["a", "b", "c"]).withColumn("doc_id", F.when(F.col("doc_id") == 1, "x"))
    assert sorted(str(r["doc_id"]) for r in fingerprints.edited_fingerprints(nulls).collect()) == ["None", "None", "x"]


def test_colliding_texts_have_their_own_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "digest", lambda c: F.lit("0" * 32))
    got = fingerprints.edited_fingerprints(docs(spark, ["aaa", "bbb", "AAA", "bbb", "ab", ""], [None, 1, 1, None, 7, 8])).collect()
    by = {}
    for r in got:
        by.setdefault(r["n_chars"] and r["edited_sha256"], r)
    names = sorted(r["fingerprint"] for r in got)
    assert len(names) == 6 and len(set(names)) == 4
    assert all((r["fingerprint"] == r["edited_fingerprint"]) == (r["near_edited"] == 1.0) for r in got)


def test_exact_groups(spark):
    rows = {r["doc_id"]: (r["class_id"], r["class_size"]) for r in fingerprints.exact_groups(docs(spark, ["Ａ b", "a  B", "c", None, ""], [9, 4, 3, 2, 1])).collect()}
    assert rows == {9: (4, 2), 4: (4, 2), 3: (3, 1), 2: (1, 2), 1: (1, 2)}


def test_a_collision_is_split(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "digest", lambda c: F.lit("0" * 32))
    rows = {r["doc_id"]: r["class_id"] for r in fingerprints.exact_groups(docs(spark, ["a", "b", "A"])).collect()}
    assert rows == {0: 0, 1: 1, 2: 0}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows_equal_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    rel = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    assert sorted(map(str, (tuple(r) for r in df.select(*cols).collect()))) == sorted(str(tuple(r[names.index(c)] for c in cols)) for r in rel.fetchall())


W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def contamination_brute(texts, items):
    wins = {}
    for i, t in items:
        w = W.findall(low(t))
        for k in range(max(1, len(w) - 9) if w else 0):
            wins.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    out = []
    for t in texts:
        w, hit, found = W.findall(low(t)), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if (x := wins.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= x
        out.append((len(w), len(hit), sorted(found)))
    return out


def test_contamination(spark):
    rng = random.Random(2)
    items = [(i, prose(rng, rng.randint(3, 25))) for i in range(12)] + [(12, None), (13, "  "), (14, "One-Two"), (15, "one two")]
    texts = list(ODD)
    for _ in range(40):
        w = prose(rng, 30).split()
        b = rng.choice(items[:12])[1].split()
        k = rng.randint(0, 20)
        texts.append(" ".join(w[:k] + b[: rng.randint(1, len(b))] + w[k:]) + rng.choice(["", " ONE, two!", "\n" + rng.choice(items[:12])[1]]))
    bench = spark.createDataFrame(items, "item_id long, text string")
    d = docs(spark, texts)
    size = F.aggregate("spans", F.lit(0), lambda a, s: a + s["b"] - s["a"])
    got = {r["doc_id"]: (r["n_words"], r["n"], r["items"]) for r in decontamination.contamination(d, bench).select("doc_id", "n_words", size.alias("n"), "items").collect()}
    want = contamination_brute(texts, items)
    assert [got[i] for i in range(len(texts))] == want
    kept = {r["doc_id"] for r in decontamination.decontaminate(d, bench).collect()}
    assert kept == {i for i, x in enumerate(want) if not x[1]}
    cut = decontamination.decontaminate(d, bench, remove="spans")
    assert cut.columns == d.columns
    for r in cut.collect():
        n = want[r["doc_id"]]
        assert len(W.findall(low(r["text"]))) >= 0 and (n[1] or r["text"] == texts[r["doc_id"]])
        if n[1]:
            total = Counter(W.findall(low(texts[r["doc_id"]])))
            left = Counter(W.findall(low(r["text"])))
            assert sum(total.values()) - sum(left.values()) == n[1] or " " not in r["text"]


def test_contamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contamination(docs(spark, ODD), none).filter("size(spans) > 0").count() == 0
    some = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontamination.contamination(docs(spark, []), some).count() == 0
    twice = decontamination.contamination(docs(spark, ["a b c", "a b c", "x"], [1, 1, None]), some)
    assert sorted(len(r["items"]) for r in twice.collect()) == [0, 1, 1]


def poisson(mean, u):
    import math

    n, term = 0, math.exp(-mean)
    cdf = term
    while cdf <= u and n < 80:
        n += 1
        term *= mean / n
        cdf += term
    return n


def test_mixing(spark):
    rng = random.Random(3)
    texts = ODD + [prose(rng, 30) for _ in range(400)]
    source = [rng.choice(["a", "a", "a", "b", None]) for _ in texts]
    d = docs(spark, texts, source=source)
    out = mixing.mix(d, weights={"a": 0.25, "b": 0.75}, total=60_000)
    assert out.columns == [*d.columns, "copy_no"]
    rows = out.collect()
    rates = {r["source"]: r["rate"] for r in mixing.source_rates(d, {"a": 0.25, "b": 0.75}, 60_000).collect()}
    assert rates[None] == 0
    got = Counter(r["doc_id"] for r in rows)
    for i, s in enumerate(source):
        rate, want = rates[s], 0
        m = max(1, -(-rate // mixing.DRAW_MEAN))
        for k in range(1, int(m) + 1):
            u = int(hashlib.md5(f"{mixing.SEED}-{k}|{i}".encode()).hexdigest()[:13], 16) / (1 << 52)
            want += poisson(rate / m, u)
        assert got[i] == want
    chars = Counter()
    for r in rows:
        chars[r["source"]] += len(r["text"] or "")
    assert abs(chars["b"] / sum(chars.values()) - 0.75) < 0.08 and abs(sum(chars.values()) / 60_000 - 1) < 0.2
    assert [tuple(r) for r in mixing.mix(d, weights={"a": 1.0}).collect()] == [tuple(r) for r in mixing.mix(d.repartition(7), weights={"a": 1.0}).collect()]
    assert mixing.mix(docs(spark, [])).count() == 0
    mixing.mix(docs(spark, [None, "", None], [None, 1, None])).count()


def test_line_dedup(spark):
    rng = random.Random(4)
    own = [prose(rng, 15) for _ in range(8)]
    shared, short = prose(rng, 14), "too short"
    texts = [f"{own[i]}\n{shared} {i} end\n{short}\n" for i in range(5)] + [own[5], f"{shared} 77 end", None, "", "\n\n", f"{own[6]}\n{own[6]}"]
    d = docs(spark, texts, [50, 40, 30, 20, 10, 60, 61, 62, 63, 64, 65])
    out = {r["doc_id"]: r["text"] for r in lines.dedup_lines(d).collect()}
    assert out[10] == texts[4]  # the least id keeps the line
    for k, i in enumerate((50, 40, 30, 20)):
        assert out[i] == f"{own[k]}\n{short}\n"
    assert out[61] == "" and out[60] == own[5] and out[62] is None and out[63] == "" and out[64] == "\n\n" and out[65] == texts[10]
    assert lines.dedup_lines(d).columns == d.columns


def test_open_stretch_and_two_documents(spark):
    rng = random.Random(5)
    a = prose(rng, 20).split()
    variants = []
    for k in range(4):
        v = list(a)
        v[12] = f"name{'abcd'[k]}"
        variants.append(" ".join(v))
    out = [r["text"] for r in lines.dedup_lines(docs(spark, variants)).orderBy("doc_id").collect()]
    assert out == [variants[0], "", "", ""]
    two = [" ".join(a)] * 2
    assert [r["text"] for r in lines.dedup_lines(docs(spark, two)).collect()] == two
    assert lines.dedup_lines(docs(spark, [])).count() == 0
    assert lines.dedup_lines(docs(spark, ODD + ["y " * 60_000], [*range(len(ODD)), None])).count() == len(ODD) + 1


def test_hash_is_the_usual_one(spark):
    got = spark.createDataFrame([("abc",)], "t string").select(F.xxhash64("t")).first()[0]
    assert got % (1 << 64) == xxhash.xxh64_intdigest(b"abc", 42)
