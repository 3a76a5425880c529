"""Operators 4 and 8 against brute force."""

import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import xxhash

from quarrygraph.llm import near_dups, substrings
from quarrygraph.llm.registry import QUERIES

from .helpers import DATA, ODD, docs, prose


def fp_brute(t):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", w) if x]
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_brute(rows, radius=3):
    ids = list(rows)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    arr = np.array([rows[i] for i in ids], np.uint64)
    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(arr ^ arr[k]) <= radius):
            a, b = find(i), find(ids[j])
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_masks_cover():
    masks = near_dups.covering_masks(list(range(64)), 3)
    assert len(masks) == 15
    rng = random.Random(0)
    for _ in range(3000):
        d = rng.sample(range(64), rng.randint(1, 3))
        assert any(not any(m >> b & 1 for b in d) for m in masks)
    few = near_dups.covering_masks(list(range(9)), 3)
    for d in itertools.combinations(range(9), 3):
        assert any(not any(m >> b & 1 for b in d) for m in few)


def test_fingerprints(spark):
    rng = random.Random(1)
    texts = ODD + [prose(rng, n) for n in (1, 2, 3, 4, 50, 3000)] + ["A B c\x0bd e", "É é É"]
    got = {r["_qg_id"]: r["fp"] % (1 << 64) for r in near_dups.fingerprints(docs(spark, texts)).collect()}
    assert got == {i: fp_brute(t) for i, t in enumerate(texts)}


def groups_of(spark, fps, crowded=1024):
    nodes = spark.createDataFrame([(near_dups._signed(f),) for f in set(fps)], "fp long")
    roots = {r["node"] % (1 << 64): r["root"] for r in near_dups.components(near_dups.links(nodes, 3, crowded)).collect()}
    return {f: roots.get(f, near_dups._signed(f)) for f in set(fps)}


def test_links_of_dense_groups(spark):
    rng = random.Random(2)
    fps = []
    for _ in range(6):
        base = rng.getrandbits(64)
        fps += [base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(60)]
    fps += [rng.getrandbits(64) for _ in range(200)]
    want = components_brute(dict(zip(fps, fps, strict=True)))
    for crowded in (1024, 10):  # the second cuts crowded keys again
        got = groups_of(spark, fps, crowded)
        by = {}
        for f in got:
            by.setdefault(got[f], set()).add(want[f])
        assert all(len(v) == 1 for v in by.values()) and len(by) == len(set(want.values()))


def test_links_across_the_sign_bit(spark):
    rng = random.Random(63)
    pairs = []
    for others in ([], [0], [5, 9], [62]):
        for _ in range(12):
            f = rng.getrandbits(64)
            pairs.append((f, f ^ (1 << 63) ^ sum(1 << b for b in others)))
    for crowded in (1024, 1):
        got = groups_of(spark, [f for p in pairs for f in p], crowded)
        assert all(got[a] == got[b] for a, b in pairs)
    fronts = [pairs[0][0] ^ (1 << b) for b in range(12)] + [pairs[0][1]]  # a large key, searched front by front
    got = groups_of(spark, fronts)
    assert len(set(got.values())) == 1


def test_a_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    got = {r["node"]: r["root"] for r in near_dups.components(edges).collect()}
    assert set(got) == {*range(301), 1000, 1001} and all(v == (0 if k < 999 else 1000) for k, v in got.items())


def test_near_groups(spark):
    rng = random.Random(3)
    base = [prose(rng, 80) for _ in range(6)]
    texts = list(ODD) + base
    for b in base[:4]:
        w = b.split()
        for _ in range(5):
            v = list(w)
            v[rng.randrange(len(v))] = "changed"
            texts.append(" ".join(v))
    ids = [3 * i + 7 for i in range(len(texts))]
    rng.shuffle(ids)
    d = docs(spark, texts, ids)
    got = {r["doc_id"]: r["component_id"] for r in near_dups.near_groups(d).collect()}
    want = components_brute({i: fp_brute(t) for i, t in zip(ids, texts, strict=True)})
    assert got == want
    kept = near_dups.dedup_near(d)
    assert kept.columns == d.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


def test_near_groups_of_odd_tables(spark):
    assert near_dups.dedup_near(docs(spark, [])).count() == 0
    assert near_dups.dedup_near(docs(spark, ["a b c d", "a b c d", None, ""], [None, None, None, 4])).count() == 2
    assert near_dups.dedup_near(docs(spark, ["a b c d"] * 3, [5, 5, 5])).count() == 1
    rows = docs(spark, ["a b c d"] * 4 + ["e f g h"] * 2, [5, 5, 5, 6, 7, 8], lang=["en", "de", "en", "fr", "en", "en"], source=["x", "y", "x", "x", "x", "x"])
    kept = {tuple(r) for p in (1, 3) for r in near_dups.dedup_near(rows.repartition(p)).collect()}
    assert sorted(r[0] for r in kept) == [5, 7]  # the same row of id 5, however rows are dealt


def test_whole_table(spark):
    from quarrygraph.llm.common import table

    rows = {r["doc_id"]: fp_brute(r["text"]) for r in table(spark, DATA, "documents").select("doc_id", "text").collect()}
    want = components_brute(rows)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op4_near_dups"](spark, DATA).collect()}
    assert got == {i: (f"{f:016x}", want[i]) for i, f in rows.items()}


def repeats_brute(texts, length):
    data = {i: (t or "").encode() for i, t in texts}
    seen = Counter(b[k : k + length] for b in data.values() for k in range(len(b) - length + 1))
    out = {}
    for i, b in data.items():
        spans = []
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                if spans and spans[-1][1] >= k:
                    spans[-1][1] = k + length
                else:
                    spans.append([k, k + length])
        kept = b"".join(b[x:y] for x, y in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(b)], strict=True))
        out[i] = (len(b), sum(e - s for s, e in spans), len(spans), hashlib.sha256(kept).hexdigest())
    return out


def repeats(spark, d, length):
    return {r["doc_id"]: (r["n_bytes"], sum(s["b"] - s["a"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in substrings.remove_repeats(d, length=length).collect()}


def planted(rng):
    shared = [prose(rng, n) for n in (40, 55, 60, 70, 120, 400)]
    texts = list(ODD)
    for _ in range(60):
        parts = [prose(rng, rng.randint(0, 90)) for _ in range(3)]
        s = rng.choice(shared)
        k = rng.randint(0, len(s) // 2)
        texts.append(parts[0] + s[k:] + parts[1] + rng.choice(["", rng.choice(shared)[: rng.randint(100, 600)]]) + parts[2])
    base = prose(rng, 300)
    for _ in range(12):  # near copies
        k = rng.randint(0, len(base) - 10)
        texts.append(base[:k] + "<edit>" + base[k + rng.randint(0, 9) :])
    texts += [base, base, "Thhaen " * 200, "Thhaen " * 70, "x" + "Thhaen " * 90, "abc " * 500, "é" * 450, prose(rng, 20) * 8]
    texts.append(texts[-1] + prose(rng, 200) + texts[-1][:500])
    return texts


def test_repeats(spark, monkeypatch):
    rng = random.Random(4)
    texts = planted(rng)
    d = docs(spark, texts)
    want = repeats_brute(list(enumerate(texts)), 400)
    assert sum(w[1] for w in want.values()) > 20_000
    assert repeats(spark, d, 400) == want
    for crowded in (3, 1):  # most groups are ranked at growing lengths; then all, up to single windows
        monkeypatch.setattr(substrings, "CROWDED", crowded)
        assert repeats(spark, d, 400) == want
    monkeypatch.setattr(substrings, "FILTER_BITS", 1 << 15)
    assert repeats(spark, d, 400) == want
    assert repeats(spark, d, 150) == repeats_brute(list(enumerate(texts)), 150)


def test_repeats_of_odd_tables(spark):
    assert substrings.remove_repeats(docs(spark, [])).count() == 0
    rng = random.Random(5)
    t = prose(rng, 200)
    rows = substrings.remove_repeats(docs(spark, [t, t, None, prose(rng, 200)], [None, 1, 1, 2])).collect()
    assert sorted(len(r["kept"]) for r in rows)[:3] == [0, 0, 0]


def test_repeats_of_whole_table(spark):
    from quarrygraph.llm.common import table

    texts = [(r["doc_id"], r["text"]) for r in table(spark, DATA, "documents").select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in QUERIES["op8_suffix_dedup"](spark, DATA).collect()}
    assert got == repeats_brute(texts, 400)
