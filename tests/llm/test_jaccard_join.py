"""The n-gram Jaccard join against all pairs of sets of strings."""

import random

import numpy as np
import pytest

from quarrygraph.llm import jaccard_join
from quarrygraph.llm.jaccard_join import keys, op12_jaccard_join, parities, possible, shingles

from .helpers import ODD, SCHEMA, docs, prose


def grams(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", words)]
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(ids, texts):
    sets = [grams(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        r = find(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return sorted(map(str, ((d, len(s), least[find(i)]) for i, (d, s) in enumerate(zip(ids, sets, strict=True)))))


def edited(rng, text, n):
    words = text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = prose(rng, 1) + str(rng.randrange(99))
    return " ".join(words)


def family(rng, size, words, most):
    """Copies of copies: chains near the threshold, so that not all members are similar."""
    out = [prose(rng, words)]
    for _ in range(size - 1):
        out.append(edited(rng, rng.choice(out), rng.randint(0, most)))
    return out


def corpus(rng):
    texts = list(ODD)
    for words, most in ((4, 1), (5, 1), (6, 1), (8, 1), (9, 1), (10, 1), (12, 1), (15, 1), (20, 1), (30, 1), (60, 2), (100, 3), (250, 8), (700, 20), (1500, 45)):
        for _ in range(2):
            texts += family(rng, 6, words, most)
    shared = prose(rng, 40)
    texts += [prose(rng, rng.randint(1, 30)) + " " + shared for _ in range(20)]
    texts += [t.upper() for t in texts[20:24]] + [t.replace(" ", "\n\t ") for t in texts[30:33]]
    texts += [" ".join(t.split(" ")[: rng.randint(1, len(t.split(" ")))]) for t in texts[40:90] if t]
    return texts


def run(spark, tmp_path, texts, ids):
    docs(spark, texts, ids).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    out = op12_jaccard_join(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted(map(str, (tuple(r) for r in out.collect())))


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, tmp_path, monkeypatch, small):
    rng = random.Random(12 + small)
    texts = corpus(rng)
    ids = [None, None, *rng.sample(range(10_000), len(texts) - 3), 5]
    if small:  # tiny blocks, shuffled joins, and every shared key dealt out as a hot one
        monkeypatch.setattr(jaccard_join, "BLOCK", 2)
        monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(jaccard_join, "HOT_LEAST", 1)
        monkeypatch.setattr(jaccard_join, "HOT_SHARE", 0.0)
        monkeypatch.setattr(jaccard_join, "HOT_SAMPLE", 1)
    assert run(spark, tmp_path, texts, ids) == brute(ids, texts)


def test_repeated_rows_and_a_group_of_copies(spark, tmp_path):
    rng = random.Random(3)
    base = prose(rng, 120)
    texts = [base] * 60 + [edited(rng, base, 1) for _ in range(30)] + [None, "", "one two", "One\ttwo"]
    ids = [7] * 5 + list(range(100, 100 + len(texts) - 5))
    assert run(spark, tmp_path, texts, ids) == brute(ids, texts)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert op12_jaccard_join(spark, str(tmp_path)).collect() == []


def test_similar_sets_share_a_key():
    rng = np.random.default_rng(4)
    for n in [*range(4, 80), 150, 333, 800, 2500]:
        for _ in range(30 if n < 100 else 5):
            touched = int(rng.integers(1, n // 4 + 2))
            gone = int(rng.integers(0, touched + 1))
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 1 << 63, touched - gone, dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 80 * (len(a) + len(b) - both):
                assert len(np.intersect1d(keys(a), keys(b))), (n, len(b), both)


def test_parities_rule_out_no_similar_pair():
    rng = random.Random(6)
    texts = family(rng, 40, 90, 3) + family(rng, 20, 60, 2) + [prose(rng, 75) for _ in range(20)]
    sets = [shingles(t.encode()) for t in texts]
    a, b = possible(np.array([len(s) for s in sets]), [parities(s) for s in sets], np.ones((len(sets),) * 2, bool), 80)
    found = {(min(p), max(p)) for p in zip(a.tolist(), b.tolist(), strict=True)}
    for i, x in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(x, sets[j]))
            if 100 * both >= 80 * (len(x) + len(sets[j]) - both):
                assert (j, i) in found
    assert len(found) < len(sets) ** 2 / 3
