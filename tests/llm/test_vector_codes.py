"""Vector codes against a loop over all entries in whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest

from quarrygraph.llm import vector_codes
from quarrygraph.llm.common import joined_counted
from quarrygraph.llm.vector_codes import encode, nearest, op13_vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, _qg_vec int"


def brute(rows):
    kept = [(i, v, g) for i, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    parts = [[[math.floor(256 * x) for x in v[p * len(v) // 16 : (p + 1) * len(v) // 16]] for p in range(16)] for _, v, _ in kept]
    first = sorted({i for i, _, _ in kept if i is not None})[:64]
    least = {i: min((v, n) for n, (j, v, _) in enumerate(kept) if j == i)[1] for i in first}
    books = [[parts[least[i]][p] for i in first] for p in range(16)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(2):
        for p in range(16):
            given = [near(v[p], books[p])[1] for v in parts]
            for e in range(len(books[p])):
                mine = [v[p] for v, g in zip(parts, given, strict=True) if g == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    final = [[near(v[p], books[p]) for p in range(16)] for v in parts]
    errors = [sum(d for d, _ in f) for f in final]
    by_label = {}
    for (_, _, g), e in zip(kept, errors, strict=True):
        by_label[g] = by_label.get(g, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted((str(i), "".join(f"{e:02x}" for _, e in f), e, by_label[g], digest) for (i, _, g), f, e in zip(kept, final, errors, strict=True))


def vectors(rng, n, size):
    rows = [(i, [rng.choice([rng.gauss(0, 1), -0.25, 0.0, -1e-4]) for _ in range(size)], rng.choice([None, 1, 2])) for i in rng.sample(range(1000), n)]
    rows += [rows[0], (rows[1][0], rows[2][1], 9), (None, rows[3][1], None), (2000, None, 1), (2001, [None] * size, 1), (2002, [math.nan] + [0.0] * (size - 1), 1), (2003, [math.inf] * size, 1)]
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], g) for i, v, g in rows]


def run(spark, tmp_path, rows):
    spark.createDataFrame([(*r, "c", 1) for r in rows], SCHEMA).write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
    out = op13_vector_codes(spark, str(tmp_path))
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((str(r[0]), *r[1:]) for r in out.collect())


@pytest.mark.parametrize(("n", "size"), [(100, 64), (40, 32), (4, 16), (90, 128)])
def test_equals_brute_force(spark, tmp_path, n, size):
    rows = vectors(random.Random(n), n, size)
    assert run(spark, tmp_path, rows) == brute(rows)


def test_empty_and_only_bad_rows(spark, tmp_path):
    assert run(spark, tmp_path, []) == []
    assert run(spark, tmp_path, [(1, None, 1), (2, [math.nan] * 16, None)]) == []


def test_odd_sizes_have_no_code(spark):
    rows = [(1, [0.5] * 16, 1), (2, [0.5] * 32, 1), (3, [], 1)]
    coded, _ = encode(spark.createDataFrame([(*r, "c", 1) for r in rows], SCHEMA))
    assert {r["vec_id"]: r["error"] for r in coded.collect()} == {1: 0, 2: None, 3: None}
    with pytest.raises(ValueError, match="equal parts"):
        encode(spark.createDataFrame([(1, [0.5] * 17, 1, "c", 1)], SCHEMA))


def test_rows_without_an_id_alone(spark):
    coded, books = encode(spark.createDataFrame([(None, [0.5] * 16, 1, "c", 1)], SCHEMA))
    assert [tuple(r) for r in coded.collect()] == [(None, 1, None, None)]
    assert not books.size


def test_huge_components_fit_in_a_long(spark):
    coded, _ = encode(spark.createDataFrame([(i, [s * 3e38] * 64, 1, "c", 1) for i, s in enumerate([1.0, -1.0, 0.0])], SCHEMA))
    assert all(r["error"] == 0 for r in coded.collect())


@pytest.mark.parametrize("spread", [2, 300, 1 << 25])
def test_bounds_lose_no_entry(spread):
    rng = np.random.default_rng(spread)
    for width in (1, 2, 3, 4, 8, 12):
        x, c = rng.integers(-spread, spread, (300, width)), rng.integers(-spread, spread, (64, width))
        d = ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
        entry, least = nearest(x, c)
        assert (entry == d.argmin(axis=1)).all()
        assert (least == d.min(axis=1)).all()


def test_many_labels_are_joined_by_shuffle(spark, tmp_path, monkeypatch):
    rows = vectors(random.Random(7), 80, 16)
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 0)
    assert run(spark, tmp_path, rows) == brute(rows)
    left = spark.createDataFrame([(1, "a"), (None, "b"), (1, "c")], "k int, v string")
    right = spark.createDataFrame([(1, 10), (None, 20)], "k int, n int")
    assert sorted((r["v"], r["n"]) for r in joined_counted(left, right, "k", 2, 0).collect()) == [("a", 10), ("b", 20), ("c", 10)]
