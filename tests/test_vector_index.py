"""The inverted-file index against a full comparison in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrygraph.operators import vector_index
from quarrygraph.operators.vector_index import add, build, probes, search, unit


def table(spark, ids, vectors, kind="long"):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in zip(ids, vectors, strict=True)], f"vec_id {kind}, embedding array<double>")


def clustered(rng, n, size=24, groups=20):
    centres = rng.normal(size=(groups, size)) * 4
    return centres[rng.integers(0, groups, n)] + rng.normal(size=(n, size)) * 0.3


def brute(ids, vectors, asked, k):
    x = np.array([v / (np.linalg.norm(v) or 1) for v in vectors])
    out = {}
    for i, q in asked:
        s = np.round(x @ (q / (np.linalg.norm(q) or 1)), 12) + 0.0
        found = sorted((-c, j) for c, j in zip(s.tolist(), ids, strict=True) if j != i)[:k]
        out[i] = [(j, pytest.approx(-c, abs=1e-9)) for c, j in found]
    return out


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["id"], r["cosine"]))
    return out


@pytest.mark.parametrize("kind", ["long", "string"])
def test_exact_on_clusters_and_odd_vectors(spark, tmp_path, monkeypatch, kind):
    monkeypatch.setattr(vector_index, "BLOCK_ROWS", 16)
    monkeypatch.setattr(vector_index, "QUERY_SLOT", 7)
    rng = np.random.default_rng(3)
    x = clustered(rng, 600)
    x[5] = x[6] = x[7]  # ties
    x[8] = x[9] = 0  # cosine 0 with all
    ids = [int(i) for i in rng.permutation(5000)[:600]]
    if kind == "string":
        ids = [f"v{i}" for i in ids]
    null = 99_999 if kind == "long" else "null"
    build(table(spark, [*ids, null], [*x, None], kind), str(tmp_path / "i"))
    asked = [(ids[i], x[i]) for i in [5, 6, 8, *range(20, 40)]] + [(-1 if kind == "long" else "new", clustered(rng, 1)[0])]
    got = answers(search(spark, str(tmp_path / "i"), table(spark, *zip(*asked, strict=True), kind), 5))
    assert got == brute(ids, x, asked, 5)


def test_reads_a_part_of_the_clusters_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK_ROWS", 32)
    rng = np.random.default_rng(4)
    x = clustered(rng, 3000)
    path = str(tmp_path / "i")
    note = build(table(spark, range(3000), x), path)
    assert note["rows"] == 3000 and note["cells"] == 55 and note["dimensions"] == 24
    asked = table(spark, range(0, 3000, 100), x[::100]).select(F.col("vec_id").alias("query_id"), unit(F.col("embedding")).alias("v"))
    pairs, _ = probes(spark, path, asked, 5)
    assert pairs.count() == pairs.distinct().count()
    read = pairs.join(vector_index._read(spark, path, "blocks"), "block").agg(F.sum("n")).first()[0]
    assert read < 0.5 * 3000 * 30


def test_added_vectors_are_found(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = clustered(rng, 400)
    path = str(tmp_path / "i")
    build(table(spark, range(300), x[:300]), path)
    before = {p: (tmp_path / "i" / p).stat().st_mtime_ns for p in vector_index._note(spark, path)["parts"]}
    note = add(table(spark, range(300, 400), x[300:]), path)
    assert note["rows"] == 400 and len(note["parts"]) == 2
    assert all((tmp_path / "i" / p).stat().st_mtime_ns == t for p, t in before.items())
    asked = [(i, x[i]) for i in (1, 299, 300, 399)]
    assert answers(search(spark, path, table(spark, *zip(*asked, strict=True)), 4)) == brute(range(400), x, asked, 4)
    with pytest.raises(ValueError, match="components"):
        add(table(spark, [1000], [[1.0]]), path)


def test_small_and_empty(spark, tmp_path):
    one = table(spark, [1, 2], [[1.0, 0.0], [0.0, 2.0]])
    build(one, str(tmp_path / "two"))
    assert answers(search(spark, str(tmp_path / "two"), one, 5)) == {1: [(2, 0.0)], 2: [(1, 0.0)]}
    assert answers(search(spark, str(tmp_path / "two"), one, 5, itself=True)) == {1: [(1, 1.0), (2, 0.0)], 2: [(2, 1.0), (1, 0.0)]}
    build(table(spark, [], []), str(tmp_path / "none"))
    assert search(spark, str(tmp_path / "none"), one, 5).count() == 0
    assert search(spark, str(tmp_path / "two"), table(spark, [], []), 5).count() == 0
    with pytest.raises(ValueError, match="no index"):
        search(spark, str(tmp_path / "nothing"), one, 5)
    with pytest.raises(ValueError, match="components"):
        build(table(spark, [1, 2], [[1.0], [1.0, 2.0]]), str(tmp_path / "bad"))
