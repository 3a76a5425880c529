"""Tables of buckets under one pointer: small commits write little, and a crash leaves what was there."""

import json
import os

import pytest
from pyspark.sql import functions as F

from quarrygraph import cli
from quarrygraph.sources import graph_json, storage
from quarrygraph.sources.star import star_graph

from .test_agent import export

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
KEYS = {"maps_to": "entity_id", "schema_edges": "edge_key"}


def rows_of(spark, path, columns=None):
    g = cli.open_graph(spark, path)
    chosen = lambda t: getattr(g, t).select(columns[t]) if columns else getattr(g, t)
    return {t: sorted(map(str, (tuple(r) for r in chosen(t).collect()))) for t in cli.TABLES}


def size(folder):
    return sum(f.stat().st_size for f in folder.rglob("*.parquet"))


def test_a_small_load_writes_little(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "BUCKET_ROWS", 64)
    g, path = star_graph(spark, DATA), str(tmp_path / "graph")
    changes = {}
    for t in cli.TABLES:
        df = getattr(g, t)
        df = df.select(*[F.col(c).cast("string").alias(c) if c.endswith("id") and c != "call_id" else F.col(c) for c in df.columns])
        if t == "schema_edges":
            df = df.distinct().withColumn("edge_key", F.concat_ws("|", *df.columns))
        changes[t] = storage.Change(df, KEYS.get(t, "id"))
    changes["extraction_runs"] = storage.Change(spark.createDataFrame([], "id string, document_id string, extractor string, entity_count int, relation_count int, chunk_count int, load_seq string"), "id")
    storage.commit(spark, path, changes, tokens={"vocabulary": cli.hashlib.sha1(repr(cli.vocabulary.load(None)).encode()).hexdigest()})
    columns = {t: getattr(cli.open_graph(spark, path), t).columns for t in cli.TABLES}
    before, total = {t: set(r) for t, r in rows_of(spark, path, columns).items()}, size(tmp_path / "graph")
    (tmp_path / "x").mkdir()
    export(spark, tmp_path / "x", "a", "Acme", "ACM")
    new = cli.load_graph(spark, graph_json.read_graphs(spark, str(tmp_path / "x")), path)
    written = sum(size(tmp_path / "graph" / w["folder"]) for w in new["written"].values())
    assert written < 0.05 * total
    after = rows_of(spark, path, columns)
    assert {t: len(set(after[t]) - before[t]) for t in ("documents", "chunks", "facts", "entities")} == {"documents": 1, "chunks": 1, "facts": 1, "entities": 2}
    assert all(before[t] <= set(after[t]) for t in cli.TABLES)


@pytest.fixture
def loads(spark, tmp_path):
    for name in "ab":
        (tmp_path / name).mkdir()
    export(spark, tmp_path / "a", "a", "Acme", "ACM")
    export(spark, tmp_path / "b", "b", "Beta", "BET", entities=[{"id": "e2", "name": "Cloud sales", "entity_type": "Metric"}, {"id": "e3", "name": "Margin", "entity_type": "Metric"}])
    return {n: graph_json.read_graphs(spark, str(tmp_path / n)) for n in "ab"}


@pytest.mark.parametrize(("reset", "stops"), [(False, (1, 4)), (True, (2,))])
def test_a_crash_at_any_step_leaves_the_old_graph(spark, tmp_path, monkeypatch, loads, reset, stops):
    path = str(tmp_path / "graph")
    cli.load_graph(spark, loads["a"], path)
    old = rows_of(spark, path)
    real = {n: getattr(storage, n) for n in ("stored", "touched", "delete", "write_text")}
    calls = {n: 0 for n in real}

    def counted(name, stop):
        def call(*a, **k):
            calls[name] += 1
            if calls[name] == stop:
                raise OSError("the writer is gone")
            return real[name](*a, **k)

        return call

    for name in real:
        for stop in stops:
            calls[name] = 0
            monkeypatch.setattr(storage, name, counted(name, stop))
            failed = False
            try:
                cli.load_graph(spark, loads["b"], path, reset=reset)
            except OSError:
                failed = True
            monkeypatch.setattr(storage, name, real[name])
            now = rows_of(spark, path)
            if failed and name != "delete":
                assert now == old, (name, stop)
            if now != old:  # the pointer had moved: all of the load is there
                assert {r["id"] for r in cli.open_graph(spark, path).documents.collect()} >= {"doc-b"}
                return


def test_two_writers(spark, tmp_path, loads):
    path = str(tmp_path / "graph")
    start = cli.load_graph(spark, loads["a"], path)
    cli.load_graph(spark, loads["b"], path)
    with pytest.raises(RuntimeError, match="another commit"):
        storage.commit(spark, path, {"companies": storage.Change(spark.createDataFrame([("x", "X", "X", "s")], "id string, name string, ticker string, sector string"), "id")}, start)
    assert {r["id"] for r in cli.open_graph(spark, path).companies.collect()} == {"acme", "beta"}


def test_readers_of_the_last_state_go_on(spark, tmp_path, loads):
    path = str(tmp_path / "graph")
    cli.load_graph(spark, loads["a"], path)
    held = cli.open_graph(spark, path)
    cli.load_graph(spark, loads["b"], path)
    assert {r["id"] for r in held.documents.collect()} == {"doc-a"}
    assert {r["id"] for r in cli.open_graph(spark, path).documents.collect()} == {"doc-a", "doc-b"}


def test_rows_go_and_columns_come(spark, tmp_path):
    path = str(tmp_path / "t")
    storage.commit(spark, path, {"t": storage.Change(spark.createDataFrame([(i, i) for i in range(9)], "k int, v int"), "k")})
    storage.commit(spark, path, {"t": storage.Change(spark.createDataFrame([(3, 30, "x")], "k int, v int, w string"), "k", spark.createDataFrame([(5,), (77,)], "k int"))})
    assert sorted(tuple(r) for r in storage.opened(spark, path, "t").collect()) == [(0, 0, None), (1, 1, None), (2, 2, None), (3, 30, "x"), (4, 4, None), (6, 6, None), (7, 7, None), (8, 8, None)]
    assert storage.opened(spark, path, "none") is None
    assert json.loads(storage.read_text(spark, f"{path}/_current.json"))["version"] == 2


def test_another_vocabulary_is_merged(spark, tmp_path, loads):
    path = str(tmp_path / "graph")
    cli.load_graph(spark, loads["a"], path)
    n = cli.open_graph(spark, path).concepts.count()
    (tmp_path / "v.json").write_text(json.dumps({"concepts": [{"id": "concept-own", "name": "Cloud revenue"}, {"id": "concept-top", "name": "Top"}], "relations": [{"source": "concept-own", "relation_type": "IS_A", "target": "concept-top"}]}))
    cli.load_graph(spark, loads["b"], path, str(tmp_path / "v.json"))
    g = cli.open_graph(spark, path)
    assert g.concepts.count() == n + 2 and g.schema_edges.filter("source_id = 'concept-own'").count() == 1
    assert {r["concept_id"] for r in g.maps_to.collect()} <= {"concept-own", "concept-top"}
