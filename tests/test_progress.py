"""Callbacks of long steps, and paths over the schema's edges."""

import json
import time

import pytest

from quarrygraph import cli, plugins, progress
from quarrygraph.operators import graph_queries
from quarrygraph.sources import graph_json, markup
from quarrygraph.sources.star import Graph

from .test_agent import export


def test_sync_load_and_embed_tell_of_their_steps(spark, tmp_path):
    (tmp_path / "md").mkdir()
    (tmp_path / "md" / "a.md").write_text("## Prepared Remarks\n\nJane Roe, CEO: AI demand lifts revenue.\n")
    (tmp_path / "m.json").write_text(json.dumps({"documents": [{"filename": "a.md", "company": "Acme", "quarter": "Q1"}]}))
    seen, out, path = [], str(tmp_path / "out"), str(tmp_path / "graph")
    assert cli.sync(spark, str(tmp_path / "md"), markup.read_manifest(spark, str(tmp_path / "m.json")), out, any_source=True, report=seen.append) == 1
    cli.load_graph(spark, cli._exports(spark, out), path, report=seen.append)
    cli.embed_chunks(spark, path, plugins.hashed_vector(4), "m", 4, report=seen.append)
    steps = [e.step for e in seen if e.state == "end"]
    assert steps[:4] == ["read documents", "cut chunks", "write exports", "read exports"] and set(steps[4:-2]) == {f"write {t}" for t in (*cli.TABLES, "extraction_runs")}
    assert steps[-2:] == ["embed chunks", "write embeddings"]
    for name in set(steps):
        mine = [e for e in seen if e.step == name]
        assert [e.state for e in mine][0] == "start" and mine[-1].state == "end" and mine[-1].rows is not None
        assert all(e.done <= e.total for e in mine)


def test_progress_within_a_step_and_failure(spark, monkeypatch):
    monkeypatch.setattr(progress, "EVERY", 0.05)
    seen = []
    with progress.step(spark, "slow", seen.append) as own:
        spark.range(8, numPartitions=8).rdd.map(lambda x: time.sleep(0.2) or x).count()
        own.rows = 8
    assert [e.state for e in seen][0] == "start" and "progress" in {e.state for e in seen} and seen[-1].state == "end" and seen[-1].rows == 8 and max(e.done for e in seen) > 0
    with pytest.raises(KeyError), progress.step(spark, "bad", seen.append):
        raise KeyError("x")
    assert seen[-1].state == "failed"
    with progress.step(spark, "quiet", None):
        pass


def walked(edges, start, types):
    """Shortest paths by breadth, the least of several."""
    found, front = {start: ""}, {start: ""}
    while front:
        new = {}
        for at, path in front.items():
            for s, kind, t in edges:
                if s == at and t not in found and (types is None or kind in types):
                    longer = f"{path} > {kind} {t}" if path else f"{kind} {t}"
                    new[t] = min(new.get(t, longer), longer)
        found |= new
        front = new
    return found


@pytest.mark.parametrize("types", [("IS_A", "PART_OF"), ("IS_A",), None])
def test_ancestors_with_cycles(spark, types):
    edges = [(1, "IS_A", 2), (2, "PART_OF", 3), (3, "IS_A", 1), (3, "DRIVES", 4), (4, "IS_A", 4), (2, "IS_A", 5), (1, "IS_A", 5), (5, "PART_OF", 6), (7, "IS_A", 2), (1, "PART_OF", 2)]
    frames = {f: spark.createDataFrame([], "id long") for f in Graph.__dataclass_fields__}
    frames["concepts"] = spark.createDataFrame([(i, str(i), "", "") for i in range(1, 9)], "id long, name string, concept_type string, description string")
    frames["schema_edges"] = spark.createDataFrame(edges, "source_id long, relation_type string, target_id long")
    got = {(r["concept_id"], r["reached_id"]): r["path"] for r in graph_queries.ancestors(Graph(**frames), types).collect()}
    assert got == {(i, t): p for i in range(1, 9) for t, p in walked(edges, i, types).items()}
    near = {(r["concept_id"], r["reached_id"]) for r in graph_queries.ancestors(Graph(**frames), types, most=1).collect()}
    assert near == {(i, i) for i in range(1, 9)} | {(s, t) for s, kind, t in edges if types is None or kind in types}


def test_a_load_without_a_callback_is_silent(spark, tmp_path, capsys):
    (tmp_path / "x").mkdir()
    export(spark, tmp_path / "x", "a", "Acme", "ACM")
    cli.load_graph(spark, graph_json.read_graphs(spark, str(tmp_path / "x")), str(tmp_path / "graph"))
    assert capsys.readouterr().out == ""
