"""Searches that move narrow rows: their rows are those of the wide join, and texts meet the returned rows only."""

import os
from dataclasses import replace

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrygraph.functions.expressions import asc, contains_any, desc
from quarrygraph.operators import graph_queries as q
from quarrygraph.operators import marks as m
from quarrygraph.plans import graph_catalog as c
from quarrygraph.sources.star import star_graph

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def g(spark):
    """The star graph with names, evidence and relations that are null or empty here and there."""
    g = star_graph(spark, DATA)
    sometimes = lambda name, n: F.when(F.xxhash64("id") % n != 0, F.col(name))
    facts = g.facts.withColumns({"evidence_text": F.when(F.xxhash64("id") % 11 == 0, "").otherwise(sometimes("evidence_text", 7)), "relation_type": sometimes("relation_type", 5)})
    return replace(g, facts=facts, entities=g.entities.withColumn("name", sometimes("name", 6)), concepts=g.concepts.withColumn("name", sometimes("name", 9)))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return [str(tuple(r)) for r in df.collect()]


def wide_signals(g, category, signal):
    own = F.lower(F.concat_ws("\x01", "source", "target", "evidence", "relation"))
    concepts = F.lower(F.concat_ws("\x01", F.concat_ws("\x01", "source_concepts"), F.concat_ws("\x01", "target_concepts")))
    found = q._agent_rows(g).filter("company is not null").filter(contains_any(own, category) | contains_any(concepts, category)).filter(contains_any(own, signal))
    w = Window.partitionBy("company").orderBy(desc(F.coalesce("confidence", F.lit(0.0))), asc("fact_id"))
    return found.withColumn("rank", F.row_number().over(w)).filter("rank <= 2").orderBy("company", "rank").limit(50).drop("rank")


def same_signals(g, *terms):
    got, want = q.category_signals(g, *terms), wide_signals(g, *terms)
    assert got.columns == want.columns and "l_orderkey" not in plan(got)
    assert rows(want) == rows(got) == rows(q.category_signals(g, *terms, limit=q.COUNT_CAP + 1))[:50] and rows(got)


def test_product_map(g):
    same_signals(g, c.PRODUCT, c.PRODUCT_SIGNAL)


def test_positive_demand(g):
    same_signals(g, c.CATEGORY, c.DEMAND)


def test_risks(g):
    same_signals(g, c.RISK_CATEGORY, c.RISK)


@pytest.mark.parametrize("terms", [(c.CATEGORY, c.DEMAND), (c.RISK_CATEGORY, c.RISK)])
def test_facts_meet_flags_without_a_shuffle(spark, g, terms, monkeypatch):
    placed, seen = q._placed, []
    monkeypatch.setattr(q, "_placed", lambda of, facts, **a: seen.append(facts) or placed(of, facts, **a))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = rows(q.category_signals(g, *terms))
        assert "Exchange hashpartitioning" not in plan(seen[0]) and "SortMergeJoin" not in plan(seen[0])
        monkeypatch.setattr(m, "MOST_BYTES", 0)  # too many blocks: facts are shuffled
        assert rows(q.category_signals(g, *terms)) == got != []
        assert "SortMergeJoin" in plan(seen[1])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_marks_by_blocks(spark):
    ids = [0, 1, 63, 64, 127, -1, -64, -65, 1 << 62, -(1 << 63), (1 << 63) - 1]
    marks = spark.createDataFrame([(x, i % 8) for i, x in enumerate(ids)] + [(None, 7)], "id long, hits long")
    ends = [*ids, 2, 62, 65, -2, None]
    facts = spark.createDataFrame([(x, y, 8) for x in ends for y in ends], "from_id long, to_id long, _hits long")
    hits = dict(marks.collect())
    want = sorted((x, y, 8 | hits[x] | hits[y]) for x in ids for y in ids)
    blocks = m.packed(marks, 3)
    assert blocks.count() == 7 and sorted(map(tuple, m.at_ends(facts, blocks, 3).select("from_id", "to_id", "_hits").collect())) == want
    assert m.packed(marks.unionByName(marks.limit(1)), 3) is None
    assert m.packed(marks.limit(0), 3).count() == 0


@pytest.mark.parametrize("terms", [c.TERMS, ["Ring", "ring", "PRESSURES"], ["ring", *(f"no such {i}" for i in range(70))]])
def test_cli_search(g, terms):
    text = F.concat_ws("\x01", F.lower("source"), F.lower("target"), F.lower("evidence_text"), F.lower("relation_type"))
    want = q._rows(g).withColumn("matched_terms", q._found(text, [t.lower() for t in terms])).filter(F.size("matched_terms") > 0)
    want = q._shaped(want, "matched_terms", "source_url").orderBy(*q._search_order()).limit(60)
    got = q.cli_relations(g, terms, 60)
    assert got.columns == want.columns and rows(got) == rows(want) and len(rows(got)) == 60
    if len(terms) <= q.MOST_TERMS:
        assert "l_orderkey" not in plan(got)


def test_cli_search_without_terms(g):
    got = q.cli_relations(g, [], 60)
    want = q._shaped(q._rows(g).withColumn("matched_terms", F.array().cast("array<string>")), "matched_terms", "source_url").orderBy(*q._search_order()).limit(60)
    assert rows(got) == rows(want)


def test_connected_nodes_look_rows_up_at_chosen_nodes(g, monkeypatch):
    searched, seen = q._searched, []
    monkeypatch.setattr(q, "_searched", lambda of, *a, **b: seen.append((of.facts, b.get("names", False))) or searched(of, *a, **b))
    got = q.connected_nodes(g, c.TERMS, 200, nodes_per_company=1)
    assert [names for _, names in seen] == [False, True]
    assert 0 < seen[1][0].select("id").distinct().count() < seen[0][0].count()
    twice = q.connected_nodes(replace(g, facts=g.facts.unionByName(g.facts)), c.TERMS, 200, nodes_per_company=1)
    counts = ["company", "focus_node_id", "node_degree", "evidence_count"]
    assert rows(got.select(*counts).distinct().orderBy(*counts)) == rows(twice.select(*counts).distinct().orderBy(*counts)) != []
