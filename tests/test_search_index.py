"""Searches by postings find what a full scan finds, and read candidates only."""

import os
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from quarrygraph.operators import graph_queries as q
from quarrygraph.operators import marks as m
from quarrygraph.operators import search_index as s
from quarrygraph.sources.star import Graph, star_graph

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    g, path = star_graph(spark, DATA), str(tmp_path_factory.mktemp("postings") / "i")
    assert s.version(spark, path) is None
    s.build(g, path, 7)
    assert s.version(spark, path) == 7
    return g, path


def rows(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


@pytest.mark.parametrize("terms", [["ring", "brand 7"], ["pressures"], ["zzz"], ["7"], ["open demand", "no such"], ["size 1"], []])
def test_counts_are_those_of_a_scan(indexed, terms):
    g, path = indexed
    assert rows(s.relation_count_indexed(g, path, terms)) == rows(q.relation_count(g, terms))


def test_rows_are_those_of_a_scan(indexed):
    g, path = indexed
    terms = ["supplier#000000003", "brand 7"]
    assert rows(s.relation_search_indexed(g, path, terms, 40)) == rows(q.relation_search(g, terms, 40))
    assert rows(s.connected_nodes_indexed(g, path, terms, 40)) == rows(q.connected_nodes(g, terms, 40))
    assert rows(s.balanced_search_indexed(g, path, terms, 40)) == rows(q.balanced_relation_search(g, terms, 40))


def test_a_rare_term_reads_few_facts(spark, indexed):
    g, path = indexed
    name = g.entities.filter("entity_type = 'BusinessSegment'").orderBy("id").select("name").first()["name"].lower()
    few = s.narrowed(g, path, [name])
    assert 0 < few.facts.count() < 0.5 * g.facts.count() and few.entities.count() < g.entities.count()
    assert s.narrowed(g, path, ["zzz"]).facts.count() == 0


def test_trigrams_are_listed_once_a_text(spark, indexed, tmp_path):
    g, path = indexed
    assert spark.read.parquet(f"{path}/evidence").count() < 0.5 * g.facts.count()
    assert spark.read.parquet(f"{path}/facts").count() == g.facts.count()
    s.write_text(spark, f"{tmp_path}/index.json", '{"version": 7}')  # of postings as they once were
    assert s.version(spark, str(tmp_path)) is None


def test_odd_texts(spark, tmp_path):
    frames = {f: spark.createDataFrame([], "id long") for f in Graph.__dataclass_fields__}
    frames["entities"] = spark.createDataFrame([(1, "Ab", None, None), (2, None, None, "ÉTÉ chaud"), (3, "", None, None)], "id long, name string, value string, context string").withColumn("canonical_name", F.col("name"))
    frames["facts"] = spark.createDataFrame([("f", 1, 2, "IS_LIKE", None), ("g", 2, 3, None, "an été"), ("h", 3, 3, "X", "")], "id string, from_id long, to_id long, relation_type string, evidence_text string")
    frames["concepts"] = spark.createDataFrame([], "id long, name string, description string")
    frames["maps_to"] = spark.createDataFrame([], "entity_id long, concept_id long")
    g, path = Graph(**frames), str(tmp_path / "i")
    s.build(g, path)
    for terms, found in ((["été"], {"f", "g"}), (["ab"], {"f"}), (["s_lik"], {"f"}), (["x"], {"h"}), (["été chaud", "n ét"], {"f", "g"})):
        assert {r["id"] for r in s.narrowed(g, path, terms).facts.collect()} == found
        assert {r["id"] for r in q._searched(s.narrowed(g, path, terms), terms).collect()} == {r["id"] for r in q._searched(g, terms).collect()} == found


@pytest.mark.parametrize("terms", [["supplier#000000003", "brand 7"], ["7"]])
def test_many_candidates_and_those_not_told_to_tasks(indexed, terms, monkeypatch):
    g, path = indexed
    few, counted, found = s.narrowed(g, path, terms), rows(s.relation_count_indexed(g, path, terms)), rows(s.relation_search_indexed(g, path, terms, 40))
    monkeypatch.setattr(s, "FEW", -1)
    many = s.narrowed(g, path, terms)
    assert many.entities is g.entities and rows(many.facts.select("id")) == rows(few.facts.select("id"))
    assert rows(s.relation_count_indexed(g, path, terms)) == counted and rows(s.relation_search_indexed(g, path, terms, 40)) == found
    monkeypatch.setattr(m, "MOST_BYTES", -1)
    assert s.narrowed(g, path, terms) is g and rows(s.relation_search_indexed(g, path, terms, 40)) == found == rows(q.relation_search(g, terms, 40))


def test_entities_are_listed_once_a_block(spark, indexed):
    g, path = indexed
    each = q.entity_texts(g).select(F.explode(s.grams(F.col("text"))).alias("gram"), "id")
    lists = spark.read.parquet(f"{path}/entities")
    told = lists.select("gram", F.explode(F.filter(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(F.getbit("bits", i) == 1, F.col("block") * 64 + i)), lambda x: x.isNotNull())).alias("id"))
    assert rows(told) == rows(each) and lists.count() < 0.3 * each.count()


def test_sparse_and_repeated_ids(spark, indexed, tmp_path):
    g, _ = indexed
    far = lambda c: F.xxhash64(F.col(c)).alias(c)
    apart = replace(
        g, entities=g.entities.withColumn("id", far("id")), maps_to=g.maps_to.withColumn("entity_id", far("entity_id")), facts=g.facts.withColumns({"from_id": far("from_id"), "to_id": far("to_id")})
    )
    twice = replace(g, entities=g.entities.unionByName(g.entities.filter("id % 4 = 1")))
    for odd, path in ((apart, str(tmp_path / "apart")), (twice, str(tmp_path / "twice"))):
        s.build(odd, path)
        terms = ["supplier#000000003", "brand 7"]
        want = q._widened(odd, q._placed(odd, q._searched(odd, terms, names=True)).orderBy(*q._search_order()).limit(40))
        assert rows(s.relation_search_indexed(odd, path, terms, 40)) == rows(want) and rows(want)
        assert rows(s.relation_count_indexed(odd, path, terms)) == rows(q.relation_count(odd, terms))


def test_only_the_foremost_facts_are_placed(spark, indexed, monkeypatch):
    g, path = indexed
    unsure = replace(g, facts=g.facts.withColumn("conf100", F.when(F.xxhash64("id") % 3 != 0, F.col("conf100"))))
    terms = ["ring", "brand 7", "open demand", "pressures"]
    whole = q._placed(unsure, q._searched(unsure, terms, names=True))
    placed, seen = q._placed, []
    monkeypatch.setattr(q, "_placed", lambda of, facts, **a: seen.append(facts) or placed(of, facts, **a))
    for limit in (7, q.COUNT_CAP):
        want = q._widened(unsure, whole.orderBy(*q._search_order()).limit(limit)).orderBy(*q._search_order())
        got = q.relation_search(unsure, terms, limit)
        assert [str(tuple(r)) for r in got.collect()] == [str(tuple(r)) for r in want.collect()] != []
    assert seen[0].count() < 0.2 * whole.count() and seen[-1].count() == whole.count() <= q.COUNT_CAP
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert "SortMergeJoin" not in q._searched_in_place(g, terms)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
