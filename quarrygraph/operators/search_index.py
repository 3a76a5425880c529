"""Trigram posting lists for searches by substring: what can't match is not read.

A text that contains a term contains all of its trigrams.  Postings name, for each
trigram, the entities (as bits of blocks of ids) and the distinct evidence texts that have it; ``facts`` has the
ends and the evidence of each fact.  The rarest trigrams of a term are looked up and
intersected; facts at what is left, or that say it, are candidates, which the search itself then verifies, so its rows are those
of a full scan.  Lists are sorted by trigram, so a lookup reads few row groups.

Terms of fewer than three characters have no trigram: they are looked for in all texts.
"""

from __future__ import annotations

import json
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.star import Graph
from ..sources.storage import delete, read_text, scratch, stored, write_text
from .graph_queries import balanced_relation_search, connected_nodes, entity_texts, relation_count, relation_search
from .marks import bit, block, fits, place

GRAM = 3
#: How postings are laid out; others don't count.
FORM = 3
#: Trigrams of a term that are looked up, the rarest first; the others are left to the check.
LOOKED_UP = 3
#: Candidates are stored up to so many; more of them are picked out of the facts wherever a search reads those.
FEW = 1_000_000


def grams(text: Column) -> Column:
    """The distinct trigrams of a lower-case text."""
    n = F.greatest(F.length(text) - GRAM + 1, F.lit(0))
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))


def _key(*columns: str) -> Column:
    """Postings name texts by a hash: two of the same hash add a candidate, which the search checks like any other."""
    return F.xxhash64(*columns)


def _sorted(rows: DataFrame, path: str) -> None:
    """Rows (gram, id) in the order of both."""
    stored(rows.repartitionByRange("gram", "id").sortWithinPartitions("gram", "id"), path)


def _listed(texts: DataFrame, path: str) -> None:
    """Postings of texts (id, text), and how many each trigram has."""
    _sorted(texts.select(F.explode(grams(F.col("text"))).alias("gram"), "id"), path)
    texts.sparkSession.read.parquet(path).groupBy("gram").count().write.parquet(f"{path}-counts")


#: What a fact says, as texts of its own: evidence in lower case, and the relation.
SAID = {"text": "lower(coalesce(evidence_text, ''))", "relation": "coalesce(relation_type, '')"}


def _said(facts: DataFrame) -> DataFrame:
    return facts.select(*[F.expr(x).alias(c) for c, x in SAID.items()])


def _keyed(facts: DataFrame) -> DataFrame:
    """Facts with the key of what they say, as ``gram``."""
    return facts.withColumn("gram", F.xxhash64(*map(F.expr, SAID.values())))


def _blocks(texts: DataFrame, path: str) -> None:
    """Postings of texts (id, text) by blocks of ids, and how many ids each trigram has.

    Texts of one block are brought together first, so that a trigram has one row a block, and no row of a trigram is moved.
    """
    own = texts.filter("id is not null").select(block("id").alias("block"), bit(place("id")).alias("bits"), "text").repartition("block")
    rows = own.select(F.explode(grams(F.col("text"))).alias("gram"), "block", "bits").groupBy("gram", "block").agg(F.bit_or("bits").alias("bits"))
    lists = stored(rows.sortWithinPartitions("gram", "block"), path)
    lists.groupBy("gram").agg(F.sum(F.bit_count("bits").cast("long")).alias("count")).write.parquet(f"{path}-counts")


def build(g: Graph, path: str, version: int = 0) -> None:
    """The postings of a graph, in place of what is at ``path``; they count once their note is written, with the graph's ``version``.

    Trigrams are listed once a distinct evidence and once a block of entities; ``facts`` is written where its rows are read.
    """
    spark = g.facts.sparkSession
    delete(spark, path)
    _blocks(entity_texts(g), f"{path}/entities")
    texts = stored(_said(g.facts).select("text", "relation").distinct(), f"{path}/texts")
    _listed(texts.select("text").distinct().select(_key("text").alias("id"), "text"), f"{path}/evidence")
    stored(_keyed(g.facts).select("gram", "from_id", "to_id").sortWithinPartitions("gram"), f"{path}/facts")
    write_text(spark, f"{path}/index.json", json.dumps({"version": version, "form": FORM}))


def version(spark: SparkSession, path: str) -> int | None:
    """The graph's version that the postings are of; None if there are none of this form."""
    note = json.loads(read_text(spark, f"{path}/index.json") or "{}")
    return note["version"] if note.get("form") == FORM else None


def _rarest(spark: SparkSession, path: str, term: str) -> list[str]:
    """The trigrams of a term that are looked up; none if one of them is in no text."""
    wanted = sorted({term[i : i + GRAM] for i in range(len(term) - GRAM + 1)})
    known = {r["gram"]: r["count"] for r in spark.read.parquet(f"{path}-counts").filter(F.col("gram").isin(wanted)).collect()}  # no more than the term is long
    return sorted(wanted, key=lambda x: (known[x], x))[:LOOKED_UP] if len(known) == len(wanted) else []


def _matching(spark: SparkSession, path: str, texts: DataFrame, term: str) -> DataFrame:
    """Ids of texts (id, text) that may contain a term."""
    if len(term) < GRAM:
        return texts.filter(F.col("text").contains(term)).select("id")
    chosen = _rarest(spark, path, term)
    lists = spark.read.parquet(path).filter(F.col("gram").isin(chosen))
    return lists.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(chosen)).select("id")


def _matching_blocks(spark: SparkSession, path: str, texts: DataFrame, term: str) -> DataFrame:
    """The same as (block, bits) of ids, by postings of blocks."""
    if len(term) < GRAM:
        return texts.filter(F.col("text").contains(term) & F.col("id").isNotNull()).groupBy(block("id").alias("block")).agg(F.bit_or(bit(place("id"))).alias("bits"))
    chosen = _rarest(spark, path, term)
    lists = spark.read.parquet(path).filter(F.col("gram").isin(chosen))
    return lists.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.bit_and("bits").alias("bits")).filter((F.col("n") == len(chosen)) & (F.col("bits") != 0)).select("block", "bits")


def _met(facts: DataFrame, ends: DataFrame, said: DataFrame) -> DataFrame:
    """Facts (gram, from_id, to_id, ...) that start or end in ``ends`` (block, bits) or say one of ``said`` (gram)."""
    hit, columns = F.lit(False), facts.columns
    for i, end in enumerate(("from_id", "to_id")):
        facts = facts.join(F.broadcast(ends.select(F.col("block").alias(f"_b{i}"), F.col("bits").alias(f"_in{i}"))), block(end) == F.col(f"_b{i}"), "left")
        hit = hit | (F.coalesce(F.getbit(f"_in{i}", place(end)), F.lit(0)) == 1)
    facts = facts.join(F.broadcast(said.select(F.col("gram").alias("_said"))), F.col("gram") == F.col("_said"), "left")
    return facts.filter(hit | F.col("_said").isNotNull()).select(*columns)


def narrowed(g: Graph, path: str, terms: list[str]) -> Graph:
    """The graph with those facts only that a search for ``terms`` may find, and with their entities; no terms find all.

    Many facts come with all entities.  Where what matches is too much to be broadcast, nothing is left out.
    """
    spark = g.facts.sparkSession
    terms = list(dict.fromkeys(t.lower() for t in terms))
    if not terms:
        return g
    texts = spark.read.parquet(f"{path}/texts").withColumn("id", _key("text"))
    entities, says = [], []
    # a mark stands between evidence and relation in what is searched, so no term runs from one into the other
    for t in terms:
        entities.append(_matching_blocks(spark, f"{path}/entities", entity_texts(g), t))
        says.append(texts.join(_matching(spark, f"{path}/evidence", texts.select("id", "text").distinct(), t), "id", "left_semi").select(_key("text", "relation").alias("gram")))
        says.append(texts.filter(F.lower("relation").contains(t)).select(_key("text", "relation").alias("gram")))
    ends = stored(reduce(DataFrame.unionByName, entities).groupBy("block").agg(F.bit_or("bits").alias("bits")))
    said = stored(reduce(DataFrame.unionByName, says).distinct())
    if not (fits(ends.count(), 2) and fits(said.count(), 1)):
        return g
    facts = _met(_keyed(g.facts), ends, said).drop("gram")
    if _met(spark.read.parquet(f"{path}/facts"), ends, said).count() > FEW:
        return replace(g, facts=facts)
    facts = stored(facts, scratch(spark, "candidates"))
    near = facts.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
    return replace(g, facts=facts, entities=g.entities.join(near, "id", "left_semi"))


def relation_search_indexed(g: Graph, path: str, terms: list[str], limit: int = 50, ticker: str = "") -> DataFrame:
    return relation_search(narrowed(g, path, terms), terms, limit, ticker)


def balanced_search_indexed(g: Graph, path: str, terms: list[str], limit: int = 50) -> DataFrame:
    return balanced_relation_search(narrowed(g, path, terms), terms, limit)


def relation_count_indexed(g: Graph, path: str, terms: list[str], ticker: str = "") -> DataFrame:
    return relation_count(narrowed(g, path, terms), terms, ticker)


def connected_nodes_indexed(g: Graph, path: str, terms: list[str], limit: int = 60) -> DataFrame:
    return connected_nodes(narrowed(g, path, terms), terms, limit)
