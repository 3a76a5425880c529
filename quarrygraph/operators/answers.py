"""Deterministic answers over relation rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph_queries import relation_rank, relation_signal
from .payload import unique_chunks


def entity_display(name: Column, value: Column, context: Column) -> Column:
    """The name with its value and context in brackets where it has any."""
    extra = F.concat_ws(", ", F.when(value.isNotNull(), F.concat(F.lit("value="), value)), F.when(context.isNotNull(), F.concat(F.lit("context="), context)))
    return F.when(extra == "", name).otherwise(F.concat(name, F.lit(" ("), extra, F.lit(")")))


def fact_path(concepts: bool = False) -> Column:
    """source -RELATION-> target, each end with its properties and, if asked, its concepts."""
    ends = []
    for side in ("source", "target"):
        end = entity_display(F.coalesce(F.col(side), F.lit("")), F.col(f"{side}_value"), F.col(f"{side}_context"))
        if concepts:
            end = F.when(F.size(f"{side}_concepts") > 0, F.concat(end, F.lit(" ["), F.array_join(f"{side}_concepts", ", "), F.lit("]"))).otherwise(end)
        ends.append(end)
    return F.concat(ends[0], F.lit(" -"), F.col("relation"), F.lit("-> "), ends[1])


def answer(rows: DataFrame, terms: list[str]) -> DataFrame:
    """One row: how many facts, the best paths, the best supporting and risk paths, and the companies.

    ``rows`` is a search result, so what is gathered is bounded by its limit.
    """
    ranked = relation_rank(rows, terms).withColumn("path", fact_path()).withColumn("signal", relation_signal(F.col("relation")))
    key = F.struct("insight_rank", (-F.col("relevance")).alias("r"), "fact_id", "path")
    top = lambda cond: F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.when(cond, key))), 1, 3), lambda s: s["path"]), "; ")
    companies = F.array_join(F.array_sort(F.collect_set("company")), ", ")
    return ranked.agg(F.count(F.lit(1)).alias("facts"), top(F.lit(True)).alias("main_paths"), top(F.col("signal") == "support").alias("bull_case"), top(F.col("signal") == "risk").alias("risk_case"), companies.alias("companies"))


def path_frequency(rows: DataFrame, n: int = 3) -> DataFrame:
    """The commonest source-relation-target paths."""
    return rows.groupBy(fact_path().alias("path")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "path").limit(n)


def metric_values(rows: DataFrame) -> DataFrame:
    """(value): the distinct ends that are metric values, or have a value or a context."""
    ends = F.array(*[
        F.when((F.coalesce(F.col(f"{s}_type"), F.lit("")) == "MetricValue") | F.col(f"{s}_value").isNotNull() | F.col(f"{s}_context").isNotNull(), entity_display(F.col(s), F.col(f"{s}_value"), F.col(f"{s}_context")))
        for s in ("source", "target")
    ])
    return rows.select(F.explode(F.array_compact(ends)).alias("value")).filter("value <> ''").distinct()


def company_breakdown(rows: DataFrame, companies: int = 4, each: int = 2) -> DataFrame:
    """(company, paths): the first paths of the first companies, both by the rows' rank (``insight_rank``, then fact id)."""
    ranked = rows.withColumn("company", F.coalesce("company", F.lit("n/a"))).withColumn("path", fact_path())
    w = Window.partitionBy("company").orderBy("insight_rank", "fact_id")
    top = ranked.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= each)
    out = top.groupBy("company").agg(F.min(F.struct("insight_rank", "fact_id")).alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "path"))), lambda x: x["path"]), ", ").alias("paths"))
    return out.orderBy("first").limit(companies).drop("first")


def cards(rows: DataFrame, limit: int = 12) -> DataFrame:
    """What a card about each fact shows, in the rows' rank."""
    concepts = [F.slice(f"{s}_concepts", 1, 2) for s in ("source", "target")]
    ontology = F.concat_ws(" -> ", *[F.when(F.size(c) > 0, F.array_join(c, ", ")) for c in concepts])
    foot = F.concat_ws(
        " \u00b7 ",
        F.when(F.size("matched_terms") > 0, F.concat(F.lit("matched: "), F.array_join("matched_terms", ", "))),
        F.concat(F.lit("confidence: "), F.col("confidence").cast("string")),
        F.concat(F.lit("chunk: "), F.col("chunk_id").cast("string")),
    )
    company = F.concat_ws(" ", F.when(F.trim("company") != "", F.trim("company")), F.when(F.trim("ticker") != "", F.trim("ticker")))
    top = rows.orderBy("insight_rank", "fact_id").limit(max(0, limit))
    return top.select(
        "fact_id", relation_signal(F.col("relation")).alias("signal"), F.when(company == "", "Unknown company").otherwise(company).alias("company"), fact_path().alias("path"), ontology.alias("ontology"),
        F.trim(F.coalesce(F.when(F.col("evidence") != "", F.col("evidence")), "chunk_preview", F.lit(""))).alias("evidence"), foot.alias("foot"),
    )


def referenced_chunks(rows: DataFrame, limit: int = 8) -> DataFrame:
    """The chunks that ranked rows refer to, each once with its best row; rows without an id count by their text."""
    text = F.coalesce("chunk_text", "chunk_preview")
    known = rows.withColumn("text", F.trim(text)).filter("text <> ''").withColumn("key", F.coalesce(F.col("chunk_id").cast("string"), "text"))
    best = unique_chunks(unique_chunks(known, ["insight_rank", "fact_id"], "key"), ["insight_rank", "fact_id"], "text")
    return best.orderBy("insight_rank", "fact_id").limit(limit).select("company", F.col("document_id").alias("document"), fact_path(True).alias("path"), F.coalesce("evidence", F.lit("")).alias("evidence"), F.col("text").alias("chunk_text"))


def node_explanation(rows: DataFrame, name: str) -> dict[str, str]:
    """Why a node matters, its main connections and its evidence, from its context rows (bounded by their limit)."""
    ranked = relation_rank(rows, []).withColumn("path", fact_path(True)).orderBy("insight_rank", "fact_id")
    got = ranked.select("path", "company", "evidence", "chunk_preview", "source", "target", "source_concepts", "target_concepts").collect()
    if not got:
        return {"why_it_matters": f"{name} has no relations in the graph.", "main_connections": "There are none.", "evidence": "There is none."}
    companies = {r["company"] for r in got if r["company"]}
    concepts = list(dict.fromkeys(c for r in got for side in ("source", "target") if r[side] == name for c in r[f"{side}_concepts"]))
    values = sorted(r["value"] for r in metric_values(rows).collect())
    why = f"{name} has {len(got)} relation facts at {len(companies)} companies."
    for label, found in (("Concepts", concepts[:6]), ("Values", values[:8])):
        why += f" {label}: {', '.join(found)}." if found else ""
    evidence = next((r["evidence"] or r["chunk_preview"] for r in got if r["evidence"] or r["chunk_preview"]), "No text is stored.")
    return {"why_it_matters": why, "main_connections": "; ".join(r["path"] for r in got[:5]), "evidence": evidence}
