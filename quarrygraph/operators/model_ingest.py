"""Extraction by a language model, as DataFrames: prompts out, parsed answers in, entity and relation rows.

A document is first asked for its summary, themes and entities; its chunks are
asked one by one or in batches, or the document is asked as a whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import norm, short_hash, slug
from ..plugins import ask_model
from .text_graph import for_graph

Model = Callable[[str], str]
BATCH = 8
DEFAULT_CONFIDENCE = 0.8
_TASK = "Answer in JSON with entities (name, entity_type, aliases) and relations (source_entity, relation_type, target_entity, scope_id, evidence_text, confidence)."


def _lines(*parts: Column | str) -> Column:
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _labelled(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"{label}: "), F.coalesce(value, F.lit("")))


def _head(*more: Column) -> list[Column]:
    return [_labelled("Company", F.col("company")), _labelled("Period", F.col("quarter")), _labelled("Source", F.col("source_url")), *more]


def document_prompts(docs: DataFrame, seed_themes: list[str] = []) -> DataFrame:  # noqa: B006
    """(document_id, prompt) for a document's summary, themes and entities; ``docs``: document_id, company, quarter, source_url, markdown."""
    task = "Answer in JSON with document_summary, themes and entities (name, entity_type, aliases)."
    return docs.select("document_id", _lines(task, *_head(), _labelled("Known themes", F.lit(", ".join(seed_themes))), F.lit("Document:"), F.col("markdown")).alias("prompt"))


def graph_prompts(docs: DataFrame, seed_themes: list[str] = []) -> DataFrame:  # noqa: B006
    """(document_id, prompt, chunk_ids) for a document's whole graph at once."""
    none = F.array().cast("array<string>").alias("chunk_ids")
    return docs.select("document_id", _lines(_TASK, *_head(), _labelled("Known themes", F.lit(", ".join(seed_themes))), F.lit("Document:"), F.col("markdown")).alias("prompt"), none)


def chunk_prompts(chunks: DataFrame, docs: DataFrame, size: int = BATCH) -> DataFrame:
    """(document_id, prompt, chunk_ids) for batches of ``size`` chunks in order; 1 asks chunk by chunk.

    ``docs``: document_id, company, quarter, source_url and themes (array).  Questions and empty chunks aren't asked.
    """
    order = Window.partitionBy("document_id").orderBy("index")
    rows = for_graph(chunks, llm=True).withColumn("batch", F.floor((F.row_number().over(order) - 1) / max(1, size)))
    one = F.struct("index", "id", _lines(F.concat(F.lit("Chunk "), F.col("id"), F.lit(" ("), F.col("chunk_type"), F.lit(", "), F.coalesce("heading", F.lit("")), F.lit("):")), F.col("text")).alias("text"))
    batches = rows.groupBy("document_id", "batch").agg(F.array_sort(F.collect_list(one)).alias("c"))  # at most ``size`` chunks
    known = batches.join(docs.select("document_id", "company", "quarter", "source_url", "themes"), "document_id")
    text = F.array_join(F.transform("c", lambda x: x["text"]), "\n\n")
    return known.select("document_id", _lines(_TASK, *_head(_labelled("Known themes", F.array_join("themes", ", "))), text).alias("prompt"), F.transform("c", lambda x: x["id"]).alias("chunk_ids"))


def entity_rows(responses: DataFrame) -> DataFrame:
    """(document_id, id, name, entity_type, aliases): an entity is its type and normalised name; ids are global; the first name by order stays."""
    e = responses.select("document_id", F.inline("response.entities")).withColumn("name", F.trim("name")).filter(F.coalesce("name", F.lit("")) != "")
    e = e.withColumn("entity_type", F.when(F.coalesce("entity_type", F.lit("")) == "", "BusinessTerm").otherwise(F.col("entity_type")))
    none = F.array().cast("array<string>")
    e = e.groupBy("document_id", "entity_type", norm(F.col("name")).alias("n")).agg(F.min("name").alias("name"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("aliases", none))))).alias("aliases"))
    return e.select("document_id", F.concat(F.lit("entity-"), F.lower("entity_type"), F.lit("-"), slug(F.col("name"))).alias("id"), "name", "entity_type", "aliases")


def relation_rows(responses: DataFrame, entities: DataFrame) -> DataFrame:
    """(document_id, id, source_entity_id, relation_type, target_entity_id, scope_id, evidence_text, confidence).

    Ends resolve within their document, by name or alias; a relation with an end that doesn't is dropped.  A scope
    that wasn't asked about gives way to the only chunk of its prompt, else to the document.
    """
    known = entities.select("document_id", "id", F.explode(F.concat(F.array("name"), "aliases")).alias("n")).select("document_id", norm(F.col("n")).alias("n"), "id")
    known = known.groupBy("document_id", "n").agg(F.min("id").alias("id"))
    r = responses.select("document_id", "chunk_ids", F.posexplode("response.relations").alias("pos", "r")).select("document_id", "chunk_ids", "pos", "r.*")
    for side in ("source", "target"):
        r = r.withColumn("n", norm(F.col(f"{side}_entity"))).join(known.withColumnRenamed("id", f"{side}_entity_id"), ["document_id", "n"]).drop("n")
    only = F.when(F.size("chunk_ids") == 1, F.get("chunk_ids", F.lit(0)))
    asked = F.when(F.array_contains("chunk_ids", F.col("scope_id")) | (F.size("chunk_ids") == 0), F.col("scope_id"))
    r = r.withColumns({
        "scope_id": F.coalesce(F.when(asked != "", asked), only, "document_id"),
        "relation_type": F.when(F.coalesce(F.trim("relation_type"), F.lit("")) == "", "RELATED_TO").otherwise(F.trim("relation_type")),
        "confidence": F.coalesce("confidence", F.lit(DEFAULT_CONFIDENCE)),
        "evidence_text": F.coalesce("evidence_text", F.lit("")),
    })
    order = Window.partitionBy("document_id").orderBy(F.coalesce(F.get("chunk_ids", F.lit(0)), F.lit("")), "pos")
    number = F.lpad(F.row_number().over(order).cast("string"), 4, "0")
    ident = F.concat(F.lit("rel-"), number, F.lit("-"), short_hash(F.concat("source_entity_id", "relation_type", "target_entity_id", "scope_id")))
    return r.withColumn("id", ident).select("document_id", "id", "source_entity_id", "relation_type", "target_entity_id", "scope_id", "evidence_text", "confidence")


def extract(docs: DataFrame, chunks: DataFrame, model: Model, mode: str = "batch", seed_themes: list[str] = [], size: int = BATCH) -> dict[str, DataFrame]:  # noqa: B006
    """Entities, relations and summaries of documents; ``mode``: document, chunk or batch.

    An answer that isn't the JSON asked for counts as an empty one; a document without entities gets its company.
    """
    if mode not in ("document", "chunk", "batch"):
        raise ValueError(f"mode must be document, chunk or batch, not {mode!r}")
    if mode == "document":
        first = responses = ask_model(graph_prompts(docs, seed_themes), model)
    else:
        first = ask_model(document_prompts(docs, seed_themes), model)
        seeds = F.array(*map(F.lit, seed_themes)).cast("array<string>")
        found = first.select("document_id", F.array_distinct(F.concat(seeds, F.coalesce("response.themes", seeds))).alias("themes"))
        responses = ask_model(chunk_prompts(chunks, docs.join(found, "document_id", "left"), 1 if mode == "chunk" else size), model)
    answers = responses if mode == "document" else first.select("document_id", "response").unionByName(responses.select("document_id", "response"))
    entities = entity_rows(answers)
    company = docs.join(entities.select("document_id").distinct(), "document_id", "left_anti")
    company = company.select("document_id", F.concat(F.lit("entity-company-"), slug(F.col("company"))).alias("id"), F.col("company").alias("name"), F.lit("Company").alias("entity_type"), F.array().cast("array<string>").alias("aliases"))
    entities = entities.unionByName(company)
    return {"entities": entities, "relations": relation_rows(responses, entities), "summaries": first.select("document_id", F.col("response.document_summary").alias("summary"))}
