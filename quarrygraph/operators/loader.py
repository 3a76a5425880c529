"""Loading: extracted rows become graph tables, idempotently.

Each upsert is one aggregation: the last writer of a key wins, by load order.
Nothing is written row by row, and a rerun of the same load changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import fiscal_year, preview, quarter_number, slug

PRIMARY_KEYS = {
    "company": "id", "sector": "name", "earnings_call": "id", "quarter": "name", "fiscal_period": "id", "source_document": "id",
    "extraction_run": "id", "chunk": "id", "entity": "id", "relation_fact": "id", "ontology_concept": "id", "business_segment": "id",
}


def upsert(old: DataFrame | None, new: DataFrame, key: str, order: str) -> DataFrame:
    """``new`` over ``old``: one row a key, the one with the greatest ``order``; equal orders break ties by value."""
    rows = new if old is None else old.unionByName(new, allowMissingColumns=True)
    rest = [c for c in rows.columns if c != key]
    last = F.max(F.struct(F.col(order), *[c for c in rest if c != order]))
    return rows.groupBy(key).agg(last.alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def merge_properties(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, properties): maps merged in load order, so that later values win and other keys stay."""
    entries = rows.select(key, order, F.explode("properties").alias("name", "value"))
    last = entries.groupBy(key, "name").agg(F.max_by("value", order).alias("value"))
    return last.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("properties"))


def document_tables(docs: DataFrame, order: str = "load_seq") -> dict[str, DataFrame]:
    """Company, sector, call, quarter, period and document tables of loaded documents.

    ``docs``: id, title, company_id, company_name, ticker, sector, fiscal_quarter,
    call_id, call_date, source_url, source_kind, markdown_path and ``order``.
    """
    sector = F.when(F.coalesce("sector", F.lit("")) == "", "Unknown").otherwise(F.col("sector"))
    label = F.col("fiscal_quarter")
    number = quarter_number(label)
    quarter = F.when(number.isNotNull(), F.concat(F.lit("Q"), number.cast("string"))).otherwise("")
    companies = docs.select(F.col("company_id").alias("id"), F.col("company_name").alias("name"), "ticker", sector.alias("sector"), order)
    calls = docs.select(F.col("call_id").alias("id"), "company_id", "fiscal_quarter", "call_date", "source_url", "source_kind", order)
    return {
        "company": upsert(None, companies, "id", order),
        "sector": docs.select(sector.alias("name")).distinct(),
        "earnings_call": upsert(None, calls, "id", order),
        "quarter": docs.select(quarter.alias("name"), number.alias("number")).distinct(),
        "fiscal_period": docs.select(slug(label).alias("id"), label.alias("label"), fiscal_year(label).alias("fiscal_year"), quarter.alias("quarter")).dropDuplicates(["id"]),
        "source_document": upsert(None, docs.select("id", "company_id", "call_id", "title", "source_url", "source_kind", "markdown_path", order), "id", order),
    }


def entity_table(rows: DataFrame, order: str = "load_seq") -> DataFrame:
    """Entities: scalars from the last load, properties merged; value and context are promoted."""
    scalars = upsert(None, rows.select("id", "name", "entity_type", "source", order), "id", order)
    out = scalars.join(merge_properties(rows, "id", order), "id", "left")
    return out.withColumns({"canonical_name": F.col("name"), "aliases": F.array().cast("array<string>"), "value": F.col("properties")["value"], "context": F.col("properties")["context"]})


def chunk_table(rows: DataFrame, order: str = "load_seq") -> DataFrame:
    return upsert(None, rows.withColumns({"text_preview": preview(F.col("text")), "text_hash": F.sha1("text"), "heading_path": F.array("heading")}), "id", order)


def fact_id(raw: Column) -> Column:
    return F.when(raw.startswith("fact-"), raw).otherwise(F.concat(F.lit("fact-"), raw))


def relation_tables(rows: DataFrame, entities: DataFrame, chunks: DataFrame, order: str = "load_seq") -> dict[str, DataFrame]:
    """Facts, their projection and their support.

    A fact needs both of its entities, else it is dropped; its chunk is chunk_id,
    else scope_id, if either is a chunk.  RELATED_TO keeps one edge for each
    (from, type, to) with the last confidence; MENTIONS_ENTITY is a set.
    """
    f = rows.withColumn("id", fact_id(F.col("id")))
    ids = entities.select("id")
    f = f.join(ids.withColumnRenamed("id", "source_entity_id"), "source_entity_id", "left_semi").join(ids.withColumnRenamed("id", "target_entity_id"), "target_entity_id", "left_semi")
    c = chunks.select("id")
    for name in ("chunk_id", "scope_id"):
        f = f.join(c.select(F.col("id").alias(f"_{name}")), F.col(name) == F.col(f"_{name}"), "left")
    f = f.withColumn("support", F.coalesce("_chunk_id", "_scope_id")).drop("_chunk_id", "_scope_id")
    layer = ["layer"] if "layer" in f.columns else []
    facts = upsert(None, f.select("id", "source_entity_id", "relation_type", "target_entity_id", "evidence_text", "confidence", "support", *layer, order), "id", order)
    related = f.groupBy("source_entity_id", "relation_type", "target_entity_id").agg(F.max_by("confidence", F.struct(order, "id")).alias("latest_confidence"))
    mentions = f.filter("support is not null").select(F.col("support").alias("chunk_id"), F.explode(F.array("source_entity_id", "target_entity_id")).alias("entity_id")).distinct()
    return {"relation_fact": facts, "related_to": related, "mentions_entity": mentions}


def schema_edges(edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """The vocabulary's edges: dangling ones go, types become safe upper-case names."""
    ids = concepts.select("id")
    e = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    kind = F.regexp_replace(F.upper("relation_type"), "[^A-Z0-9_]+", "_")
    return e.select("source_id", F.when(kind == "", "RELATED_TO").otherwise(kind).alias("relation_type"), "target_id", "description").distinct()


def violations(table: DataFrame, key: str) -> DataFrame:
    """Keys that are null or stand more than once; empty if the constraint holds."""
    return table.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | F.col(key).isNull())


def only_new(found: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What isn't there yet: the rows whose key has no output."""
    return found.join(done.select(key), key, "left_anti")


def extraction_runs(graphs: DataFrame, extractor: str = "quarrygraph") -> DataFrame:
    """One run a loaded document, with how much it gave."""
    n = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    return graphs.select(
        F.concat(F.col("document.id"), F.lit("-extraction-run")).alias("id"), F.col("document.id").alias("document_id"), F.lit(extractor).alias("extractor"),
        n("entities").alias("entity_count"), n("relations").alias("relation_count"), n("chunks").alias("chunk_count"), "load_seq",
    )


def keeping(old: DataFrame | None, new: DataFrame, key: str, keep: tuple[str, ...]) -> DataFrame:
    """``new`` rows whose columns in ``keep`` hold on to the old row's value where they have none."""
    if old is None:
        return new
    before = old.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in keep])
    return new.join(before, new[key] == before["_key"], "left").withColumns({c: F.coalesce(c, f"_{c}") for c in keep}).drop("_key", *[f"_{c}" for c in keep])


def require_keys(tables: dict[str, DataFrame], key: str = "id") -> None:
    """An error that names the tables with null or repeated keys."""
    bad = [name for name, df in tables.items() if not violations(df, key).isEmpty()]
    if bad:
        raise ValueError(f"keys are null or repeated in {', '.join(bad)}")
