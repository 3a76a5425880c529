"""The evidence graph as lazy tables, and one built from the driver's star schema.

A graph is a star schema, too: relation facts refer to two entities and to the
chunk that supports them; chunks refer to documents, documents to companies.
Keys are long integers; texts are made at the edge.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window


@dataclass(frozen=True)
class Graph:
    """Lazy tables; a query reads those that it names, and of them the columns that it uses."""

    companies: DataFrame  # id, name, ticker, sector
    documents: DataFrame  # id, title, source_url, company_id
    calls: DataFrame  # id, company_id, fiscal_quarter, call_date
    chunks: DataFrame  # id, document_id, call_id, heading, text, text_preview
    entities: DataFrame  # id, name, canonical_name, entity_type, value, context
    facts: DataFrame  # id, from_id, to_id, relation_type, layer, conf100, evidence_text, chunk_id
    concepts: DataFrame  # id, name, concept_type, description
    maps_to: DataFrame  # entity_id, concept_id, conf100
    schema_edges: DataFrame  # source_id, relation_type, target_id

    def evidence(self) -> DataFrame:
        """Chunks with their document and company, all or nothing."""
        chunks = self.chunks.select(F.col("id").alias("chunk_id"), "document_id", "text_preview", F.col("text").alias("chunk_text"))
        docs = self.documents.select(F.col("id").alias("document_id"), "title", "source_url", "company_id")
        companies = self.companies.select(F.col("id").alias("company_id"), F.col("name").alias("company"), "ticker")
        return chunks.join(docs, "document_id").join(companies, "company_id")

    def mentions(self) -> DataFrame:
        """(chunk_id, entity_id): both ends of every supported fact, once."""
        return self.facts.filter("chunk_id is not null").select("chunk_id", F.explode(F.array("from_id", "to_id")).alias("entity_id")).distinct()


ENTITY_TYPES = {"ECONOMY": "Theme", "MEDIUM": "Metric", "STANDARD": "Product", "SMALL": "Risk", "LARGE": "MetricValue", "PROMO": "BusinessOutcome"}
RELATION_TYPES = {"A": "DRIVES", "N": "PRESSURES", "R": "DISCUSSES"}


def star_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The conformance graph over the TPC-H-like tables (survey section 7.2)."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    nation, region, customer, orders = read("nation"), read("region"), read("customer"), read("orders")
    part, supplier, lineitem = read("part"), read("supplier"), read("lineitem")
    companies = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("T"), "n_nationkey").alias("ticker"), F.col("r_name").alias("sector")
    )
    documents = customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.concat(F.lit("https://filings.example/"), "c_custkey").alias("source_url"), F.col("c_nationkey").cast("long").alias("company_id"))
    year, quarter = F.year("o_orderdate"), F.quarter("o_orderdate")
    dated = orders.join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    calls = dated.select(F.col("c_nationkey").cast("long").alias("company_id"), year.alias("y"), quarter.alias("q")).distinct()
    calls = calls.select((F.col("company_id") * 100000 + F.col("y") * 10 + F.col("q")).alias("id"), "company_id", F.concat(F.lit("FY"), "y", F.lit(" Q"), "q").alias("fiscal_quarter"), F.concat("y", F.lit("-"), F.lpad((F.col("q") * 3).cast("string"), 2, "0"), F.lit("-01")).alias("call_date"))
    text = F.concat(F.lit("Order "), "o_orderkey", F.lit(" priority "), "o_orderpriority", F.lit(" status "), "o_orderstatus", F.lit(" on "), F.date_format("o_orderdate", "yyyy-MM-dd"))
    chunks = orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("document_id"), F.col("o_orderpriority").alias("heading"), text.alias("text"), F.substring(text, 1, 360).alias("text_preview"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    kind = F.create_map(*[F.lit(x) for pair in ENTITY_TYPES.items() for x in pair])[F.col("p_type")]
    parts = part.select(
        (F.col("p_partkey") * 2).alias("id"), F.col("p_name").alias("name"), F.concat("p_name", F.lit(" "), "p_partkey").alias("canonical_name"), kind.alias("entity_type"),
        F.when(F.col("p_type") == "LARGE", F.concat(F.lit("size "), "p_size")).alias("value"), F.when(F.col("p_type") == "SMALL", F.concat(F.lit("context "), "p_brand")).alias("context"),
    )
    suppliers = supplier.select(
        (F.col("s_suppkey") * 2 + 1).alias("id"), F.col("s_name").alias("name"), F.lower("s_name").alias("canonical_name"),
        F.when(F.col("s_suppkey") % 10 == 0, "Company").otherwise("BusinessSegment").alias("entity_type"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("context"),
    )
    relation = F.create_map(*[F.lit(x) for pair in RELATION_TYPES.items() for x in pair])[F.col("l_returnflag")]
    facts = lineitem.select(
        F.concat_ws("-", F.lit("fact"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        (F.col("l_partkey") * 2).alias("from_id"), (F.col("l_suppkey") * 2 + 1).alias("to_id"), relation.alias("relation_type"),
        F.when(F.col("l_linestatus") == "O", "insight").alias("layer"),
        F.when(F.col("l_tax") != 0, 100 - F.round(F.col("l_discount") * 100).cast("long")).alias("conf100"),
        F.concat(F.when(F.col("l_linestatus") == "O", "open demand").otherwise("filled supply"), F.lit(" of "), F.col("l_quantity").cast("int")).alias("evidence_text"),
        F.when(F.col("l_quantity") <= 45, F.col("l_orderkey")).alias("chunk_id"),
    )
    brand = F.regexp_extract("p_brand", "#([0-9]+)", 1).cast("long")
    brands = part.select(brand.alias("n")).distinct()
    regions = region.select(F.col("r_regionkey").cast("long").alias("n"), "r_name")
    concept = lambda i, name, kind, text: [i.alias("id"), name.alias("name"), F.lit(kind).alias("concept_type"), text.alias("description")]
    concepts = (
        brands.select(*concept(F.col("n"), F.concat(F.lit("Brand "), "n"), "Brand", F.concat(F.lit("goods of brand "), "n")))
        .unionByName(brands.select((F.col("n") % 5).alias("n")).distinct().select(*concept(F.col("n") + 1000, F.concat(F.lit("Family "), "n"), "Family", F.concat(F.lit("brand family "), "n"))))
        .unionByName(regions.select(*concept(F.col("n") + 2000, F.col("r_name"), "Region", F.concat(F.lit("suppliers in "), "r_name"))))
        .unionByName(region.limit(1).select(*concept(F.lit(3000).cast("long"), F.lit("Business domain"), "Root", F.lit("root of the tree"))))
    )
    maps_to = part.select((F.col("p_partkey") * 2).alias("entity_id"), brand.alias("concept_id"), F.lit(100).alias("conf100")).unionByName(
        supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select((F.col("s_suppkey") * 2 + 1).alias("entity_id"), (F.col("n_regionkey") + 2000).cast("long").alias("concept_id"), F.lit(88).alias("conf100"))
    )
    edge = lambda s, kind, t: [s.cast("long").alias("source_id"), F.lit(kind).alias("relation_type"), t.cast("long").alias("target_id")]
    schema_edges = (
        brands.select(*edge(F.col("n"), "IS_A", F.col("n") % 5 + 1000))
        .unionByName(brands.select((F.col("n") % 5).alias("n")).distinct().select(*edge(F.col("n") + 1000, "IS_A", F.lit(3000))))
        .unionByName(regions.select(*edge(F.col("n") + 2000, "PART_OF", F.lit(3000))))
        .unionByName(regions.select(*edge(F.col("n") + 1000, "DRIVES_SCHEMA", F.col("n") + 2000)))
    )
    return Graph(companies, documents, calls, chunks, parts.unionByName(suppliers), facts, concepts, maps_to, schema_edges)


def with_index(chunks: DataFrame) -> DataFrame:
    """Chunks numbered within their document by day and id."""
    return chunks.withColumn("index", F.row_number().over(Window.partitionBy("document_id").orderBy("day", "id")))
