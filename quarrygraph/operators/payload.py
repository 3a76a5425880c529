"""Graph payloads: node and edge tables made from relation rows, and their filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.star import Graph
from .graph_queries import balanced_relation_search, relation_search


def payload(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of relation rows: nodes by id (the last row wins), edges by fact id.

    Rows are in order of their fact id.
    """
    ends = [rows.select(F.col(f"{s}_id").alias("id"), F.struct(F.col("fact_id"), F.lit(i).alias("end")).alias("at"), F.col(s).alias("label"), F.col(f"{s}_type").alias("type"), F.col(f"{s}_value").alias("value"), F.col(f"{s}_context").alias("context")) for i, s in enumerate(("source", "target"))]
    both = ends[0].unionByName(ends[1])
    last = both.groupBy("id").agg(F.max_by(F.struct("label", "type", "value", "context"), "at").alias("n"))
    edges = rows.groupBy("fact_id").agg(F.max(F.struct(F.col("source_id").alias("source"), F.col("target_id").alias("target"), F.col("relation").alias("label"), F.col("relation_layer").alias("layer"))).alias("e"))
    return last.select("id", "n.*").orderBy("type", "label", "id"), edges.select(F.col("fact_id").alias("id"), "e.*").orderBy("source", "label", "target", "id")


def graph_payload(g: Graph, terms: list[str], limit: int = 100, ticker: str = "") -> tuple[DataFrame, DataFrame]:
    """The payload of a search: one company's facts with its hub, or facts dealt round-robin over companies."""
    if not ticker:
        return payload(balanced_relation_search(g, terms, limit))
    return company_context(*payload(relation_search(g, terms, limit, ticker)), ticker)


def node_degree(edges: DataFrame, context_layer: str = "company_scope") -> DataFrame:
    """(id, degree): edges at each node, either way; context edges don't count."""
    own = edges.filter(F.coalesce("layer", F.lit("")) != context_layer)
    return own.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def min_degree(nodes: DataFrame, edges: DataFrame, k: int, context_layer: str = "company_scope") -> tuple[DataFrame, DataFrame]:
    """Nodes of degree ``k`` or more, the edges between them, and context edges to them; a single pass, no core."""
    if k <= 0:
        return nodes, edges
    keep = node_degree(edges, context_layer).filter(F.col("degree") >= k).select("id")
    context = edges.filter(F.col("layer") == context_layer)
    hubs = context.join(keep.withColumnRenamed("id", "target"), "target", "left_semi").select(F.col("source").alias("id")).distinct()
    kept = edges.filter(F.coalesce("layer", F.lit("")) != context_layer)
    for side in ("source", "target"):
        kept = kept.join(keep.withColumnRenamed("id", side), side, "left_semi")
    more = context.join(keep.withColumnRenamed("id", "target"), "target", "left_semi")
    return nodes.join(keep.unionByName(hubs).distinct(), "id", "left_semi"), kept.select(*edges.columns).unionByName(more.select(*edges.columns))


def company_context(nodes: DataFrame, edges: DataFrame, company: str, limit: int = 24) -> tuple[DataFrame, DataFrame]:
    """A hub node for a company with HAS_CONTEXT edges to the first ``limit`` distinct ends, in order of edge id."""
    ends = edges.select(F.posexplode(F.array("source", "target")).alias("pos", "end"), "id")
    first = ends.groupBy("end").agg(F.min(F.struct("id", "pos")).alias("at")).orderBy("at").limit(limit)
    hub = F.lit(f"company-{company.lower()}")
    more = first.select(F.concat(hub, F.lit("-"), F.col("end").cast("string")).alias("id"), hub.alias("source"), F.col("end").cast("string").alias("target"), F.lit("HAS_CONTEXT").alias("label"), F.lit("company_scope").alias("layer"))
    text = edges.withColumns({c: F.col(c).cast("string") for c in ("id", "source", "target")})
    node = nodes.sparkSession.range(1).select(hub.alias("id"), F.lit(company).alias("label"), F.lit("Company").alias("type"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("context"))
    return nodes.withColumn("id", F.col("id").cast("string")).unionByName(node), text.unionByName(more)


def display_size(degree: str = "degree"):
    return F.least(F.lit(42), 18 + 5 * F.col(degree))


def unique_chunks(rows: DataFrame, order: list, key: str = "chunk_id") -> DataFrame:
    """The first row of each chunk."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def edge_table(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with their ends' labels."""
    n = nodes.select("id", "label")
    out = edges.join(n.select(F.col("id").alias("source"), F.col("label").alias("source_label")), "source", "left")
    return out.join(n.select(F.col("id").alias("target"), F.col("label").alias("target_label")), "target", "left")


HIERARCHY = ("IS_A", "PART_OF")


def ontology_payload(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of concept relations (source_id, relation, target_id, source, target, relation_layer)."""
    ends = [rows.select(F.col(f"{s}_id").alias("id"), F.col(s).alias("label")) for s in ("source", "target")]
    nodes = ends[0].unionByName(ends[1]).groupBy("id").agg(F.max("label").alias("label")).withColumn("type", F.lit("OntologyConcept"))
    name = F.concat(F.lit("ontology-"), F.col("source_id").cast("string"), F.lit("-"), "relation", F.lit("-"), F.col("target_id").cast("string"))
    edges = rows.groupBy("source_id", "relation", "target_id").agg(F.max("relation_layer").alias("layer"))
    return nodes, edges.select(name.alias("id"), F.col("source_id").alias("source"), F.col("target_id").alias("target"), F.col("relation").alias("label"), "layer")


def drawn(nodes: DataFrame, edges: DataFrame, most: int = 120, hierarchical: bool = False, least_degree: int = 1) -> tuple[DataFrame, DataFrame]:
    """What a drawing shows: the first ``most`` edges by id between nodes of enough degree, sized nodes.

    A hierarchical drawing keeps the schema's IS_A and PART_OF edges and their nodes, if there are any.
    """
    nodes, edges = min_degree(nodes, edges, least_degree)
    edges = edges.orderBy("source", "label", "target", "id").limit(most)
    if hierarchical:
        schema = edges.filter((F.col("layer") == "ontology_schema") & F.col("label").isin(*HIERARCHY))
        if not schema.isEmpty():  # at most ``most`` edges
            edges = schema
            ends = schema.select(F.explode(F.array("source", "target")).alias("id")).distinct()
            nodes = nodes.join(ends, "id", "left_semi")
    degree = edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    nodes = nodes.join(degree, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return nodes.withColumn("size", display_size()), edges


def concept_choices(rows: DataFrame) -> DataFrame:
    """(label, id) to choose a concept by."""
    kept = rows.filter(F.col("concept_id").isNotNull() & (F.coalesce("name", F.lit("")) != ""))
    return kept.select(F.format_string("%s (%s) \u00b7 %s mapped", F.col("name"), F.col("concept_type"), F.coalesce("mapped_entities", F.lit(0)).cast("string")).alias("label"), F.col("concept_id").cast("string").alias("id"))


def node_choices(rows: DataFrame) -> DataFrame:
    """(label, id) to choose a node by."""
    kept = rows.filter(F.col("node_id").isNotNull() & (F.coalesce("name", F.lit("")) != ""))
    return kept.select(F.format_string("%s (%s)", F.col("name"), F.coalesce("entity_type", F.lit("Entity"))).alias("label"), F.col("node_id").alias("id"))
