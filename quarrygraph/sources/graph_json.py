"""Extracted graphs as JSON files: one object a document, with a fixed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DOC = "id string, title string, company_id string, company_name string, ticker string, sector string, fiscal_quarter string, call_id string, call_date string, source_url string, source_kind string, markdown_path string"
_CHUNK = "id string, document_id string, index int, chunk_type string, heading string, text string, start_line int, end_line int, speaker_name string, speaker_title string, text_hash string, paragraph_index int"
_ENTITY = "id string, name string, entity_type string, source string, properties map<string,string>"
_RELATION = "id string, source_entity_id string, relation_type string, target_entity_id string, scope_id string, evidence_text string, confidence double, properties map<string,string>"
_OVERVIEW = "id string, document_id string, summary string, themes array<string>, metrics array<string>, risks array<string>, chunk_count int, qa_pair_count int, entity_ids array<string>, relation_ids array<string>"


def _struct(fields: str) -> str:
    return "struct<" + ", ".join(f.replace(" ", ":", 1) for f in fields.split(", ")) + ">"


GRAPH_SCHEMA = f"document {_struct(_DOC)}, overview {_struct(_OVERVIEW)}, chunks array<{_struct(_CHUNK)}>, entities array<{_struct(_ENTITY)}>, relations array<{_struct(_RELATION)}>"


def read_graphs(spark: SparkSession, path: str, pattern: str = "*graph.json", recursive: bool = True) -> DataFrame:
    """One row a file, with its name and ``load_seq`` (the order of names); a file that isn't such JSON is an error."""
    reader = spark.read.schema(GRAPH_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").option("encoding", "UTF-8")
    if recursive:
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return reader.json(path).withColumn("file", F.input_file_name()).withColumn("load_seq", F.col("file"))


def graph_rows(graphs: DataFrame) -> dict[str, DataFrame]:
    """Documents, chunks, entities and relations as rows, each with its file's ``load_seq``."""
    out = {"documents": graphs.select("document.*", "load_seq")}
    for name in ("chunks", "entities", "relations"):
        out[name] = graphs.select("load_seq", F.inline(name))
    return out


def write_graphs(graphs: DataFrame, path: str) -> None:
    """Back to JSON, a line a document."""
    graphs.drop("file", "load_seq").write.mode("overwrite").json(path)
