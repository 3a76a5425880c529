"""The concept vocabulary: its own small JSON, or a file of the same shape."""

from __future__ import annotations

import json
import re
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULT = Path(__file__).with_name("vocabulary.json")


@lru_cache(maxsize=8)
def load(path: str | None = None) -> tuple[tuple[dict, ...], tuple[dict, ...]]:
    """(concepts, relations); a concept's name comes first among its aliases, each once."""
    raw = json.loads(Path(path or DEFAULT).read_text(encoding="utf-8-sig"))
    concepts = []
    for c in raw.get("concepts", []):
        name = str(c["name"]).strip()
        ident = str(c.get("id") or "concept-" + (re.sub(r"[^a-z0-9]+", "-", name.lower()).strip("-") or "unknown"))
        aliases = list(dict.fromkeys([name, *(str(a).strip() for a in c.get("aliases", []) if str(a).strip())]))
        concepts.append({"id": ident, "name": name, "concept_type": str(c.get("concept_type") or c.get("type") or ""), "description": str(c.get("description") or ""), "aliases": aliases})
    relations = [
        {"source_id": str(r.get("source") or r.get("source_id")), "relation_type": re.sub(r"[^A-Z0-9]+", "_", str(r.get("relation_type") or r.get("type")).upper()), "target_id": str(r.get("target") or r.get("target_id")), "description": str(r.get("description") or "")}
        for r in raw.get("relations", [])
    ]
    return tuple(concepts), tuple(relations)


def tables(spark: SparkSession, path: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(concepts, aliases in order, relations) as small tables."""
    concepts, relations = load(path)
    c = spark.createDataFrame([(x["id"], x["name"], x["concept_type"], x["description"]) for x in concepts], "id string, name string, concept_type string, description string")
    a = spark.createDataFrame([(x["id"], x["name"], y) for x in concepts for y in x["aliases"]], "concept_id string, name string, alias string")
    r = spark.createDataFrame([tuple(x.values()) for x in relations], "source_id string, relation_type string, target_id string, description string")
    return c, a, r
