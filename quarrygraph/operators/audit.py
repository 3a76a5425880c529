"""Export audit: counts and warnings for each extracted graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions.expressions import contains_any


def source_warnings(url: Column, title: Column, kind: Column) -> Column:
    text = F.lower(F.concat_ws(" ", F.coalesce(url, F.lit("")), F.coalesce(title, F.lit("")), F.coalesce(kind, F.lit(""))))
    off = F.array_compact(F.array(*[F.when(text.contains(t), F.lit(t)) for t in fixed.AUDIT_OFF_TOPIC]))
    return F.array_compact(F.array(
        F.when(~contains_any(text, list(fixed.AUDIT_POSITIVE)), "source does not include an earnings/transcript/call keyword"),
        F.when(F.size(off) > 0, F.concat(F.lit("off-topic source keyword(s): "), F.array_join(off, ", "))),
    ))


def audit(exports: DataFrame) -> DataFrame:
    """One row an export: ``url``, ``title``, ``kind``, ``chunks``, ``entities``, ``relations`` (counts) gain ``warnings``."""
    empty = F.array_compact(F.array(*[F.when(F.col(c) == 0, f"no {c}") for c in ("chunks", "entities", "relations")]))
    return exports.withColumn("warnings", F.concat(source_warnings(F.col("url"), F.col("title"), F.col("kind")), empty))


def audit_exports(graphs: DataFrame) -> DataFrame:
    """The audit of extracted graphs as read from their JSON."""
    n = lambda c: F.coalesce(F.size(c), F.lit(0)) if c else F.lit(0)
    return audit(graphs.select(F.col("document.id").alias("id"), F.col("document.source_url").alias("url"), F.col("document.title").alias("title"), F.col("document.source_kind").alias("kind"), *[F.greatest(n(c), F.lit(0)).alias(c) for c in ("chunks", "entities", "relations")]))
