"""Chunk embeddings: what is pending, the texts to embed, storage, coverage, and exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_DIMENSIONS = 4096
#: Query vectors that are compared at once: what is held on each executor, whatever their number.
QUERY_BLOCK = 1024


def safe_dimensions(n: int) -> int:
    if not 1 <= n <= MAX_DIMENSIONS:
        raise ValueError(f"dimensions must be between 1 and {MAX_DIMENSIONS}")
    return n


def pending(chunks: DataFrame, stored: DataFrame, model: str, dimensions: int, force: bool = False, limit: int | None = None) -> DataFrame:
    """Chunks without an embedding of this model and size; all of them with ``force``."""
    rows = chunks.join(stored.select(F.col("chunk_id").alias("id"), "embedding", "embedding_model", "embedding_dimensions"), "id", "left")
    if not force:
        rows = rows.filter(F.col("embedding").isNull() | F.col("embedding_model").isNull() | (F.col("embedding_model") != model) | F.col("embedding_dimensions").isNull() | (F.col("embedding_dimensions") != dimensions))
    rows = rows.drop("embedding", "embedding_model", "embedding_dimensions").orderBy("document_id", "index", "id")
    return rows if limit is None else rows.limit(limit)


def embedding_text(ticker: Column, company: Column, title: Column, heading: Column, text: Column) -> Column:
    return F.substring(F.concat_ws("\n", F.concat(F.lit("Company: "), F.coalesce(company, ticker)), F.concat(F.lit("Ticker: "), ticker), F.concat(F.lit("Document: "), title), F.concat(F.lit("Heading: "), heading), F.lit("Text:"), text), 1, 8000)


def embed(rows: DataFrame, function: Callable[[list[str]], list[list[float]]], dimensions: int, batch: int = 24, text_col: str = "embedding_text") -> DataFrame:
    """Add unit vectors by calling ``function`` on ``batch`` texts at a time; a wrong size is an error."""
    safe_dimensions(dimensions)

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        out: list[list[float]] = []
        for i in range(0, len(texts), batch):
            got = function(texts.iloc[i : i + batch].tolist())
            if any(len(v) != dimensions for v in got) or len(got) != len(texts.iloc[i : i + batch]):
                raise ValueError("the embedding function returned vectors of another number or size")
            out += got
        v = np.array(out, np.float64).reshape(len(texts), dimensions)
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        return pd.Series(list(v / np.where(norm == 0, 1, norm)))

    return rows.withColumn("embedding", run(text_col)).withColumn("embedding_dimensions", F.lit(dimensions))


def coverage(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    rows = chunks.select("id").join(stored.select(F.col("chunk_id").alias("id"), "embedding"), "id", "left")
    return rows.agg(F.count(F.lit(1)).alias("chunks"), F.count("embedding").alias("embedded_chunks"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, id, cosine, rank): exact cosine neighbours of each query among all vectors, itself left out.

    Queries pass in blocks of QUERY_BLOCK; each task keeps its best ``k`` of a
    block, so k rows a query and task are ranked in the end.  A zero vector has
    cosine 0 with every other.
    """
    spark = vectors.sparkSession
    total = queries.count()
    parts = max(1, -(-total // QUERY_BLOCK))
    numbered = queries.select(F.col(id_col).alias("i"), F.col(vector_col).alias("v"), F.pmod(F.xxhash64(id_col), F.lit(parts)).alias("part"))
    found = None
    for part in range(parts):
        block = numbered.filter(F.col("part") == part).collect()
        if not block:
            continue
        ids = np.array([r["i"] for r in block], np.int64)
        q = np.array([r["v"] for r in block], np.float64)
        held = spark.sparkContext.broadcast((ids, q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, q = held.value
            best_s, best_i = np.full((len(ids), k), -np.inf), np.full((len(ids), k), -1, np.int64)
            for b in batches:
                v = np.stack(b.column(1).to_numpy(zero_copy_only=False)).astype(np.float64) if len(b) else np.zeros((0, q.shape[1]))
                own = b.column(0).to_numpy()
                for at in range(0, len(own), 4096):
                    x, o = v[at : at + 4096], own[at : at + 4096]
                    s = q @ (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)).T
                    s[ids[:, None] == o[None, :]] = -np.inf
                    s, o = np.hstack([best_s, s]), np.hstack([best_i, np.broadcast_to(o, s.shape)])
                    order = np.lexsort((o, -s), axis=1)[:, :k]
                    best_s, best_i = np.take_along_axis(s, order, 1), np.take_along_axis(o, order, 1)
            keep = np.isfinite(best_s)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, k).reshape(-1, k)[keep]), pa.array(best_i[keep]), pa.array(best_s[keep])], ["query_id", "id", "cosine"])

        one = vectors.select(F.col(id_col).cast("long"), vector_col).mapInArrow(run, "query_id bigint, id bigint, cosine double")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], "query_id bigint, id bigint, cosine double, rank int")
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
