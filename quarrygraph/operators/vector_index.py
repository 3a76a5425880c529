"""Inverted-file index for exact cosine search: cells skipped by the triangle inequality.

On unit vectors the cosine falls as the distance grows, so what holds of distances
holds of ranks.  Vectors are dealt to the cell of their nearest centroid and stored in blocks
by their distance to it, each block with its least and greatest.  For a query q at a distance d
from a centroid, every vector of a block [lo, hi] is at least max(d - hi, lo - d) away.

A search first reads the blocks nearest to each query, enough for k answers; the
k-th answer's distance bounds the rest: only blocks that may hold something nearer are read.
Results are those of a full scan.  Queries are a DataFrame, too; each block is read once,
whatever their number, and queries meet it in groups of QUERY_SLOT.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.storage import delete, read_text, scratch, stored, write_text

#: What the driver and each task hold of an index: its centroids, at most so many.
MAX_CELLS = 2048
#: Rows of a cell that teach its centroid, and rounds of teaching.
TRAIN_ROWS, ROUNDS = 64, 4
BLOCK_ROWS = 2048
QUERY_SLOT = 1024
#: Block numbers that are pushed down to the scan; beyond that they are joined.
PUSHED = 5000
#: What rounding may add to a distance; ties are never lost.
SLACK = 1e-6
_ZERO = -1  # the cell of zero vectors, whose cosine with all others is 0


def unit(vector: Column) -> Column:
    """A vector of length 1; a zero vector stays."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm == 0, vector).otherwise(F.transform(vector, lambda x: x / norm))


def _rows(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    return df.filter(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), unit(v).alias("v"))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size) if len(column) else np.zeros((0, size))


def _nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each row and the distance to its centroid; zero vectors have a cell of their own at distance 0."""
    squares = (centroids * centroids).sum(axis=1)
    cell = np.concatenate([(squares[None, :] - 2 * x[i : i + 4096] @ centroids.T).argmin(axis=1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])
    dist = np.sqrt(((x - centroids[cell]) ** 2).sum(axis=1))
    zero = ~x.any(axis=1)
    return np.where(zero, _ZERO, cell), np.where(zero, 0.0, dist)


def _taught(sample: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid as the mean of the sample's rows in its cell, unit length; tasks give sums, the driver holds centroids only."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(centroids.shape), np.zeros(len(centroids), np.int64)
        for b in batches:
            x = _matrix(b.column(0), centroids.shape[1])
            x = x[x.any(axis=1)]
            cell, _ = _nearest(x, centroids)
            np.add.at(total, cell, x)
            n += np.bincount(cell, minlength=len(n))
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(list(total[used]), pa.list_(pa.float64()))], ["cell", "total"])

    def added(table: pa.Table) -> pa.Table:
        total = np.stack(table["total"].to_numpy()).sum(axis=0)
        return pa.table({"cell": table["cell"][:1], "total": pa.array([total], pa.list_(pa.float64()))})

    out = centroids.copy()
    for r in sample.select("v").mapInArrow(sums, "cell bigint, total array<double>").groupBy("cell").applyInArrow(added, "cell bigint, total array<double>").collect():
        t = np.array(r["total"])
        if (norm := np.linalg.norm(t)) > 0:
            out[r["cell"]] = t / norm
    return out


def _blocked(rows: DataFrame, centroids: np.ndarray, first: int) -> DataFrame:
    """(block, cell, dist, id, v): rows by cell and distance, cut into blocks; Spark's ranges split a crowded cell."""
    kind = rows.schema["id"].dataType.simpleString()
    size = centroids.shape[1]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, dist = _nearest(_matrix(b.column(1), size), centroids)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(dist), *b.columns], ["cell", "dist", "id", "v"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, last, n = first + (TaskContext.get().partitionId() << 24), None, 0
        for b in batches:
            cells, out = b.column(0).to_pylist(), []
            for c in cells:
                if c != last or n == BLOCK_ROWS:
                    number, last, n = number + 1, c, 0
                n += 1
                out.append(number)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), *b.columns], ["block", "cell", "dist", "id", "v"])

    dealt_rows = rows.mapInArrow(dealt, f"cell bigint, dist double, id {kind}, v array<double>")
    ranged = dealt_rows.repartitionByRange("cell", "dist").sortWithinPartitions("cell", "dist")
    return ranged.mapInArrow(cut, f"block bigint, cell bigint, dist double, id {kind}, v array<double>")


def _note(spark: SparkSession, path: str) -> dict:
    text = read_text(spark, f"{path}/index.json")
    if text is None:
        raise ValueError(f"no index at {path}")
    return json.loads(text)


def _append(spark: SparkSession, path: str, rows: DataFrame, centroids: np.ndarray, note: dict) -> None:
    """A new part of blocks; it counts once the note names it, so a reader never sees half of it."""
    part = len(note["parts"])
    where = f"{path}/part={part:06d}-{scratch(spark).rpartition('-')[2][:8]}"
    rows = stored(_blocked(rows, centroids, part << 44), f"{where}/vectors")
    blocks = rows.groupBy("block", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("dist").alias("lo"), F.max("dist").alias("hi"))
    n = stored(blocks, f"{where}/blocks").agg(F.sum("n")).first()[0] or 0
    note["parts"].append(where.rpartition("/")[2])
    note["rows"] += n
    write_text(spark, f"{path}/index.json", json.dumps(note))


def build(vectors: DataFrame, path: str, id_col: str = "vec_id", vector_col: str = "embedding", cells: int | None = None, name: str = "chunk-vectors") -> dict:
    """An index of ``vectors`` at ``path``, in place of what is there; returns its note (name, dimensions, cells, rows).

    There are about sqrt(rows) cells, at most MAX_CELLS.  Centroids learn from TRAIN_ROWS rows a cell, drawn by the hash
    of the id; every vector is indexed.  Null vectors are left out; all others must be of one size.
    """
    spark = vectors.sparkSession
    rows = _rows(vectors, id_col, vector_col)
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("v")).alias("lo"), F.max(F.size("v")).alias("hi")).first()
    if seen["n"] and seen["lo"] != seen["hi"]:
        raise ValueError(f"vectors have {seen['lo']} to {seen['hi']} components")
    cells = max(1, min(MAX_CELLS, cells or round(math.sqrt(seen["n"]))))
    share = min(1.0, TRAIN_ROWS * cells / max(1, seen["n"]))
    h = F.pmod(F.xxhash64(F.lit("index"), "id"), F.lit(1 << 30))
    sample = rows.filter(h < int(share * (1 << 30)) + 1)
    first = sample.filter(F.exists("v", lambda x: x != 0)).orderBy(h, "id").limit(cells).select("v").collect()
    centroids = np.array([r["v"] for r in first], np.float64).reshape(len(first), seen["hi"] or 0) if first else np.zeros((1, seen["hi"] or 0))
    for _ in range(ROUNDS if len(first) > 1 else 0):
        centroids = _taught(sample, centroids)
    delete(spark, path)
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell bigint, centroid array<double>").coalesce(1).write.parquet(f"{path}/cells")
    note = {"name": name, "dimensions": seen["hi"] or 0, "similarity": "cosine", "cells": len(centroids), "parts": [], "rows": 0}
    _append(spark, path, rows, centroids, note)
    return _note(spark, path)


def add(vectors: DataFrame, path: str, id_col: str = "vec_id", vector_col: str = "embedding") -> dict:
    """New vectors (with new ids) into an index: only they are dealt to cells and written, as blocks of their own."""
    spark = vectors.sparkSession
    note = _note(spark, path)
    rows = _rows(vectors, id_col, vector_col)
    if not rows.filter(F.size("v") != note["dimensions"]).isEmpty():
        raise ValueError(f"vectors must have {note['dimensions']} components")
    _append(spark, path, rows, _centroids(spark, path), note)
    return _note(spark, path)


def _centroids(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()  # at most MAX_CELLS
    return np.array([r["centroid"] for r in rows], np.float64)


def _read(spark: SparkSession, path: str, what: str) -> DataFrame:
    return spark.read.parquet(*[f"{path}/{p}/{what}" for p in _note(spark, path)["parts"]])


def _cells_of(queries: DataFrame, centroids: np.ndarray, held: list[tuple[int, int, float]], k: int | None) -> DataFrame:
    """(query_id, cell, d, tau) of the cells to look into: the nearest ones that hold ``k`` rows, or those within the query's tau."""
    kind = queries.schema["query_id"].dataType.simpleString()
    cell, n, radius = (np.array([h[i] for h in held], t) for i, t in enumerate((np.int64, np.int64, np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, tau = _matrix(b.column(1), centroids.shape[1]), b.column(2).to_numpy(zero_copy_only=False)
            zero = ~x.any(axis=1)
            d = np.sqrt(np.maximum(1 - 2 * (x @ centroids.T) + (centroids * centroids).sum(axis=1), 0))
            d = np.where(cell == _ZERO, math.sqrt(2), d[:, np.maximum(cell, 0)])
            if k is None:
                take = (d - radius <= tau[:, None]) | zero[:, None]
            else:
                order = np.argsort(d, axis=1, kind="stable")
                before = np.cumsum(n[order], axis=1) - n[order]
                take = np.zeros(d.shape, bool)
                np.put_along_axis(take, order, before < k, axis=1)
            q, c = np.nonzero(take)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(q)), pa.array(cell[c]), pa.array(d[q, c]), pa.array(np.where(zero, np.inf, tau)[q])], ["query_id", "cell", "d", "tau"])

    return queries.select("query_id", "v", "tau").mapInArrow(run, f"query_id {kind}, cell bigint, d double, tau double")


def _scanned(spark: SparkSession, path: str, queries: DataFrame, pairs: DataFrame, k: int, itself: bool) -> DataFrame:
    """(query_id, id, cosine): the best ``k`` of each query in each of its blocks; ``pairs``: query_id, block."""
    slots = max(1, -(-queries.count() // QUERY_SLOT))
    slot = F.pmod(F.xxhash64("query_id"), F.lit(slots)).cast("int")
    asked = pairs.join(queries.select("query_id", "v"), "query_id").select("block", slot.alias("slot"), "query_id", "v")
    wanted = stored(pairs.select("block", slot.alias("slot")).distinct())
    some = [r["block"] for r in wanted.select("block").distinct().limit(PUSHED + 1).collect()]
    rows = _read(spark, path, "vectors").select("block", "id", "v")
    if len(some) <= PUSHED:
        rows = rows.filter(F.col("block").isin(some))  # row groups without these blocks are not read
    rows = rows.join(wanted, "block").select("block", "slot", "id", "v")
    kinds = queries.schema["query_id"].dataType.simpleString(), rows.schema["id"].dataType.simpleString()

    def best(one: pa.Table, two: pa.Table) -> pa.Table:
        one, two = one.combine_chunks(), two.combine_chunks()
        if not len(one) or not len(two):
            return pa.table({"query_id": one["query_id"][:0], "id": two["id"][:0], "cosine": pa.array([], pa.float64())})
        q, x = np.stack(one["v"].to_numpy()), np.stack(two["v"].to_numpy())
        s = np.round(q @ x.T, 12) + 0.0
        if not itself:
            ids, own = two["id"].to_pylist(), one["query_id"].to_pylist()
            at = {}
            for j, i in enumerate(ids):
                at.setdefault(i, []).append(j)
            for i, o in enumerate(own):
                s[i, at.get(o, [])] = -np.inf
        rank = np.argsort(np.argsort(np.array(two["id"].to_pylist(), dtype=object), kind="stable"), kind="stable")
        order = np.lexsort((np.broadcast_to(rank, s.shape), -s), axis=1)[:, :k]
        top = np.take_along_axis(s, order, 1)
        i, j = np.nonzero(np.isfinite(top))
        return pa.table({"query_id": one["query_id"].take(pa.array(i)), "id": two["id"].take(pa.array(order[i, j])), "cosine": pa.array(top[i, j])})

    return asked.groupBy("block", "slot").cogroup(rows.groupBy("block", "slot")).applyInArrow(best, f"query_id {kinds[0]}, id {kinds[1]}, cosine double")


def probes(spark: SparkSession, path: str, queries: DataFrame, k: int, itself: bool = False) -> tuple[DataFrame, DataFrame]:
    """(pairs, answers) of a search: the (query_id, block) that are read, and (query_id, id, cosine) found in them.

    ``queries``: query_id, v of unit length.
    """
    centroids = _centroids(spark, path)
    blocks = _read(spark, path, "blocks")
    held = [(r["cell"], r["n"], r["hi"]) for r in blocks.groupBy("cell").agg(F.sum("n").alias("n"), F.max("hi").alias("hi")).orderBy("cell").collect()]  # at most MAX_CELLS + 1
    if not held:
        return queries.select("query_id", F.lit(0).cast("long").alias("block")).limit(0), queries.select("query_id", F.lit(None).cast("long").alias("id"), F.lit(0.0).alias("cosine")).limit(0)
    need = k + (0 if itself else 1)
    near = _cells_of(queries.withColumn("tau", F.lit(float("inf"))), centroids, held, need).join(blocks, "cell")
    bound = F.greatest(F.lit(0.0), F.col("d") - F.col("hi"), F.col("lo") - F.col("d"))
    order = Window.partitionBy("query_id").orderBy(bound, "d", "block").rowsBetween(Window.unboundedPreceding, -1)
    first = stored(near.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).filter(F.col("before") < need).select("query_id", "block"))
    found = stored(_scanned(spark, path, queries, first, k, itself))
    kth = Window.partitionBy("query_id").orderBy(F.desc("cosine"))
    taus = found.withColumn("r", F.row_number().over(kth)).filter(F.col("r") == k).select("query_id", (F.sqrt(F.greatest(2 - 2 * F.col("cosine"), F.lit(0.0))) + SLACK).alias("tau"))
    bounded = queries.join(taus, "query_id", "left").withColumn("tau", F.coalesce("tau", F.lit(float("inf"))))
    rest = _cells_of(bounded, centroids, held, None).join(blocks, "cell").filter((F.col("lo") <= F.col("d") + F.col("tau")) & (F.col("hi") >= F.col("d") - F.col("tau")))
    rest = stored(rest.select("query_id", "block").join(first, ["query_id", "block"], "left_anti"))
    return first.unionByName(rest), found.unionByName(_scanned(spark, path, queries, rest, k, itself))


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", itself: bool = False) -> DataFrame:
    """(query_id, id, cosine, rank): the ``k`` vectors of the index with the greatest cosine to each query, ties by id.

    Unless ``itself``, a vector with the query's own id is left out.  A zero vector has cosine 0 with every other.
    Null queries have no answers; repeated ids are one query each only if their vectors are equal.
    """
    _note(spark, path)
    asked = stored(_rows(queries, id_col, vector_col).select(F.col("id").alias("query_id"), "v").dropDuplicates(["query_id"]))
    _, found = probes(spark, path, asked, k, itself)
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
