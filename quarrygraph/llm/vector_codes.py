"""Codes of vectors: each of 16 parts is named by the nearest entry of its codebook, in whole numbers.

Codebooks start as the parts of the vectors with the least ids and are refined in
two rounds.  A round is one pass: tasks assign their rows and return sums and counts
of each entry, which Spark adds up; only codebooks, PARTS x ENTRIES rows whatever the
input, reach the driver.

An entry is looked for by segment means.  By the sums and the residual norms of equal
blocks, (Sx-Sc)^2/L + (rx-rc)^2 summed over blocks is never more than the squared
distance; blocks are first a whole part, then halves, quarters and so on.  Entries whose bound
exceeds a known distance go; survivors get their exact distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import joined_counted, stored, table

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
ROWS = 4096
#: Groups of equal labels up to this number are broadcast.
BROADCAST_LABELS = 200_000


def _blocks(width: int) -> list[int]:
    """Lengths of blocks, coarse to fine; the last below a whole component is left to the exact distance."""
    lengths = [width] if width else []
    while lengths and lengths[-1] % 2 == 0 and lengths[-1] > 2:
        lengths.append(lengths[-1] // 2)
    return lengths


def _summary(x: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums and residual norms of the blocks of ``length`` of each row; the squares are whole numbers, so exact."""
    b = x.reshape(len(x), -1, length)
    s = b.sum(axis=2)
    return s.astype(np.float64), np.sqrt(np.maximum(length * (b * b).sum(axis=2) - s * s, 0) / length)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the entry nearest to each row of ``x`` (whole numbers); ties to the lower index."""
    n, k = len(x), len(entries)
    lengths = _blocks(x.shape[1])
    if not lengths or not n:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    # what rounding can add to a bound, generously
    slack = 1e-9 + 1e-12 * ((x * x).sum(axis=1, dtype=np.float64) + (entries * entries).sum(axis=1, dtype=np.float64).max())
    s, r = _summary(x, lengths[0])
    sc, rc = _summary(entries, lengths[0])
    bound = np.zeros((n, k))
    for b in range(s.shape[1]):
        bound += (s[:, b, None] - sc[None, :, b]) ** 2 / lengths[0] + (r[:, b, None] - rc[None, :, b]) ** 2
    seed = bound.argmin(axis=1)
    known = ((x - entries[seed]) ** 2).sum(axis=1)
    row, entry = np.nonzero(bound - slack[:, None] <= known[:, None])
    for length in lengths[1:]:
        s, r = _summary(x, length)
        sc, rc = _summary(entries, length)
        fine = ((s[row] - sc[entry]) ** 2 / length + (r[row] - rc[entry]) ** 2).sum(axis=1)
        ok = fine - slack[row] <= known[row]
        row, entry = row[ok], entry[ok]
    exact = ((x[row] - entries[entry]) ** 2).sum(axis=1)
    starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))  # the seed survives in every row
    least = np.minimum.reduceat(exact, starts)
    hit = np.flatnonzero(exact == least[row])
    hit = hit[np.concatenate([[True], row[hit][1:] != row[hit][:-1]])]
    return entry[hit], least


def assign(v: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows x parts) and the summed squared distances of whole-number vectors; ``books``: part, entry, position."""
    width = books.shape[2]
    codes, error = np.zeros((len(v), len(books)), np.int64), np.zeros(len(v), np.int64)
    for p, book in enumerate(books):
        codes[:, p], d = nearest(v[:, p * width : (p + 1) * width], book)
        error += d
    return codes, error


def _whole(vectors: pa.Array, size: int) -> np.ndarray:
    """floor(SCALE * x) of each component, held within what lets a vector's squared distance fit in a long."""
    most = int((2**60 / max(size, 1)) ** 0.5 / 2)
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), size)
    return np.clip(np.floor(SCALE * x), -most, most).astype(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch], size: int, column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            b = batch.slice(i, ROWS)
            yield b, _whole(b.column(column), size)


def kept_rows(df: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(_qg_id, _qg_vec, _qg_label) of rows whose vector is there and all of whose components are finite."""
    bad = F.exists(vec_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.filter(F.col(vec_col).isNotNull() & ~bad)
    return rows.select(F.col(id_col).alias("_qg_id"), F.col(vec_col).cast("array<double>").alias("_qg_vec"), F.col(label_col).alias("_qg_label"))


def _start(kept: DataFrame) -> np.ndarray:
    """The vectors of the ENTRIES least ids, ascending; of rows that share an id, the least vector."""
    ids = kept.select("_qg_id").filter("_qg_id is not null").distinct().orderBy("_qg_id").limit(ENTRIES)
    rows = kept.join(F.broadcast(ids), "_qg_id").groupBy("_qg_id").agg(F.min("_qg_vec").alias("v")).orderBy("_qg_id").collect()
    size = len(rows[0]["v"]) if rows else 0
    if size % PARTS:
        raise ValueError(f"vectors of {size} components can't be cut into {PARTS} equal parts")
    same = [r["v"] for r in rows if len(r["v"]) == size]
    v = _whole(pa.array(same, pa.list_(pa.float64())), size)
    return v.reshape(len(same), PARTS, size // PARTS).transpose(1, 0, 2)


def codebooks(kept: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """Whole-number entries by part, entry and position; none without a row that has an id."""
    books = _start(kept)
    size = PARTS * books.shape[2]
    if not books.size:
        return books
    rows = kept.filter(F.size("_qg_vec") == size).select("_qg_vec")
    for _ in range(rounds):
        held = books

        def run(batches: Iterator[pa.RecordBatch], held: np.ndarray = held) -> Iterator[pa.RecordBatch]:
            sums, counts = np.zeros(held.shape, np.int64), np.zeros(held.shape[:2], np.int64)
            for _, v in _chunks(batches, size, 0):
                codes, _ = assign(v, held)
                for p in range(PARTS):
                    np.add.at(sums[p], codes[:, p], v[:, p * held.shape[2] : (p + 1) * held.shape[2]])
                    counts[p] += np.bincount(codes[:, p], minlength=held.shape[1])
            used = np.flatnonzero(counts)
            flat = sums.reshape(-1, held.shape[2])[used]
            where = np.repeat(used, held.shape[2]), np.tile(np.arange(held.shape[2]), len(used))
            yield pa.RecordBatch.from_arrays([pa.array(where[0]), pa.array(where[1]), pa.array(flat.ravel()), pa.array(np.repeat(counts.ravel()[used], held.shape[2]))], ["entry", "pos", "total", "n"])

        # the sums are added as decimals, so that no number of rows overflows them
        total = rows.mapInArrow(run, "entry bigint, pos bigint, total bigint, n bigint").groupBy("entry", "pos").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
        books = held.copy()
        flat = books.reshape(-1, held.shape[2])
        for r in total.collect():
            flat[r["entry"], r["pos"]] = int(r["total"]) // r["n"]
    return books


def encode(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(id, label, codes array<int>, error) of each row with a finite vector, and the codebooks.

    Rows whose vector is null, or holds a null, NaN or infinite component, go.  Repeated rows
    get equal codes; rows without an id teach and are encoded, but start no codebook.
    Vectors with another number of components than the least id's have no codes and no error.
    Scaled components are held within +-2^30/(2 sqrt(size)), so that errors fit in a long.
    """
    kept = kept_rows(df, id_col, vec_col, label_col)
    books = codebooks(kept, rounds)
    size = PARTS * books.shape[2]
    schema = f"_qg_id {df.schema[id_col].dataType.simpleString()}, _qg_label {df.schema[label_col].dataType.simpleString()}, codes array<int>, error bigint"
    if not books.shape[1]:
        rows = kept.select("_qg_id", "_qg_label", F.lit(None).cast("array<int>").alias("codes"), F.lit(None).cast("long").alias("error"))
    else:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b, v in _chunks(batches, size, 2):
                codes, error = assign(v, books)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, PARTS, dtype=np.int32)), pa.array(codes.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists, pa.array(error)], ["_qg_id", "_qg_label", "codes", "error"])

        same = F.size("_qg_vec") == size
        rows = kept.filter(same).select("_qg_id", "_qg_label", "_qg_vec").mapInArrow(run, schema)
        odd = kept.filter(~same).select("_qg_id", "_qg_label", F.lit(None).cast("array<int>").alias("codes"), F.lit(None).cast("long").alias("error"))
        rows = rows.unionByName(odd)
    return rows.select(F.col("_qg_id").alias(id_col), F.col("_qg_label").alias(label_col), "codes", "error"), books


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code, error, error by label and a digest of the codebooks for each row of embeddings with a finite vector; an empty table gives no rows."""
    coded, books = encode(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    rows = stored(coded.select("vec_id", "label", code.alias("code"), "error"))
    labels = rows.groupBy("label").agg(F.sum("error").alias("label_error"))
    out = joined_counted(rows, labels, "label", labels.count(), BROADCAST_LABELS)
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    """Both rounds in SQL; a part's distances are summed by (vector, part, entry)."""

    def assigned(book: str) -> str:
        return f"""(SELECT vec_id, part, arg_min(entry, struct_pack(d := d, e := entry)) AS entry, min(d) AS d
            FROM (SELECT x.vec_id, x.part, c.entry, sum((x.v - c.v) * (x.v - c.v)) AS d FROM x JOIN {book} c USING (part, pos) GROUP BY 1, 2, 3) GROUP BY 1, 2)"""

    ctes = [
        """kept AS (SELECT vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)""",
        f"""x AS (SELECT vec_id, CAST(floor((i - 1) / (n // {PARTS})) AS INT) AS part, CAST((i - 1) % (n // {PARTS}) AS INT) AS pos, CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT) AS v
            FROM (SELECT vec_id, unnest(embedding) AS e, unnest(range(1, len(embedding) + 1)) AS i, len(embedding) AS n FROM kept))""",
        f"""first AS (SELECT vec_id, CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INT) AS entry FROM (SELECT DISTINCT vec_id FROM kept WHERE vec_id IS NOT NULL ORDER BY vec_id LIMIT {ENTRIES}))""",
        "book0 AS (SELECT entry, part, pos, v FROM first JOIN x USING (vec_id))",
    ]
    for r in range(ROUNDS):
        ctes.append(f"""mean{r} AS (SELECT part, a.entry, pos, CAST(floor(sum(v) / count(*)) AS BIGINT) AS v FROM {assigned(f"book{r}")} a JOIN x USING (vec_id, part) GROUP BY 1, 2, 3)""")
        ctes.append(f"book{r + 1} AS (SELECT entry, part, pos, coalesce(m.v, b.v) AS v FROM book{r} b LEFT JOIN mean{r} m USING (part, entry, pos))")
    ctes.append(f"final AS (SELECT vec_id, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM {assigned(f'book{ROUNDS}')} GROUP BY 1)")
    ctes.append(f"digest AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, pos)) AS h FROM book{ROUNDS})")
    return f"""WITH {", ".join(ctes)} SELECT f.vec_id, f.code, f.error, CAST(sum(f.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, d.h AS codebooks_sha256
        FROM final f JOIN kept k USING (vec_id) CROSS JOIN digest d"""


OP13_SQL = _sql()
