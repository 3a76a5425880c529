"""Arrow batches of texts as byte arrays, and bounded samples of labelled rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes that are worked on at once; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20
CHUNK_ROWS = 256

#: 1 for bytes of words by the contracts' definition, before lower-casing.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER_BYTE = np.arange(256, dtype=np.uint8)
LOWER_BYTE[0x41:0x5B] += 32


def byte_chunks(texts: pa.Array, limit: int = CHUNK_BYTES, rows: int = CHUNK_ROWS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, bytes, offsets) of stretches of a binary array, without a copy."""
    n = len(texts)
    if not n:
        return
    wide = pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n, i + rows)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Offsets of the words' first bytes; a text's end ends its word."""
    word = WORD_BYTE[data]
    start = word.copy()
    start[1:] &= ~word[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[first] = word[first]
    return np.flatnonzero(start)


def text_bytes(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit("")).cast("binary")


def sampled(df: DataFrame, label: str, id_col: str, per_label: int, in_all: int | None = None) -> DataFrame:
    """About ``per_label`` rows of each label (all if there are fewer), the same ones at every run.

    With ``in_all``, that many rows are shared out among the labels.

    A row is taken if the hash of its id is below its label's threshold.
    """
    counts = df.groupBy(label).count().collect()
    if in_all and len(counts) * per_label > in_all:
        per_label = max(1, in_all // len(counts))
    take = F.lit(0.0)
    for r in counts:
        take = F.when(F.col(label).eqNullSafe(F.lit(r[label])), F.lit(min(1.0, per_label / r["count"]))).otherwise(take)
    return df.filter(F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col)), F.lit(1 << 30)) < take * (1 << 30))
