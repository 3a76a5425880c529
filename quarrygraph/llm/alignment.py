"""Alignment of two tokenizations of one text, by elementary intervals.

Both tokenizations cover the same bytes, so each is an ascending array of ends.
The union of both arrays cuts the text into elementary intervals; each lies in one
token of either side (found by binary search in the ends), so each interval is one
overlap.  Ends that both sides share close a group of tokens; the products of a
group's two sides expand it to pairs.

A text is cut at spaces that follow something other than white space.  Neither
tokenizer has a token across such a place (the first splits there, no piece of the second
continues there, which is checked when it is loaded), so pieces are aligned on their own and those
that come again are looked up.

Counts of pairs of ids by document are added up by Spark and joined back.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, joined_counted, stored, table

TOKENIZERS = "/opt/tokenizers"
BYTES_FILE = "byte_bpe_50k.tiktoken"
PIECES_FILE = "piece_bpe_32k.model"
#: How the byte-level tokenizer splits a text before it merges; part of its definition.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CUT = re.compile(r"(?<=\S) ")
#: Characters that are aligned at once; a longer text is worked on in such parts.
PART_CHARS = 1 << 19
CHUNK_ROWS = 256
#: Bytes of pieces that a task keeps, and their number; then it starts afresh.
KEPT_BYTES, KEPT_PIECES = 8 << 20, 200_000
#: Pairs of ids up to this number are broadcast with their counts.
BROADCAST_PAIRS = 300_000
#: A pair of ids is one number: the first id times this, and the second.
SIDE = 1 << 20


def load(spark: SparkSession, path: str = TOKENIZERS) -> Broadcast:
    """Both vocabularies (some 1.4 MB) as bytes, read by the driver, so executors need no such folder."""
    return spark.sparkContext.broadcast(tuple(open(f"{path.rstrip('/')}/{name}", "rb").read() for name in (BYTES_FILE, PIECES_FILE)))


class Tokenizers:
    """Both tokenizers, and each token's length in bytes.

    The first is the byte-level vocabulary as ranks, which are its ids; tests hold it
    against the JSON file of the same vocabulary.
    """

    def __init__(self, files: tuple[bytes, bytes]) -> None:
        import sentencepiece
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in files[0].splitlines() if line)}
        self.first = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.second = sentencepiece.SentencePieceProcessor(model_proto=files[1])
        self.first_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.first_bytes[i] = token
        pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece goes on over a space: texts can't be cut there")
        byte = [self.second.is_byte(i) for i in range(len(pieces))]
        self.second_bytes = [bytes([int(p[3:5], 16)]) if b else p.replace("▁", " ").encode() for p, b in zip(pieces, byte, strict=True)]
        self.first_length = np.array([len(b) for b in self.first_bytes], np.int64)
        self.second_length = np.array([len(b) for b in self.second_bytes], np.int64)
        self.space = self.second.piece_to_id("▁")

    def pieces(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of space + text by the first, and of text by the second, which adds the space."""
        second = self.second.encode(texts, num_threads=1)
        return [self.first.encode_ordinary(" " + t) for t in texts], [s if t else [self.space] for s, t in zip(second, texts, strict=True)]

    def whole(self, text: str, a: list[int], b: list[int]) -> bool:
        want = b" " + text.encode()
        return b"".join(map(self.first_bytes.__getitem__, a)) == want and b"".join(map(self.second_bytes.__getitem__, b)) == want


def intervals(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ends, token of a, token of b, group) of the elementary intervals of two tokenizations with one last end."""
    ends = np.union1d(ends_a, ends_b)
    a, b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    shared = (ends_a[a] == ends) & (ends_b[b] == ends)
    return ends, a, b, np.cumsum(shared) - shared


def products(a: np.ndarray, b: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (token of a, token of b) of each group, from the tokens and groups of the intervals; groups hold consecutive tokens."""
    if not len(group):
        return a, b
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    last = np.concatenate([starts[1:], [len(group)]]) - 1
    n_a, n_b = a[last] - a[starts] + 1, b[last] - b[starts] + 1
    size = n_a * n_b
    g = np.repeat(np.arange(len(starts)), size)
    k = np.arange(len(g)) - np.repeat(np.cumsum(size) - size, size)
    return a[starts][g] + k // n_b[g], b[starts][g] + k % n_b[g]


class _Pieces:
    """What is known of pieces: counts of tokens, groups and links, the groups as text, and the links' pairs."""

    def __init__(self, tokenizers: Tokenizers) -> None:
        self.t = tokenizers
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.size = 0
        self.text: list[str] = []
        self.counts = np.zeros((0, 4), np.int64)
        self.ok = np.zeros(0, bool)
        self.start = np.zeros(1, np.int64)
        self.pairs = np.zeros(0, np.int64)

    def add(self, new: list[str]) -> None:
        a, b = self.t.pieces(new)
        ok = np.array([self.t.whole(*x) for x in zip(new, a, b, strict=True)], bool)
        a, b = [x if o else [] for x, o in zip(a, ok, strict=True)], [x if o else [] for x, o in zip(b, ok, strict=True)]
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
        flat_a, flat_b = (np.fromiter((i for x in side for i in x), np.int64, int(n.sum())) for side, n in ((a, n_a), (b, n_b)))
        _, own_a, own_b, group = intervals(np.cumsum(self.t.first_length[flat_a]), np.cumsum(self.t.second_length[flat_b]))
        piece = np.repeat(np.arange(len(new)), n_a)[own_a]
        links = np.bincount(piece, minlength=len(new))
        closes = np.concatenate([group[1:] != group[:-1], [True]]) if len(group) else np.zeros(0, bool)
        groups = np.bincount(piece[closes], minlength=len(new))
        # the texts of groups, from the tokens at which they end
        names_a, names_b = [str(i) for i in flat_a.tolist()], [str(i) for i in flat_b.tolist()]
        texts, i, j = [], 0, 0
        for x, y in zip((own_a[closes] + 1).tolist(), (own_b[closes] + 1).tolist(), strict=True):
            texts.append(f"{names_a[i]}|{names_b[j]}" if x - i == 1 == y - j else f"{','.join(names_a[i:x])}|{','.join(names_b[j:y])}")
            i, j = x, y
        at = 0
        for n in groups.tolist():
            self.text.append(";".join(texts[at : at + n]))
            at += n
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
        self.size += sum(map(len, new))
        self.counts = np.concatenate([self.counts, np.stack([n_a, n_b, groups, links], axis=1)])
        self.ok = np.concatenate([self.ok, ok])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(links)])
        self.pairs = np.concatenate([self.pairs, flat_a[own_a] * SIDE + flat_b[own_b]])


def _parts(text: str) -> Iterator[str]:
    """The text in parts of some PART_CHARS, cut where pieces are; the space between two goes."""
    at = 0
    while len(text) - at > PART_CHARS:
        cut = CUT.search(text, at + PART_CHARS)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:]


def _summed(row: np.ndarray, pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, pair, times) with each pair of a row once."""
    order = np.lexsort((pairs, row))
    row, pairs, times = row[order], pairs[order], times[order]
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (pairs[1:] != pairs[:-1])])) if len(row) else np.zeros(0, np.int64)
    return row[new], pairs[new], np.add.reduceat(times, new) if len(new) else times[new]


def aligned(texts: list[str | None], known: _Pieces) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Counts (n_a, n_b, n_groups, n_links) and groups of each text, and its pairs: (row, pair, times)."""
    n = len(texts)
    counts, groups, whole = np.zeros((n, 4), np.int64), [""] * n, np.ones(n, bool)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    todo = [(i, part) for i, t in enumerate(texts) if t for part in _parts(t)]
    at = 0
    while at < len(todo):
        # as many parts as are worked on at once
        end, chars = at, 0
        while end < len(todo) and (end == at or chars + len(todo[end][1]) <= PART_CHARS):
            chars += len(todo[end][1])
            end += 1
        if known.size > KEPT_BYTES or len(known.number) > KEPT_PIECES:
            known.clear()
        split = [CUT.split(part) for _, part in todo[at:end]]
        if new := list({p for s in split for p in s if p not in known.number}):
            known.add(new)
        row = np.repeat([i for i, _ in todo[at:end]], [len(s) for s in split])
        seg = np.fromiter((known.number[p] for s in split for p in s), np.int64, len(row))
        for (i, _), s in zip(todo[at:end], split, strict=True):
            text = ";".join([known.text[known.number[p]] for p in s])
            groups[i] = f"{groups[i]};{text}" if groups[i] else text
        np.add.at(counts, row, known.counts[seg])
        np.logical_and.at(whole, row, known.ok[seg])
        key, times = np.unique(row * (1 << 32) + seg, return_counts=True)
        r, s = key >> 32, key & ((1 << 32) - 1)
        length = known.start[s + 1] - known.start[s]
        where = np.repeat(known.start[s] - (np.cumsum(length) - length), length) + np.arange(length.sum())
        found.append(_summed(np.repeat(r, length), known.pairs[where], np.repeat(times, length)))
        at = end
    row, pairs, times = _summed(*(np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in range(3)))
    counts[~whole] = 0
    ok = whole[row]
    return counts, [g if w else "" for g, w in zip(groups, whole, strict=True)], row[ok], pairs[ok], times[ok]


def align(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = TOKENIZERS) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups, pairs, times) of each row.

    groups is `a1,a2|b1;a3|b2,b3`, the ids of each group in order; pairs holds each linked pair of
    ids (a * SIDE + b) once, ascending, and times how many links it has.  A text that is null, empty, or that a
    tokenizer does not give back byte by byte has no tokens: zeros, '' and empty arrays.  Rows are treated one by
    one, so repeated rows get equal results.
    """
    files = load(df.sparkSession, path)
    schema = f"_qg_id {df.schema[id_col].dataType.simpleString()}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, pairs array<bigint>, times array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Pieces(Tokenizers(files.value))
        for batch in batches:
            for i in range(0, batch.num_rows, CHUNK_ROWS):
                b = batch.slice(i, CHUNK_ROWS)
                counts, groups, row, pairs, times = aligned(b.column(1).to_pylist(), known)
                ends = pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (pairs, times.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(counts[:, k]) for k in range(4)), pa.array(groups, pa.string()), *lists], ["_qg_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"])

    rows = df.select(F.col(id_col).alias("_qg_id"), F.col(text_col).alias("_qg_text")).mapInArrow(run, schema)
    return rows.withColumnRenamed("_qg_id", id_col)


def overlaps(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = TOKENIZERS, expand: bool = False) -> DataFrame:
    """(id, a_index, b_index, a_token, b_token, first_byte, last_byte, group) of each overlap of each row, in order.

    Indexes count tokens from 0; bytes are those of space + text, the last not included.  With
    ``expand``, all pairs of each group's two sides instead, without bytes.  Rows without tokens give none.
    """
    files = load(df.sparkSession, path)
    key = f"_qg_id {df.schema[id_col].dataType.simpleString()}"
    schema = f"{key}, a_index bigint, b_index bigint, a_token int, b_token int, first_byte bigint, last_byte bigint, group bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Tokenizers(files.value)
        for batch in batches:
            for n, text in enumerate(batch.column(1)):
                text = text.as_py()
                if not text:
                    continue
                (ids_a,), (ids_b,) = t.pieces([text])
                if not t.whole(text, ids_a, ids_b):
                    continue
                one, two = np.array(ids_a), np.array(ids_b)
                ends, a, b, group = intervals(np.cumsum(t.first_length[one]), np.cumsum(t.second_length[two]))
                first = np.concatenate([[0], ends[:-1]])
                if expand:
                    of_a = np.zeros(len(one), np.int64)
                    of_a[a] = group
                    a, b = products(a, b, group)
                    first = ends = np.ma.masked_all(len(a), np.int64)
                    group = of_a[a]
                for i in range(0, len(a), 1 << 16):
                    cut = slice(i, i + (1 << 16))
                    same = batch.column(0).take(pa.array(np.full(len(a[cut]), n)))
                    cols = [a[cut], b[cut], one[a[cut]].astype(np.int32), two[b[cut]].astype(np.int32), first[cut], ends[cut], group[cut]]
                    yield pa.RecordBatch.from_arrays([same, *map(pa.array, cols)], ["_qg_id", "a_index", "b_index", "a_token", "b_token", "first_byte", "last_byte", "group"])

    return df.select(F.col(id_col).alias("_qg_id"), F.col(text_col).alias("_qg_text")).mapInArrow(run, schema).withColumnRenamed("_qg_id", id_col)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, count, best) over all documents of ``align``: how many hold the pair linked, and whether that is its first id's highest count."""
    counts = checkpoint(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").count())
    most = counts.groupBy(F.expr(f"pair div {SIDE}").alias("a")).agg(F.max("count").alias("most"))
    return checkpoint(counts.withColumn("a", F.expr(f"pair div {SIDE}")).join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best")))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, groups and links of each document, with the links' counts over all documents; an empty table gives no rows."""
    rows = align(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.when(F.col("n_a") == 0, "").otherwise(F.sha2("groups", 256))
    # a row's number is written with it, so it stays when the file is read again
    rows = stored(rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest.alias("groups_sha256"), "pairs", "times", F.monotonically_increasing_id().alias("row")))
    counts = pair_counts(rows)
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("row", F.col("l.pairs").alias("pair"), F.col("l.times").cast("long").alias("times"))
    held = joined_counted(links, counts, "pair", counts.count(), BROADCAST_PAIRS)
    sums = held.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    out = rows.drop("pairs", "times").join(sums, "row", "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
