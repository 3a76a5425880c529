"""Suffix dedup: bytes covered by a long string that starts anywhere else go.

Prefix doubling sorts all positions by their first 1, 2, 4, ... bytes and reranks
until a position is unique or past the threshold.  Here strings grow in the same way,
and Spark ranks them round by round, but only at sampled places, chosen so that nothing is lost.

1. The owner of a window of MIN_LENGTH bytes is its least 128-byte string (the first of
   equal ones).  Equal windows have equal owners at equal offsets, so windows are
   compared under the name of their owner only.  An owner's windows start in one stretch;
   they and the bytes that they cover are its surroundings.  Names that stand once are unique and go.
2. Owners with equal surroundings are one kind.  Kinds that stand twice are
   repeated as a whole; the others need to be compared with the kinds of their name.
3. A crowded group of kinds is ranked by longer strings: its windows are cut into four
   stretches, and all windows of a stretch share 332, then 383, 396, 399 and at last 400
   bytes.  The rank of a stretch is that of its shorter string and the bytes next to it.
   Stretches that are unique go; those equal in all their bytes are repeated.
   A group that is small enough is ranked in memory.
4. All windows of an owner contain it, so the first and the last repeated one
   bound one removed run.  Runs are merged per text.

A text that has a copy is removed whole and stands for its copies elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import byte_chunks
from .common import checkpoint, maybe_broadcast, stored, table

MIN_LENGTH = 400
GRAM = 128
#: Of each so many bytes one sampled string is looked up for ``n_shared``.
PASSAGE = 256
#: Kinds of one group that are compared in memory (some 0.3 MB of text); Spark ranks a group with more by longer strings.
CROWDED = 512
FAN_OUT = 4
#: Bits of the filters, at most; a fuller filter costs time, not rows.
FILTER_BITS = 1 << 29
#: Repeated names up to this number are broadcast.
BROADCAST_NAMES = 200_000
#: Positions that are sampled at once; their offsets fill the low bits of a rank.
_BLOCK = 1 << 16
_LOW = np.uint64((1 << 17) - 1)


def doubled(h: np.ndarray, by: int) -> np.ndarray:
    """Names of twice the length (or of length + ``by``) from names of a length."""
    later = h[by:]
    return h[:-by] * np.uint64(0xC2B2AE3D27D4EB4F) + (later ^ (later >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)


def names(data: np.ndarray, length: int) -> np.ndarray:
    """The name of the ``length`` bytes from each position, by doubling."""
    h = data.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x165667B19E3779F9)
    n = 1
    while n < length:
        by = min(n, length - n)
        if by >= len(h):
            return np.zeros(0, np.uint64)
        h = doubled(h, by)
        n += by
    return h ^ (h >> np.uint64(31))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def owners(data: np.ndarray, offsets: np.ndarray, lengths: tuple[int, ...]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Names of all positions, and for each of ``lengths`` (position, first window, last window) of each owner.

    ``offsets`` bound the texts in ``data``; no window crosses a text's end.
    """
    n = len(data)
    name = np.zeros(n, np.uint64)
    own = [np.zeros(n, np.int64) for _ in lengths]
    most = max(lengths)
    for b in range(0, n, _BLOCK):
        h = names(data[b : b + _BLOCK + most - 1], GRAM)
        name[b : b + len(h)] = h
        rank = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        for o, length in zip(own, lengths, strict=True):
            if len(h) > length - GRAM:
                first = _least(rank, length - GRAM + 1)[:_BLOCK]
                o[b : b + len(first)] = (first & _LOW).astype(np.int64) + b
    ends = np.repeat(offsets[1:], np.diff(offsets))
    found = []
    for o, length in zip(own, lengths, strict=True):
        s = np.flatnonzero(np.arange(n) + length <= ends)
        at = o[s]
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (s[1:] != s[:-1] + 1)]) if len(s) else np.zeros(0, bool))
        found.append((at[new], s[new], s[np.concatenate([new[1:], [len(s)]]) - 1] if len(s) else s))
    return name, found


def _fresh(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(hashes, hashes, bytes, offsets) of stretches of the texts of at least ``least`` bytes that this task hasn't seen."""
    seen: set = set()
    for batch in batches:
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        take = []
        for i, key in enumerate(keys):
            if key not in seen:
                seen.add(key)
                take.append(i)
        t = batch.take(pa.array(take, pa.int64()))
        t = t.filter(pa.compute.greater_equal(pa.compute.binary_length(t.column(2)), least))
        a, b = (t.column(c).to_numpy() for c in (0, 1))
        for i, j, data, offsets in byte_chunks(t.column(2)):
            yield a[i:j], b[i:j], data, offsets


def _name_rows(rows: DataFrame, length: int) -> DataFrame:
    """(a, th, n): how often each sampled name stands in each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for th1, th2, data, offsets in _fresh(batches, length):
            name, [(at, _, _)] = owners(data, offsets, (length,))
            text = np.searchsorted(offsets, at, "right") - 1
            a = name[at].view(np.int64)
            order = np.lexsort((a, text))
            a, text = a[order], text[order]
            new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (text[1:] != text[:-1])])) if len(a) else np.zeros(0, np.int64)
            n = np.diff(np.concatenate([new, [len(a)]]))
            yield pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array((th1 ^ th2)[text[new]]), pa.array(n)], ["a", "th", "n"])

    return rows.mapInArrow(run, "a bigint, th bigint, n bigint")


def _bits(count: int) -> int:
    return min(FILTER_BITS, max(1 << 16, 1 << (16 * count).bit_length()))


def _filter(found: DataFrame, key: str, bits: int) -> np.ndarray:
    """The lowest bits of the keys in ``found`` as a bitmap; its size is bounded, whatever the input."""
    part = found.select(F.pmod(key, F.lit(bits)).alias("bit")).select(F.floor(F.col("bit") / 32768).cast("int").alias("page"), (F.col("bit") % 32768).alias("bit"))
    pages = part.groupBy("page").agg(F.bitmap_construct_agg("bit").alias("map")).collect()
    out = np.zeros(max(bits, 32768) // 8, np.uint8)
    for r in pages:
        out[r["page"] * 4096 : (r["page"] + 1) * 4096] = np.frombuffer(r["map"], np.uint8)
    return out


def _hits(bitmap: np.ndarray, key: np.ndarray, bits: int) -> np.ndarray:
    bit = (key.view(np.uint64) & np.uint64(bits - 1)).astype(np.int64)
    return bitmap[bit >> 3] >> (bit & 7).astype(np.uint8) & 1 == 1


_FOUND = {"th1": pa.int64(), "th2": pa.int64(), "a": pa.int64(), "k": pa.int64(), "c": pa.int32(), "n": pa.int32(), "left": pa.int32(), "lo": pa.int32(), "hi": pa.int32(), "around": pa.binary()}


def _found(rows: DataFrame, repeated, bits: int, length: int, passage: int) -> DataFrame:
    """What each text has under names that may be repeated.

    Rows with c > 0: c sampled places of the name a.  Rows with n > 0: a kind (a, k) with the bytes ``around`` it
    (null where this task gave them before), the owner being ``left`` bytes behind their start; n is 1 for one place,
    which covers [lo, hi), and 2 for a kind that the text has several times.
    What that kind covers are the rows with n = 0 and c = 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set = set()
        for th1, th2, data, offsets in _fresh(batches, passage):
            name, [(at, _, _), (p, lo, hi)] = owners(data, offsets, (passage, length))
            out: dict = {k: [] for k in _FOUND}

            def put(*row) -> None:
                for k, v in zip(out, row, strict=True):  # noqa: B023
                    out[k].append(v)  # noqa: B023

            at = at[_hits(repeated.value, name[at], bits)]
            text = np.searchsorted(offsets, at, "right") - 1
            order = np.lexsort((name[at], text))
            a, text = name[at][order].view(np.int64), text[order]
            new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (text[1:] != text[:-1])])) if len(a) else np.zeros(0, np.int64)
            shared = [th1[text[new]], th2[text[new]], a[new], np.diff(np.concatenate([new, [len(a)]]))]
            cols = [pa.array(c, t) for c, t in zip(shared, [pa.int64(), pa.int64(), pa.int64(), pa.int32()], strict=True)]
            none = [pa.nulls(len(new), t) for t in _FOUND.values()]
            zero = pa.array(np.zeros(len(new), np.int32))
            yield pa.RecordBatch.from_arrays([*cols[:3], none[3], cols[3], zero, *none[6:]], list(_FOUND))

            ok = _hits(repeated.value, name[p], bits)
            p, lo, hi = p[ok], lo[ok], hi[ok]
            text = np.searchsorted(offsets, p, "right") - 1
            whole, kinds, last = memoryview(data), {}, -1

            def flush(t: int, kinds: dict) -> None:
                own: list = []
                for (a, k), (left, w, starts) in kinds.items():
                    begin = int(offsets[t])  # noqa: B023
                    around = None
                    if (a, k) not in given:
                        given.add((a, k))
                        around = bytes(whole[begin + starts[0] : begin + starts[0] + w + length - 1])  # noqa: B023
                    one = len(starts) == 1
                    put(th1[t], th2[t], a, k, 0, 1 if one else 2, left, starts[0] if one else None, starts[0] + w + length - 1 if one else None, around)  # noqa: B023
                    if not one:
                        own += [(s, s + w + length - 1) for s in starts]
                runs: list = []
                for s, e in sorted(own):
                    if runs and s <= runs[-1][1]:
                        runs[-1][1] = max(e, runs[-1][1])
                    else:
                        runs.append([s, e])
                for s, e in runs:
                    put(th1[t], th2[t], None, None, 0, 0, None, s, e, None)  # noqa: B023

            for t, a, q, s, e in zip(text.tolist(), name[p].view(np.int64).tolist(), p.tolist(), lo.tolist(), hi.tolist(), strict=True):
                if t != last:
                    flush(last, kinds)
                    kinds, last = {}, t
                k = xxhash.xxh64_intdigest(whole[s : e + length], q - s)
                k -= (1 << 64) * (k >> 63)
                kinds.setdefault((a, k), (q - s, e - s + 1, []))[2].append(s - int(offsets[t]))
            flush(last, kinds)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), _FOUND.values(), strict=True)], list(_FOUND))

    return rows.mapInArrow(run, ", ".join(f"{k} {({pa.int64(): 'bigint', pa.int32(): 'int', pa.binary(): 'binary'})[t]}" for k, t in _FOUND.items()))


def _in_memory(rows: DataFrame, length: int) -> DataFrame:
    """(a, k, x, y): the first and the last repeated window of the kinds that stand once, group by group as they arrive.

    ``rows``: g, a, k, n, base, x0, bytes; groups are not crowded.
    """

    def marked(t: pa.Table) -> pa.RecordBatch:
        g, n, x0, base = (t.column(c).to_numpy() for c in ("g", "n", "x0", "base"))
        bound = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        size = np.diff(np.concatenate([bound, [len(g)]]))
        alive = np.repeat((size > 1) & (np.minimum.reduceat(n, bound) == 1), size)
        keep = np.flatnonzero(alive)
        if not len(keep):
            return pa.RecordBatch.from_arrays([pa.array([], s) for s in (pa.int64(), pa.int64(), pa.int32(), pa.int32())], ["a", "k", "x", "y"])
        t, n, x0, base, run = t.take(pa.array(keep)), n[keep], x0[keep], base[keep], np.repeat(np.arange(len(size)), size)[keep]
        bytes_ = t.column("bytes").to_pylist()
        width = np.array([len(b) for b in bytes_], np.int64)
        name = names(np.frombuffer(b"".join(bytes_), np.uint8), length)
        m = width - length + 1
        row = np.repeat(np.arange(len(m)), m)
        within = np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m)
        w = name[np.repeat(np.cumsum(width) - width, m) + within]
        offset = within + x0[row]
        key = (w ^ (run[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93) + offset.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
        order = np.argsort(key, kind="stable")
        x, y = order[:-1], order[1:]
        same = (key[x] == key[y]) & (w[x] == w[y]) & (run[row[x]] == run[row[y]]) & (offset[x] == offset[y])
        hit = np.zeros(len(row), bool)
        hit[x[same]] = hit[y[same]] = True
        first, last = np.full(len(m), 1 << 30), np.full(len(m), -1)
        np.minimum.at(first, row[hit], offset[hit])
        np.maximum.at(last, row[hit], offset[hit])
        good = np.flatnonzero((last >= 0) & (n == 1))
        ids = t.select(["a", "k"]).take(pa.array(good)).combine_chunks()
        cols = [ids.column(0).combine_chunks(), ids.column(1).combine_chunks(), pa.array((first - base)[good].astype(np.int32)), pa.array((last - base)[good].astype(np.int32))]
        return pa.RecordBatch.from_arrays(cols, ["a", "k", "x", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None  # rows whose group may go on in the next batch
        for batch in batches:
            for i in range(0, len(batch), 2048):
                t = pa.Table.from_batches([batch.slice(i, 2048)])
                t = pa.concat_tables([kept, t]) if kept is not None else t
                g = t.column("g").to_numpy()
                end = int(np.searchsorted(g, g[-1]))
                kept = t.slice(end)
                if end:
                    yield marked(t.slice(0, end))
        if kept is not None and len(kept):
            yield marked(kept)

    return rows.select("g", "a", "k", "n", "base", "x0", "bytes").repartition("g").sortWithinPartitions("g").mapInArrow(run, "a bigint, k bigint, x int, y int")


def _ranked(nodes: DataFrame, size: int, length: int) -> tuple[DataFrame, DataFrame]:
    """One round: stretches of ``size`` windows of crowded groups, ranked by the bytes that all of their windows share.

    Gives (marks, nodes): the stretches of kinds that stand once and are repeated as a whole, and
    what is left to be compared, one of each set of equal stretches.
    """
    reach = length - GRAM
    x1 = F.col("x0") + F.octet_length("bytes") - length
    rows = nodes.withColumn("cell", F.explode(F.sequence(F.floor(F.col("x0") / size).cast("int"), F.floor(x1 / size).cast("int"))))
    rows = rows.withColumns({"from": F.greatest("x0", F.col("cell") * size), "to": F.least(x1, F.col("cell") * size + size - 1), "end": F.least(F.lit(reach), F.col("cell") * size + size - 1)})
    shared = F.expr(f"substring(bytes, end - x0 + 1, cell * {size} + {length} - end)")
    rows = rows.select(
        F.xxhash64("g", "cell", shared).alias("g"), "a", "k", "n", "base", F.col("from").alias("x0"), F.col("to").alias("x1"), F.expr(f"substring(bytes, from - x0 + 1, to - from + {length})").alias("bytes")
    ).withColumn("all", F.xxhash64(F.lit(1), "x0", "bytes"))
    kinds = stored(rows.groupBy("g", "all").agg(F.sum("n").alias("n"), F.min(F.struct("a", "k", "base", "x0")).alias("one"), F.first("bytes").alias("bytes")))
    marks = rows.filter("n = 1").join(kinds.filter("n > 1").select("g", "all"), ["g", "all"], "left_semi").select("a", "k", (F.col("x0") - F.col("base")).alias("x"), (F.col("x1") - F.col("base")).alias("y"))
    left = kinds.select("g", F.col("one.a").alias("a"), F.col("one.k").alias("k"), F.least(F.col("n"), F.lit(2)).cast("int").alias("n"), F.col("one.base").alias("base"), F.col("one.x0").alias("x0"), "bytes")
    return marks, left


def _marks(kinds: DataFrame, length: int) -> DataFrame:
    """(a, k, x, y): which windows of each kind are repeated, from the first to the last; ``kinds``: a, k, n, left, around."""
    reach = length - GRAM
    base = F.lit(reach) - F.col("left")
    done = [kinds.filter("n > 1").select("a", "k", F.lit(0).alias("x"), (F.octet_length("around") - length).alias("y"))]
    nodes = kinds.select(F.col("a").alias("g"), "a", "k", F.least(F.col("n"), F.lit(2)).cast("int").alias("n"), base.alias("base"), base.alias("x0"), F.col("around").alias("bytes"))
    size = reach + 1
    while True:
        groups = nodes.groupBy("g").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least"))
        crowded = checkpoint(groups.filter((F.col("kinds") > CROWDED) & (F.col("least") == 1)).select("g"))
        count = crowded.count()
        if size > 1:
            crowd = maybe_broadcast(crowded, count, BROADCAST_NAMES)
            done.append(_in_memory(nodes.join(crowd, "g", "left_anti") if count else nodes, length))
        if not count:
            break
        size = -(-size // FAN_OUT)
        marks, nodes = _ranked(nodes.join(crowd, "g", "left_semi"), size, length)
        done.append(marks)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.groupBy("a", "k").agg(F.min("x").alias("x"), F.max("y").alias("y"))


def repeated_spans(texts: DataFrame, length: int = MIN_LENGTH, passage: int = PASSAGE) -> DataFrame:
    """(th1, th2, spans, n_shared): merged removed runs [a, b) of the texts that have any, and how many sampled
    places of the text stand elsewhere; ``texts``: th1, th2, text (binary)."""
    spark = texts.sparkSession
    passage = min(passage, length)
    if passage < GRAM:
        raise ValueError(f"strings of under {GRAM} bytes can't be compared")
    seen = _name_rows(texts, passage).groupBy("a").agg(F.min("th").alias("lo"), F.max("th").alias("hi"), F.max("n").alias("own"))
    twice = checkpoint(seen.filter("lo <> hi or own > 1").select("a"))
    count = twice.count()
    bits = _bits(count)
    found = stored(_found(texts, spark.sparkContext.broadcast(_filter(twice, "a", bits)), bits, length, passage))
    shared = found.filter("c > 0").join(maybe_broadcast(twice, count, BROADCAST_NAMES), "a", "left_semi").groupBy("th1", "th2").agg(F.sum("c").alias("n_shared"))

    kinds = stored(found.filter("n > 0").groupBy("a", "k").agg(F.sum("n").alias("n"), F.first("left").alias("left"), F.first("around", True).alias("around")))
    places = found.filter("n = 1").select("th1", "th2", "a", "k", "lo").join(_marks(kinds, length), ["a", "k"])
    runs = places.select("th1", "th2", (F.col("lo") + F.col("x")).alias("a"), (F.col("lo") + F.col("y") + length).alias("b"))
    runs = runs.unionByName(found.filter("n = 0 and c = 0").select("th1", "th2", F.col("lo").alias("a"), F.col("hi").alias("b")))
    span = F.struct("a", "b")

    def merge(acc, s):
        top = F.get(acc, F.size(acc) - 1)
        return F.when((F.size(acc) > 0) & (top["b"] >= s["a"]), F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(top["a"].alias("a"), F.greatest(top["b"], s["b"]).alias("b"))))).otherwise(F.concat(acc, F.array(s)))

    spans = runs.groupBy("th1", "th2").agg(F.aggregate(F.array_sort(F.collect_set(span)), F.array().cast("array<struct<a:int,b:int>>"), merge).alias("spans"))
    return spans.join(shared, ["th1", "th2"], "full_outer")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = MIN_LENGTH, passage: int = PASSAGE) -> DataFrame:
    """One row per input row: id, n_bytes, spans (removed byte runs), kept (the remaining bytes, binary), n_shared.

    Null texts are empty.  Texts under ``length`` bytes lose nothing, but for copies.  Of repeated
    rows and other copies of at least ``length`` bytes each is removed whole.

    n_shared tells of shorter passages, which stay: of each ``passage`` bytes at least one 128-byte string is
    sampled, and n_shared says at how many places the text has one that also stands in another text, or twice in
    this one.  It is above 0 for each text with a string of ``passage`` bytes that another text has.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = df.select(F.col(id_col).alias("_qg_id"), text.alias("text")).withColumn("th1", F.xxhash64("text")).withColumn("th2", F.xxhash64(F.lit(1), "text"))
    copies = rows.filter(F.octet_length("text") >= length).groupBy("th1", "th2").count().filter("count > 1").select("th1", "th2", F.lit(True).alias("copied"))
    spans = repeated_spans(rows.select("th1", "th2", "text"), length, passage)
    gone = checkpoint(copies.join(spans, ["th1", "th2"], "full_outer"))
    bits = _bits(gone.count())
    touched = df.sparkSession.sparkContext.broadcast(_filter(gone, "th1", bits))

    def split(wanted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(_hits(touched.value, batch.column(2).to_numpy(), bits) == wanted))

        return run

    kind = df.schema[id_col].dataType.simpleString()
    shape = f"_qg_id {kind}, text binary, th1 bigint, th2 bigint"
    none = F.array().cast("array<struct<a:int,b:int>>")
    # texts that nothing was found in are not shuffled
    plain = rows.mapInArrow(split(False), shape).select("_qg_id", F.octet_length("text").cast("long").alias("n_bytes"), none.alias("spans"), F.col("text").alias("kept"), F.lit(0).cast("long").alias("n_shared"))
    joined = rows.mapInArrow(split(True), shape).join(gone, ["th1", "th2"], "left")
    joined = joined.select("_qg_id", "text", F.when(F.col("copied"), F.array(F.struct(F.lit(0).alias("a"), F.octet_length("text").alias("b")))).otherwise(F.coalesce("spans", none)).alias("spans"), F.coalesce("n_shared", F.lit(0)).cast("long").alias("n_shared"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for t, spans in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                data = t.as_buffer()
                at, parts = 0, []
                for s in spans:
                    parts.append(data[at : s["a"]].to_pybytes())
                    at = s["b"]
                kept.append(b"".join([*parts, data[at:].to_pybytes()]))
            size = pa.array([len(t.as_buffer()) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, batch.column(2), pa.array(kept, pa.binary()), batch.column(3)], ["_qg_id", "n_bytes", "spans", "kept", "n_shared"])

    cut = joined.mapInArrow(run, f"_qg_id {kind}, n_bytes bigint, spans array<struct<a:int,b:int>>, kept binary, n_shared bigint")
    return plain.unionByName(cut).withColumnRenamed("_qg_id", id_col)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removed bytes of every whole text; null is empty, copies of 400 bytes or more go whole, an empty table gives no rows.

    n_shared, beyond the contract, tells of passages from 256 bytes on (see ``remove_repeats``).
    """
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["b"] - s["a"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_shared")
