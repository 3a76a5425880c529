"""SimHash near-dedup by covering locality-sensitive hashing.

Each text gets a 64-bit SimHash of its word shingles.  Equal fingerprints are
one node from then on.  Structured bit masks (one for each non-zero vector of
r+1 bits) guarantee that two fingerprints within radius r agree on all bits of
some mask; so only fingerprints that share a masked value are compared.  A
crowded masked value is cut again by masks on its free bits, after which at most
2^14 different fingerprints can share a key, whatever the input.  Links become
components by alternating star contractions, all as joins.

Where a least Jaccard similarity is given, texts are linked by their sets of
five-word shingles too: MinHash bands propose candidates (a pair at 0.8 shares
none of the bands with a chance of 7 in a million), whose exact similarity counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, maybe_broadcast, stored, table

SHINGLE = 3
RADIUS = 3
#: Fingerprints under one masked value before it is cut again.
CROWDED = 1024
BLOCK = 1 << 16
#: Words of the shingles whose sets are compared; bands, and minima in each.
SET_SHINGLE = 5
BANDS, BAND_ROWS = 30, 5
#: Sets that are compared with one another in one task; what bands join up beyond that is dealt into blocks.
BLOCK_SETS = 512
#: Candidates up to this number are broadcast.
BROADCAST_TEXTS = 200_000
_FACTORS = np.random.default_rng(5).integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(data: bytes, shingle: int = SET_SHINGLE) -> np.ndarray:
    """The XXH64 of each distinct shingle, ascending; no words: empty."""
    tokens = data.lower().split()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(tokens[i : i + shingle]), 42) for i in range(max(1, len(tokens) - shingle + 1) if tokens else 0)), np.uint64))


def set_keys(hashes: np.ndarray) -> tuple[int, list[int]]:
    """A name of the set and the keys of its bands, as signed longs; an empty set has no bands."""
    if not len(hashes):
        return 0, []
    least = np.full(len(_FACTORS), (1 << 64) - 1, np.uint64)
    for i in range(0, len(hashes), 4096):
        least = np.minimum(least, (hashes[i : i + 4096, None] * _FACTORS).min(axis=0))
    rows = least.reshape(BANDS, BAND_ROWS)
    digest = xxhash.xxh64_intdigest
    return _signed(digest(hashes.tobytes(), 42)), [_signed(digest(r.tobytes(), v)) for v, r in enumerate(rows)]


def simhash(data: bytes, shingle: int = SHINGLE) -> int:
    """A bit is 1 if set in over half the shingles' XXH64 (seed 42); no words: 0."""
    tokens = data.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= shingle:
        starts, ends = [0], [len(joined)]
    else:
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        stop = np.cumsum(lengths + 1) - 1
        starts, ends = (stop - lengths)[: len(tokens) - shingle + 1].tolist(), stop[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for i in range(0, len(starts), BLOCK):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[i : i + BLOCK], ends[i : i + BLOCK], strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts), bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, sets: bool = False) -> DataFrame:
    """(_qg_id, _qg_th, fp): id, text hash and SimHash (as a signed long) of each row; null texts have no words.

    With ``sets`` also node and keys: the name and the band keys of the shingle set.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("_qg_id"), F.xxhash64(text).alias("_qg_th"), text.cast("binary").alias("_qg_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([simhash(t.as_py(), shingle) for t in b.column(2)], np.uint64).view(np.int64)
            cols, names = [b.column(0), b.column(1), pa.array(fp)], ["_qg_id", "_qg_th", "fp"]
            if sets:
                found = [set_keys(shingle_set(t.as_py())) for t in b.column(2)]
                cols += [pa.array([n for n, _ in found], pa.int64()), pa.array([k for _, k in found], pa.list_(pa.int64()))]
                names += ["node", "keys"]
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"_qg_id {df.schema[id_col].dataType.simpleString()}, _qg_th bigint, fp bigint"
    return rows.mapInArrow(run, schema + (", node bigint, keys array<bigint>" if sets else ""))


def covering_masks(bits: list[int], radius: int) -> list[int]:
    """Masks over ``bits`` such that any ``radius`` of them are all outside some mask."""
    vectors = (1 << (radius + 1)) - 1
    return [sum(1 << b for i, b in enumerate(bits) if bin((i % vectors + 1) & v).count("1") % 2) for v in range(1, vectors + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of signed fingerprints; counted unsigned, as numpy counts the bits of a negative number's absolute value."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def _linked(rows: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) that join up what is within ``radius`` under each key; ``rows``: mask, key, fp, all distinct.

    Keys of up to 8 give each close pair; larger ones give a star for each of
    their components, so links never outnumber the rows by more than 3.5.
    """

    def big(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, right, rest = [], [], f
        while len(rest) > 1:
            seed, front, rest = rest[0], rest[:1], rest[1:]
            while len(front) and len(rest):
                near = np.zeros(len(rest), bool)
                step = max(1, (1 << 21) // len(rest))
                for i in range(0, len(front), step):
                    near |= (differing(front[i : i + step, None], rest[None, :]) <= radius).any(axis=0)
                front, rest = rest[near], rest[~near]
                left.append(np.full(len(front), seed, np.int64))
                right.append(front)
        return np.concatenate(left or [f[:0]]), np.concatenate(right or [f[:0]])

    def links(mask: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        new = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
        bounds = np.concatenate([[0], new, [len(fp)]])
        sizes = np.diff(bounds)
        run = np.repeat(np.arange(len(sizes)), sizes)
        small = sizes[run] <= 8
        left, right = [], []
        for lag in range(1, 8):
            a, b = fp[:-lag], fp[lag:]
            ok = (run[:-lag] == run[lag:]) & small[lag:]
            ok[ok] = differing(a[ok], b[ok]) <= radius
            left.append(a[ok])
            right.append(b[ok])
        for r in np.flatnonzero(sizes > 8):
            a, b = big(fp[bounds[r] : bounds[r + 1]])
            left.append(a)
            right.append(b)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None  # the last key's rows, as more may come
        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if kept:
                cols = [np.concatenate(x) for x in zip(kept, cols, strict=True)]
            n = len(cols[0])
            if not n:
                continue
            same = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
            first = n - int(same[::-1].argmin() if not same.all() else n)
            kept = [c[first:] for c in cols]
            if first > 1:
                yield links(*[c[:first] for c in cols])
        if kept and len(kept[0]) > 1:
            yield links(*kept)

    return rows.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp").mapInArrow(run, "a bigint, b bigint").distinct()


def links(nodes: DataFrame, radius: int = RADIUS, crowded: int = CROWDED) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of ``nodes`` (distinct fp) within ``radius`` bits."""
    masks = covering_masks(list(range(64)), radius)
    keys = F.array(*[F.struct(F.lit(v).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("key")) for v, m in enumerate(masks)])
    rows = nodes.select("fp", F.inline(keys))
    hot = checkpoint(rows.groupBy("mask", "key").count().filter(F.col("count") > crowded).select("mask", "key"))
    if hot.isEmpty():
        return _linked(rows.select("mask", "key", "fp"), radius)
    finer = None
    for v, m in enumerate(masks):
        subs = covering_masks([b for b in range(64) if not m >> b & 1], radius)
        one = F.array(*[F.struct(F.lit(len(masks) + v * len(subs) + u).alias("mask2"), F.col("fp").bitwiseAND(F.lit(_signed(m | s)).cast("long")).alias("key2")) for u, s in enumerate(subs)])
        finer = F.when(F.col("mask") == v, one) if finer is None else finer.when(F.col("mask") == v, one)
    cold = rows.join(hot, ["mask", "key"], "left_anti").select("mask", "key", "fp")
    again = rows.join(hot, ["mask", "key"], "left_semi").select("fp", F.inline(finer)).select(F.col("mask2").alias("mask"), F.col("key2").alias("key"), "fp")
    return _linked(cold.unionByName(again), radius)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b); the root is the component's least node.

    Large and small stars alternate until nothing changes; each round is two
    aggregations and joins, cut by a checkpoint, so no component is gathered.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = checkpoint(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = state(e)
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = checkpoint(moved.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
        now = state(e)
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _starred(rows: DataFrame) -> DataFrame:
    """Links (a, b) from each node to the first node with the same key; ``rows``: key, node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the last key and its first node
        for b in batches:
            key, node = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            if last:
                key, node = np.concatenate([[last[0]], key]), np.concatenate([[last[1]], node])
            if not len(key):
                continue
            new = np.concatenate([[True], key[1:] != key[:-1]])
            first = node[np.flatnonzero(new)[np.cumsum(new) - 1]]
            last = key[-1], first[-1]
            ok = first != node
            yield pa.RecordBatch.from_arrays([pa.array(node[ok]), pa.array(first[ok])], ["a", "b"])

    return rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "a bigint, b bigint").distinct()


def similar(sets: list[np.ndarray], least: float) -> Iterator[tuple[int, int]]:
    """Pairs that join up all sets whose Jaccard similarity is ``least`` or more: a star for each component."""
    sizes = np.array([len(s) for s in sets])
    _, names = np.unique(np.concatenate(sets), return_inverse=True)
    parts = np.split(names, np.cumsum(sizes)[:-1])
    mark = np.zeros(int(names.max()) + 1, bool)
    rest = list(range(len(sets)))
    while len(rest) > 1:
        seed, front = rest[0], rest[:1]
        rest = rest[1:]
        while front and rest:
            one = front.pop()
            mark[parts[one]] = True
            n = sizes[rest]
            shared = np.add.reduceat(mark[np.concatenate([parts[i] for i in rest])], np.concatenate([[0], np.cumsum(n)[:-1]]), dtype=np.int64)
            mark[parts[one]] = False
            near = shared >= least * (n + sizes[one] - shared)
            front += [i for i, ok in zip(rest, near, strict=True) if ok]
            yield from ((seed, i) for i, ok in zip(rest, near, strict=True) if ok)
            rest = [i for i, ok in zip(rest, near, strict=True) if not ok]


def similar_links(df: DataFrame, rows: DataFrame, id_col: str, text_col: str, least: float) -> DataFrame:
    """Links (a, b) of fingerprints whose texts' shingle sets have a Jaccard similarity of ``least`` or more.

    ``rows`` are those of ``fingerprints`` with sets.  Candidates that bands join
    up, each set once, are compared exactly, at most some BLOCK_SETS of one group (or
    twice that, of two blocks) in one task.
    """
    known = rows.filter(F.size("keys") > 0)
    sets = checkpoint(known.groupBy("node").agg(F.min(F.struct("_qg_id", "_qg_th", "fp")).alias("one"), F.first("keys").alias("keys")))
    equal = known.join(sets.select("node", F.col("one.fp").alias("b")), "node").filter("fp <> b").select(F.col("fp").alias("a"), "b").distinct()
    roots = components(_starred(sets.select(F.explode("keys").alias("key"), "node")))
    chosen = checkpoint(roots.join(sets, "node").select("root", F.col("one._qg_id").alias("_qg_id"), F.col("one._qg_th").alias("_qg_th"), F.col("one.fp").alias("fp")))
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = df.select(F.col(id_col).alias("_qg_did"), F.xxhash64(text).alias("_qg_dth"), text.cast("binary").alias("_qg_text"))
    same = F.col("_qg_id").eqNullSafe(F.col("_qg_did")) & (F.col("_qg_th") == F.col("_qg_dth"))
    texts = texts.join(maybe_broadcast(chosen, chosen.count(), BROADCAST_TEXTS), same).select("root", "fp", "_qg_text")
    large = checkpoint(chosen.groupBy("root").count().filter(F.col("count") > BLOCK_SETS).select("root", "count"))
    count = large.count()
    if not count:
        return equal.unionByName(_verified(texts, ["root"], least))
    large = maybe_broadcast(large, count, BROADCAST_TEXTS)
    found = equal.unionByName(_verified(texts.join(large, "root", "left_anti"), ["root"], least))
    hot = stored(texts.join(large.select("root"), "root"))
    # within blocks first, then what stands for their components: copies of one text are one component by now
    within = checkpoint(_verified(_blocks(hot), ["root", "block"], least))
    named = components(within)
    seeds = hot.join(named.filter("node <> root").select(F.col("node").alias("fp")), "fp", "left_anti")
    across = checkpoint(_verified(_paired(seeds), ["root", "block", "other"], least))
    # only where components are left apart, blocks are compared with blocks
    named = components(within.unionByName(across)).select(F.col("node").alias("fp"), F.col("root").alias("name"))
    names = hot.select("root", "fp").join(named, "fp", "left").groupBy("root").agg(F.min(F.coalesce("name", "fp")).alias("lo"), F.max(F.coalesce("name", "fp")).alias("hi"))
    apart = checkpoint(names.filter("lo <> hi").select("root"))
    rest = _verified(_paired(hot.join(apart, "root", "left_semi")), ["root", "block", "other"], least)
    return found.unionByName(within).unionByName(across).unionByName(rest)


def _blocks(rows: DataFrame) -> DataFrame:
    """``rows`` (root, fp, text) with a block of each: a root's are dealt into blocks of about BLOCK_SETS."""
    sizes = rows.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK_SETS).cast("int").alias("blocks"))
    return rows.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))


def _paired(rows: DataFrame) -> DataFrame:
    """``rows`` under each pair of their block with another, or under it alone if there is one only: any two meet."""
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j")
    return _blocks(rows).select("root", "fp", "_qg_text", "block", other).select("root", "fp", "_qg_text", F.least("block", "j").alias("block"), F.greatest("block", "j").alias("other"))


def _verified(texts: DataFrame, key: list[str], least: float) -> DataFrame:
    """Links (a, b) that join up what is similar among the texts of each key, compared in one task."""

    def links(fps: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        found = [(fps[a], fps[b]) for a, b in similar(sets, least)] if len(fps) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, fps, sets = None, [], []
        for b in batches:
            for k, f, t in zip(*b.columns, strict=True):
                if k.as_py() != last:
                    yield links(fps, sets)
                    last, fps, sets = k.as_py(), [], []
                fps.append(f.as_py())
                sets.append(shingle_set(t.as_py()))
        yield links(fps, sets)

    return texts.select(F.xxhash64(*key).alias("_qg_key"), "fp", "_qg_text").repartition("_qg_key").sortWithinPartitions("_qg_key").mapInArrow(run, "a bigint, b bigint")


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, jaccard: float | None = None) -> DataFrame:
    """One row per input row: id, text_hash, fp (signed long), component_id, and the row that stands for the component.

    component_id is the least id among all rows reachable by links; null ids
    never name a component unless there is no other.  keeper_id and keeper_hash
    name one row of each component.  Texts without words share fingerprint 0.
    Texts whose five-word shingles have at least the similarity ``jaccard`` are linked too.
    """
    rows = checkpoint(fingerprints(df, id_col, text_col, shingle, jaccard is not None))
    first = F.min(F.struct(F.col("_qg_id").isNull().alias("none"), F.col("_qg_id").alias("id"), F.col("_qg_th").alias("th")))
    nodes = checkpoint(rows.groupBy("fp").agg(first.alias("first")))
    close = links(nodes.select("fp"), radius)
    if jaccard is not None:
        close = close.unionByName(similar_links(df, rows, id_col, text_col, jaccard))
    roots = components(close).withColumnRenamed("node", "fp")
    nodes = checkpoint(nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    named = nodes.groupBy("root").agg(F.min("first").alias("least"))
    named = nodes.select("fp", "root").join(named, "root").select("fp", "least")
    return rows.join(named, "fp").select(F.col("_qg_id").alias(id_col), F.col("_qg_th").alias("text_hash"), "fp", F.col("least.id").alias("component_id"), F.col("least.id").alias("keeper_id"), F.col("least.th").alias("keeper_hash"))


def dedup_near(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, jaccard: float | None = None) -> DataFrame:
    """``df`` with one row of each component; the columns stay.

    Of several rows with the keeper's id and text, the one whose columns together have the least hash stays.
    """
    groups = near_groups(df, id_col, text_col, shingle, radius, jaccard)
    keep = checkpoint(groups.filter(F.col(id_col).eqNullSafe(F.col("keeper_id")) & (F.col("text_hash") == F.col("keeper_hash"))).groupBy(F.col(id_col).alias("_qg_id"), F.col("text_hash").alias("_qg_th")).count())
    same = F.col(id_col).eqNullSafe(F.col("_qg_id")) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col("_qg_th"))
    several = keep.filter("count > 1").drop("count")
    if several.isEmpty():
        return df.join(keep, same, "left_semi")
    one = df.join(keep.filter("count = 1"), same, "left_semi")
    rows = df.join(several, same).groupBy("_qg_id", "_qg_th").agg(F.min_by(F.struct(*[F.col(c) for c in df.columns]), F.xxhash64(*df.columns)).alias("_qg_row"))
    return one.unionByName(rows.select("_qg_row.*"))


def op4_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every whole text; null has no words, repeated rows share both, an empty table gives no rows."""
    groups = near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
