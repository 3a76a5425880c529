"""Join of texts whose sets of word n-grams are similar, by vertical partitioning.

The global order of n-grams is that of their hashes, and cutting it into fragments cuts
each set into segments.

1. Equal sets are one class; from then on each class counts once.
2. Two similar sets differ in few n-grams, and each of those touches one fragment, so nearly all of
   their segments are equal.  Of n n-grams at most n/4 (at a similarity of 0.8) can be touched, so
   any n/4+1 segments that a fixed order puts first hold one that both have: the larger
   segments come first.  The number of fragments follows the set's size, in ranges; a set
   near the lower end of its range also meets the range below.  A set with too few
   segments is cut again by another order, and in the end by single n-grams.
3. Each segment that several classes have makes a group.  First, each class is compared with the one class of
   its groups that is in most groups, as it is like many; what is then apart from its group's largest
   component meets the first class of that.  Groups whose members are then in one component are done.  In
   the others, all pairs of different components are bounded by parities of their
   n-grams (each n-gram flips one bit, so two sets differ in at least as many n-grams as
   bits), and what may be similar is compared.
4. A pair is compared by fragments of the order: each fragment's overlap is counted on
   its own, in different tasks, and summed by pair.

No pair is taken for similar without its exact sum, and none that is similar is missed; within a
component, pairs that would only join what is joined are not compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, maybe_broadcast, stored, table
from .near_dups import components

SHINGLE = 5
#: A pair links at PERCENT * |union| <= 100 * |intersection|.
PERCENT = 80
#: Fragments of which the overlaps are counted separately.
FRAGMENTS = 8
#: Members that are compared with one class, or with one another, in one task.
BLOCK = 512
#: Cuts of the order that are tried before single n-grams.
CUTS = 3
#: A group is dealt out if it holds more than this share of all its rows; so there are at most 1/HOT_SHARE such groups.
HOT_SHARE, HOT_SAMPLE, HOT_LEAST = 1 / 2000, 16, 64
BROADCAST_ROWS = 200_000
#: Ranges of sizes grow by this factor, so a set lies in two ranges at most.
RANGE = 1.5
_ODD = np.random.default_rng(12).integers(0, 1 << 63, 2 * max(SHINGLE, CUTS + 3), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray, seed: int = 0) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _ODD[seed]
    return (h ^ (h >> np.uint64(29))) * _ODD[-1]


def shingles(data: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of the distinct n-grams, ascending; fewer words are one n-gram, no words none."""
    tokens = data.lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(t, 42) for t in tokens), np.uint64, len(tokens))
    n = min(shingle, len(tokens))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = (out ^ (out >> np.uint64(31))) * _ODD[i] + h[i : len(h) - n + 1 + i]
    return np.unique(_mixed(out))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def node_of(s: np.ndarray) -> int:
    return _signed(xxhash.xxh64_intdigest(s.tobytes(), 12)) if len(s) else 0


def _range(n: int) -> int:
    """The range of a size: range r holds sizes from its low end to below that of r + 1."""
    r = int(np.log(n) / np.log(RANGE))
    while _low(r + 1) <= n:
        r += 1
    while _low(r) > n:
        r -= 1
    return r


def _low(r: int) -> int:
    return int(np.ceil(RANGE**r - 1e-9))


def _segments(s: np.ndarray, fragments: int) -> tuple[np.ndarray, np.ndarray]:
    """(digest, size) of the segments of ascending ``s``, without the empty ones; the fragment is in the digest."""
    f = ((s >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)
    starts = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]]))
    return _mixed(np.add.reduceat(_mixed(s, 1), starts) + _mixed(f[starts] + np.uint64(1), 2)), np.diff(np.concatenate([starts, [len(s)]]))


def keys(s: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Keys of a set such that any two similar sets share one.

    A set of n n-grams and a partner of m, n <= m <= 100 n / percent, differ in at most
    (100 - percent) (n + m) / (100 + percent); so for the partner's largest size.
    """
    n = len(s)
    if not n:
        return np.zeros(0, np.uint64)
    own, found = _range(n), []
    ranges = [(own, (100 - percent) * (n + 100 * n // percent) // (100 + percent))]
    if own and (_low(own) - 1) * 100 >= percent * n:  # partners in the range below are smaller
        ranges.append((own - 1, (100 - percent) * (n + _low(own) - 1) // (100 + percent)))
    for r, touched in ranges:
        if not touched:  # only equal sets are similar, and they are one class
            continue
        top = _low(r + 1) - 1
        fragments = int(1.3 * ((100 - percent) * (top + 100 * top // percent) // (100 + percent) + 1))
        for cut in range(CUTS + 1):
            if cut < CUTS:
                token, size = _segments(np.sort(_mixed(s, cut + 2)) if cut else s, fragments)
            else:
                token, size = _mixed(s, 1), np.ones(n, np.int64)
            salt = _mixed(np.array([r * (CUTS + 1) + cut + 1], np.uint64), 2)
            order = np.lexsort((token, -size))[: touched + 1]
            found.append(_mixed(token[order] ^ salt, 1))
            if len(token) > touched:
                break
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def _by_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.col(id_col).alias("_qg_id"), F.xxhash64(text).alias("_qg_th"), text.cast("binary").alias("_qg_text"))


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_qg_id, _qg_th, node, n) of each row: id, text hash, class of its set, and the set's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, n = [], []
            for t in b.column(2):
                s = shingles(t.as_py())
                node.append(node_of(s))
                n.append(len(s))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(node, pa.int64()), pa.array(n, pa.int64())], ["_qg_id", "_qg_th", "node", "n"])

    return _by_text(df, id_col, text_col).mapInArrow(run, f"_qg_id {df.schema[id_col].dataType.simpleString()}, _qg_th bigint, node bigint, n bigint")


def _keyed(texts: DataFrame, percent: int) -> DataFrame:
    """(key, node) of each class; a task gives a class once, so copies don't add up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            left, right, size = [], [], 0
            for t in batch.column(2):
                s = shingles(t.as_py())
                node = node_of(s)
                if not len(s) or node in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(node)
                left.append(keys(s, percent))
                right.append(np.full(len(left[-1]), node, np.int64))
                size += len(left[-1])
                if size > 1 << 16:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left).view(np.int64)), pa.array(np.concatenate(right))], ["key", "node"])
                    left, right, size = [], [], 0
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left).view(np.int64)), pa.array(np.concatenate(right))], ["key", "node"])

    return texts.mapInArrow(run, "key bigint, node bigint")


def _grouped(rows: DataFrame) -> DataFrame:
    """(name, node) of each key with two nodes or more; equal groups have equal names."""

    def groups(key: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        new = np.concatenate([[True], key[1:] != key[:-1]])
        fresh = new | np.concatenate([[True], node[1:] != node[:-1]])  # a node once a key
        key, node, new = key[fresh], node[fresh], new[fresh]
        starts = np.flatnonzero(new)
        size = np.diff(np.concatenate([starts, [len(key)]]))
        names = np.add.reduceat(_mixed(node.view(np.uint64), 1), starts).view(np.int64)
        keep = np.repeat(size > 1, size)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(names, size)[keep]), pa.array(node[keep])], ["name", "node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[np.ndarray]] = []  # the last key's rows, as more may come
        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if kept and len(cols[0]) and cols[0][-1] == kept[0][0][0]:
                kept.append(cols)
                continue
            cols = [np.concatenate(x) for x in zip(*kept, cols, strict=True)]
            if not len(cols[0]):
                continue
            cut = int(np.searchsorted(cols[0], cols[0][-1]))
            kept = [[c[cut:] for c in cols]]
            if cut:
                yield groups(cols[0][:cut], cols[1][:cut])
        if kept:
            yield groups(*[np.concatenate(x) for x in zip(*kept, strict=True)])

    return rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "name bigint, node bigint")


def similar_groups(texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(name, node): groups of classes that share a key, equal groups once.

    Keys with more than HOT_SHARE of all rows are looked for on a sample of the texts, which decides
    only how rows are dealt out: their groups are found by aggregates, so no task holds one.
    """
    drawn = texts.filter(F.pmod("_qg_th", F.lit(HOT_SAMPLE)) == 0)
    sample = checkpoint(_keyed(drawn, percent).distinct())
    hot = checkpoint(sample.groupBy("key").count().filter(F.col("count") > max(HOT_LEAST, sample.count() * HOT_SHARE)).select("key"))
    rows = _keyed(texts, percent)
    if hot.isEmpty():
        return stored(_grouped(rows).distinct())
    rows = rows.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "key", "left")
    cold = stored(_grouped(rows.filter("hot is null").select("key", "node")).distinct())
    many = stored(rows.filter("hot").select("key", "node").distinct())
    named = many.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(node))").alias("name")).filter("n > 1").drop("n")
    return stored(cold.unionByName(many.join(F.broadcast(named), "key").select("name", "node").distinct()))


def _texts_of(texts: DataFrame, chosen: DataFrame) -> DataFrame:
    """The columns of ``chosen`` (_qg_id, _qg_th and more) with the text that they name."""
    chosen = chosen.withColumnsRenamed({"_qg_id": "_qg_cid", "_qg_th": "_qg_cth"})
    same = F.col("_qg_id").eqNullSafe(F.col("_qg_cid")) & (F.col("_qg_th") == F.col("_qg_cth"))
    return texts.join(maybe_broadcast(chosen, chosen.count(), BROADCAST_ROWS), same).drop("_qg_id", "_qg_th", "_qg_cid", "_qg_cth")


def overlaps(texts: DataFrame, standing: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b, overlap) of distinct ``pairs`` of classes that share an n-gram.

    Both sets' segments meet in a task for each fragment (and for each block of a class's many
    partners); the partial overlaps are summed by pair.  ``standing``: node, and the text that stands for it.
    """
    many = checkpoint(pairs.groupBy("a").count().filter(F.col("count") > BLOCK).select("a", F.ceil(F.col("count") / BLOCK).alias("blocks")))
    block = F.pmod(F.xxhash64("b"), F.coalesce("blocks", F.lit(1))).cast("int")
    dealt = checkpoint(pairs.join(maybe_broadcast(many, many.count(), BROADCAST_ROWS), "a", "left").select("a", "b", block.alias("block")))
    roles = dealt.select(F.col("b").alias("node"), "a", "block", F.lit(1).alias("side")).unionByName(dealt.select(F.col("a").alias("node"), "a", "block").distinct().withColumn("side", F.lit(0)))
    roles = checkpoint(roles.join(standing, "node"))
    rows = _texts_of(texts, roles).select("node", "a", "block", "side", "_qg_text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                s = shingles(one.column(4)[0].as_py())
                bounds = np.searchsorted(s, np.arange(1, FRAGMENTS, dtype=np.uint64) << np.uint64(61))
                ends = np.concatenate([[0], bounds, [len(s)]])
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(s.view(np.int64)))
                same = [c.take(pa.array(np.zeros(FRAGMENTS, np.int64))) for c in one.columns[:4]]
                rows = [*same, pa.array(np.arange(FRAGMENTS, dtype=np.int32)), pa.array(np.full(FRAGMENTS, len(s))), lists]
                yield pa.RecordBatch.from_arrays(rows, ["node", "a", "block", "side", "fragment", "n", "segment"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, hub, size, last = None, None, 0, None
        for batch in batches:
            out: list[tuple[int, int, int, int, int]] = []
            cols = [batch.column(i).to_pylist() for i in range(6)]
            ends, flat = batch.column(6).offsets.to_numpy(), batch.column(6).values.to_numpy()
            for k, (node, a, block, side, fragment, n) in enumerate(zip(*cols, strict=True)):
                segment = flat[ends[k] : ends[k + 1]].view(np.uint64)
                if (a, block, fragment) != group:
                    group, hub, size, last = (a, block, fragment), segment.copy(), n, None
                elif side and node != last and len(segment) and len(hub):  # repeated rows come together
                    at = np.searchsorted(hub, segment)
                    both = int((hub[np.minimum(at, len(hub) - 1)] == segment).sum())
                    if both:
                        out.append((a, node, size, n, both))
                    last = node
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(5)], ["a", "b", "n_a", "n_b", "overlap"])

    cut_rows = rows.mapInArrow(cut, "node bigint, a bigint, block int, side int, fragment int, n bigint, segment array<bigint>")
    parts = cut_rows.repartition("a", "block", "fragment").sortWithinPartitions("a", "block", "fragment", "side", "node").mapInArrow(count, "a bigint, b bigint, n_a bigint, n_b bigint, overlap bigint")
    return parts.groupBy("a", "b").agg(F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"), F.sum("overlap").alias("overlap"))


def linked(texts: DataFrame, standing: DataFrame, pairs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The ``pairs`` (a, b) whose sets are similar."""
    return overlaps(texts, standing, pairs).filter(F.expr(f"100 * overlap >= {percent} * (n_a + n_b - overlap)")).select("a", "b")


def parities(s: np.ndarray) -> bytes:
    """A bit for each n-gram's hash modulo a power of two of at least four times the set's size: whether an odd number has it."""
    size = max(64, 4 << int(len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1, bitorder="little").tobytes()


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    """Parities of fewer bits: hashes that are now equal flip one bit."""
    while bits.shape[1] > size:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def possible(n: np.ndarray, bits: list[bytes], apart: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs, where ``apart`` (a matrix), that sizes and parities don't rule out."""
    left, right = [], []
    lengths = np.array([len(b) for b in bits])
    by = {w: np.flatnonzero(lengths == w) for w in np.unique(lengths)}
    rows = {w: np.frombuffer(b"".join(bits[i] for i in at), np.uint64).reshape(len(at), -1) for w, at in by.items()}
    for w, one in by.items():
        for v, two in by.items():
            if v < w:
                continue
            x, y = rows[w], _folded(rows[v], rows[w].shape[1])
            step = max(1, (1 << 20) // max(1, y.size))
            for i in range(0, len(one), step):
                few = np.bitwise_count(x[i : i + step, None, :] ^ y[None, :, :]).sum(axis=2, dtype=np.int64)
                a, b = n[one[i : i + step], None], n[None, two]
                ok = (few * (100 + percent) <= (100 - percent) * (a + b)) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b)) & apart[np.ix_(one[i : i + step], two)]
                p, q = np.nonzero(ok)
                left.append(one[i + p])
                right.append(two[q])
    return np.concatenate(left), np.concatenate(right)


def _across(texts: DataFrame, standing: DataFrame, groups: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of classes of one group that are in different components and may be similar.

    A group's largest component isn't compared with itself: its members are dealt into blocks that
    meet the blocks of the others, which meet one another.
    """
    label = F.coalesce("root", "node")
    named = groups.select("name", "node").distinct().join(roots, "node", "left").select("name", "node", label.alias("label"))
    sizes = named.groupBy("name", "label").count().groupBy("name").agg(F.max(F.struct("count", "label")).alias("most"), F.sum("count").alias("size"), F.count(F.lit(1)).alias("labels"))
    sizes = sizes.filter("labels > 1").select("name", F.col("most.label").alias("major"), F.col("most.count").alias("n_major"), "size")
    small = F.col("size") <= BLOCK
    minors = F.when(small, 1).otherwise(F.ceil((F.col("size") - F.col("n_major")) / BLOCK)).cast("int")
    majors = F.when(small, 0).otherwise(F.ceil(F.col("n_major") / BLOCK)).cast("int")
    open_rows = stored(named.join(sizes, "name").select("name", "node", "label", (F.col("label") == F.col("major")).alias("is_major"), minors.alias("minors"), majors.alias("majors")))
    nodes = checkpoint(open_rows.select("node").distinct().join(standing, "node"))

    def flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([parities(s) for s in sets], pa.binary())], ["node", "n", "bits"])

    bits = _texts_of(texts, nodes).select("node", "_qg_text").mapInArrow(flagged, "node bigint, n bigint, bits binary").dropDuplicates(["node"])
    h = F.xxhash64("node")
    block = F.when(F.col("is_major") & (F.col("majors") > 0), F.col("minors") + F.pmod(h, F.greatest("majors", F.lit(1)))).otherwise(F.pmod(h, "minors")).cast("int")
    meets = F.when(F.col("block") >= F.col("minors"), F.col("minors")).otherwise(F.col("minors") + F.col("majors"))
    rows = open_rows.withColumn("block", block).withColumn("j", F.explode(F.sequence(F.lit(0), meets - 1)))
    rows = rows.select("name", "node", "label", "block", F.least("block", "j").alias("lo"), F.greatest("block", "j").alias("hi")).join(bits, "node")

    def pairs(key: tuple, group: list[tuple]) -> pa.RecordBatch:
        node, label, block = (np.array([g[i] for g in group], np.int64) for i in range(3))
        apart = (label[:, None] != label[None, :]) & ((block[:, None] != block[None, :]) | (key[1] == key[2]))
        a, b = possible(np.array([g[3] for g in group], np.int64), [g[4] for g in group], apart, percent)
        both = np.unique(np.stack([np.minimum(node[a], node[b]), np.maximum(node[a], node[b])], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, group = None, []
        for batch in batches:
            for name, lo, hi, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (name, lo, hi) != last:
                    if group:
                        yield pairs(last, group)
                    last, group = (name, lo, hi), []
                group.append(rest)
        if group:
            yield pairs(last, group)

    rows = rows.select("name", "lo", "hi", "node", "label", "block", "n", "bits")
    return rows.repartition("name", "lo", "hi").sortWithinPartitions("name", "lo", "hi").mapInArrow(run, "a bigint, b bigint").distinct()


def _pairs(rows: DataFrame) -> DataFrame:
    """(a, b) of distinct classes, the lesser first, from ``rows`` of node and other."""
    return checkpoint(rows.filter("node <> other").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct())


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """The classes of all rows (as ``classes`` gives them), and links (a, b) of classes that join up all similar ones."""
    texts = _by_text(df, id_col, text_col)
    rows = checkpoint(classes(df, id_col, text_col))
    standing = checkpoint(rows.filter("n > 0").groupBy("node").agg(F.min(F.struct("_qg_id", "_qg_th")).alias("one")).select("node", "one.*"))
    groups = similar_groups(texts, percent)
    # a class that many groups have is like many others, so it comes first in each of them
    degree = groups.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    groups = stored(groups.join(degree, "node").select("name", "node", "degree"))
    best = F.max(F.struct("degree", "node")).alias("best")
    tops = groups.groupBy("name").agg(best)
    done = _pairs(groups.join(tops, "name").groupBy("node").agg(F.max("best").alias("best")).select("node", F.col("best.node").alias("other")))
    links = checkpoint(linked(texts, standing, done, percent))
    # then what is still apart meets the first class of its group's largest component
    named = groups.join(components(links), "node", "left").select("name", "node", "degree", F.coalesce("root", "node").alias("label"))
    parts = named.groupBy("name", "label").agg(F.count(F.lit(1)).alias("n"), best)
    major = parts.groupBy("name").agg(F.max(F.struct("n", "label", "best")).alias("m"), F.count(F.lit(1)).alias("labels")).filter("labels > 1").select("name", F.col("m.label").alias("major"), F.col("m.best").alias("best"))
    apart = named.join(major, "name").filter("label <> major").groupBy("node").agg(F.max("best").alias("best"))
    more = checkpoint(_pairs(apart.select("node", F.col("best.node").alias("other"))).join(done, ["a", "b"], "left_anti"))
    links = checkpoint(links.unionByName(linked(texts, standing, more, percent)))
    rest = _across(texts, standing, groups.select("name", "node"), components(links), percent).join(done.unionByName(more), ["a", "b"], "left_anti")
    return rows, links.unionByName(checkpoint(linked(texts, standing, checkpoint(rest), percent)))


def similar_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(id, n, node, component_id) of each row: the set's size, its class, and the least id reachable by links.

    Null and empty texts, and those without words, have size 0, class 0 and are linked with nothing.
    Rows with equal sets are linked, repeated rows among them.  Null ids name a component
    only if it has no other.  Ties don't matter, as links are symmetric.
    """
    rows, links = join(df, id_col, text_col, percent)
    sizes = rows.filter("n > 0").groupBy("node").agg(F.min("_qg_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    nodes = sizes.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    nodes = checkpoint(nodes)
    named = nodes.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("classes"))
    # only classes of several rows or components are looked up; the few with many copies are broadcast
    named = checkpoint(nodes.join(named, "root").filter("copies > 1 or classes > 1").select("node", "component_id", "copies"))
    limit = max(HOT_LEAST, rows.count() * HOT_SHARE)
    hot, cold = named.filter(F.col("copies") > limit), named.filter(F.col("copies") <= limit)
    marked = rows.join(F.broadcast(hot.select("node", F.col("component_id").alias("hot_id"), F.lit(True).alias("hot"))), "node", "left")
    out = marked.filter("hot is null").join(cold.select("node", "component_id"), "node", "left").select("_qg_id", "n", "node", F.coalesce("component_id", "_qg_id").alias("component_id"))
    out = out.unionByName(marked.filter("hot").select("_qg_id", "n", "node", F.col("hot_id").alias("component_id")))
    return out.withColumnRenamed("_qg_id", id_col)


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of each document by five-word sets at a similarity of 0.8; an empty table gives no rows."""
    found = similar_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


OP12_SQL = f"""WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(g) AS g FROM (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {SHINGLE} THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - {SHINGLE} + 2), lambda i: array_to_string(ws[i : i + {SHINGLE} - 1], ' ')) END) AS g FROM w)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
e AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2)
    JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * o >= {PERCENT} * (p.n + q.n - o)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1) c USING (doc_id)"""
