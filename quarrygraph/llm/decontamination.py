"""Benchmark decontamination: windows of benchmark words looked up in training texts, native functions only.

The distinct word windows of the benchmark form a hash table.  Each has a mark,
the least hash of two neighbouring words.  Every training text is scanned pair by
pair; the windows around a pair that may be a mark are looked up, and a hash that
is found is verified word by word.
No text crosses the network: only hits do, combined per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, ascii_lower, checkpoint, maybe_broadcast, table, words

#: Bytes of the filter of word pairs, at most, as it is part of the plan; a fuller filter costs time, not hits.
FILTER_BYTES = 1 << 16
#: Distinct benchmark windows (about 150 bytes each) that may be broadcast; above it the join shuffles.
BROADCAST_WINDOWS = 500_000
WINDOW = 10


def _windows(tokens: Column, starts: Column, n: int) -> Column:
    """array<struct<pos, words>>: the windows of ``n`` tokens at ``starts``."""
    return F.transform(starts, lambda i: F.struct(i.alias("pos"), F.slice(tokens, i + 1, n).alias("words")))


def _pair(tokens: Column, i: Column) -> Column:
    return F.xxhash64(F.get(tokens, i), F.get(tokens, i + 1))


def _marks(tokens: Column, n: int) -> Column:
    """The mark of a window: the least hash of its neighbouring words; of one word, its own."""
    return F.xxhash64(F.get(tokens, F.lit(0))) if n == 1 else F.array_min(F.transform(F.sequence(F.lit(0), F.lit(n - 2)), lambda i: _pair(tokens, i)))


def _filter(wins: DataFrame, lengths: list[int]) -> bytes:
    """A byte for each slot of the windows' marks; bounded by FILTER_BYTES."""
    marks = None
    for n in lengths:
        one = wins.filter(F.col("n") == n).select(_marks(F.col("win"), n).alias("mark"))
        marks = one if marks is None else marks.unionByName(one)
    marks = marks.distinct()
    slots = min(FILTER_BYTES, max(1 << 10, 1 << (16 * marks.count()).bit_length()))
    out = bytearray(slots)
    for r in marks.select(F.col("mark").bitwiseAND(F.lit(slots - 1)).alias("slot")).distinct().collect():
        out[r["slot"]] = 1
    return bytes(out)


def _starts(tokens: Column, lengths: list[int], marked: bytes) -> dict[int, Column]:
    """By length, where the windows of a text start that may have a mark of the filter."""
    size = F.size(tokens)
    hit = lambda h: F.substring(F.lit(bytearray(marked)), h.bitwiseAND(F.lit(len(marked) - 1)).cast("int") + 1, 1) == F.lit(bytearray(b"\1"))
    none = F.array().cast("array<int>")
    at = {}
    if 1 in lengths:
        at[1] = F.when(size >= 1, F.filter(F.sequence(F.lit(0), size - 1), lambda i: hit(F.xxhash64(F.get(tokens, i))))).otherwise(none)
    if max(lengths) > 1:
        at[2] = F.when(size >= 2, F.filter(F.sequence(F.lit(0), size - 2), lambda i: hit(_pair(tokens, i)))).otherwise(none)
    return at


def _around(pairs: Column, size: Column, n: int) -> Column:
    """Where the windows of ``n`` words start that hold one of the pairs."""
    each = F.transform(pairs, lambda p: F.sequence(F.greatest(p - (n - 2), F.lit(0)), F.least(p, size - n)))
    return F.when(size >= n, F.array_distinct(F.flatten(each))).otherwise(F.array().cast("array<int>"))


def benchmark_windows(bench: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(h, n, win, items): each distinct window with the ids of the items that have it.

    An item of fewer words than ``window``, but not none, is one window.
    """
    b = bench.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).filter("size(w) > 0")
    wins = F.when(F.size("w") < window, F.array(F.col("w"))).otherwise(F.transform(F.sequence(F.lit(1), F.size("w") - window + 1), lambda i: F.slice("w", i, window)))
    b = b.select("item", F.explode(wins).alias("win"))
    return b.groupBy("win").agg(F.collect_set("item").alias("items")).select(F.xxhash64("win").alias("h"), F.size("win").alias("n"), "win", "items")


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per input row: id, text hash, n_words, spans (merged word ranges [from, to)), items (sorted ids).

    Null and empty texts have no words and no hits; rows that repeat an id are
    told apart by their text; an empty benchmark hits nothing.
    """
    wins = checkpoint(benchmark_windows(bench, item_col, item_text, window))
    lengths = sorted(r["n"] for r in wins.select("n").distinct().collect())  # at most `window` values
    marked = _filter(wins, lengths) if lengths else b""
    wins = maybe_broadcast(wins.select("h", "win", "items"), wins.count(), BROADCAST_WINDOWS)
    base = docs.select(F.col(id_col).alias("_qg_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_qg_text"))
    keyed = base.select("_qg_id", F.xxhash64("_qg_text").alias("_qg_th"), F.char_length("_qg_text").alias("_qg_n"), "_qg_text")
    light = keyed.select("_qg_id", "_qg_th", "_qg_n", F.size(words(F.col("_qg_text"))).cast("long").alias("n_words"))
    tokens = keyed.select("_qg_id", "_qg_th", "_qg_n", words(F.col("_qg_text")).alias("w"))
    none = F.array().cast("array<struct<a:int,b:int>>")
    if not lengths:
        return light.select(F.col("_qg_id").alias(id_col), F.col("_qg_th").alias("text_hash"), "n_words", none.alias("spans"), F.array().cast("array<string>").alias("items"))
    # windows that share no pair of neighbouring words with a benchmark window's mark can't be hits; the others become
    # rows, with their position and their words only, and are looked up and verified word by word
    marks = _starts(F.col("w"), lengths, marked)
    tokens = tokens.withColumns({f"_qg_at{k}": c for k, c in marks.items()})  # no filter here: pushed down, it would split each text once a pair
    starts = {n: F.col("_qg_at1") if n == 1 else _around(F.col("_qg_at2"), F.size("w"), n) for n in lengths}
    windows = tokens.select("_qg_id", "_qg_th", "_qg_n", F.inline(F.concat(*[_windows(F.col("w"), starts[n], n) for n in lengths]))).withColumn("h", F.xxhash64("words"))
    found = windows.join(wins, (windows["h"] == wins["h"]) & (windows["words"] == wins["win"]))
    found = found.select("_qg_id", "_qg_th", "_qg_n", F.struct(F.col("pos").alias("a"), (F.col("pos") + F.size("win")).alias("b")).alias("span"), "items")
    merged = F.aggregate(
        F.array_sort(F.collect_set("span")),
        none,
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.element_at(F.when(F.size(acc) > 0, acc).otherwise(F.array(s)), -1)["b"] >= s["a"]),
            F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.element_at(F.when(F.size(acc) > 0, acc).otherwise(F.array(s)), -1)["a"].alias("a"), F.greatest(F.element_at(F.when(F.size(acc) > 0, acc).otherwise(F.array(s)), -1)["b"], s["b"]).alias("b")))),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    hits = found.groupBy("_qg_id", "_qg_th", "_qg_n").agg(merged.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    hits = hits.select(F.col("_qg_id").alias("_qg_hid"), F.col("_qg_th").alias("_qg_hth"), F.col("_qg_n").alias("_qg_hn"), "spans", "items")
    same = F.col("_qg_id").eqNullSafe(F.col("_qg_hid")) & (F.col("_qg_th") == F.col("_qg_hth")) & (F.col("_qg_n") == F.col("_qg_hn"))
    return light.join(hits, same, "left").select(F.col("_qg_id").alias(id_col), F.col("_qg_th").alias("text_hash"), "n_words", F.coalesce("spans", none).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def decontaminate(docs: DataFrame, bench: DataFrame, remove: str = "documents", id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` without contamination; the columns stay.

    remove="documents": rows with a hit go.  remove="spans": hit words go, with
    what stands between the words of one span; other text stays as it is.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove must be 'documents' or 'spans', not {remove!r}")
    bad = contamination(docs, bench, id_col, text_col, item_col, item_text, window).filter("size(spans) > 0")
    bad = bad.select(F.col(id_col).alias("_qg_id"), F.col("text_hash").alias("_qg_th"), F.col("spans").alias("_qg_spans")).dropDuplicates(["_qg_id", "_qg_th"])
    text = F.coalesce(F.col(text_col), F.lit(""))
    same = F.col(id_col).eqNullSafe(F.col("_qg_id")) & (F.xxhash64(text) == F.col("_qg_th"))
    if remove == "documents":
        return docs.join(bad, same, "left_anti")
    # words and the gaps around them: gap 0, word 0, gap 1, word 1, ..., last gap
    lowered = ascii_lower(text)
    gaps = F.split(lowered, WORD, -1)

    def cut(acc: Column, s: Column) -> Column:
        """acc.at: characters that are passed; acc.words: words that are passed; acc.out: kept text."""
        start, end = _offset(F.col("_qg_gaps"), "_qg_ends", s["a"]), F.get(F.col("_qg_ends"), s["b"] - 1)
        return F.struct(end.alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, start - acc["at"])).alias("out"))

    joined = docs.join(bad, same, "left").withColumn("_qg_gaps", F.when(F.col("_qg_spans").isNotNull(), gaps))
    lengths = F.transform(F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0)), lambda w: F.char_length(w))
    ends = F.aggregate(
        F.zip_with(F.slice(gaps, F.lit(1), F.size(lengths)), lengths, lambda g, n: F.char_length(g) + n),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends")),
        lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["ends"], F.array(acc["at"] + n)).alias("ends")),
        lambda acc: acc["ends"],
    )
    joined = joined.withColumn("_qg_ends", F.when(F.col("_qg_spans").isNotNull(), ends))
    kept = F.aggregate(F.col("_qg_spans"), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), cut, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))
    return joined.withColumn(text_col, F.when(F.col("_qg_spans").isNotNull(), kept).otherwise(F.col(text_col))).select(*docs.columns)


def _offset(gaps: Column, ends: str, word: Column) -> Column:
    """Where a word starts: after the word before it and the gap between."""
    return F.coalesce(F.get(F.col(ends), F.when(word > 0, word - 1).otherwise(F.lit(None).cast("int"))), F.lit(0)) + F.char_length(F.get(gaps, word))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words of every whole text; null has no words, repeated rows are hit alike, an empty table gives no rows."""
    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["b"] - s["a"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, dw.n AS n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
