"""Line dedup by a log-template tree, native functions only.

Lines are parsed as log templates are: tokens with a digit are variable fields
(<*>); a line descends a tree of fixed depth by its token count and its leading
tokens; below that leaf, one of four stretches of the remaining tokens may be
variable too.  So a line has four templates, one for each stretch left open (one
template, all fixed, if it is short).  A template that recurs across documents
keeps its lines in the document with the least id and drops them elsewhere.

Where ``verbatim_docs`` is given, lines also have a verbatim template: those of
``min_tokens`` tokens or LONG_BYTES bytes need that many documents only, shorter
ones with a letter ``min_docs``; and all lines of ``min_tokens`` have a stretch open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, table

#: Documents that must share a template before its lines go.
MIN_DOCS = 3
#: Shorter lines never go.
MIN_TOKENS = 5
#: Leading tokens that are always fixed.
DEPTH = 2
#: Stretches of the rest; lines of fewer tokens than OPEN_TOKENS have none open.
STRETCHES = 4
OPEN_TOKENS = 10
#: Bytes of a line that is long whatever its tokens, as in scripts without spaces.
LONG_BYTES = 40


def masked(line: Column) -> Column:
    """The line with each white-space token that has an ASCII digit as <*>."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, r"(?<!\S)[^\s0-9]*+[0-9]\S*+", "<*>")).otherwise(line)


def tokens(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(r"\S+"), F.lit(0))


def template_keys(toks: Column, min_tokens: int = MIN_TOKENS, open_tokens: int = OPEN_TOKENS) -> Column:
    """64-bit names of the line's templates; none for lines under ``min_tokens``."""
    n = F.size(toks)
    cut = [(F.lit(DEPTH) + F.floor((n - DEPTH) * j / STRETCHES)).cast("int") for j in range(STRETCHES + 1)]
    open_at = [F.xxhash64(F.lit(j), n, F.slice(toks, F.lit(1), cut[j]), F.slice(toks, cut[j + 1] + 1, n)) for j in range(STRETCHES)]
    return F.when(n >= open_tokens, F.array(*open_at)).when(n >= min_tokens, F.array(F.xxhash64(F.lit(-1), n, toks))).otherwise(F.array().cast("array<bigint>"))


def verbatim_key(line: Column, min_tokens: int = MIN_TOKENS) -> Column:
    """The name of a trimmed line as it stands, odd if the line is long; none for short lines without a letter."""
    name = F.xxhash64(F.lit(-2), line)
    long = (F.octet_length(line) >= LONG_BYTES) | line.rlike(rf"(?:\S+\s+){{{min_tokens - 1}}}\S")
    return F.when(long, F.array(name.bitwiseOR(F.lit(1)))).when(line.rlike(r"\p{L}"), F.array(name.bitwiseAND(F.lit(-2)))).otherwise(F.array().cast("array<bigint>"))


def recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, verbatim_docs: int | None = None) -> DataFrame:
    """(_qg_id, _qg_th, _qg_drop): for texts that lose lines, the sorted positions (from 0) of those.

    Rows of one id are one document; rows without an id are, if their texts are equal.  The
    least id keeps a line; where no row has one, the text of the least hash does.
    """
    base = docs.select(F.col(id_col).alias("_qg_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_qg_text"))
    # one step a lambda: within a lambda, Spark evaluates an expression as often as it is named
    keys = F.transform(F.transform(F.transform(F.split("_qg_text", "\n", -1), masked), tokens), lambda t: template_keys(t, min_tokens, OPEN_TOKENS if verbatim_docs is None else min_tokens))
    least: Column = F.lit(min_docs)
    if verbatim_docs is not None:
        verbatim = F.transform(F.transform(F.split("_qg_text", "\n", -1), lambda s: F.btrim(s, F.lit(" \t\x0b\f\r"))), lambda s: verbatim_key(s, min_tokens))
        keys = F.zip_with(F.transform(keys, lambda k: F.transform(k, lambda x: x.bitwiseAND(F.lit(-2)))), verbatim, lambda a, b: F.concat(a, b))
        least = F.when(F.col("key").bitwiseAND(F.lit(1)) == 1, F.lit(verbatim_docs)).otherwise(least)
    lined = checkpoint(base.select("_qg_id", F.xxhash64("_qg_text").alias("_qg_th"), keys.alias("keys")))
    unnamed = F.when(F.col("_qg_id").isNull(), F.col("_qg_th")).alias("_qg_nth")
    who = lined.select("_qg_id", unnamed).groupBy("_qg_id", "_qg_nth").count().filter("count > 1")
    once = lined.select("_qg_id", unnamed, F.explode(F.array_distinct(F.flatten("keys"))).alias("key"))
    if not who.isEmpty():
        once = once.distinct()
    recurring = once.groupBy("key").agg(F.count(F.lit(1)).alias("df"), F.min("_qg_id").alias("keeper"), F.min("_qg_nth").alias("keeper_th")).filter(F.col("df") >= least).select("key", "keeper", "keeper_th")
    lines = lined.select("_qg_id", "_qg_th", F.posexplode("keys").alias("pos", "line")).select("_qg_id", "_qg_th", "pos", F.explode("line").alias("key"))
    keeps = F.col("_qg_id").eqNullSafe(F.col("keeper")) & (F.col("keeper").isNotNull() | (F.col("_qg_th") == F.col("keeper_th")))
    gone = lines.join(recurring, "key").filter(~keeps)
    return gone.groupBy("_qg_id", "_qg_th").agg(F.array_sort(F.collect_set("pos")).alias("_qg_drop"))


def _with_drops(docs: DataFrame, id_col: str, text_col: str, min_docs: int, min_tokens: int, verbatim_docs: int | None = None) -> DataFrame:
    drops = recurring_lines(docs, id_col, text_col, min_docs, min_tokens, verbatim_docs)
    drops = drops.withColumnsRenamed({"_qg_id": "_qg_did", "_qg_th": "_qg_dth"})
    same = F.col(id_col).eqNullSafe(F.col("_qg_did")) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col("_qg_dth"))
    return docs.join(drops, same, "left")


def _kept(text_col: str) -> Column:
    lines = F.split(F.col(text_col), "\n", -1)
    return F.when(F.col("_qg_drop").isNull(), F.col(text_col)).otherwise(F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("_qg_drop", i)), "\n"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, verbatim_docs: int | None = None) -> DataFrame:
    """``docs`` without the lines whose template recurs elsewhere; every row and column stays.

    Null texts stay null; a text that loses all of its lines becomes empty.
    Lines end at a newline only.  Texts without recurring lines are unchanged to
    the byte.
    """
    return _with_drops(docs, id_col, text_col, min_docs, min_tokens, verbatim_docs).withColumn(text_col, _kept(text_col)).select(*docs.columns)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dropped lines of every whole text; null is empty, rows of one id are one document, an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = _with_drops(docs, "doc_id", "text", MIN_DOCS, MIN_TOKENS)
    kept = F.coalesce(_kept("text"), F.lit(""))
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1))
    return out.select("doc_id", lines.cast("long").alias("n_lines"), F.coalesce(F.size(F.col("_qg_drop")), F.lit(0)).cast("long").alias("n_dropped"), F.sha2(kept, 256).alias("kept_sha256"))


_TOKENS = r"list_transform(list_filter(regexp_split_to_array(line, '[ \t\n\x0B\f\r]+'), lambda t: t <> ''), lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END)"
OP7_SQL = f"""
WITH l AS (SELECT doc_id, i - 1 AS pos, ls[i] AS line, len(ls) AS n_lines FROM
           (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
t AS (SELECT doc_id, pos, line, n_lines, {_TOKENS} AS toks FROM l),
k AS (SELECT doc_id, pos, CASE WHEN len(toks) < {OPEN_TOKENS} THEN concat_ws('|', '-1', len(toks), array_to_string(toks, ' '))
             ELSE concat_ws('|', j, len(toks), array_to_string(toks[1:{DEPTH} + (len(toks) - {DEPTH}) * j // {STRETCHES}], ' '), array_to_string(toks[{DEPTH} + (len(toks) - {DEPTH}) * (j + 1) // {STRETCHES} + 1:], ' ')) END AS key
      FROM t, range(0, {STRETCHES}) AS r(j) WHERE len(toks) >= {MIN_TOKENS} AND (len(toks) >= {OPEN_TOKENS} OR j = 0)),
rec AS (SELECT key, min(doc_id) AS keeper FROM k GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
gone AS (SELECT DISTINCT doc_id, pos FROM k JOIN rec USING (key) WHERE keeper < doc_id)
SELECT t.doc_id, CAST(any_value(n_lines) AS BIGINT) AS n_lines, count(gone.pos) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY t.pos) FILTER (WHERE gone.pos IS NULL), '')) AS kept_sha256
FROM t LEFT JOIN gone ON t.doc_id = gone.doc_id AND t.pos = gone.pos GROUP BY t.doc_id
"""
