"""Mixing sources to target weights: Poisson replication, native functions only.

Each document is repeated a Poisson number of times whose mean is its source's
target repetition rate.  The uniform behind the draw is a hash of seed and id,
so a rerun, on any cluster, draws the same.  The copies are shuffled globally by
another hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, maybe_broadcast, table

#: Sources whose rates may be broadcast; above it the join shuffles, with skewed partitions split at run time.
BROADCAST_SOURCES = 100_000
#: The mean of one draw.  A larger rate is the sum of several draws, which is again Poisson.
DRAW_MEAN = 8.0
SEED = 17
#: Default weight of a source: its share of the characters to this power.
TEMPERATURE = 0.7


def uniform(seed: str | Column, key: Column) -> Column:
    """A number in [0, 1) with 52 bits from md5 of seed and key."""
    seed = F.lit(seed) if isinstance(seed, str) else seed
    return F.conv(F.substring(F.md5(F.concat_ws("|", seed, key)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson_inverse(u: Column, mean: Column) -> Column:
    """The count whose Poisson distribution function first exceeds ``u``; ``mean`` up to DRAW_MEAN.

    With 52 bits of u a count above 80 has no probability left.
    """
    steps = F.aggregate(
        F.sequence(F.lit(1), F.lit(80)),
        F.struct(F.exp(-mean).alias("term"), F.exp(-mean).alias("cdf"), F.lit(0).alias("n")),
        lambda s, k: F.struct(
            (s["term"] * mean / k).alias("term"),
            (s["cdf"] + s["term"] * mean / k).alias("cdf"),
            (s["n"] + (s["cdf"] <= u).cast("int")).alias("n"),
        ),
        lambda s: s["n"],
    )
    return steps


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(source, chars, rate): the mean number of copies that brings each source to its target.

    ``weights`` maps sources to target shares (a source that isn't named gets
    0); by default a share is the source's characters to the power TEMPERATURE.
    ``total`` is the target number of characters, by default that of the input.
    Null is a source of its own (named null).  Sources without a character keep rate 1.
    """
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(F.char_length(F.coalesce(F.col(text_col), F.lit("")))).alias("chars"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow(F.col("chars").cast("double"), F.lit(TEMPERATURE)))
    else:
        named = F.lit(None).cast("double")
        for name, w in weights.items():
            named = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(named)
        sizes = sizes.withColumn("weight", F.coalesce(named, F.lit(0.0)))
    sizes = checkpoint(sizes)
    sums = sizes.agg(F.sum("weight").alias("w"), F.sum("chars").alias("c")).first()
    goal = float(total if total is not None else sums["c"] or 0)
    rate = F.when(F.col("chars") == 0, F.lit(1.0)).otherwise(F.lit(goal) * F.col("weight") / F.lit(float(sums["w"] or 1.0) or 1.0) / F.col("chars"))
    return sizes.select("source", "chars", rate.alias("rate"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", shuffle: bool = True) -> DataFrame:
    """``docs`` with each row repeated by its draw, plus ``copy_no`` (from 1), in a random global order.

    Rows with equal ids (null is one id) draw alike.  A row with draw 0 goes.
    An empty table stays empty.
    """
    rates = source_rates(docs, weights, total, source_col, text_col)
    n_sources = rates.count()
    rates = maybe_broadcast(rates.select(F.col("source").alias("_qg_source"), F.col("rate").alias("_qg_rate")), n_sources, BROADCAST_SOURCES)
    joined = docs.join(rates, F.col(source_col).eqNullSafe(F.col("_qg_source")), "inner")
    draws = F.greatest(F.ceil(F.col("_qg_rate") / DRAW_MEAN), F.lit(1)).cast("int")
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    # the uniforms are made first: a lambda evaluates what it names at every step
    uniforms = F.transform(F.sequence(F.lit(1), draws), lambda k: uniform(F.concat(F.lit(f"{seed}-"), k.cast("string")), key))
    joined = joined.withColumn("_qg_mean", F.col("_qg_rate") / draws)
    count = F.aggregate(uniforms, F.lit(0), lambda n, u: n + poisson_inverse(u, F.col("_qg_mean")))
    copies = joined.withColumn("_qg_n", count).filter("_qg_n > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("_qg_n"))))
    copies = copies.select(*docs.columns, "copy_no")
    return copies.orderBy(F.md5(F.concat_ws("|", F.lit(f"{seed}-order"), key, F.col("copy_no").cast("string")))) if shuffle else copies


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy with its whole document, in the mixed order."""
    return mix(table(spark, sf_dir, "documents"))


OP6_SQL = f"""
WITH sizes AS (SELECT source, CAST(sum(length(coalesce(text, ''))) AS DOUBLE) AS chars FROM documents GROUP BY source),
goal AS (SELECT sum(chars) AS total, sum(chars ** {TEMPERATURE}) AS weights FROM sizes),
rates AS (SELECT source, CASE WHEN chars = 0 THEN 1.0 ELSE total * (chars ** {TEMPERATURE}) / weights / chars END AS rate FROM sizes, goal),
draws AS (SELECT *, greatest(CAST(ceil(rate / {DRAW_MEAN}) AS INT), 1) AS m FROM rates),
u AS (SELECT d.*, rate / m AS mean, CAST(('0x' || substr(md5('{SEED}-' || k || '|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT) / {float(1 << 52)} AS u, k
      FROM documents d JOIN draws ON d.source IS NOT DISTINCT FROM draws.source, unnest(range(1, m + 1)) AS t(k)),
cdf AS (SELECT mean, n, sum(term) OVER (PARTITION BY mean ORDER BY n) AS cdf
        FROM (SELECT mean, n, exp(-mean + n * ln(mean) - lgamma(n + 1)) AS term FROM (SELECT DISTINCT mean FROM u) m, range(0, 80) AS r(n))),
counts AS (SELECT doc_id, text, lang, source, n_chars, sum(c) AS copies FROM
           (SELECT doc_id, text, lang, source, n_chars, k, (SELECT count(*) FROM cdf WHERE cdf.mean = u.mean AND cdf.cdf <= u.u) AS c FROM u) GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, CAST(copy_no AS INT) AS copy_no FROM counts, unnest(range(1, CAST(copies AS BIGINT) + 1)) AS t(copy_no)
"""
