"""Document fingerprints: a canonical exact digest, native DataFrame functions only.

A text is canonicalised (Unicode NFKC, lower case, white space folded to single
spaces and trimmed) and digested by two differently seeded 64-bit xxhashes.
Rows with equal digests form a bucket; inside buckets of two or more the
canonical bytes are compared, so a collision splits the bucket.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import checkpoint, maybe_broadcast, stored, table

#: Bucket digests that may be broadcast (two longs each); above it the join shuffles.
BROADCAST_BUCKETS = 1_000_000
#: Rows that stand together when neighbours by id are looked up; small stretches are dealt out evenly.
NEIGHBOUR_ROWS = 128
#: Quantiles of the id that the driver holds, whatever the size of the input.
MAX_SPLITS = 1024


def canonical(text: Column) -> Column:
    """NFKC, lower case, runs of white space as one space, trimmed; null is empty.

    Pure ASCII is in NFKC already, so the normaliser (the ICU library that Spark
    ships, called on the JVM) sees other texts only.
    """
    t = F.coalesce(text, F.lit(""))
    nfkc = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), t, F.lit(True))
    normal = F.when(F.octet_length(t) == F.char_length(t), t).otherwise(nfkc)
    return F.trim(F.regexp_replace(F.lower(normal), "[\\s\\x{85}\\x{2028}\\x{2029}]+", " "))


def digest(canon: Column) -> Column:
    """128 bits of xxhash as 32 lower-case hex digits."""
    return F.concat(*[F.lpad(F.lower(F.hex(F.xxhash64(F.lit(seed), canon))), 16, "0") for seed in (1, 2)])


def fingerprint(df: DataFrame, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """Add the digest of the canonical text; empty and null texts share one digest."""
    return df.withColumn("_qg_canon", canonical(F.col(text_col))).withColumn(out, digest(F.col("_qg_canon"))).drop("_qg_canon")


def collisions(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(fingerprint, canon, ordinal) of the buckets that hold different canonical texts; nearly always empty.

    Only buckets of two or more rows are compared.  The least and greatest
    canonical text of a bucket are combined on the map side, so a bucket with a
    third of all rows reaches the shuffle as two texts a task.
    """
    canon = df.select(canonical(F.col(text_col)).alias("canon")).withColumn("fingerprint", digest(F.col("canon")))
    buckets = checkpoint(canon.groupBy("fingerprint").count().filter("count > 1").select("fingerprint"))
    shared = canon.join(maybe_broadcast(buckets, buckets.count(), BROADCAST_BUCKETS), "fingerprint", "left_semi")
    mixed = shared.groupBy("fingerprint").agg(F.min("canon").alias("lo"), F.max("canon").alias("hi")).filter("lo <> hi").select("fingerprint")
    mixed = checkpoint(mixed)
    if mixed.isEmpty():
        return mixed.select("fingerprint", F.lit("").alias("canon"), F.lit(0).alias("ordinal"))
    texts = canon.join(mixed, "fingerprint", "left_semi").distinct()
    return texts.select("fingerprint", "canon", F.row_number().over(Window.partitionBy("fingerprint").orderBy("canon")).alias("ordinal"))


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, fingerprint, class_id (least id of equal canonical texts), class_size.

    Null and empty texts are one class.  Null ids join a class but never name it,
    unless all of its ids are null.  Repeated rows count each.
    """
    base = df.select(F.col(id_col).alias("_qg_id"), canonical(F.col(text_col)).alias("_qg_canon"))
    base = base.withColumn("fingerprint", digest(F.col("_qg_canon")))
    clash = collisions(df.select(F.col(text_col).alias("text")))
    if clash.isEmpty():
        base = base.drop("_qg_canon")
    else:
        clash = clash.select("fingerprint", F.col("canon").alias("_qg_canon"), "ordinal")
        base = base.join(clash, ["fingerprint", "_qg_canon"], "left").select("_qg_id", F.concat("fingerprint", F.coalesce(F.concat(F.lit("-"), "ordinal"), F.lit(""))).alias("fingerprint"))
    base = checkpoint(base)
    classes = base.groupBy("fingerprint").agg(F.min("_qg_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return base.join(classes, "fingerprint").select(F.col("_qg_id").alias(id_col), "fingerprint", "class_id", "class_size")


def _id_buckets(df: DataFrame, id_col: str) -> tuple[Column, int]:
    """A bucket number that never falls as the id grows, about NEIGHBOUR_ROWS ids to a bucket.

    Quantiles of the ids (at most MAX_SPLITS) follow their distribution, and
    each stretch between two of them is cut evenly.  Rows without an id come below, in
    as many buckets, by the hash of ``text``.
    """
    n = df.count()
    splits = max(1, min(MAX_SPLITS, math.ceil(n / NEIGHBOUR_ROWS)))
    cuts = max(1, math.ceil(n / NEIGHBOUR_ROWS / splits))
    at = [k / splits for k in range(splits + 1)]
    bounds = df.agg(F.percentile_approx(id_col, at, 10_000).alias("q")).first()["q"] or [0, 1]
    bounds = sorted(set(bounds))
    if len(bounds) == 1:
        bounds.append(bounds[0] + 1)
    array = F.array(*[F.lit(int(b)).cast("long") for b in bounds[:-1]])
    steps = [1 << k for k in reversed(range(max(1, (len(bounds) - 1).bit_length())))]
    # binary search for the last bound that is not above the id
    last = F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(1),
        lambda lo, s: F.when((lo + s <= F.size(array)) & (F.get(array, lo + s - 1) <= F.col(id_col)), lo + s).otherwise(lo),
    )
    ends = F.array(*[F.lit(int(b)).cast("double") for b in bounds])
    lo, hi = F.get(ends, F.col("_qg_k") - 1), F.get(ends, F.col("_qg_k"))
    sub = F.least(F.greatest(F.floor((F.col(id_col).cast("double") - lo) * cuts / (hi - lo)), F.lit(0)), F.lit(cuts - 1))
    least = -(1 << 63)
    nth = F.floor((F.xxhash64("text").cast("double") - least) * (splits * cuts) / float(1 << 64))
    unnamed = -1 - F.least(nth, F.lit(splits * cuts - 1))
    return last, F.when(F.col(id_col).isNull(), unnamed).otherwise(F.col("_qg_k") * cuts + sub).cast("long"), cuts


def _ranged(docs: DataFrame) -> DataFrame:
    """``docs`` with a bucket that never falls as an id of any type grows: Spark's ranges of ids, written so that they hold; null ids below, by text."""
    parts = max(1, min(10 * MAX_SPLITS, math.ceil(docs.count() / NEIGHBOUR_ROWS)))
    named = stored(docs.filter("doc_id is not null").repartitionByRange(parts, "doc_id").withColumn("_qg_b", F.spark_partition_id().cast("long")))
    unnamed = -1 - F.pmod(F.xxhash64("text"), F.lit(parts))
    return named.unionByName(docs.filter("doc_id is null").withColumn("_qg_b", unnamed))


def _numbered(rows: DataFrame, clash: DataFrame, name: str, canon: str) -> DataFrame:
    """``rows`` with what tells texts of one digest apart in ``name``: their ordinal, or 0 for a text that no document has."""
    numbers = F.broadcast(clash.groupBy("fingerprint").agg(F.map_from_entries(F.collect_list(F.struct("canon", "ordinal"))).alias("_qg_ordinals")).withColumnRenamed("fingerprint", "_qg_f"))
    suffix = F.when(F.col("_qg_f").isNotNull(), F.concat(F.lit("-"), F.coalesce(F.element_at("_qg_ordinals", F.col(canon)), F.lit(0)))).otherwise("")
    return rows.join(numbers, F.col(name) == F.col("_qg_f"), "left").withColumn(name, F.concat(name, suffix)).drop("_qg_f", "_qg_ordinals")


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text, and whether they and the next document's agree.

    The next document is the one that follows by descending id (null ids last,
    equal ids by text hash); after the last comes the first.  Ids are of any type that has an
    order: numbers are cut into stretches by quantiles, others (texts, dates) by Spark's ranges.
    Equality is that of canonical bytes, so the likeness of two fingerprints is 1 or 0, and
    fingerprints of texts whose digests collide get a suffix.  A single
    document follows itself; an empty table gives no rows.
    """
    docs = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    clash = collisions(docs)
    if clash.isEmpty():
        clash = None
    if isinstance(docs.schema["doc_id"].dataType, IntegralType):
        last, bucket, cuts = _id_buckets(docs.select("doc_id"), "doc_id")
        docs = docs.withColumn("_qg_k", last).withColumn("_qg_b", bucket).drop("_qg_k")
    else:
        docs, cuts = _ranged(docs), MAX_SPLITS
    docs = docs.repartition("_qg_b").withColumn("canon", canonical(F.col("text"))).withColumn("fingerprint", digest(F.col("canon")))
    in_bucket = Window.partitionBy("_qg_b").orderBy(F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    rows = docs.select(
        "*",
        F.row_number().over(in_bucket).alias("_qg_rn"),
        F.lead("text").over(in_bucket).alias("next_text"),
        F.lead("canon").over(in_bucket).alias("next_canon"),
    )

    def compared(rows: DataFrame) -> DataFrame:
        n = F.char_length("text")
        k = F.floor(n / 3).cast("int")
        rows = rows.withColumn("edited", F.concat(F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 3) as int))"), F.substring("next_text", F.lit(1), k)))
        rows = rows.withColumn("edited_canon", canonical(F.col("edited"))).withColumn("edited_fingerprint", digest(F.col("edited_canon")))
        if clash is not None:
            rows = _numbered(_numbered(rows, clash, "fingerprint", "canon"), clash, "edited_fingerprint", "edited_canon")
        return rows.select(
            "*",
            n.cast("long").alias("n_chars"),
            F.sha2("edited", 256).alias("edited_sha256"),
            (F.col("edited_canon") == F.col("canon")).cast("double").alias("near_edited"),
            (F.col("next_canon") == F.col("canon")).cast("double").alias("near_next"),
        )

    result = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    edge = F.col("next_text").isNull() | (F.col("_qg_rn") == 1)
    done = checkpoint(compared(rows).select(*result, "_qg_b", "_qg_rn", F.col("next_text").isNull().alias("_qg_tail"), F.when(edge, F.col("text")).alias("text")))
    # the last row of a bucket is followed by the first of the next bucket that has rows
    heads = done.filter("_qg_rn = 1").select(F.col("_qg_b").alias("_qg_next"), F.col("text").alias("next_text"))
    numbers = heads.select(F.col("_qg_next").alias("_qg_b"), F.floor(F.col("_qg_next") / cuts).alias("k"))
    tops = numbers.groupBy("k").agg(F.max("_qg_b").alias("top"))
    down = Window.orderBy(F.col("k").desc())  # at most 2 * MAX_SPLITS + 2 rows
    tops = tops.select("k", F.coalesce(F.lead("top").over(down), F.first("top").over(down)).alias("below"))
    step = F.lead("_qg_b").over(Window.partitionBy("k").orderBy(F.col("_qg_b").desc()))
    following = numbers.withColumn("step", step).join(tops, "k").select("_qg_b", F.coalesce("step", "below").alias("_qg_next"))
    tails = done.filter("_qg_tail").select("_qg_b", "doc_id", "text").join(following, "_qg_b").join(heads, "_qg_next")
    tails = tails.withColumn("canon", canonical(F.col("text"))).withColumn("fingerprint", digest(F.col("canon"))).withColumn("next_canon", canonical(F.col("next_text")))
    return done.filter("not _qg_tail").select(*result).unionByName(compared(tails).select(*result))


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text and its edited text; null is empty, repeated rows follow one another, an empty table gives no rows."""
    return edited_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
