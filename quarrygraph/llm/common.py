"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: A word of the contracts: ASCII letters and digits, and everything above ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands between words, once A-Z are lowered.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share.

    Only in local mode, where driver and executors are one process, a temporary
    one takes its place; a cluster has to name its folder.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(found)
    return found


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with files that every executor can read."""
    sc = df.sparkSession.sparkContext
    folder = shared_folder(df.sparkSession)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage with a compressed Parquet table in the shared folder, for wide rows; the folder's owner clears it."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/quarrygraph-{uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only, whatever the locale."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """The words of a text as an array; null has none.  Splitting takes half the time of extracting."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN, -1), "")


def maybe_broadcast(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Broadcast ``df`` if its counted ``rows`` are within ``limit``; else leave the join to shuffle."""
    return F.broadcast(df) if rows <= limit else df


def joined_counted(rows: DataFrame, small: DataFrame, key: str, count: int, limit: int, salts: int = 16) -> DataFrame:
    """``rows`` with the columns of ``small`` (one row a key, null one of them) by a counted broadcast, or beyond its limit by a join that deals out each key's rows."""
    right = small.withColumnRenamed(key, "_qg_key")
    if count <= limit:
        return rows.join(F.broadcast(right), F.col(key).eqNullSafe(F.col("_qg_key"))).drop("_qg_key")
    right = right.withColumn("_qg_slot", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    left = rows.withColumn("_qg_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    return left.join(right, F.col(key).eqNullSafe(F.col("_qg_key")) & (F.col("_qg_salt") == F.col("_qg_slot"))).drop("_qg_key", "_qg_slot", "_qg_salt")


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(n))
