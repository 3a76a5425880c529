"""Folders that driver and executors share: scratch tables, and sets of tables that change by one pointer file.

A set of tables is a folder with a pointer, which names for each table its schema, its key and the folder of
each hash bucket of the key.  A commit writes the buckets that it touches into new folders and
then replaces the pointer, so a reader sees all of a commit or nothing, whenever
the writer dies, and a small commit writes little, whatever the tables' size.  Folders that no pointer needs
are deleted one commit later, so who has just opened the tables can still read them.
"""

from __future__ import annotations

import json
import tempfile
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..progress import Report, step

_BUCKET = "_bucket"
POINTER = "_current.json"
#: Rows of a bucket, as a table is first written; a table has a power of two of buckets, within these bounds.
BUCKET_ROWS, LEAST_BUCKETS, MOST_BUCKETS = 512, 4, 16_384
#: Rows of one file; a larger bucket is written by several tasks.
FILE_ROWS = 2_000_000
#: Tables that a commit writes at the same time.
AT_ONCE = 4


def files(spark: SparkSession, path: str):
    """(file system, Hadoop path) of a path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = files(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = files(spark, path)
    fs.delete(p, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None if there is none."""
    fs, p = files(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return str(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, whole or not at all: it is written aside and renamed over what is there."""
    jvm = spark.sparkContext._jvm
    _, p = files(spark, path)
    aside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid4().hex}")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    fs, _ = files(spark, path)
    stream = fs.create(aside, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(aside, p, options)


def scratch(spark: SparkSession, prefix: str = "quarrygraph") -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names; only local mode may do without the setting."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{prefix}-{uuid4().hex}"


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written as Parquet (in scratch without a path) and read again, so that its lineage ends there."""
    path = path or scratch(df.sparkSession)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class Change:
    """Rows for one table: they replace what stands under their keys, and what stands under ``gone`` (a column like the key) goes."""

    rows: DataFrame
    key: str
    gone: DataFrame | None = None


def state(spark: SparkSession, path: str) -> dict:
    """What the pointer says; an empty set of tables without one."""
    text = read_text(spark, f"{path}/{POINTER}")
    return json.loads(text) if text else {"version": 0, "tokens": {}, "tables": {}, "stale": []}


def _number(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def opened(spark: SparkSession, path: str, name: str, now: dict | None = None, buckets: list[int] | None = None) -> DataFrame | None:
    """A table, or some of its buckets; None if there is no such table.  ``now``: the state to read, else the newest."""
    table = (now or state(spark, path))["tables"].get(name)
    if table is None:
        return None
    schema = StructType.fromJson(table["schema"])
    folders = [f"{path}/{folder}/{_BUCKET}={b}" for b, folder in table["folders"].items() if buckets is None or int(b) in buckets]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def touched(df: DataFrame, key: str, buckets: int) -> list[int]:
    """The buckets of a column's values; at most ``buckets``."""
    return sorted(r[0] for r in df.select(_number(key, buckets)).distinct().collect())


def near(spark: SparkSession, path: str, name: str, keys: DataFrame, key: str, now: dict) -> DataFrame | None:
    """The rows of a table in the buckets of ``keys`` (a column ``key`` like the table's)."""
    table = now["tables"].get(name)
    return None if table is None else opened(spark, path, name, now, touched(keys, key, table["buckets"]))


def _written(spark: SparkSession, path: str, name: str, change: Change, now: dict, aside: str) -> tuple[dict, list[str], dict, DataFrame, int] | None:
    """A table's touched buckets in a new folder: (table, superseded folders, what was written, its rows, new rows); None if there is nothing to do."""
    rows, table = stored(change.rows, f"{aside}/{name}"), now["tables"].get(name)
    n = rows.count()
    if table is None:
        size = LEAST_BUCKETS
        while size < MOST_BUCKETS and size * BUCKET_ROWS < n:
            size *= 2
        table = {"key": change.key, "buckets": size, "folders": {}}
    keys = rows.select(change.key)
    if change.gone is not None:
        keys = keys.unionByName(change.gone.select(change.key))
    parts = touched(keys, change.key, table["buckets"])
    if not parts and name in now["tables"]:
        return None
    schema = rows.schema
    old = opened(spark, path, name, now, parts)
    if old is not None:
        rows = old.join(keys.distinct(), change.key, "left_anti").unionByName(rows, allowMissingColumns=True)
        schema = StructType.fromJson(table["schema"])
        schema = StructType([*schema, *(f for f in rows.schema if f.name not in schema.names)])
        rows = rows.select(schema.names)
    folder = f"data/{name}/v{now['version'] + 1:08d}-{uuid4().hex[:8]}"
    split = F.pmod(F.xxhash64(F.lit("file"), *[f.name for f in schema if f.dataType.typeName() != "map"]), F.lit(max(1, -(-n // max(1, len(parts)) // FILE_ROWS))))
    numbered = rows.withColumn(_BUCKET, _number(change.key, table["buckets"]))
    numbered.repartition(max(1, min(len(parts), 512)), _BUCKET, split).write.partitionBy(_BUCKET).parquet(f"{path}/{folder}")
    fs, p = files(spark, f"{path}/{folder}")
    made = sorted(s.getPath().getName().partition("=")[2] for s in fs.listStatus(p) if s.getPath().getName().startswith(f"{_BUCKET}="))
    keep = {b: f for b, f in table["folders"].items() if int(b) not in parts}
    stale = [f"{f}/{_BUCKET}={b}" for b, f in table["folders"].items() if int(b) in parts]
    table = table | {"schema": json.loads(schema.json()), "folders": keep | dict.fromkeys(made, folder)}
    new = spark.read.schema(schema).parquet(*[f"{path}/{folder}/{_BUCKET}={b}" for b in made]) if made else spark.createDataFrame([], schema)
    return table, stale, {"buckets": len(parts), "folder": folder}, new, n


def commit(spark: SparkSession, path: str, changes: dict[str, Change], now: dict | None = None, tokens: dict | None = None, check=None, report: Report | None = None) -> dict:
    """Bring ``changes`` into the tables at ``path``; returns the new state, with the rows and buckets written of each table.

    Rows must be one a key, or several that replace each other together.  ``now`` is the state that they were made from: if another
    commit has come between, it is an error and nothing changes.  ``check`` is called with the touched
    buckets of each table, as they will be, before the pointer moves.  ``tokens`` are kept with the state.
    ``report`` hears of each table.
    """
    now = now or state(spark, path)
    version = now["version"] + 1
    tables, stale, written = dict(now["tables"]), [], {}
    staged: dict[str, DataFrame] = {}
    aside = f"{path}/data/_aside-{uuid4().hex}"
    try:

        def one(name: str) -> None:
            with step(spark, f"write {name}", report) as own:
                done = _written(spark, path, name, changes[name], now, aside)
                if done is not None:
                    tables[name], old, written[name], staged[name], own.rows = done
                    stale.extend(old)

        with ThreadPoolExecutor(AT_ONCE) as pool:  # tables don't wait for each other
            for future in [pool.submit(one, name) for name in changes]:
                future.result()
        if check is not None:
            check(staged)
        if state(spark, path)["version"] != now["version"]:
            raise RuntimeError("the tables were changed by another commit; nothing was written over it")
    except Exception:
        for w in written.values():
            delete(spark, f"{path}/{w['folder']}")
        raise
    finally:
        delete(spark, aside)
    new = {"version": version, "tokens": now["tokens"] | (tokens or {}), "tables": tables, "stale": stale}
    write_text(spark, f"{path}/{POINTER}", json.dumps(new))
    for folder in now["stale"]:
        delete(spark, f"{path}/{folder}")
    return new | {"written": written}


def emptied(spark: SparkSession, path: str) -> None:
    """No tables from now on; other files in the folder stay."""
    delete(spark, f"{path}/{POINTER}")
    delete(spark, f"{path}/data")
