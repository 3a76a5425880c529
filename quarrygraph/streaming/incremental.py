"""Incremental loads: new files are upserted as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.loader import upsert
from ..sources import storage

_TABLE = "rows"


def upsert_batch(path: str, key: str, order: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: a micro-batch over the rows of the buckets that it touches, by one commit.

    The commit keeps the batch's number, so a batch that runs again after a crash changes nothing,
    and readers see all of a batch or nothing.  What no state needs any more is deleted by the next batch.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        now = storage.state(spark, path)
        if now["tokens"].get("batch", -1) >= batch_id:
            return
        keys = batch.select(key).distinct()
        old = storage.near(spark, path, _TABLE, keys, key, now)
        rows = upsert(None if old is None else old.join(keys, key, "left_semi"), batch, key, order)
        storage.commit(spark, path, {_TABLE: storage.Change(rows, key)}, now, {"batch": batch_id})

    return run


def latest(spark: SparkSession, path: str) -> DataFrame | None:
    """The table as the last whole batch left it; None if there is none."""
    return storage.opened(spark, path, _TABLE)


def stream_upsert(source: DataFrame, path: str, checkpoint: str, key: str, order: str) -> StreamingQuery:
    """Start the load of what is there now; it ends when that is done and a later start goes on from it."""
    return source.writeStream.foreachBatch(upsert_batch(path, key, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
