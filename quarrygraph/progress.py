"""Progress of long steps: a callback is told of their start, of the tasks that Spark has done, and of their end."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import SparkSession

#: Seconds between two looks at Spark's counts.
EVERY = 0.5


@dataclass(frozen=True)
class Event:
    """``state``: start, progress, end or failed; ``done`` of ``total`` tasks of the step's jobs so far; ``rows`` where the step knows them."""

    step: str
    state: str
    done: int = 0
    total: int = 0
    rows: int | None = None
    seconds: float = 0.0


Report = Callable[[Event], None]


class Step:
    """What a step says about itself while it runs."""

    rows: int | None = None


def _tasks(spark: SparkSession, tag: str) -> tuple[int, int]:
    done = total = 0
    tracker = spark.sparkContext.statusTracker()
    for job in spark.sparkContext._jsc.sc().statusTracker().getJobIdsForTag(tag):
        info = tracker.getJobInfo(job)
        for stage in info.stageIds if info else []:
            if (s := tracker.getStageInfo(stage)) is not None:
                done, total = done + s.numCompletedTasks, total + s.numTasks
    return done, total


@contextmanager
def step(spark: SparkSession, name: str, report: Report | None) -> Iterator[Step]:
    """Run the body as a step; without ``report`` nothing is watched.  An error is reported and goes on its way."""
    own = Step()
    if report is None:
        yield own
        return
    sc, tag, began = spark.sparkContext, f"step-{uuid4().hex}", time.time()
    over, last = threading.Event(), (0, 0)

    def tell(state: str, counts: tuple[int, int]) -> None:
        report(Event(name, state, *counts, own.rows, time.time() - began))

    def watch() -> None:
        nonlocal last
        while not over.wait(EVERY):
            now = _tasks(spark, tag)
            if now != last:
                last = now
                tell("progress", now)

    tell("start", (0, 0))
    sc.addJobTag(tag)
    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    state = "failed"
    try:
        yield own
        state = "end"
    finally:
        over.set()
        watcher.join()
        sc.removeJobTag(tag)
        tell(state, _tasks(spark, tag))
