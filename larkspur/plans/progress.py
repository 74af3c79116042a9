"""Progress of a running block, from Spark's own status tracker."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Progress:
    """Stages that run now, and their tasks."""

    stages: int
    done: int
    total: int

    def __str__(self) -> str:
        return f"{self.done} of {self.total} tasks in {self.stages} stages"


def now(spark: SparkSession) -> Progress:
    tracker = spark.sparkContext.statusTracker()
    known = [s for s in map(tracker.getStageInfo, tracker.getActiveStageIds()) if s is not None]
    return Progress(len(known), sum(s.numCompletedTasks for s in known), sum(s.numTasks for s in known))


@contextmanager
def watch(spark: SparkSession, report: Callable[[Progress], object] | None, every: float = 1.0) -> Iterator[None]:
    """Call ``report`` now and then while the block runs, and once when it ends; None reports nothing.

    The calls come from a thread of the driver. An error in ``report`` ends the reports, not the block.
    """
    if report is None:
        yield
        return
    over = threading.Event()

    def loop() -> None:
        while not over.wait(every):
            report(now(spark))

    thread = threading.Thread(target=loop, name="progress", daemon=True)
    thread.start()
    try:
        yield
    finally:
        over.set()
        thread.join()
    report(now(spark))
