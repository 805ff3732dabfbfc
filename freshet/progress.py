"""Progress inside a long stage of work (K3): how many of its tasks have ended, as Spark's status tracker tells it."""

from __future__ import annotations

import contextlib
import threading
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession


@contextlib.contextmanager
def ticking(spark: SparkSession, report: Callable[[int], None], low: int, high: int, every: float = 0.25) -> Iterator[None]:
    """While the block runs, report(percent) is called with rising whole numbers over `low` and under `high`.

    Stages that start inside count as they appear, by their tasks; a stage that was running before counts too. The
    calls come from a thread of their own, one at a time, and the last one is over when the block ends; an error in `report`
    ends the ticks, not the work.
    """
    ended = threading.Event()
    tasks: dict[int, tuple[int, int]] = {}

    def watch() -> None:
        last, tracker = low, spark.sparkContext.statusTracker()
        while not ended.wait(every):
            for stage in tracker.getActiveStageIds():
                info = tracker.getStageInfo(stage)
                if info:
                    tasks[stage] = (info.numCompletedTasks, info.numTasks)
            for stage in set(tasks) - set(tracker.getActiveStageIds()):
                tasks[stage] = (tasks[stage][1], tasks[stage][1])
            known = sum(n for _, n in tasks.values())
            now = min(high - 1, low + (high - low) * sum(n for n, _ in tasks.values()) // known) if known else low
            if now > last:
                last = now
                report(now)

    watcher = threading.Thread(target=watch, daemon=True, name="freshet-progress")
    watcher.start()
    try:
        yield
    finally:
        ended.set()
        watcher.join()
