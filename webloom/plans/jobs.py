"""Running an analysis so that it can be watched and called off."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession


class Analysis:
    """An action on a DataFrame in a thread of its own: started, finished, cancelled or failed."""

    def __init__(self, spark: SparkSession, make: Callable[[], DataFrame], act: Callable[[DataFrame], object]):
        self.spark, self.tag = spark, f"webloom-{uuid.uuid4().hex}"
        self.state, self.result, self.error = "running", None, None
        self._make, self._act, self._stop = make, act, threading.Event()
        self._thread = InheritableThread(target=self._run)
        self._thread.start()

    def _run(self) -> None:
        self.spark.sparkContext.addJobTag(self.tag)
        try:
            self.result = self._act(self._make())
            self.state = "cancelled" if self._stop.is_set() else "finished"
        except Exception as wrong:  # noqa: BLE001  told to whoever waits
            self.state, self.error = ("cancelled", None) if self._stop.is_set() else ("failed", wrong)
        finally:
            self.spark.sparkContext.removeJobTag(self.tag)

    def cancel(self) -> None:
        self._stop.set()
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def wait(self, seconds: float | None = None) -> str:
        self._thread.join(seconds)
        return self.state


def progress(spark: SparkSession) -> float:
    """The share of the tasks of running stages that are done; 1 if none runs."""
    tracker = spark.sparkContext.statusTracker()
    stages = [s for s in map(tracker.getStageInfo, tracker.getActiveStageIds()) if s]
    total = sum(s.numTasks for s in stages)
    return sum(s.numCompletedTasks for s in stages) / total if total else 1.0
