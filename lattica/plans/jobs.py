"""Running an action that can be cancelled and whose progress can be read."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import SparkSession


class Run:
    """``action`` in a job group of its own, on another thread."""

    def __init__(self, spark: SparkSession, action: Callable[[], Any]):
        self.spark, self.group = spark, f"lattica-{uuid.uuid4().hex}"
        self.result: Any = None
        self.error: Exception | None = None
        self._done = threading.Event()

        def work() -> None:
            spark.sparkContext.setJobGroup(self.group, "lattica", True)
            try:
                self.result = action()
            except Exception as e:  # handed to wait()
                self.error = e
            finally:
                self._done.set()

        self._thread = InheritableThread(target=work, daemon=True)
        self._thread.start()

    def progress(self) -> float:
        """Share of the tasks done among those of the stages known so far."""
        tracker = self.spark.sparkContext.statusTracker()
        stages = [s for j in tracker.getJobIdsForGroup(self.group) if (info := tracker.getJobInfo(j)) for i in info.stageIds if (s := tracker.getStageInfo(i))]
        total = sum(s.numTasks for s in stages)
        return 1.0 if self._done.is_set() else sum(s.numCompletedTasks for s in stages) / total if total else 0.0

    def cancel(self) -> None:
        self.spark.sparkContext.cancelJobGroup(self.group)

    def wait(self, seconds: float | None = None) -> Any:
        if not self._done.wait(seconds):
            raise TimeoutError(f"not done after {seconds} s")
        if self.error:
            raise self.error
        return self.result
