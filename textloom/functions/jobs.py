"""Queries that run while others do, and results that are kept for a while.

``start`` runs a function of Spark in a thread of its own under a job tag, so its jobs can be told apart: how far they are,
and an end to them alone.  ``Results`` keeps what functions return as Parquet, by function and arguments, until it is too old.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession


class Job:
    """A function that runs; ``value`` and ``error`` once it is done."""

    def __init__(self, spark: SparkSession, f: Callable[..., Any], args: tuple, kwargs: dict):
        self.context, self.tag = spark.sparkContext, f"textloom-{uuid.uuid4().hex}"
        self.value: Any = None
        self.error: BaseException | None = None
        self.cancelled = False

        def run() -> None:
            self.context.setJobGroup(self.tag, self.tag)  # progress goes by group, the end by tag
            self.context.addJobTag(self.tag)
            try:
                if not self.cancelled:
                    self.value = f(*args, **kwargs)
            except BaseException as e:  # noqa: BLE001  given to who waits
                self.error = e

        self._thread = InheritableThread(target=run, daemon=True)
        self._thread.start()

    @property
    def done(self) -> bool:
        return not self._thread.is_alive()

    def progress(self) -> tuple[int, int]:
        """(tasks that are finished, tasks) of the stages that the job has at work now."""
        tracker, finished, every = self.context.statusTracker(), 0, 0
        for j in tracker.getJobIdsForGroup(self.tag):
            info = tracker.getJobInfo(j)
            for stage in info.stageIds if info and info.status == "RUNNING" else ():
                s = tracker.getStageInfo(stage)
                if s:
                    finished, every = finished + s.numCompletedTasks, every + s.numTasks
        return finished, every

    def cancel(self) -> None:
        """End this job's work; that of others goes on."""
        self.cancelled = True
        self.context.cancelJobsWithTag(self.tag)

    def result(self, seconds: float | None = None) -> Any:
        """The function's value, when it is there; what it raised is raised."""
        self._thread.join(seconds)
        if not self.done:
            raise TimeoutError(self.tag)
        if self.error:
            raise self.error
        return self.value


def start(spark: SparkSession, f: Callable[..., Any], *args: Any, **kwargs: Any) -> Job:
    return Job(spark, f, args, kwargs)


class Results:
    """What functions gave, in a folder that driver and executors share; ``seconds`` old at most.

    A result is written to a folder of its own and published by renaming it to its time, so readers see whole results only
    and one that fails leaves the one before.  Arguments are to be values that JSON can say.
    """

    def __init__(self, spark: SparkSession, path: str, seconds: float = 3600.0, clock: Callable[[], float] = time.time):
        self.spark, self.path, self.seconds, self.clock = spark, path.rstrip("/"), seconds, clock
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _folder(self, f: Callable, args: tuple, kwargs: dict) -> str:
        key = json.dumps([f.__module__, f.__qualname__, args, kwargs], sort_keys=True)
        return f"{self.path}/{hashlib.sha256(key.encode()).hexdigest()[:32]}"

    def _times(self, folder: str) -> list[int]:
        """Milliseconds when results were made, oldest first."""
        if not self._fs.exists(self._path(folder)):
            return []
        return sorted(int(x.getPath().getName()) for x in self._fs.listStatus(self._path(folder)) if x.getPath().getName().isdigit())

    def get(self, f: Callable[..., DataFrame], *args: Any, **kwargs: Any) -> DataFrame:
        """The kept result of f(spark, ...), made anew if there is none or it is too old."""
        folder = self._folder(f, args, kwargs)
        times = self._times(folder)
        if not times or self.clock() * 1000 - times[-1] > self.seconds * 1000:
            return self.refresh(f, *args, **kwargs)
        return self.spark.read.parquet(f"{folder}/{times[-1]}")

    def refresh(self, f: Callable[..., DataFrame], *args: Any, **kwargs: Any) -> DataFrame:
        """Make a result anew; the one before stays for those who read it, older ones go."""
        folder = self._folder(f, args, kwargs)
        before, made = self._times(folder), int(self.clock() * 1000)
        made = max(made, before[-1] + 1) if before else made
        draft = f"{folder}/_draft-{uuid.uuid4().hex}"
        f(self.spark, *args, **kwargs).write.parquet(draft)
        if not self._fs.rename(self._path(draft), self._path(f"{folder}/{made}")):
            raise RuntimeError(f"can't publish {folder}/{made}")
        for old in before[:-1]:
            self._fs.delete(self._path(f"{folder}/{old}"), True)
        return self.spark.read.parquet(f"{folder}/{made}")


def every(spark: SparkSession, seconds: float, task: Callable[[int], None], check: str, rounds: int | None = None):
    """Run ``task(n)`` every so many seconds, by a stream's trigger: n goes on after a restart from the folder ``check``.

    Returns the streaming query, to be stopped; with ``rounds`` it ends by itself after so many.
    """
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    box: dict[str, Any] = {}

    def run(_: DataFrame, n: int) -> None:
        if rounds is None or n < rounds:
            task(n)
        elif "query" in box:
            box["query"].stop()

    box["query"] = ticks.writeStream.foreachBatch(run).option("checkpointLocation", check).trigger(processingTime=f"{int(seconds * 1000)} milliseconds").start()
    return box["query"]
