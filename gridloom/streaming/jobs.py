"""Handles of background operations: Spark's job groups carry cancellation, its status tracker the progress."""

from __future__ import annotations

import contextvars
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import SparkSession

from .parts import PartLog, totals


class Cancelled(Exception):
    """The operation was asked to stop."""


_current: contextvars.ContextVar[Job | None] = contextvars.ContextVar("job", default=None)


def check() -> None:
    """Raise in an operation that was asked to stop. Called between its steps."""
    job = _current.get()
    if job and job._asked.is_set():
        raise Cancelled


def commit() -> None:
    """The last moment at which the operation can be stopped: after this its output gets its name."""
    job = _current.get()
    if job:
        with job._lock:
            if job._asked.is_set():
                raise Cancelled
            job._committed = True


def log(parts: PartLog) -> None:
    """Let the running operation's progress count what the tasks of a step commit there. The step before is over."""
    job = _current.get()
    if job:
        job._logs.append(parts)


@dataclass(frozen=True)
class Progress:
    """Tasks of all steps so far; bytes, rows and matches that the present step's tasks have done, each counted once however often it ran."""

    tasks: int
    finished: int
    seconds: float
    done: bool
    cancelled: bool
    bytes: int = 0
    rows: int = 0
    matches: int = 0

    @property
    def percent(self) -> float:
        return 100.0 if self.done and not self.cancelled else 100 * self.finished / self.tasks if self.tasks else 0.0


class Job:
    """One operation on a thread of its own. A cancelled one gives None and leaves no output."""

    def __init__(self, spark: SparkSession, work: Callable[[], Any]):
        self._spark, self._group = spark, f"job-{uuid.uuid4().hex}"
        self._result: Any = None
        self._error: BaseException | None = None
        self._asked, self._lock, self._committed = threading.Event(), threading.Lock(), False
        self._logs: list[PartLog] = []
        self._began = time.monotonic()
        self._ended: float | None = None
        self.cancelled = False

        def run():
            spark.sparkContext.setJobGroup(self._group, "gridloom", interruptOnCancel=False)
            _current.set(self)
            try:
                result = work()
                with self._lock:  # what has published nothing can still be taken back
                    if self._asked.is_set() and not self._committed:
                        raise Cancelled
                    self._committed, self._result = True, result
            except BaseException as e:  # handed on by wait()
                if self._asked.is_set() and not self._committed:
                    self.cancelled = True
                else:
                    self._error = e
            finally:
                self._ended = time.monotonic()

        self._thread = InheritableThread(target=run, daemon=True)
        self._thread.start()

    def cancel(self) -> bool:
        """Ask the operation to stop, in the Spark jobs it runs or will run; whether it's not too late."""
        with self._lock:
            if self._committed:
                return False
            self._asked.set()
        self._spark.sparkContext._jsc.sc().cancelJobGroupAndFutureJobs(self._group)
        return True

    def progress(self) -> Progress:
        tracker = self._spark.sparkContext.statusTracker()
        tasks = finished = 0
        for job in tracker.getJobIdsForGroup(self._group):
            for stage in getattr(tracker.getJobInfo(job), "stageIds", ()):
                info = tracker.getStageInfo(stage)
                if info:
                    tasks, finished = tasks + info.numTasks, finished + info.numCompletedTasks
        step = totals(self._logs[-1:])
        work = {name: step.get(name, 0) for name in ("bytes", "rows", "matches")}
        return Progress(tasks, finished, (self._ended or time.monotonic()) - self._began, self._ended is not None, self.cancelled, **work)

    def wait(self, timeout: float | None = None) -> Any:
        self._thread.join(timeout)
        if self._thread.is_alive():
            raise TimeoutError("the operation is still running")
        if self._error:
            raise self._error
        return self._result


class Latest:
    """Runs only the newest of the requests for a window: an older one is cancelled."""

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._job: Job | None = None

    def submit(self, work: Callable[[], Any]) -> Job:
        if self._job and not self._job.progress().done:
            self._job.cancel()
        self._job = Job(self._spark, work)
        return self._job
