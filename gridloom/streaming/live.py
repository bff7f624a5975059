"""Reading a file while its index is made, and matches while a filter runs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import SparkSession

from ..operators.filters import Predicate
from ..plans import split_index
from ..plans.split_index import SplitIndex
from ..sheet import FilteredSheet, Sheet
from ..sources import files
from .jobs import Job, log
from .parts import PartLog


class LiveIndex:
    """The index of a file in the making: ranges are scanned in any order, and those before the first missing one are published."""

    def __init__(self, spark: SparkSession, path: str, size: int, step: int | None = None):
        self.spark, self.path, self.size = spark, path, size
        step = step or split_index.step_for(size, spark.sparkContext.defaultParallelism)
        self.ranges = [(b, min(b + step, size)) for b in range(0, size, step)]
        self.log = PartLog(spark, len(self.ranges))
        self._chained: tuple[int, SplitIndex] = (0, SplitIndex((), 0))

    def scan(self, part: int) -> None:
        """Scan one range and commit what it found; runs in a task."""
        scan_and_commit(self.log, self.path, part, *self.ranges[part])

    def run(self) -> SplitIndex:
        """Scan all ranges by a Spark job, and give the whole index."""
        given, path, todo = self.log, self.path, list(enumerate(self.ranges))
        log(given)
        if todo:
            self.spark.sparkContext.parallelize(todo, len(todo)).foreach(lambda x: scan_and_commit(given, path, x[0], *x[1]))
        return split_index.completed(split_index.chain(self._found(), self.size), path, self.size)

    def _found(self) -> list[tuple[int, int, int, int, int]]:
        return [(p["quotes"], p["even"], p["first_even"], p["odd"], p["first_odd"]) for p in self.log.prefix()]

    def published(self) -> SplitIndex:
        """The parts whose records are all known by now. A later one has these and more."""
        found = self._found()
        if len(found) > self._chained[0]:
            index = split_index.chain(found, self.ranges[len(found) - 1][1])
            # where the last part ends isn't known until the next one begins
            self._chained = len(found), SplitIndex(index.splits[:-1], index.splits[-1][2] if index.splits else 0)
        return self._chained[1]


def scan_and_commit(to: PartLog, path: str, part: int, begin: int, end: int) -> None:
    store, name = files.filesystem(path)
    quotes, even, first_even, odd, first_odd = split_index.scan_range(store, name, begin, end)
    to.commit(part, bytes=end - begin, quotes=quotes, even=even, first_even=first_even, odd=odd, first_odd=first_odd)


class LiveSheet:
    """A file that is shown while it's indexed."""

    def __init__(self, spark: SparkSession, path: str, step: int | None = None, start: bool = True, **options):
        self._index = LiveIndex(spark, path, files.stamp(path)[0], step)
        self._first = Sheet.open(spark, path, index=SplitIndex((), 0), **options)
        self.job = Job(spark, self._index.run) if start else None

    @property
    def done(self) -> bool:
        return self.job is not None and self.job.progress().done

    def sheet(self) -> Sheet:
        """The sheet as far as it's indexed: its rows are those before the first range that isn't scanned."""
        index = self.job.wait() if self.done else self._index.published()
        return self._first.indexed(index)

    def count(self) -> int:
        return self.sheet().count()

    def rows(self, start: int, count: int):
        """Records that are there already; ``RowNotIndexed`` for others."""
        return self.sheet().rows(start, count)

    def wait(self) -> Sheet:
        self.job.wait()
        return self.sheet()


@dataclass(frozen=True)
class LiveMatches(FilteredSheet):
    """Matches that are there while the file's parts are still being read: those of the parts before the first one that isn't done."""

    job: Job | None = None
    log: PartLog | None = None

    @property
    def _by_part(self) -> list[int]:
        if self.job is not None and self.job.progress().done:
            self.job.wait()
            known = self.log.read()
            return [known.get(i, {}).get("matches", 0) for i in range(self.log.parts)]
        return [p["matches"] for p in self.log.prefix()]


def filter_live(sheet: Sheet, predicates: Sequence[Predicate]) -> LiveMatches:
    """Filter a file in the background. Each part's matches are counted as its task ends."""
    found = sheet.filter(predicates)
    splits = sheet.index.splits
    to = PartLog(sheet.spark, len(splits))
    ends = [*(s[2] for s in splits[1:]), sheet.index.records]
    sizes = [(e - b, after - row) for (b, e, row), after in zip(splits, ends, strict=True)]

    def count(batches):
        n = sum(b.num_rows for b in batches)
        part = TaskContext.get().partitionId()
        if part < len(sizes):
            to.commit(part, matches=n, bytes=sizes[part][0], rows=sizes[part][1])
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    def run() -> int:
        log(to)
        return sum(r["n"] for r in found.places().mapInArrow(count, "n bigint").collect())  # a number for each part

    return LiveMatches(found.sheet, found.matches, found.predicates, Job(sheet.spark, run), to)


def first_matches(matches: LiveMatches, count: int) -> list:
    """The first matches, as many of them as are there already."""
    here = sum(matches._by_part)
    return matches.rows(0, min(count, here)).collect() if here and count else []


__all__ = ["LiveIndex", "LiveMatches", "LiveSheet", "filter_live", "first_matches"]
