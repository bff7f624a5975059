"""Where a delimited file can be cut: the exact record starts and row numbers of its ranges.

A line's end is a record's end only outside quotes. In well-formed input the
parity of the quotes before a byte tells whether it is inside, so each range
reports, for both parities, how many records end in it and where the first
does; a running parity over the ranges then picks the right answer for each.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of a range at most as long as there are no more than LIMIT of them, and at least; and what is read at a time.
RANGE, LEAST, CHUNK = 64 << 20, 1 << 20, 4 << 20
#: Bytes that an index may take, 24 for a split, and the splits that fit: the power of two below.
BUDGET = 4 << 20
LIMIT = 1 << (BUDGET // 24).bit_length() - 1


@dataclass(frozen=True)
class SplitIndex:
    """``splits``: first byte, end byte and first row of each part; ``records`` in all."""

    splits: tuple[tuple[int, int, int], ...]
    records: int

    def within(self, limit: int) -> SplitIndex:
        """An index of at most ``limit`` splits, a power of two, over the same records: while there are more, neighbours become one."""
        kept = self.splits
        while len(kept) > limit:
            kept = tuple((pair[0][0], pair[-1][1], pair[0][2]) for pair in (kept[i : i + 2] for i in range(0, len(kept), 2)))
        return SplitIndex(kept, self.records)

    def holding(self, rows) -> list[int]:
        """Numbers of the splits that hold some rows."""
        firsts = [s[2] for s in self.splits]
        return sorted({bisect_right(firsts, r) - 1 for r in rows if 0 <= r < self.records})

    def covering(self, start: int, count: int) -> list[tuple[int, int, int]]:
        """The parts that hold rows ``start`` to ``start + count - 1``."""
        firsts = [s[2] for s in self.splits]
        low = max(0, bisect_right(firsts, start) - 1)
        return [s for s in self.splits[low:] if s[2] < start + count]


def scan_range(store, path: str, begin: int, end: int) -> tuple[int, int, int, int, int]:
    """Quotes, then for an even and an odd number before the range: records that end here and offset after the first end."""
    quotes, ends, first = 0, [0, 0], [-1, -1]
    with store.open_input_file(path) as f:
        at = begin
        while at < end:
            data = np.frombuffer(f.read_at(min(CHUNK, end - at), at), np.uint8)
            if not len(data):
                break
            line, marks = np.flatnonzero(data == 10), np.flatnonzero(data == 34)
            odd = (np.searchsorted(marks, line) + quotes) & 1
            for parity in (0, 1):
                hit = line[odd == parity] if len(marks) or quotes & 1 == parity else line[:0]
                if len(hit) and first[parity] < 0:
                    first[parity] = at + int(hit[0]) + 1
                ends[parity] += len(hit)
            quotes += len(marks)
            at += len(data)
    return quotes, ends[0], first[0], ends[1], first[1]


def chain(found: list[tuple[int, int, int, int, int]], size: int) -> SplitIndex:
    """Parts from the ranges' answers, in order."""
    starts: list[tuple[int, int]] = [(0, 0)] if size else []
    parity = rows = 0
    for i, (quotes, even, first_even, odd, first_odd) in enumerate(found):
        count, first = (odd, first_odd) if parity else (even, first_even)
        if i and count and first < size:
            starts.append((first, rows + 1))
        rows += count
        parity ^= quotes & 1
    splits = tuple((b, starts[i + 1][0] if i + 1 < len(starts) else size, r) for i, (b, r) in enumerate(starts))
    return SplitIndex(splits, rows)


def step_for(size: int, tasks: int, limit: int = LIMIT) -> int:
    """Bytes of a range: three for each task that the cluster runs at a time, within LEAST and RANGE; of what would be more than ``limit`` ranges twice as much, and again."""
    step = max(LEAST, min(RANGE, -(-size // (3 * tasks))))
    while -(-size // step) > limit:
        step *= 2
    return step


def build(spark: SparkSession, path: str, size: int, step: int | None = None) -> SplitIndex:
    """The index of a file; one row of numbers for each of at most LIMIT ranges comes to the driver. Small files are scanned here."""
    from ..sources.files import filesystem

    step = step or step_for(size, spark.sparkContext.defaultParallelism)
    ranges = [(b, min(b + step, size)) for b in range(0, size, step)]
    if len(ranges) <= 1:
        store, name = filesystem(path)
        found = [scan_range(store, name, b, e) for b, e in ranges]
    else:

        def scan(batches):
            store, name = filesystem(path)
            for batch in batches:
                for i, b, e in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                    yield pa.RecordBatch.from_pydict(dict(zip(("i", "q", "a", "b", "c", "d"), ([x] for x in (i, *scan_range(store, name, b, e))), strict=True)))

        todo = spark.range(0, len(ranges), 1, len(ranges)).selectExpr("id AS i", f"id * {step} AS b", f"least((id + 1) * {step}, {size}) AS e")
        got = todo.mapInArrow(scan, "i bigint, q bigint, a bigint, b bigint, c bigint, d bigint").collect()
        found = [tuple(r)[1:] for r in sorted(got)]
    return completed(chain(found, size), path, size)


def completed(index: SplitIndex, path: str, size: int) -> SplitIndex:
    """The index of a whole file: within the budget, and with the last record, also if it has no line's end."""
    from ..sources.files import filesystem

    index = index.within(LIMIT)
    if size:
        store, name = filesystem(path)
        with store.open_input_file(name) as f:
            if f.read_at(1, size - 1) != b"\n":
                return SplitIndex(index.splits, index.records + 1)
    return index
