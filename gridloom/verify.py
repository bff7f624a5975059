"""Checks of written files against what was asked for."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import functions as F

from .errors import InvalidData
from .functions import cells
from .operators import sorting
from .sheet import Sheet


def edits_arrived(written: Sheet, edits: Mapping[tuple[int, int], str]) -> None:
    """Every edited cell of the written file has its value."""
    wanted = written.spark.createDataFrame([(r, c, v) for (r, c), v in edits.items()], "row bigint, column int, value string")
    right = written.body.join(wanted, "row").where(F.get("fields", F.col("column")) == F.col("value")).count()
    if right != len(edits):
        raise InvalidData(f"{len(edits) - right} edited cells differ")


def in_order(written: Sheet, column: int, descending: bool = False) -> int:
    """Rows of the written file, whose neighbours are in order by the column's bytes."""
    placed = sorting.keyed(written.body, column).withColumn("place", F.col("row"))
    got = sorting.order_violations(placed, descending).first()
    if got["violations"]:
        raise InvalidData(f"{got['violations']} rows are out of order")
    return written.body.count()


def same_rows(a: Sheet, b: Sheet) -> None:
    """Both hold the same rows, in any order."""
    left, right = (sorting.fingerprint(s.body.withColumn("_r", cells.record(F.col("fields"), ",")), "_r").first() for s in (a, b))
    if left != right:
        raise InvalidData("the rows differ")
