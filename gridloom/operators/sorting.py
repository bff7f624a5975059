"""Stable sort by one column's bytes, with verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells
from ..plans.ordinals import with_ordinal


def keyed(rows: DataFrame, column: int) -> DataFrame:
    return rows.withColumn("key", cells.cell_or_empty(F.col("fields"), column))


def sorted_rows(rows: DataFrame, column: int, descending: bool = False) -> DataFrame:
    """Rows in the order of the column: a range exchange and a sort in each task; ties keep their row order in both directions."""
    key = cells.cell_or_empty(F.col("fields"), column)
    return rows.orderBy(key.desc() if descending else key.asc(), F.col("row").asc())


def sort_ordinals(rows: DataFrame, column: int, descending: bool = False, name: str = "place") -> DataFrame:
    """Rows with their ``key`` and place in the sorted order."""
    return with_ordinal(keyed(rows, column), ["key", "row"], name, descending)


def fingerprint(rows: DataFrame, content: str, *more: Column) -> DataFrame:
    """``(n, mixed, total)`` of a multiset of rows: equal for equal multisets, in any order; and what else is aggregated.

    A sort changes none of it, so the optimizer leaves sorts of ``rows`` out:
    to check one, take the fingerprint of what it wrote.
    """
    return rows.agg(
        *more,
        F.count("*").alias("n"),
        F.coalesce(F.bit_xor(F.xxhash64(F.lit(0), content)), F.lit(0)).alias("mixed"),
        F.coalesce(F.sum(F.xxhash64(F.lit(1), content).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("total"),
    )


def order_violations(placed: DataFrame, descending: bool = False) -> DataFrame:
    """``(adjacencies, violations)``: neighbours by ``place`` whose ``key`` and ``row`` are out of order.

    Neighbours meet by a self-join of places one apart, which spreads by
    place, so no task sees all rows.
    """
    after = placed.select((F.col("place") - 1).alias("place"), F.col("key").alias("_key"), F.col("row").alias("_row"))
    both = placed.select("place", "key", "row").join(after, "place")
    worse = F.col("key") < F.col("_key") if descending else F.col("key") > F.col("_key")
    return both.agg(F.count("*").alias("adjacencies"), F.count_if(worse | ((F.col("key") == F.col("_key")) & (F.col("row") > F.col("_row")))).alias("violations"))


def temporary_bytes(size: int, rows: int) -> int:
    """Bytes of temporary files that a merge sort of so many bytes and rows may need."""
    return 4 * size + 48 * rows
