"""Literal search in row-major order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidOption


def hits(rows: DataFrame, needle: str, start: tuple[int, int] = (0, 0)) -> DataFrame:
    """Every cell at or after ``start`` that contains ``needle``: its ``row``, ``column`` and what else ``rows`` carry."""
    if not needle:
        raise InvalidOption("search needs a query")
    row, column = start
    kept = rows.where(F.col("row") >= row)
    others = [c for c in rows.columns if c not in ("row", "fields")]
    cells = kept.select("row", *others, F.posexplode("fields").alias("column", "_text"))
    found = cells.where(F.contains("_text", F.lit(needle))).drop("_text")
    return found.where((F.col("row") > row) | (F.col("column") >= column))


def find_next(rows: DataFrame, needle: str, start: tuple[int, int] = (0, 0)) -> DataFrame:
    """The first hit, or no row. Each task passes on its first alone."""
    return hits(rows, needle, start).orderBy("row", "column").limit(1)
