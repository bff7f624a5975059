"""Literal replacement of all occurrences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidOption
from ..functions import cells


def replaced(rows: DataFrame, needle: str, replacement: str) -> DataFrame:
    """Rows with new ``fields`` and ``replacements``, how many there were in the row."""
    if not needle:
        raise InvalidOption("replace needs a query")
    fields = F.col("fields")
    return rows.withColumns({"replacements": cells.count_all(fields, needle), "fields": cells.replace_all(fields, needle, replacement)})


def replacement_total(rows: DataFrame, needle: str) -> DataFrame:
    return rows.agg(F.coalesce(F.sum(cells.count_all(F.col("fields"), needle)), F.lit(0)).alias("replacements"))
