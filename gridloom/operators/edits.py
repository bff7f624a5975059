"""Sparse edits: values by row and column that take the place of existing cells."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells

#: Up to so many edited rows the edits are a literal in the plan; beyond, they are a joined table.
LITERAL_ROWS = 64
#: Edits of so many bytes, about, are sent to all tasks, so rows stay where they are; more are shuffled.
SENT_BYTES = 8 << 20


def keeps_order(edits: Mapping[tuple[int, int], str]) -> bool:
    """Whether rows keep their order and partitions when these edits are applied."""
    return sum(len(v) + 64 for v in edits.values()) <= SENT_BYTES


def edit_table(spark: SparkSession, edits: Mapping[tuple[int, int], str]) -> DataFrame:
    return spark.createDataFrame([(r, c, v) for (r, c), v in sorted(edits.items())], "row bigint, column int, value string")


def apply_edits(rows: DataFrame, edits: Mapping[tuple[int, int], str] | DataFrame) -> DataFrame:
    """``rows`` with edited ``fields``; edits of cells that don't exist have no effect.

    ``raw``, where there is one, becomes null in edited rows and in no others.
    Edits given as a table are grouped by row and joined; the optimizer sends
    them to all tasks only if their size allows it.
    """
    sent = False
    if isinstance(edits, Mapping):
        by_row: dict[int, dict[int, str]] = {}
        for (row, column), value in edits.items():
            by_row.setdefault(row, {})[column] = value
        if not by_row:
            return rows
        if len(by_row) <= LITERAL_ROWS:
            found = F.lit(None).cast("map<int,string>")
            for row, own in sorted(by_row.items(), reverse=True):
                found = F.when(F.col("row") == row, cells.edit_map(own)).otherwise(found)
            kept = {"raw": F.when(~F.col("row").isin(list(by_row)), F.col("raw"))} if "raw" in rows.columns else {}
            return rows.withColumns({"fields": cells.with_edits(F.col("fields"), found), **kept})
        sent = keeps_order(edits)
        edits = edit_table(rows.sparkSession, edits)
    grouped = edits.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("column", "value"))).alias("_edits"))
    joined = rows.join(F.broadcast(grouped) if sent else grouped, "row", "left")
    kept = {"raw": F.when(F.col("_edits").isNull(), F.col("raw"))} if "raw" in rows.columns else {}
    return joined.withColumns({"fields": cells.with_edits(F.col("fields"), F.col("_edits")), **kept}).select(*rows.columns)


def invalid_edits(rows: DataFrame, edits: Mapping[tuple[int, int], str] | DataFrame) -> DataFrame:
    """Edits whose cell doesn't exist: the row is missing, or too short."""
    if isinstance(edits, Mapping):
        edits = edit_table(rows.sparkSession, edits)
    size = rows.select("row", F.size("fields").alias("_size"))
    wanted = edits.join(size, "row", "left")
    return wanted.where(F.col("_size").isNull() | (F.col("column") >= F.col("_size")) | (F.col("column") < 0)).drop("_size")
