"""Row ordinals in a given order, without gathering a large table into one task."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

from ..shared import shared_dir

#: Rows, and bytes of them, that one window partition or range holds, about; ranges at most, as many rows as are summed up and sent to all tasks.
ROWS, BYTES, RANGES = 500_000, 128 << 20, 200_000
#: Bits of a generated id that count within a partition.
_BITS = 33


def _size(df: DataFrame) -> Column:
    """Bytes of a row, about: those of its texts and of what is nested, as text, and eight for any other column."""
    long = [f for f in df.schema if isinstance(f.dataType, (StringType, BinaryType, ArrayType, MapType, StructType))]
    flat = [F.col(f.name) if isinstance(f.dataType, (StringType, BinaryType)) else F.col(f.name).cast("string") for f in long]
    return sum((F.coalesce(F.octet_length(c), F.lit(0)).cast("bigint") for c in flat), F.lit(8 * (len(df.columns) - len(long))).cast("bigint"))


def with_ordinal(df: DataFrame, keys: Sequence[str], name: str = "row", descending: bool = False) -> DataFrame:
    """Add ``name``: 0, 1, ... in the total order of the columns ``keys``, which must tell rows apart.

    ``descending`` turns the first key alone, so ties keep their order. A
    table small by rows and by bytes is one window. A larger one is dealt by
    ranges of all keys, so that one value of the first is no task's alone,
    sorted within them and written to the shared folder with each row's place
    in its range; the ranges' bases are a running sum over at most RANGES rows.
    """
    order = [F.col(keys[0]).desc() if descending else F.col(keys[0]).asc(), *(F.col(k).asc() for k in keys[1:])]
    total, size = df.agg(F.count("*"), F.coalesce(F.sum(_size(df)), F.lit(0))).first()
    if total <= ROWS and size <= BYTES:
        return df.withColumn(name, (F.row_number().over(W.orderBy(*order)) - 1).cast("bigint"))
    ranges = min(RANGES, max(-(-total // ROWS), -(-size // BYTES)))
    placed = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    path = f"{shared_dir(df.sparkSession)}/ordinals-{uuid.uuid4().hex}"
    placed.write.parquet(path)
    placed = df.sparkSession.read.schema(placed.schema).parquet(path).withColumn("_range", F.shiftright("_place", _BITS))
    base = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    base = base.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_base"))  # a row for each range
    ordinal = F.col("_base") + F.col("_place").bitwiseAND((1 << _BITS) - 1)
    return placed.join(F.broadcast(base), "_range").withColumn(name, ordinal.cast("bigint")).select(*df.columns, name)
