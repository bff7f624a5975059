"""Structural changes of columns, on rows and on header names alike."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidOption
from ..functions import cells

#: Fixed value: columns that a change may make at most.
MOST_COLUMNS = 65_536


def check_columns(columns: Sequence[int], width: int, least: int = 1) -> None:
    if len(columns) < least or len(set(columns)) != len(columns) or any(not 0 <= c < width for c in columns):
        raise InvalidOption(f"columns must be at least {least}, distinct and inside the sheet")


@dataclass(frozen=True)
class Split:
    """One column into ``count``: pieces at a literal separator, the rest in the last."""

    column: int
    separator: str
    count: int
    names: tuple[str, ...] | None = None

    def check(self, width: int) -> None:
        check_columns([self.column], width)
        if not self.separator:
            raise InvalidOption("split needs a separator")
        if self.count < 2 or width - 1 + self.count > MOST_COLUMNS:
            raise InvalidOption("split makes 2 columns or more")
        if self.names is not None and len(self.names) != self.count:
            raise InvalidOption("split needs a name for each column")

    def on(self, fields: Column) -> Column:
        return cells.split_column(fields, self.column, self.separator, self.count)

    def header(self, names: Sequence[str]) -> list[str]:
        new = self.names or (names[self.column], *[""] * (self.count - 1))
        return [*names[: self.column], *new, *names[self.column + 1 :]]


@dataclass(frozen=True)
class Join:
    """Columns, in the order given, into one at the place of the first of them."""

    columns: tuple[int, ...]
    separator: str = ""
    name: str | None = None

    def check(self, width: int) -> None:
        check_columns(self.columns, width, 2)

    def on(self, fields: Column) -> Column:
        return cells.join_columns(fields, self.columns, self.separator)

    def header(self, names: Sequence[str]) -> list[str]:
        low, gone = min(self.columns), set(self.columns)
        new = names[self.columns[0]] if self.name is None else self.name
        return [x for i, n in enumerate(names) for x in ([new] if i == low else []) + ([n] if i not in gone else [])]


@dataclass(frozen=True)
class Arrange:
    """The first ``width`` columns as ``columns`` says; what wider rows have follows."""

    width: int
    columns: tuple[int, ...] = field(default=())

    def check(self, width: int) -> None:
        check_columns(self.columns, self.width)
        if self.width > MOST_COLUMNS:
            raise InvalidOption("too many columns")

    def on(self, fields: Column) -> Column:
        return cells.arrange(fields, self.width, self.columns)

    def header(self, names: Sequence[str]) -> list[str]:
        return [*(names[c] if c < len(names) else "" for c in self.columns), *names[self.width :]]


Change = Split | Join | Arrange


def moved(width: int, block: Sequence[int], place: int) -> Arrange:
    """The columns of ``block``, ascending, before the ``place``-th of the others."""
    check_columns(block, width)
    rest = [c for c in range(width) if c not in set(block)]
    if not 0 <= place <= len(rest):
        raise InvalidOption("the place is outside the sheet")
    return Arrange(width, (*rest[:place], *sorted(block), *rest[place:]))


def deleted(width: int, gone: Sequence[int]) -> Arrange:
    check_columns(gone, width)
    rest = tuple(c for c in range(width) if c not in set(gone))
    if not rest:
        raise InvalidOption("a sheet keeps a column")
    return Arrange(width, rest)


def change(rows: DataFrame, what: Change) -> DataFrame:
    return rows.withColumn("fields", what.on(F.col("fields")))


def split_width(rows: DataFrame, column: int, separator: str) -> DataFrame:
    """``(rows_scanned, max_pieces)``: a missing cell counts as one piece."""
    if not separator:
        raise InvalidOption("split needs a separator")
    size = cells.piece_count(cells.cell_or_empty(F.col("fields"), column), separator)
    return rows.agg(F.count("*").alias("rows_scanned"), F.coalesce(F.max(size), F.lit(0)).cast("bigint").alias("max_pieces"))


#: Fixed value: columns that are shown at a time.
WINDOW = 64


def window(width: int, focused: int) -> range:
    """The columns that are shown with one of them in the middle, as far as there are columns on both sides."""
    if width <= WINDOW:
        return range(width)
    start = min(max(0, focused - WINDOW // 2), width - WINDOW)
    return range(start, start + WINDOW)
