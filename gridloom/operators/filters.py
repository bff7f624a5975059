"""Literal filters joined by AND, and ranges of their matches."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidOption, MatchNotIndexed
from ..functions import cells
from ..plans.ordinals import with_ordinal


#: Ranges of matches that end before this one are cut off the sorted beginning.
NEAR = 100_000


@dataclass(frozen=True)
class Contains:
    column: int
    value: str

    def on(self, fields: Column) -> Column:
        return cells.contains(fields, self.column, self.value)


@dataclass(frozen=True)
class Equals:
    column: int
    value: str

    def on(self, fields: Column) -> Column:
        return cells.equals(fields, self.column, self.value)


Predicate = Contains | Equals


def check(predicates: Sequence[Predicate]) -> None:
    if not predicates:
        raise InvalidOption("filter needs at least one predicate")
    if any(isinstance(p, Contains) and not p.value for p in predicates):
        raise InvalidOption("contains needs a value")
    if any(p.column < 0 for p in predicates):
        raise InvalidOption("filter column is out of range")


def matching(rows: DataFrame, predicates: Sequence[Predicate], fields: str = "fields") -> DataFrame:
    """Rows for which all predicates hold. A missing cell fails its predicate."""
    check(predicates)
    return rows.where(cells.all_of([p.on(F.col(fields)) for p in predicates]))


def match_ordinals(matches: DataFrame, name: str = "match") -> DataFrame:
    """Add each match's place among the matches, in row order."""
    return with_ordinal(matches, ["row"], name)


def match_range(matches: DataFrame, start: int, count: int) -> DataFrame:
    """``count`` matches from the one with ordinal ``start``, in row order, with ordinal ``match``.

    Past the last match it's an error, fewer than asked are returned at the
    end, and a count of 0 gives none. Near the beginning the engine keeps
    ``start + count`` rows of each partition at most; deeper, ordinals are
    counted by ranges of rows, so no task holds what comes before.
    """
    if start < 0 or count < 0:
        raise InvalidOption("match ranges begin at 0")
    if not count:
        return matches.limit(0).withColumn("match", F.lit(0).cast("bigint"))
    found = matches.count()
    if start >= found:
        raise MatchNotIndexed(start, found)
    if start + count > NEAR:
        return match_ordinals(matches).where(F.col("match").between(start, start + count - 1))
    window = matches.orderBy("row").offset(start).limit(count)
    return with_ordinal(window, ["row"], "match").withColumn("match", F.col("match") + start)
