"""Expressions over ``fields``, an array of strings with one element for each cell.

A cell beyond the end of its row is missing, which differs from empty: a
lookup gives null for it. Filters use that as it is; everything else takes
missing as empty. Bytes that aren't UTF-8 travel as Latin-1, one character a
byte, see ``lift``; a file's sheet is lifted, a table's is not.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The byte order mark as lifted characters, and the longest text that is shown.
LIFTED_BOM = "ï»¿"
SHOWN = 80


def lift(value: Column) -> Column:
    """Bytes as text, byte for character."""
    return F.decode(value, "ISO-8859-1")


def lower(value: Column) -> Column:
    """The bytes of lifted text."""
    return F.encode(value, "ISO-8859-1")


def lift_bytes(value: bytes | str) -> str:
    return (value.encode() if isinstance(value, str) else value).decode("latin-1")


def cell(fields: Column, column: int) -> Column:
    return F.get(fields, F.lit(column))


def cell_or_empty(fields: Column, column: int) -> Column:
    return F.coalesce(cell(fields, column), F.lit(""))


def contains(fields: Column, column: int, needle: str) -> Column:
    return F.contains(cell(fields, column), F.lit(needle))


def equals(fields: Column, column: int, value: str) -> Column:
    return cell(fields, column) == F.lit(value)


def all_of(predicates: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates)


def literal_pattern(text: str) -> str:
    """A regular expression that matches ``text`` and nothing else."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def padded(fields: Column, width: int) -> Column:
    """``fields`` with empty cells up to ``width``; wider rows stay."""
    return F.concat(fields, F.array_repeat(F.lit(""), F.greatest(F.lit(0), F.lit(width) - F.size(fields))))


def pieces(value: Column, separator: str, count: int) -> Column:
    """At most ``count`` pieces, the rest in the last, and empty ones up to ``count``."""
    return padded(F.split(value, literal_pattern(separator), count), count)


def piece_count(value: Column, separator: str) -> Column:
    return F.size(F.split(value, literal_pattern(separator), -1))


def tail(fields: Column, start: int) -> Column:
    return F.slice(fields, start + 1, F.greatest(F.lit(0), F.size(fields) - start))


def split_column(fields: Column, column: int, separator: str, count: int) -> Column:
    full = padded(fields, column + 1)
    middle = pieces(cell_or_empty(fields, column), separator, count)
    return F.concat(F.slice(full, 1, column), middle, tail(full, column + 1))


def join_text(fields: Column, columns: Sequence[int], separator: str) -> Column:
    """Cells in the order of ``columns``; missing ones are empty, so they aren't skipped."""
    return F.array_join(F.array(*(cell_or_empty(fields, c) for c in columns)), separator)


def join_columns(fields: Column, columns: Sequence[int], separator: str) -> Column:
    low, high, gone = min(columns), max(columns), set(columns)
    full = padded(fields, high + 1)
    between = [cell_or_empty(fields, c) for c in range(low, high + 1) if c not in gone]
    return F.concat(F.slice(full, 1, low), F.array(join_text(fields, columns, separator), *between), tail(full, high + 1))


def arrange(fields: Column, width: int, columns: Sequence[int]) -> Column:
    """The first ``width`` cells as ``columns`` says, then what a wider row has."""
    return F.concat(F.array(*(cell_or_empty(fields, c) for c in columns)), tail(fields, width))


def occurrences(value: Column, needle: str) -> Column:
    """Non-overlapping occurrences, from the left."""
    return F.floor((F.length(value) - F.length(F.replace(value, F.lit(needle), F.lit("")))) / len(needle)).cast("bigint")


def replace_all(fields: Column, needle: str, replacement: str) -> Column:
    return F.transform(fields, lambda v: F.replace(v, F.lit(needle), F.lit(replacement)))


def count_all(fields: Column, needle: str) -> Column:
    return F.aggregate(fields, F.lit(0).cast("bigint"), lambda total, v: total + occurrences(v, needle))


def with_edits(fields: Column, edits: Column) -> Column:
    """``fields`` where ``edits``, a map from column to value or null, has a value for an existing cell."""
    return F.when(edits.isNull(), fields).otherwise(F.transform(fields, lambda v, i: F.coalesce(F.try_element_at(edits, i), v)))


def edit_map(edits: Mapping[int, str]) -> Column:
    return F.create_map(*(x for c, v in sorted(edits.items()) for x in (F.lit(c), F.lit(v))))


def quoted(value: Column, delimiter: str, force: Column | bool = False) -> Column:
    special = F.contains(value, F.lit(delimiter)) | F.contains(value, F.lit('"')) | F.contains(value, F.lit("\r")) | F.contains(value, F.lit("\n"))
    force = F.lit(force) if isinstance(force, bool) else force
    return F.when(special | force, F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)


def record(fields: Column, delimiter: str, bom: bool = False, ending: Column | None = None) -> Column:
    """One delimited record. A first cell that begins with a byte order mark, in a file without one, and a
    sole empty cell without a line's end are quoted, so that both are read as they were written."""
    end = F.lit("") if ending is None else ending
    first = F.get(fields, F.lit(0))
    force = F.lit(False) if bom else F.startswith(first, F.lit(LIFTED_BOM))
    force = force | ((F.size(fields) == 1) & (first == "") & (end == ""))
    cells = F.transform(fields, lambda v, i: quoted(v, delimiter, (i == 0) & force))
    return F.concat(F.array_join(cells, delimiter), end)


def tsv(fields: Column) -> Column:
    """A row for the clipboard."""
    return F.array_join(F.transform(fields, lambda v: quoted(v, "\t")), "\t")


def cell_kind(value: Column) -> Column:
    number = value.rlike(r"\A[0-9+\-.eE]+\z") & value.rlike("[0-9]")
    return F.when(value == "", "empty").when(number, "number").otherwise("text")


def looks_like_name(value: Column) -> Column:
    return value.rlike(r"\A[A-Za-z_][A-Za-z0-9_]*\z")


def shown(value: Column, limit: int = SHOWN) -> Column:
    """One line of at most ``limit`` characters."""
    flat = F.replace(F.replace(value, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    return F.when(F.length(flat) > limit, F.concat(F.left(flat, F.lit(limit - 3)), F.lit("..."))).otherwise(flat)
