"""Sheets: immutable views of delimited files and tables with pending edits, and what can be done with them."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import cached_property
from itertools import accumulate
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import BootstrapLimitExceeded, InvalidData, InvalidOption, OperationRefused, MatchNotIndexed, ParseError, RecordTooLarge, RowNotIndexed, SourceChanged
from .functions import cells
from .operators import columns as cols
from .operators import edits as overlay
from .operators import filters, replacing, search, sorting
from .operators.filters import Predicate
from .plans import split_index
from .plans.ordinals import with_ordinal
from .shared import shared_dir
from .sources import delimited, dialect, files, grammar, publication
from .sources.publication import Span
from .streaming import jobs

#: Fixed value: bytes that a copy to the clipboard may have.
CLIPBOARD = 64 << 20


def _text(value: bytes | str) -> str:
    return cells.lift_bytes(value)


def _records(spark: SparkSession, path: str, delimiter: bytes, splits, rows: tuple[int, int] | None = None) -> DataFrame:
    """``(row, offset, ending, raw, fields)`` of some parts of a file, as lifted text."""
    ending = F.when(F.endswith("raw", F.lit("\r\n")), "\r\n").when(F.endswith("raw", F.lit("\n")), "\n").otherwise("")
    return delimited.read(spark, path, delimiter, splits, rows).select("row", "offset", ending.alias("ending"), "raw", "fields")


@dataclass(frozen=True)
class SortSummary:
    rows: int
    mixed: int
    total: Any


def _cells(spark: SparkSession, path: str, delimiter: bytes, splits, rows: tuple[int, int] | None = None) -> DataFrame:
    """``(row, offset, fields)`` alone, for what doesn't write records."""
    return delimited.read(spark, path, delimiter, splits, rows, "row bigint, offset bigint, fields array<string>")


def _content() -> Any:
    """Fields as one text that tells them apart."""
    return F.array_join(F.transform("fields", lambda v: F.concat(F.length(v).cast("string"), F.lit(":"), v)), "")


class Later:
    """A table that is made when it's first asked for."""

    def __init__(self, make: Callable[[], DataFrame]):
        self._make, self._made = make, None

    def get(self) -> DataFrame:
        if self._made is None:
            self._made = self._make()
        return self._made


@dataclass(frozen=True)
class Sorted:
    """What a sorted sheet's file must be: the lines in their order, and the fingerprint of the records before the sort."""

    lines: DataFrame
    rows: int
    mixed: int
    total: Any


@dataclass(frozen=True)
class Match:
    row: int
    column: int
    offset: int | None


@dataclass(frozen=True)
class Sheet:
    """Rows ``(row, offset, ending, raw, fields)`` with the header, if any, kept apart.

    Text is lifted (one character a byte) for files and plain for tables.
    ``raw`` is the record as it was read, or null where the fields have
    changed since. ``edits`` and ``renames`` wait for the next operation that
    takes them; every operation gives a new sheet. ``before`` and ``after``
    are one step of undo and redo. ``in_order`` says that partitions and the
    rows in them already come in the order of ``row``. ``original`` is the file
    that a working copy was made of, with its stamp.
    """

    spark: SparkSession
    held: DataFrame | Later
    names: tuple[str, ...] | None
    dialect: dialect.Dialect
    width: int
    path: str | None = None
    stamp: tuple | None = None
    bom: bool = False
    head_raw: str | None = None
    head_ending: str = "\n"
    head_bytes: int = 0
    lifted: bool = True
    in_order: bool = True
    sorted: Sorted | None = None
    original: tuple[str, tuple] | None = None
    index: split_index.SplitIndex | None = None
    edits: Mapping[tuple[int, int], str] = field(default_factory=dict)
    renames: Mapping[int, str] = field(default_factory=dict)
    before: Sheet | None = None
    after: Sheet | None = None
    opened: Sheet | None = None

    # Opening --------------------------------------------------------------

    @classmethod
    def open(cls, spark: SparkSession, path: str, rows: int = dialect.HEAD_ROWS, delimiter: bytes | None = None, header: str = "auto", sample_bytes: int = dialect.SAMPLE, limit: int = dialect.HEAD_BYTES, step: int | None = None, index: split_index.SplitIndex | None = None) -> Sheet:
        """Detect the dialect on a bounded head and index the file's records, unless an index is given."""
        if rows <= 0 or sample_bytes <= 0 or limit <= 0 or sample_bytes > limit:
            raise InvalidOption("open needs rows, a sample and a limit no smaller than it")
        if header not in ("auto", "first-row", "none"):
            raise InvalidOption(f"header {header!r}")
        known = files.stamp(path)
        size = known[0]
        store, name = files.filesystem(path)
        with store.open_input_file(name) as f:
            sample = f.read_at(min(sample_bytes, size), 0)
            delimiter = grammar.check_delimiter(delimiter) if delimiter else dialect.sniff_delimiter(sample)
            data, first = sample, None
            while first is None:
                first = dialect.head(data, len(data) >= size, delimiter, rows, limit)
                if len(first) < rows and len(data) < size:
                    if len(data) >= limit:
                        raise BootstrapLimitExceeded(limit, len(first))
                    data, first = f.read_at(min(limit, size, 4 * len(data)), 0), None
        parsed = [grammar.parse(r, delimiter, at) for at, r in first]
        has_header = dialect.sniff_header(parsed) if header == "auto" else header == "first-row" and bool(parsed)
        index = index or split_index.build(spark, path, size, step)
        bom = sample.startswith(grammar.BOM)
        body = _records(spark, path, delimiter, index.splits).where(F.col("row") >= int(has_header))
        top = first[0][1][3:] if bom and first else first[0][1] if first else b""
        made = cls(
            spark, body, tuple(_text(v) for v in parsed[0]) if has_header else None, dialect.Dialect(delimiter, has_header), max(map(len, parsed), default=0), path, known, bom,
            _text(top) if has_header else None, _text(grammar.ending(top)) if has_header else "\n", len(first[0][1]) if has_header else 3 * bom, True, index=index,
        )
        return made._settled()

    @classmethod
    def from_dataframe(cls, df: DataFrame, order_by: Sequence[str], names: Sequence[str] | None = None) -> Sheet:
        """A table as a sheet, in the order of keys that tell its rows apart; nulls become missing text, that is empty."""
        names = list(names or df.columns)
        placed = with_ordinal(df, list(order_by))
        fields = F.array(*(F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names))
        body = placed.select("row", F.lit(None).cast("bigint").alias("offset"), F.lit("\n").alias("ending"), F.lit(None).cast("string").alias("raw"), fields.alias("fields"))
        return cls(df.sparkSession, body, tuple(names), dialect.Dialect(b",", False), len(names), lifted=False, in_order=False)._settled()

    def indexed(self, index: split_index.SplitIndex) -> Sheet:
        """The same file by another index, such as one that reaches further."""
        body = _records(self.spark, self.path, self.dialect.delimiter, index.splits).where(F.col("row") >= self.data_start)
        return replace(self, held=body, index=index)

    def _settled(self) -> Sheet:
        return replace(self, opened=None)

    @property
    def body(self) -> DataFrame:
        """Data rows without the pending edits."""
        return self.held.get() if isinstance(self.held, Later) else self.held

    @property
    def data_start(self) -> int:
        """Number of the first data row: rows are physical records, a header included."""
        return int(self.dialect.has_header)

    @property
    def delimiter(self) -> str:
        return self.dialect.delimiter.decode("latin-1")

    def _in(self, value: bytes | str) -> str:
        return _text(value) if self.lifted else value.decode() if isinstance(value, bytes) else value

    def ensure_source_unchanged(self) -> None:
        if self.path is not None and self.stamp is not None:
            files.check_stamp(self.path, self.stamp)

    def validate(self) -> None:
        """Read everything; raise the error nearest the beginning. Parts after it may be cut wrongly, so only that one counts."""
        if self.path is None or self.index is None:
            return
        path, code = self.path, self.dialect.delimiter

        def first_error(split):
            begin, end, _ = split
            try:
                for at, held, ends in delimited.runs(path, begin, end, code):
                    delimited.check(held, ends, code, at)
            except ParseError as e:
                return [(e.offset, begin, end)]
            return []

        if self.index.splits:
            bad = self.spark.sparkContext.parallelize(self.index.splits, len(self.index.splits)).flatMap(first_error).takeOrdered(1)
            for _, begin, end in bad:
                for at, held, ends in delimited.runs(path, begin, end, code):
                    delimited.check(held, ends, code, at)

    # Reading --------------------------------------------------------------

    def rows_frame(self, with_edits: bool = True) -> DataFrame:
        """Data rows with the pending edits in place."""
        return self._with_edits(self.body) if with_edits else self.body

    def _with_edits(self, rows: DataFrame) -> DataFrame:
        return overlay.apply_edits(rows, self.edits) if self.edits else rows

    def _only(self, rows: Iterable[int]) -> DataFrame:
        """Data rows among which the given ones are: of a file, only the parts that hold them are read, and of these only from the first to the last."""
        wanted = sorted(set(rows))
        if self.index is None or self.path is None or not wanted:
            return self.body.where(F.col("row").isin(wanted)) if len(wanted) <= overlay.LITERAL_ROWS else self.body
        splits = [self.index.splits[i] for i in self.index.holding(wanted)]
        return _cells(self.spark, self.path, self.dialect.delimiter, splits, (max(wanted[0], self.data_start), wanted[-1]))

    def cells_frame(self) -> DataFrame:
        """``(row, fields)`` of the data rows with the pending edits, for what doesn't write records."""
        if self.index is None or self.path is None:
            return self.rows_frame().select("row", "fields")
        rows = _cells(self.spark, self.path, self.dialect.delimiter, self.index.splits).where(F.col("row") >= self.data_start)
        return self._with_edits(rows).select("row", "fields")

    def _row(self, row: int) -> list[str]:
        """The fields of one data row, with its edits."""
        if row < self.data_start:
            raise InvalidOption("cell edit row or column is out of range")
        found = self._with_edits(self._only([row])).where(F.col("row") == row).select("fields").first()
        if not found:
            raise RowNotIndexed(row, self.count())
        return found["fields"]

    def header(self) -> list[str] | None:
        return None if self.names is None else [self.renames.get(i, n) for i, n in enumerate(self.names)]

    def count(self) -> int:
        """All records, a header included."""
        if self.index is not None:
            return self.index.records
        return self.body.count() + self.data_start

    def rows(self, start: int, count: int) -> DataFrame:
        """``count`` records from the physical row ``start``; of a file only the parts that hold them are read."""
        total = self.count()
        if not count:
            return self.body.limit(0)
        if start >= total:
            raise RowNotIndexed(start, total)
        last = min(start + count, total) - 1
        if self.index is not None and self.path is not None:
            read = delimited.read(self.spark, self.path, self.dialect.delimiter, self.index.covering(start, count), (start, last))
            return read.orderBy("row")
        return self.body.where(F.col("row").between(start, last)).orderBy("row")

    def wide(self) -> DataFrame:
        """Cells as columns by header name, or ``Column N`` where there is none."""
        names = self.header() or []
        named = [names[i] if i < len(names) and names[i] else f"Column {i + 1}" for i in range(max(self.width, len(names)))]
        return self.rows_frame().select("row", *(cells.cell(F.col("fields"), i).alias(n) for i, n in enumerate(named)))

    def shown(self, columns: Sequence[int]) -> DataFrame:
        """Some columns in some order, for display alone."""
        cols.check_columns(columns, max(self.width, 1))
        return self.rows_frame().select("row", F.array(*(cells.cell(F.col("fields"), c) for c in columns)).alias("fields"))

    def window(self, focused: int) -> range:
        """The columns that are shown around one of them: all, or WINDOW of more."""
        return cols.window(max(self.width, len(self.names or ())), focused)

    def _copied(self, values: Sequence[str], quoted: bool) -> str:
        out = []
        for value in values:
            try:
                text = value.encode("latin-1").decode() if self.lifted else value
            except UnicodeDecodeError:
                raise InvalidData("The selected data is not valid UTF-8 and cannot be copied yet.") from None
            out.append('"' + text.replace('"', '""') + '"' if quoted and any(c in text for c in '\t\r\n"') else text)
        joined = "\t".join(out)
        if len(joined.encode()) > CLIPBOARD:
            raise OperationRefused(f"Copy exceeds the {dialect.human_bytes(CLIPBOARD)} clipboard limit.")
        return joined

    def clipboard_row(self, row: int) -> str:
        """A data row as tab-separated text."""
        return self._copied(self._row(row), True)

    def clipboard_cell(self, row: int, column: int) -> str:
        """A cell as it is; a missing one is empty."""
        fields = self._row(row)
        return self._copied(fields[column : column + 1], False)

    # Searching and filtering ----------------------------------------------

    def find(self, needle: bytes | str, start: tuple[int, int] = (0, 0)) -> Match | None:
        """The first cell at or after ``start`` that contains the needle.

        A file is searched in waves of its parts, each twice as wide as the
        one before, and no further than the wave that has a hit.
        """
        start, needle = max((self.data_start, 0), start), self._in(needle)
        if self.path is None or self.index is None:
            waves = [self.rows_frame()]
        else:
            splits = [s for s, after in zip(self.index.splits, [*(s[2] for s in self.index.splits[1:]), self.index.records], strict=True) if after > start[0]]
            width, waves = self.spark.sparkContext.defaultParallelism, []
            while splits:
                waves.append(splits[:width])
                splits, width = splits[width:], 2 * width
        for wave in waves:
            jobs.check()
            rows = wave if isinstance(wave, DataFrame) else self._with_edits(_cells(self.spark, self.path, self.dialect.delimiter, wave))
            hit = search.find_next(rows.select("row", "offset", "fields"), needle, start).first()
            if hit:
                return Match(hit["row"], hit["column"], hit["offset"])
        if not needle:
            raise InvalidOption("search needs a query")
        return None

    def filter(self, predicates: Sequence[Predicate]) -> FilteredSheet:
        if self.edits:
            raise OperationRefused("save or discard cell edits before filtering")
        wanted = [type(p)(p.column, self._in(p.value)) for p in predicates]
        return FilteredSheet(self, filters.matching(self.body, wanted), tuple(wanted))

    # Editing --------------------------------------------------------------

    def edit(self, changes: Mapping[tuple[int, int], bytes | str]) -> Sheet:
        """Pending values of existing data cells. A value equal to the source's takes its edit back."""
        new = {at: self._in(v) for at, v in changes.items()}
        if any(r < self.data_start for r, _ in new):
            raise InvalidOption("cell edits must target data rows")
        rows = self._only(r for r, _ in new)
        table = overlay.edit_table(self.spark, new).withColumn("_edit", F.lit(1))
        found = rows.select("row", "fields").join(table, "row").where(F.col("column").between(0, F.size("fields") - 1))
        found = found.select("row", "column", (F.get("fields", F.col("column")) == F.col("value")).alias("same")).collect() if new else []  # a row for each edit given
        if len(found) < len(new):
            raise InvalidOption("cell edit row or column is out of range")
        same = [r for r in found if r["same"]]
        merged = {**self.edits, **new}
        for r in same:
            merged.pop((r["row"], r["column"]), None)
        return replace(self, edits=merged, after=None)

    def rename(self, changes: Mapping[int, bytes | str]) -> Sheet:
        if self.names is None:
            raise InvalidOption("the sheet has no header")
        if any(not 0 <= c < len(self.names) for c in changes):
            raise InvalidOption("header column is out of range")
        merged = {**self.renames, **{c: self._in(v) for c, v in changes.items()}}
        return replace(self, renames={c: v for c, v in merged.items() if v != self.names[c]}, after=None)

    @property
    def dirty(self) -> bool:
        return bool(self.edits or self.renames or self.before)

    def _changed(self, body: DataFrame, names, width: int, **more) -> Sheet:
        start = self.opened or (replace(self, edits={}, renames={}) if not self.before else None)
        same = names is not None and self.names is not None and tuple(names) == self.names and not self.renames
        more = {"in_order": self.in_order and overlay.keeps_order(self.edits), "sorted": None, **more}
        return replace(self, held=body, names=None if names is None else tuple(names), width=width, edits={}, renames={}, before=replace(self, before=None, after=None), after=None, opened=start, index=None, head_raw=self.head_raw if same else None, **more)

    def apply(self, change: cols.Change) -> Sheet:
        """Split, join or arrange: edits first, then the change; a rename of a column that goes has no effect."""
        change.check(max(self.width, len(self.names or ())))
        rows = cols.change(self.rows_frame(), change).withColumn("raw", F.lit(None).cast("string"))
        header = self.header()
        names = None if header is None else change.header(header)
        grown = {cols.Split: lambda: self.width - 1 + change.count, cols.Join: lambda: self.width - len(change.columns) + 1, cols.Arrange: lambda: max(0, self.width - change.width) + len(change.columns)}[type(change)]()
        return self._changed(rows, names, grown)

    def analyze_split(self, column: int, separator: bytes | str, most: int = cols.MOST_COLUMNS) -> tuple[int, int]:
        """Rows and the most pieces of one of them."""
        got = cols.split_width(self.cells_frame(), column, self._in(separator)).first()
        if got["max_pieces"] > most:
            raise InvalidOption(f"the split makes more than {most} columns")
        return got["rows_scanned"], got["max_pieces"]

    def split(self, column: int, separator: bytes | str, count: int | None = None, names: Sequence[str] | None = None) -> Sheet:
        """Without ``count`` into as many columns as any row needs."""
        if count is None:
            count = self.analyze_split(column, separator)[1]
            if count < 2:
                raise InvalidOption("the separator was not found")
        return self.apply(cols.Split(column, self._in(separator), count, tuple(map(self._in, names)) if names else None))

    def join(self, columns: Sequence[int], separator: bytes | str = "", name: str | None = None) -> Sheet:
        return self.apply(cols.Join(tuple(columns), self._in(separator), None if name is None else self._in(name)))

    def arrange(self, columns: Sequence[int], width: int | None = None) -> Sheet:
        return self.apply(cols.Arrange(self.width if width is None else width, tuple(columns)))

    def move(self, block: Sequence[int], place: int) -> Sheet:
        change = cols.moved(self.width, block, place)
        return self if change.columns == tuple(range(self.width)) else self.apply(change)

    def delete(self, columns: Sequence[int]) -> Sheet:
        return self.apply(cols.deleted(self.width, columns))

    def replace_all(self, needle: bytes | str, replacement: bytes | str) -> tuple[Sheet, int] | None:
        """The new sheet and how many there were; None, with nothing changed, if there was none."""
        needle, replacement = self._in(needle), self._in(replacement)
        if needle == replacement:
            return None
        out = replacing.replaced(self.rows_frame(), needle, replacement)
        total = replacing.replacement_total(self.cells_frame(), needle).first()[0]
        if not total:
            return None
        rows = out.withColumn("raw", F.when(F.col("replacements") == 0, F.col("raw"))).drop("replacements")
        return self._changed(rows, self.header(), self.width), total

    def replace_in_cell(self, row: int, column: int, needle: bytes | str, replacement: bytes | str) -> Sheet:
        fields = self._row(row) if 0 <= row < self.count() else []
        if not 0 <= column < len(fields):
            raise InvalidOption("cell edit row or column is out of range")
        value = fields[column].replace(self._in(needle), self._in(replacement)) if needle else fields[column]
        return self.edit({(row, column): value.encode("latin-1") if self.lifted else value})

    def sort(self, column: int, descending: bool = False) -> tuple[Sheet, SortSummary]:
        """Stable sort by one column. A file saved of it is read back, before it gets its name, and must hold the same records."""
        if not 0 <= column < max(self.width, 1):
            raise InvalidOption("sort column is out of range")
        rows = self.rows_frame()
        keyed = sorting.keyed(rows, column)
        # one scan: the fingerprint, what ends the file's lines, and whether the one record without a line's end stays the last one
        open_key = F.max(F.when(F.col("ending") == "", F.col("key")))
        seen = sorting.fingerprint(keyed.withColumn("_content", _content()), "_content", F.min_by("ending", F.when(F.col("ending") != "", F.col("row"))).alias("ending"), open_key.alias("open"), (F.min("key") if descending else F.max("key")).alias("end")).first()
        common = (self.head_ending if self.names is not None and self.head_ending else None) or seen["ending"] or "\n"
        stays = seen["open"] is not None and seen["open"] == seen["end"]
        ending = F.col("ending") if stays else F.when(F.col("ending") == "", common).otherwise(F.col("ending"))
        mark = F.lit(not self.bom) & F.startswith(F.get("fields", F.lit(0)), F.lit(cells.LIFTED_BOM))
        keyed = keyed.withColumns({"raw": F.when((ending == F.col("ending")) & ~mark, F.col("raw")), "ending": ending})
        placed = Later(lambda: sorting.sort_ordinals(keyed.drop("key"), column, descending).withColumn("row", F.col("place") + self.data_start).select(*rows.columns))
        lines = self._lines(sorting.sorted_rows(keyed, column, descending))
        proof = Sorted(lines, seen["n"], seen["mixed"], seen["total"])
        return self._changed(placed, self.header(), self.width, in_order=False, sorted=proof), SortSummary(seen["n"], seen["mixed"], seen["total"])

    def sort_estimate(self) -> int:
        """Bytes of temporary files that a sort may need: the source, two bytes a row, and every pending value with all its bytes quoted."""
        rows = self.count() - self.data_start
        pending = sum(2 * len(v if self.lifted else v.encode()) + 2 for v in (*self.edits.values(), *self.renames.values()))
        return sorting.temporary_bytes((self.stamp[0] if self.stamp else 0) + 2 * rows + pending, rows)

    # History --------------------------------------------------------------

    def undo(self) -> Sheet:
        if not self.before:
            raise OperationRefused("there is nothing to undo")
        if self.edits or self.renames:
            raise OperationRefused("later edits would be lost")
        return replace(self.before, after=replace(self, before=None, after=None))

    def redo(self) -> Sheet:
        if not self.after:
            raise OperationRefused("there is nothing to redo")
        return replace(self.after, before=replace(self, before=None, after=None))

    def discard(self) -> Sheet:
        """The sheet as it was opened."""
        return self.opened or replace(self, edits={}, renames={}, before=None, after=None)

    # Writing --------------------------------------------------------------

    def _lines(self, rows: DataFrame) -> DataFrame:
        written = cells.record(F.col("fields"), self.delimiter, self.bom, F.col("ending"))
        return rows.select("row", F.coalesce("raw", written).alias("line"))

    def lines(self) -> DataFrame:
        """``(row, line)``: every data record as it is written; records that didn't change keep their bytes."""
        return self._lines(self.rows_frame())

    def head_line(self) -> bytes:
        code = "latin-1" if self.lifted else "utf-8"
        mark = grammar.BOM if self.bom else b""
        if self.names is None:
            return mark
        if self.head_raw is not None and not self.renames:
            return mark + self.head_raw.encode(code)
        return mark + grammar.write([n.encode(code) for n in self.header()], self.dialect.delimiter, self.head_ending.encode(), self.bom)

    def _spans(self, folder: str) -> tuple[list[Span], int]:
        """The data's bytes, in order, and records. Of a file with edits alone, parts without one are ranges of the source as they are; others are written anew, into ``folder``."""
        untouched = self.index is not None and self.path is not None and files.is_local(folder) and overlay.keeps_order(self.edits)
        if self.sorted is not None and not self.edits:
            written = publication.write_lines(self.sorted.lines, folder, self.lifted)
            return list(written.spans), written.rows
        if not untouched:
            keeps = self.in_order and overlay.keeps_order(self.edits)
            written = publication.write_lines(self.lines() if keeps else self.lines().orderBy("row"), folder, self.lifted)
            return list(written.spans), written.rows
        edited = self.index.holding(r for r, _ in self.edits)
        parts: dict[int, Span] = {}
        if edited:
            rows = _records(self.spark, self.path, self.dialect.delimiter, [self.index.splits[i] for i in edited]).where(F.col("row") >= self.data_start)
            written = publication.write_lines(self._lines(self._with_edits(rows)), folder, self.lifted)
            parts = dict(zip(edited, written.spans, strict=True))
        # a new header alone is put before bytes that are copied unread; otherwise all records are checked
        check = None if self.renames and not edited else self.dialect.delimiter
        spans = [parts.get(i) or Span(self.path, max(b, self.head_bytes), e, check, grammar.MAX_RECORD) for i, (b, e, _) in enumerate(self.index.splits)]
        return [s for s in spans if s.size > 0], self.index.records - self.data_start

    def _write(self, made: Callable[[str], tuple[Sequence[Span], int]], destination: str, replace_it: bool = False, mode: int | None = None, unchanged: Callable[[], None] | None = None, verify: Callable[[str], None] = lambda path: None) -> tuple[int, int]:
        folder = publication.folder_for(destination, shared_dir(self.spark))
        if len(self.head_line()) > grammar.MAX_RECORD:
            raise RecordTooLarge(grammar.MAX_RECORD)

        def before():
            (unchanged or self.ensure_source_unchanged)()
            jobs.commit()

        try:
            spans, rows = made(folder)
            size = publication.publish(self.spark, self.head_line(), spans, destination, before, replace_it, mode, verify)
        finally:
            publication.remove(self.spark, folder)
        return rows + int(self.names is not None), size

    def _verify(self, path: str) -> None:
        """The written file of a sorted sheet holds the records that were sorted."""
        if self.sorted is None or self.edits:
            return
        again = Sheet.open(self.spark, path, delimiter=self.dialect.delimiter, header="first-row" if self.names is not None else "none")
        plain = F.transform("fields", lambda v: F.decode(cells.lower(v), "UTF-8"))  # as a table's sheet has them
        rows = again.body if self.lifted else again.body.withColumn("fields", plain)
        got = sorting.fingerprint(rows.withColumn("_content", _content()), "_content").first()
        if (got["n"], got["mixed"], got["total"]) != (self.sorted.rows, self.sorted.mixed, self.sorted.total):
            raise InvalidData("the sorted rows differ from the source")

    def save_as(self, destination: str, mode: int | None = None) -> tuple[int, int]:
        """A new file with all that is pending; rows and bytes written. The source must not have changed."""
        files.check_destination(self.path, destination)
        self.ensure_source_unchanged()
        return self._write(self._spans, destination, mode=mode, verify=self._verify)

    def save(self) -> Sheet:
        """Write over the source, in one step, and open it again."""
        if self.path is None:
            raise InvalidOption("the sheet has no file")
        if not self.dirty:
            raise OperationRefused("there is nothing to save")
        files.check_overwritten(self.path)
        self.ensure_source_unchanged()
        self._write(self._spans, self.path, replace_it=True, mode=files.permissions(self.path), verify=self._verify)
        return self._again(self.path)

    def _again(self, path: str) -> Sheet:
        return Sheet.open(self.spark, path, delimiter=self.dialect.delimiter, header="first-row" if self.dialect.has_header else "none")

    def working_copy(self, destination: str) -> Sheet:
        """A private file with all that is pending, opened; it remembers its original. Further edits are saved to the copy, or by ``save_to_original`` to the original."""
        if self.path is None:
            raise InvalidOption("the sheet has no file")
        original = self.original or (self.path, self.stamp)
        self.save_as(destination, mode=0o600)
        return replace(self._again(destination), original=original)

    def save_to_original(self) -> Sheet:
        """Write a working copy, with all that is pending, over its original, in one step. Refused if either has changed meanwhile."""
        if self.original is None:
            raise InvalidOption("the sheet is no working copy")
        path, known = self.original
        files.check_overwritten(path)

        def unchanged():
            self.ensure_source_unchanged()
            files.check_stamp(path, known)

        unchanged()
        self._write(self._spans, path, replace_it=True, mode=files.permissions(path), unchanged=unchanged, verify=self._verify)
        return self._again(path)


@dataclass(frozen=True)
class FilteredSheet:
    """The rows of a sheet for which a filter holds.

    Of a file, the matches in each of its parts are counted once and kept, so
    that a count is there and a range of matches reads only the parts it lies in.
    """

    sheet: Sheet
    matches: DataFrame
    predicates: tuple[Predicate, ...] = ()

    @cached_property
    def _by_part(self) -> list[int] | None:
        """Matches in each part of the file: a number for each 64 MB."""
        if self.sheet.index is None or self.sheet.path is None:
            return None
        found = {r["part"]: r["n"] for r in self.places().groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n")).collect()}
        return [found.get(i, 0) for i in range(len(self.sheet.index.splits))]

    def places(self) -> DataFrame:
        """``row`` of each match; of a file, partitions are its parts."""
        return filters.matching(self.sheet.cells_frame(), self.predicates).select("row") if self.predicates else self.matches.select("row")

    def count(self) -> int:
        return self.matches.count() if self._by_part is None else sum(self._by_part)

    def rows(self, start: int, count: int) -> DataFrame:
        if self._by_part is None or start < 0 or count < 1:
            return filters.match_range(self.matches, start, count).orderBy("match")
        ends = list(accumulate(self._by_part))
        if not ends or start >= ends[-1]:
            raise MatchNotIndexed(start, ends[-1] if ends else 0)
        here = [i for i, n in enumerate(self._by_part) if n and ends[i] > start and ends[i] - n < start + count]
        first = ends[here[0]] - self._by_part[here[0]]
        sheet = self.sheet
        rows = _records(sheet.spark, sheet.path, sheet.dialect.delimiter, [sheet.index.splits[i] for i in here]).where(F.col("row") >= sheet.data_start)
        got = filters.match_range(filters.matching(rows, self.predicates), start - first, count)
        return got.withColumn("match", F.col("match") + first).orderBy("match")

    def export(self, destination: str) -> tuple[int, int]:
        """Header and matching records, byte for byte. Refused while anything is pending."""
        if self.sheet.dirty:
            raise OperationRefused("save or discard changes before exporting")
        files.check_destination(self.sheet.path, destination)
        written = cells.record(F.col("fields"), self.sheet.delimiter, self.sheet.bom, F.col("ending"))
        lines = self.matches.select("row", F.coalesce("raw", written).alias("line"))
        in_order = self.sheet.in_order

        def made(folder: str):
            out = publication.write_lines(lines if in_order else lines.orderBy("row"), folder, self.sheet.lifted)
            return out.spans, out.rows

        return replace(self.sheet, stamp=None)._write(made, destination)


__all__ = ["FilteredSheet", "Match", "Sheet", "SortSummary", "SourceChanged"]
