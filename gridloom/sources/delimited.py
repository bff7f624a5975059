"""The ``delimited`` data source: a file's parts, parsed in parallel into Arrow batches of lifted text.

Records are cut into fields by array operations on a whole run of bytes, with
the parity of the quotes before a byte as the state. They also find the first
record that isn't well-formed; the grammar then says what is wrong with it.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..errors import RecordTooLarge
from . import grammar
from .files import filesystem

SCHEMA = "row bigint, offset bigint, raw string, fields array<string>"
CHUNK = 4 << 20


class Part(InputPartition):
    def __init__(self, begin: int, end: int, row: int):
        super().__init__((begin, end, row))


def records(path: str, begin: int, end: int, delimiter: bytes):
    """(offset, record) of the bytes from ``begin`` to ``end``, which lie between records."""
    store, name = filesystem(path)
    framer = grammar.Framer(delimiter, begin)
    with store.open_input_file(name) as f:
        at = begin
        while at < end:
            data = f.read_at(min(CHUNK, end - at), at)
            if not data:
                break
            at += len(data)
            yield from framer.feed(data)
    yield from framer.finish()


def runs(path: str, begin: int, end: int, delimiter: bytes):
    """(offset, bytes, ends of the records in them) of runs of whole records; errors of the grammar are left to the parser."""
    store, name = filesystem(path)
    held, at = b"", begin
    with store.open_input_file(name) as f:
        while at < end:
            chunk = f.read_at(min(max(CHUNK, len(held)), end - at), at)
            if not chunk:
                break
            at += len(chunk)
            held += chunk
            data = np.frombuffer(held, np.uint8)
            line = np.flatnonzero(data == 10)
            quotes = np.flatnonzero(data == 34)
            ends = line[np.searchsorted(quotes, line) % 2 == 0] + 1 if len(quotes) else line + 1
            if not len(ends):
                if len(held) > grammar.MAX_RECORD + 1:
                    list(grammar.Framer(delimiter, at - len(held)).feed(held))  # says what is wrong
                continue
            whole = int(ends[-1])
            yield at - len(held), held[:whole], ends
            held = held[whole:]
    if held:
        yield at - len(held), held, np.array([len(held)])


def lifted(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Strings between neighbouring ``offsets`` of ``data``, a character for each byte."""
    if len(data) and data.max() > 127:
        wide = data > 127
        size = 1 + wide.astype(np.int64)
        place = np.cumsum(size) - size
        out = np.empty(int(size.sum()), np.uint8)
        out[place] = np.where(wide, 0xC0 | data >> 6, data)
        out[place[wide] + 1] = 0x80 | data[wide] & 0x3F
        data, offsets = out, np.concatenate([place, [len(out)]])[offsets]
    return pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def opening(data: np.ndarray, quotes: np.ndarray, delimiter: int, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of every other quote, from the first, open a field, and places of quotes that may not be where they are.

    What precedes a quote with an even number before it, and what follows one
    with an odd number, isn't inside quotes; so its neighbours tell. Data
    before ``begin`` don't count.
    """
    opens, closes = quotes[::2], quotes[1::2]
    before = data[np.maximum(opens - 1, 0)]
    first = (opens == begin) | (before == delimiter) | (before == 10)
    last = len(data) - 1
    after, then = (data[np.minimum(closes + i, last)] for i in (1, 2))
    may = (closes == last) | (after == 34) | (after == delimiter) | (after == 10) | ((after == 13) & (then == 10) & (closes + 2 <= last))
    return first, np.concatenate([opens[~first & (before != 34)], closes[~may], quotes[-1:] if len(quotes) % 2 else quotes[:0]])


def cut(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, delimiter: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Of neighbouring records: which bytes are text of their fields, how many of these come before each field's end, how many fields each record has, and the first record that isn't well-formed, or -1.

    ``ends`` are after the line's end, if there is one. A quote with an even
    number of quotes before it opens a field or is the second of two in one;
    one with an odd number closes a field or is the first of two.
    """
    line = data[ends - 1] == 10
    stops = ends - line
    returns = line & (stops > starts) & (data[np.maximum(stops - 1, 0)] == 13)
    stops = stops - returns
    text = np.ones(len(data), bool)
    text[: starts[0]] = False
    text[ends[line] - 1] = False
    text[stops[returns]] = False
    cuts = np.flatnonzero(data == delimiter)
    quotes = np.flatnonzero(data == 34)
    dropped, bad = quotes[:0], -1
    if len(quotes):
        cuts = cuts[np.searchsorted(quotes, cuts) % 2 == 0]
        first, wrong = opening(data, quotes, delimiter, int(starts[0]))
        if len(wrong):
            bad = int(np.searchsorted(ends, wrong.min(), "right"))
        keep = np.zeros(len(quotes), bool)
        keep[::2] = ~first
        dropped = quotes[~keep]
        text[dropped] = False
    text[cuts] = False
    per = 1 + np.diff(np.searchsorted(cuts, stops), prepend=0)
    last = np.cumsum(per) - 1
    is_stop = np.zeros(len(cuts) + len(stops), bool)
    is_stop[last] = True
    edges = np.empty(len(is_stop), np.int64)
    edges[is_stop], edges[~is_stop] = stops, cuts
    # before a field's end all is text but what lies between records, a byte for each delimiter, and some quotes
    gaps = starts - np.concatenate([[0], np.cumsum(stops - starts)[:-1]])
    record = np.repeat(np.arange(len(stops)), per)
    before = edges - gaps[record] - (np.arange(len(edges)) - record)
    if len(dropped):
        before -= np.searchsorted(dropped, edges)
    return text, before, per, bad


def fields_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, delimiter: int) -> tuple[pa.Array, int]:
    """Fields of records, and the first record that isn't well-formed, or -1."""
    text, before, per, bad = cut(data, starts, ends, delimiter)
    if bad >= 0:
        return pa.array([], pa.list_(pa.string())), bad
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32()), lifted(data[text], np.concatenate([[0], before]))), bad


def refuse(data: bytes, delimiter: bytes, at: int) -> None:
    """Raise what is wrong with a record that array operations found to be so."""
    framer = grammar.Framer(delimiter, at)
    for place, whole in [*framer.feed(data), *framer.finish()]:
        grammar.parse(whole, delimiter, place)


def check(held: bytes, ends: np.ndarray, delimiter: bytes, at: int, limit: int = grammar.MAX_RECORD) -> None:
    """Raise unless these whole records, at offset ``at`` of their file, are well-formed and within the limit."""
    data = np.frombuffer(held, np.uint8)
    starts = np.concatenate([[0], ends[:-1]])
    long = np.flatnonzero(ends - starts > limit)
    bad = -1
    if b'"' in held:
        wrong = opening(data, np.flatnonzero(data == 34), delimiter[0], 3 if at == 0 and held.startswith(grammar.BOM) else 0)[1]
        if len(wrong):
            bad = int(np.searchsorted(ends, wrong.min(), "right"))
    for i in sorted({*long[:1].tolist(), *([bad] if bad >= 0 else [])}):
        begin = int(ends[i - 1]) if i else 0
        if i != bad:
            raise RecordTooLarge(limit)
        refuse(held[begin : int(ends[i])], delimiter, at + begin)
        refuse(held[begin:], delimiter, at + begin)


class DelimitedReader(DataSourceReader):
    """Reads the parts it plans. What goes to tasks is the options and each task's own part, not the list of parts."""

    def __init__(self, options: dict, wanted: StructType):
        self.path, self.delimiter = options["path"], options["delimiter"].encode("latin-1")
        self.splits = json.loads(options["splits"])
        first, last = int(options.get("first_row", 0)), int(options.get("last_row", 1 << 62))
        self.rows = first, last
        self.names = wanted.fieldNames()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "splits"}

    def partitions(self):
        return [Part(*s) for s in self.splits] or [Part(0, 0, 0)]

    def read(self, partition):
        begin, end, row = partition.value
        first, last = self.rows
        for offset, held, ends in runs(self.path, begin, end, self.delimiter):
            starts = np.concatenate([[0], ends[:-1]])
            low, high = max(0, first - row), min(len(ends), last - row + 1)
            row += len(ends)
            if high <= 0:
                break
            if low < high:
                yield self.batch(offset, held, starts[low:high], ends[low:high], row - len(ends) + low)

    def batch(self, offset: int, held: bytes, starts: np.ndarray, ends: np.ndarray, row: int) -> pa.RecordBatch:
        base, stop = int(starts[0]), int(ends[-1])
        data = np.frombuffer(held, np.uint8)[base:stop]
        starts, ends, offset = starts - base, ends - base, offset + base
        mark = 3 if offset == 0 and held.startswith(grammar.BOM) else 0
        begins = starts
        if mark:
            begins = starts.copy()
            begins[0] = mark
        fields, bad = fields_of(data, begins, ends, self.delimiter[0])
        for i in np.flatnonzero(ends - starts > grammar.MAX_RECORD)[:1].tolist() + ([bad] if bad >= 0 else []):
            refuse(data[starts[i] : ends[i]].tobytes(), self.delimiter, offset + int(starts[i]))
            refuse(data[starts[i] :].tobytes(), self.delimiter, offset + int(starts[i]))
        columns = {
            "row": lambda: pa.array(np.arange(row, row + len(ends)), pa.int64()),
            "offset": lambda: pa.array(starts + offset, pa.int64()),
            "raw": lambda: lifted(data, np.concatenate([[mark], ends])),
            "fields": lambda: fields,
        }
        return pa.RecordBatch.from_arrays([columns[n]() for n in self.names], self.names)


class Delimited(DataSource):
    """Options: ``path``, ``delimiter``, ``splits`` as JSON and, for a range of rows, ``first_row`` and ``last_row``."""

    @classmethod
    def name(cls):
        return "delimited"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return DelimitedReader(dict(self.options), schema)


def read(spark: SparkSession, path: str, delimiter: bytes, splits, rows: tuple[int, int] | None = None, columns: str = SCHEMA):
    """``columns`` of SCHEMA, in its form: no others are made and sent."""
    spark.dataSource.register(Delimited)
    reader = spark.read.format("delimited").schema(columns).option("delimiter", delimiter.decode("latin-1")).option("splits", json.dumps(list(splits)))
    if rows:
        reader = reader.option("first_row", rows[0]).option("last_row", rows[1])
    return reader.load(path)
