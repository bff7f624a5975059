"""One file from many parts, none of whose bytes pass the driver.

Lines are written as text by the tasks that make them, a file for each task.
The sizes of these files, and of ranges of the source that stay as they are,
added up, give each its place in the output; tasks then write them there. The
driver sees names, sizes and the header. On a mounted file system the output is
a hidden sibling that takes writes at any place; elsewhere the file system must
be able to put files together itself, as HDFS does.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..errors import DestinationExists, InvalidData, InvalidOption, RecordTooLarge, SheetError, SourceChanged
from ..streaming import jobs
from ..streaming.parts import PartLog
from . import delimited, files, grammar

#: Bytes that a task holds at a time.
CHUNK = 8 << 20


@dataclass(frozen=True)
class Span:
    """Bytes from ``begin`` to ``end`` of a file. With a ``delimiter`` they are whole records, and checked to be well-formed and of ``limit`` bytes at most."""

    path: str
    begin: int
    end: int
    delimiter: bytes | None = None
    limit: int = grammar.MAX_RECORD

    @property
    def size(self) -> int:
        return self.end - self.begin


@dataclass(frozen=True)
class Written:
    """Lines as files of a folder, in order."""

    spans: tuple[Span, ...]
    rows: int


def write_lines(lines: DataFrame, folder: str, lifted: bool) -> Written:
    """Write ``line`` of each row, in the order of partitions and of rows in them, to a new folder.

    The text writer ends every line with LF, so a line leaves its own to it.
    Only the last line of all may have none.
    """
    line, text = F.col("line"), F.length("line")
    ended = F.endswith(line, F.lit("\n"))
    body = F.when(ended, F.substring(line, F.lit(1), text - 1)).otherwise(line)
    seen = Observation(f"lines-{uuid.uuid4().hex}")
    kept = lines.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(~ended).alias("open"), F.max(F.octet_length(line) if not lifted else text).alias("longest"))
    kept.select(_bytes(body, lifted).alias("value")).write.option("lineSep", "\n").text(folder)
    got = seen.get
    if (got["longest"] or 0) > grammar.MAX_RECORD:
        raise RecordTooLarge(grammar.MAX_RECORD)
    if got["open"] > 1:
        raise InvalidData("a record before the last one has no line's end")
    store, where = hadoop(lines.sparkSession, folder)
    named = [(f.getPath().getName(), f.getLen()) for f in store.listStatus(where)]
    found = sorted((int(m[1]), name, size) for name, size in named if size and (m := re.match(r"part-(\d+)-", name)))
    spans = [Span(f"{folder}/{name}", 0, size) for _, name, size in found]
    if got["open"] and spans:
        last = spans[-1]
        spans[-1] = Span(last.path, 0, last.size - 1)
    return Written(tuple(spans), got["rows"])


def _bytes(line: Column, lifted: bool) -> Column:
    """Text that the writer writes as the bytes that it stands for: a cast of bytes to text keeps them as they are."""
    return F.encode(line, "ISO-8859-1").cast("string") if lifted else line


def copy_span(span: Span, hidden: str, at: int) -> int:
    """Write a span's bytes to their place in a file that exists; the same again if a task is run again."""
    out = os.open(hidden, os.O_WRONLY)
    try:
        if span.delimiter is not None:
            wrote = 0
            for offset, held, ends in delimited.runs(span.path, span.begin, span.end, span.delimiter):
                delimited.check(held, ends, span.delimiter, offset, span.limit)
                wrote += _put(out, held, at + wrote)
        else:
            store, name = files.filesystem(span.path)
            with store.open_input_file(name) as f:
                wrote = 0
                while wrote < span.size:
                    data = f.read_at(min(CHUNK, span.size - wrote), span.begin + wrote)
                    if not data:
                        break
                    wrote += _put(out, data, at + wrote)
        os.fsync(out)
    finally:
        os.close(out)
    return wrote


def _copied(part: int, span: Span, hidden: str, at: int, done: PartLog) -> tuple[int, SheetError | None]:
    """Bytes written, or what is wrong with the records: running the task again wouldn't mend that."""
    try:
        size = copy_span(span, hidden, at)
    except SheetError as e:
        return 0, e
    done.commit(part, bytes=size)
    return size, None


def _put(out: int, data: bytes, at: int) -> int:
    view, done = memoryview(data), 0
    while done < len(view):
        done += os.pwrite(out, view[done:], at + done)
    return done


def compose(spark: SparkSession, head: bytes, spans: Sequence[Span], hidden: str) -> int:
    """Write the header here and every span in a task of its own; the size of it all."""
    places = [len(head), *accumulate((s.size for s in spans), initial=len(head))][1:]
    size = places[-1]
    with open(hidden, "r+b") as out:
        out.truncate(size)
        out.write(head)
    if spans:
        jobs.check()
        todo = [(i, s, at) for i, (s, at) in enumerate(zip(spans, places, strict=False)) if s.size]
        to = PartLog(spark, len(spans))
        jobs.log(to)
        try:
            done = spark.sparkContext.parallelize(todo, max(1, len(todo))).map(lambda x: _copied(x[0], x[1], hidden, x[2], to)).collect() if todo else []  # a number for each span
            to.read()
        finally:
            to.remove()
        for _, error in done:
            if error:
                raise error
        if sum(n for n, _ in done) != size - len(head) or os.path.getsize(hidden) != size:
            raise SourceChanged()
    return size


def publish(spark: SparkSession, head: bytes, spans: Sequence[Span], destination: str, before: Callable[[], None] = lambda: None, replace: bool = False, mode: int | None = None, verify: Callable[[str], None] = lambda path: None) -> int:
    """Header and spans as one file. ``verify`` reads it under its hidden name; ``before`` is called last; only then it gets its name."""
    if not files.is_local(destination):
        return publish_by_concat(spark, head, spans, destination, before, replace, verify)
    with files.hidden_sibling(destination, mode) as hidden:
        size = compose(spark, head, spans, hidden)
        verify(hidden)
        before()
        files.give_name(hidden, destination, replace)
        return size


def folder_for(destination: str, shared: str) -> str:
    """Where parts are written: in the shared folder, or beside an output whose file system puts them together."""
    if files.is_local(destination):
        return f"{shared}/parts-{uuid.uuid4().hex}"
    parent, _, name = destination.rpartition("/")
    return f"{parent}/.{name}-export-{uuid.uuid4().hex}.tmp"


def hadoop(spark: SparkSession, path: str):
    """Spark's own file system of a URI, and the path as it takes it."""
    java = spark._jvm
    where = java.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def remove(spark: SparkSession, folder: str) -> None:
    """Take away a folder of parts, if there is one."""
    store, where = hadoop(spark, folder)
    store.delete(where, True)


def publish_by_concat(spark: SparkSession, head: bytes, spans: Sequence[Span], destination: str, before: Callable[[], None], replace: bool, verify: Callable[[str], None]) -> int:
    """Parts that lie beside the destination are joined by its file system, without reading them, and renamed."""
    store, where = hadoop(spark, destination)
    parent, _, name = destination.rpartition("/")
    first = f"{parent}/.{name}-export-{uuid.uuid4().hex}.first"
    path = spark._jvm.org.apache.hadoop.fs.Path
    if any(s.begin or not s.path.startswith(f"{parent}/.") for s in spans):
        raise InvalidOption("only whole parts beside the destination can be joined")
    if not replace and store.exists(where):
        raise DestinationExists()
    try:
        out = store.create(path(first), False)
        try:
            out.write(bytearray(head))
        finally:
            out.close()
        parts = [path(s.path) for s in spans]
        if parts:
            short = store.getFileStatus(parts[-1]).getLen() - spans[-1].size
            array = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Path, len(parts))
            for i, p in enumerate(parts):
                array[i] = p
            try:
                store.concat(path(first), array)
            except Exception as e:  # of the file system's own kind
                raise InvalidOption(f"{destination}: its file system can't put files together: {type(e).__name__}") from e
            if short:
                store.truncate(path(first), store.getFileStatus(path(first)).getLen() - short)
        size = store.getFileStatus(path(first)).getLen()
        if size != len(head) + sum(s.size for s in spans):
            raise SourceChanged()
        verify(first)
        before()
        if replace:
            store.delete(where, False)
        if not store.rename(path(first), where):
            raise DestinationExists()
        return size
    finally:
        if store.exists(path(first)):
            store.delete(path(first), False)
