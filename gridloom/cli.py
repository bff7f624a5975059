"""Commands: open, viewport, search, filter, export, edit-save-as, transform-save-as, sort-save-as, generate."""

from __future__ import annotations

import argparse
import random
import sys
import time

from pyspark.sql import functions as F

from . import verify
from .errors import InvalidOption, SheetError
from .functions import viewport
from .operators.filters import Contains, Equals
from .sheet import Sheet
from .sources import dialect
from .sources.generate import generate
from .streaming.live import LiveSheet

#: Fixed value: matches that ``filter`` prints of the beginning, the middle and the end.
SAMPLE = 100
_KINDS = {"contains": Contains, "equals": Equals}


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("gridloom").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def _open(args) -> Sheet:
    return Sheet.open(_session(), args.file, rows=getattr(args, "rows", None) or dialect.HEAD_ROWS, delimiter=dialect.parse_delimiter(args.delimiter) if args.delimiter else None, header=getattr(args, "header", None) or "auto")


def _predicates(args) -> list:
    first = [(args.column, args.operator, args.value)]
    out = []
    for column, operator, value in [*first, *(args.and_ or [])]:
        if operator not in _KINDS:
            raise InvalidOption(f"operator {operator!r}")
        out.append(_KINDS[operator](dialect.one_based(column, "column"), value))
    return out


def _timed(label: str, size: int, began: float) -> None:
    took = time.perf_counter() - began
    print(f"{label}: {took:.3f} s, {dialect.human_bytes(dialect.rate(size, took))}/s")


def _print_rows(rows) -> None:
    for r in rows:
        print(f"{r['row']}\t" + "\t".join(dialect.shown(v.encode("latin-1")) for v in r["fields"]))


def cmd_open(args) -> None:
    sheet = _open(args)
    print(f"delimiter {sheet.delimiter!r}, {'header' if sheet.names else 'no header'}, {sheet.width} columns, {sheet.count()} records")
    _print_rows(sheet.rows(0, 5).collect())
    if args.jump is not None:
        _print_rows(sheet.rows(args.jump, args.jump_count).collect())


def _read_while_indexed(args, took) -> Sheet:
    """Read from the first to the last row that is there, over and over, until the index ends."""
    live = LiveSheet(_session(), args.file, delimiter=dialect.parse_delimiter(args.delimiter) if args.delimiter else None)
    rng, began = random.Random(args.seed), time.perf_counter()
    while not live.done:
        sheet = live.sheet()
        there = sheet.count()
        if there:
            at = viewport.start_of(rng.randrange(there), 0, there, args.rows)
            start = time.perf_counter()
            sheet.rows(at, args.rows).collect()
            took.append(1000 * (time.perf_counter() - start))
        else:
            time.sleep(0.01)
    sheet = live.wait()
    _timed("index", live.job.progress().bytes, began)
    print(f"{sheet.count()} records, {len(took)} reads while indexing")
    return sheet


def cmd_viewport(args) -> None:
    rng, took = random.Random(args.seed), {"live": [], "repeated": [], "sequential": [], "random": []}
    sheet = _read_while_indexed(args, took["live"]) if args.live else _open(args)
    last = viewport.last_start(sheet.count(), args.rows)
    for i in range(args.iterations):
        for name, at in (("repeated", last // 2), ("sequential", min(last, i * args.rows)), ("random", rng.randint(0, last))):
            began = time.perf_counter()
            sheet.rows(at, args.rows).collect()
            took[name].append(1000 * (time.perf_counter() - began))
    for name, ms in took.items():
        if ms:
            print(f"{name}: min {min(ms):.3f}, p50 {dialect.nearest_rank(ms, 50):.3f}, p95 {dialect.nearest_rank(ms, 95):.3f}, max {max(ms):.3f} ms")


def cmd_search(args) -> None:
    sheet, began = _open(args), time.perf_counter()
    start = (dialect.one_based(args.start_row, "row") + sheet.data_start, dialect.one_based(args.start_column, "column"))
    hit = sheet.find(args.query, start)
    print(f"data row {hit.row - sheet.data_start + 1}, column {hit.column + 1}, byte {hit.offset}" if hit else "not found")
    _timed("search", sheet.stamp[0], began)


def cmd_filter(args) -> None:
    sheet, began = _open(args), time.perf_counter()
    found = sheet.filter(_predicates(args))
    count = found.count()
    print(f"{count} matches")
    _timed("filter", sheet.stamp[0], began)
    sampled, checksum = [], 0
    for start, n in viewport.sample_ranges(count, SAMPLE):
        rows = found.rows(start, n).collect()
        _print_rows(rows)
        places = [(r["match"], r["row"], r["offset"]) for r in rows]
        sampled += places
        checksum = viewport.matches_checksum(((*at, [v.encode("latin-1") for v in r["fields"]]) for at, r in zip(places, rows, strict=True)), checksum)
    if sampled:
        first, last = sampled[0], sampled[-1]
        print(f"{len(sampled)} sampled: match {first[0]} in row {first[1]} at byte {first[2]} to match {last[0]} in row {last[1]} at byte {last[2]}, checksum {checksum:016x}")


def cmd_export(args) -> None:
    sheet, began = _open(args), time.perf_counter()
    rows, size = sheet.filter(_predicates(args)).export(args.output)
    print(f"{rows} rows, {size} bytes")
    _timed("export", sheet.stamp[0], began)


def cmd_edit(args) -> None:
    sheet, began = _open(args), time.perf_counter()
    edits = {(dialect.one_based(r, "row") + sheet.data_start, dialect.one_based(c, "column")): v for r, c, v in args.edit}
    if len(edits) != len(args.edit):
        raise InvalidOption("a cell is edited twice")
    rows, size = sheet.edit(edits).save_as(args.output)
    _timed("edit", sheet.stamp[0], began)
    again = Sheet.open(sheet.spark, args.output, delimiter=sheet.dialect.delimiter, header="first-row" if sheet.names else "none")
    verify.edits_arrived(again, {at: v.encode().decode("latin-1") for at, v in edits.items()})
    print(f"{rows} rows, {size} bytes, {len(edits)} edits checked")


def cmd_transform(args) -> None:
    sheet, began = _open(args), time.perf_counter()
    names = args.output_header
    if args.split:
        column, separator, count = args.split
        out = sheet.split(dialect.one_based(column, "column"), separator, int(count), names)
    else:
        columns, separator = args.join
        out = sheet.join([dialect.one_based(c, "column") for c in columns.split(",")], separator, names[0] if names else None)
    rows, size = out.save_as(args.output)
    _timed("transform", sheet.stamp[0], began)
    again = Sheet.open(sheet.spark, args.output, delimiter=sheet.dialect.delimiter, header="first-row" if sheet.names else "none")
    if again.count() != rows:
        raise SheetError("the written file has another number of records")
    if again.header() != out.header():
        raise SheetError("the written header differs")
    for at in sorted({0, (rows - sheet.data_start) // 2, rows - sheet.data_start - 1}) if rows > sheet.data_start else []:
        place = F.col("row") == at + sheet.data_start
        if again.body.where(place).select("fields").first() != out.rows_frame().where(place).select("fields").first():
            raise SheetError(f"data row {at + 1} differs")
    print(f"{rows} rows, {size} bytes")


def cmd_sort(args) -> None:
    sheet, began = _open(args), time.perf_counter()
    column, falling = dialect.one_based(args.column, "column"), args.order == "desc"
    print(f"temporary bytes, at most: {sheet.sort_estimate()}")
    source = dialect.digest_of(args.file)
    out, summary = sheet.sort(column, falling)
    rows, size = out.save_as(args.output, mode=0o600)
    _timed("sort", sheet.stamp[0], began)
    if dialect.digest_of(args.file) != source:
        raise SheetError("the source is not as it was before the sort")
    again = Sheet.open(sheet.spark, args.output, delimiter=sheet.dialect.delimiter, header="first-row" if sheet.names else "none")
    if (again.head_raw, again.bom) != (sheet.head_raw, sheet.bom):
        raise SheetError("the written header differs")
    verify.in_order(again, column, falling)
    print(f"{rows} rows, {size} bytes, {summary.rows} data rows in order")


def cmd_generate(args) -> None:
    size, rows = generate(args.output, dialect.parse_size(args.size), args.columns, dialect.parse_delimiter(args.delimiter or ","), args.seed)
    print(f"{size} bytes, {rows} data rows, FNV-1a {dialect.fnv1a_of(args.output):016x}")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="gridloom")
    commands = top.add_subparsers(dest="command", required=True)

    def add(name, run, *, file=True, output=False):
        p = commands.add_parser(name)
        p.set_defaults(run=run)
        if file:
            p.add_argument("file")
        if output:
            p.add_argument("--output", required=True)
        p.add_argument("--delimiter")
        return p

    p = add("open", cmd_open)
    p.add_argument("--rows", type=int)
    p.add_argument("--jump", type=int)
    p.add_argument("--jump-count", type=int, default=5)
    p = add("viewport", cmd_viewport)
    p.add_argument("--iterations", type=int, default=500)
    p.add_argument("--rows", type=int, default=100)
    p.add_argument("--seed", type=int, default=1)
    p.add_argument("--live", action="store_true")
    p = add("search", cmd_search)
    p.add_argument("--query", required=True)
    p.add_argument("--start-row", default="1")
    p.add_argument("--start-column", default="1")
    for name, run, output in (("filter", cmd_filter, False), ("export", cmd_export, True)):
        p = add(name, run, output=output)
        p.add_argument("--column", required=True)
        p.add_argument("--operator", required=True)
        p.add_argument("--value", required=True)
        p.add_argument("--and", dest="and_", nargs=3, action="append", metavar=("COLUMN", "OPERATOR", "VALUE"))
    p = add("edit-save-as", cmd_edit, output=True)
    p.add_argument("--edit", nargs=3, action="append", required=True, metavar=("ROW", "COLUMN", "VALUE"))
    p = add("transform-save-as", cmd_transform, output=True)
    how = p.add_mutually_exclusive_group(required=True)
    how.add_argument("--split", nargs=3, metavar=("COLUMN", "SEPARATOR", "COUNT"))
    how.add_argument("--join", nargs=2, metavar=("COLUMNS", "SEPARATOR"))
    p.add_argument("--output-header", action="append")
    p = add("sort-save-as", cmd_sort)
    p.add_argument("output")
    p.add_argument("--column", required=True)
    p.add_argument("--order", choices=("asc", "desc"), default="asc")
    p.add_argument("--header", choices=("auto", "first-row", "none"), default="auto")
    p = add("generate", cmd_generate, file=False, output=True)
    p.add_argument("--size", required=True)
    p.add_argument("--columns", type=int, required=True)
    p.add_argument("--seed", type=int, default=1)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        args.run(args)
    except (SheetError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
