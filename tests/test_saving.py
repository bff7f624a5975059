"""Files that are saved in parallel: untouched bytes, places of parts, checks before a file gets its name."""

import os
import pickle
import random
import threading
import time

import pytest
from gridloom import errors
from gridloom.operators import edits as overlay
from gridloom.operators.filters import Equals
from gridloom.plans import split_index
from gridloom.plans.split_index import SplitIndex
from gridloom.sheet import Sheet
from gridloom.sources import delimited, publication
from gridloom.sources.publication import Span
from gridloom.streaming.jobs import Job


@pytest.fixture
def file(tmp_path):
    def make(data, name="in.csv"):
        path = tmp_path / name
        path.write_bytes(data)
        return str(path)

    return make


def records(n):
    """Quoted without need, so that whatever is written anew differs."""
    return [b'"q%d",v%d\n' % (i, i) for i in range(n)]


@pytest.mark.parametrize("edited", [1, 64, 65, 10_000])
@pytest.mark.parametrize("step", [None, 20_000])
def test_untouched_records_keep_their_bytes(spark, file, tmp_path, edited, step):
    lines = records(12_000)
    sheet = Sheet.open(spark, file(b"".join(lines)), header="none", step=step).edit({(i, 1): f"new {i}" for i in range(1, edited + 1)})
    rows, size = sheet.save_as(str(tmp_path / "out.csv"))
    want = [b"q%d,new %d\n" % (i, i) if 1 <= i <= edited else line for i, line in enumerate(lines)]
    assert (tmp_path / "out.csv").read_bytes() == b"".join(want) and (rows, size) == (12_000, len(b"".join(want)))


def test_edits_too_many_to_send_are_joined_in_order(spark, file, tmp_path, monkeypatch):
    monkeypatch.setattr(overlay, "SENT_BYTES", 10)
    monkeypatch.setattr(overlay, "LITERAL_ROWS", 1)
    lines = records(500)
    sheet = Sheet.open(spark, file(b"".join(lines)), header="none", step=1000).edit({(i, 1): "x" for i in range(0, 500, 7)})
    sheet.save_as(str(tmp_path / "out.csv"))
    assert (tmp_path / "out.csv").read_bytes() == b"".join(b"q%d,x\n" % i if i % 7 == 0 else line for i, line in enumerate(lines))


def test_a_record_without_a_lines_end_stays_so(spark, file, tmp_path):
    data = b"a,b\n1,2\n3,\xff"
    for name, changed in (("same", lambda s: s), ("edit", lambda s: s.edit({(2, 0): "z"})), ("split", lambda s: s.split(0, "|", 2))):
        out = tmp_path / f"{name}.csv"
        changed(Sheet.open(spark, file(data), header="first-row")).save_as(str(out))
        assert out.read_bytes() == {"same": data, "edit": b"a,b\n1,2\nz,\xff", "split": b"a,Split 2,b\n1,,2\n3,,\xff"}[name] or name == "split" and out.read_bytes().endswith(b"\n1,,2\n3,,\xff")


def test_one_edit_reads_one_part_and_writes_one(spark, file, tmp_path):
    lines = records(5000)
    sheet = Sheet.open(spark, file(b"".join(lines)), header="none", step=4000)
    parts = len(sheet.index.splits)
    assert parts > 10 and sheet._only([2500]).rdd.getNumPartitions() == 1 and sheet._only([2500]).count() == 1
    spans, rows = sheet.edit({(2500, 1): "x"})._spans(f"file://{tmp_path}/parts")
    assert rows == 5000 and len(spans) == parts and sum(s.path.startswith("file:") for s in spans) == 1
    assert sheet._only([3, 4999]).rdd.getNumPartitions() == 2
    assert sheet.clipboard_row(4999) == "q4999\tv4999" and sheet.replace_in_cell(17, 1, "v", "w").edits == {(17, 1): "w17"}


def test_a_new_header_is_put_before_unread_bytes(spark, file, tmp_path):
    body = b'1,"x\ny"\r\n' * 200 + b'broken,"'  # what follows a header isn't read again
    sheet = Sheet.open(spark, file(b"\xef\xbb\xbfid,name\r\n" + body), header="first-row", step=300).rename({1: 'a "name"'})
    sheet.save_as(str(tmp_path / "out.csv"))
    assert (tmp_path / "out.csv").read_bytes() == b'\xef\xbb\xbfid,"a ""name"""\r\n' + body


def test_edits_of_a_malformed_file_are_refused(spark, file, tmp_path):
    data = b"".join(records(400)) + b'a"b,c\n' + b"".join(records(400))
    sheet = Sheet.open(spark, file(data), header="none", step=1500).edit({(0, 1): "x"})
    with pytest.raises(errors.UnexpectedQuote, match=str(data.index(b'"b,c'))):
        sheet.save_as(str(tmp_path / "out.csv"))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["in.csv"]


def test_a_sort_is_in_the_plan_and_its_file_is_read_back(spark, file, tmp_path, monkeypatch):
    rng = random.Random(5)
    lines = [b"%d,%s\n" % (i, bytes([rng.randint(97, 122)]) * 3) for i in range(800)]
    sheet, summary = Sheet.open(spark, file(b"".join(lines)), header="none", step=1000).sort(1, True)
    plan = sheet.sorted.lines._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort [" in plan and summary.rows == 800
    sheet.save_as(str(tmp_path / "out.csv"))
    assert (tmp_path / "out.csv").read_bytes() == b"".join(sorted(lines, key=lambda x: x.split(b",")[1], reverse=True))
    compose = publication.compose

    def swapped(spark, head, spans, hidden):
        size = compose(spark, head, spans, hidden)
        with open(hidden, "r+b") as f:
            data = bytearray(f.read())
            data[-2] ^= 1
            f.seek(0)
            f.write(data)
        return size

    monkeypatch.setattr(publication, "compose", swapped)
    with pytest.raises(errors.InvalidData):
        sheet.save_as(str(tmp_path / "bad.csv"))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["in.csv", "out.csv"]


def test_spans_are_written_at_their_places_whatever_runs_again(spark, file, tmp_path):
    parts = [os.urandom(n) for n in (0, 1, 70_000, 3)]
    spans = [Span(file(p, f"p{i}"), 0, len(p)) for i, p in enumerate(parts)]
    out = tmp_path / "out"
    assert publication.publish(spark, b"head", [*spans, Span(spans[2].path, 10, 20)], str(out)) == out.stat().st_size
    assert out.read_bytes() == b"head" + b"".join(parts) + parts[2][10:20]
    hidden = tmp_path / "again"
    hidden.write_bytes(b"x" * 70_001)
    for _ in range(2):
        assert publication.copy_span(spans[2], str(hidden), 1) == 70_000
    assert hidden.read_bytes() == b"x" + parts[2]
    with pytest.raises(errors.SourceChanged):  # a part that is shorter than was said
        publication.publish(spark, b"", [Span(spans[1].path, 0, 5)], str(tmp_path / "short"))
    assert not (tmp_path / "short").exists() and not [p for p in tmp_path.iterdir() if p.name.startswith(".")]


def test_a_task_that_fails_is_run_again(tmp_path):
    """A session of its own, whose tasks may fail: the part appears only after the first attempt."""
    import subprocess
    import sys

    code = f"""
import threading, time, os
from pyspark.sql import SparkSession
from gridloom.sources import publication
spark = SparkSession.builder.master("local[2,40]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
open("{tmp_path}/a", "wb").write(b"a" * 1000)
def late():
    time.sleep(4)
    open("{tmp_path}/b.new", "wb").write(b"b" * 1000)
    os.rename("{tmp_path}/b.new", "{tmp_path}/b")
threading.Thread(target=late).start()
publication.publish(spark, b"h", [publication.Span("{tmp_path}/a", 0, 1000), publication.Span("{tmp_path}/b", 0, 1000)], "{tmp_path}/out")
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120, capture_output=True)
    assert (tmp_path / "out").read_bytes() == b"h" + b"a" * 1000 + b"b" * 1000


def test_a_store_that_joins_files_gets_them_beside_the_destination(spark, tmp_path, monkeypatch):
    """The way that files of other stores take, on one that joins files."""
    calls = []

    class Store:
        def __init__(self, real):
            self.real = real

        def concat(self, first, parts):
            calls.append(len(parts))
            for p in parts:
                with open(first.toUri().getPath(), "ab") as out, open(p.toUri().getPath(), "rb") as part:
                    out.write(part.read())

        def truncate(self, path, size):
            os.truncate(path.toUri().getPath(), size)

        def __getattr__(self, name):
            return getattr(self.real, name)

    hadoop = publication.hadoop

    def raw(spark, path):
        store, where = hadoop(spark, path)
        return Store(store.getRawFileSystem()), where

    monkeypatch.setattr(publication, "hadoop", raw)
    monkeypatch.setattr("gridloom.sources.files.is_local", lambda path: not path.startswith("file://"))
    source = tmp_path / "in.csv"
    source.write_bytes(b"a,b\n" + b"".join(records(300)) + b"x,y")
    sheet = Sheet.open(spark, str(source), header="first-row", step=1000)
    uri = f"file://{tmp_path}/out.csv"
    rows, size = sheet.split(0, "q", 2).save_as(uri)
    want = b"".join([b",%d,v%d\n" % (i, i) for i in range(300)]) + b"x,,y"
    assert (tmp_path / "out.csv").read_bytes().endswith(want) and rows == 302 and size == (tmp_path / "out.csv").stat().st_size and calls
    with pytest.raises(errors.DestinationExists):
        sheet.split(0, "q", 2).save_as(uri)
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")) == ["in.csv", "out.csv"]


def test_an_index_keeps_to_its_budget():
    many = SplitIndex(tuple((64 * i, 64 * i + 64, 5 * i) for i in range(10**6)), 5 * 10**6)
    index = many.within(split_index.LIMIT)
    assert len(index.splits) <= split_index.LIMIT and index.splits[0][0] == 0 and index.splits[-1][1] == 64 * 10**6
    assert all(a[1] == b[0] and a[2] < b[2] for a, b in zip(index.splits, index.splits[1:]))
    assert [s for s in index.covering(2_500_001, 3)] == [s for s in index.splits if s[2] <= 2_500_003 and s[1] // 64 * 5 > 2_500_001]
    assert split_index.LIMIT & (split_index.LIMIT - 1) == 0 and split_index.step_for(10**14, 1000) * split_index.LIMIT >= 10**14
    assert split_index.step_for(10**8, 8) < 5 << 20 and split_index.step_for(10**13, 8) == split_index.step_for(10**13, 80)

    class Wanted:
        def fieldNames(self):
            return ["row"]

    import json

    sizes = {len(pickle.dumps(delimited.DelimitedReader({"path": "x", "delimiter": ",", "splits": json.dumps(index.splits[:n])}, Wanted()))) for n in (1, 1000, len(index.splits))}
    assert len(sizes) == 1  # what each task gets doesn't grow with the file


def test_working_copies(spark, file, tmp_path):
    path, copy = file(b"a,b\n1,2\n3,4\n"), tmp_path / "copy.csv"
    os.chmod(path, 0o640)
    work = Sheet.open(spark, path, header="first-row").edit({(1, 0): "x"}).working_copy(str(copy))
    assert copy.read_bytes() == b"a,b\nx,2\n3,4\n" and copy.stat().st_mode & 0o777 == 0o600
    more = work.edit({(2, 1): "y"})
    assert more.original[0] == path and open(path, "rb").read() == b"a,b\n1,2\n3,4\n"
    again = more.save_to_original()
    assert open(path, "rb").read() == b"a,b\nx,2\n3,y\n" and os.stat(path).st_mode & 0o777 == 0o640 and again.path == path
    with pytest.raises(errors.SourceChanged):  # the original isn't what the copy was made of
        more.save_to_original()
    work = again.working_copy(str(tmp_path / "other.csv")).edit({(1, 0): "z"})
    (tmp_path / "other.csv").write_bytes(b"a,b\nchanged,2\n3,4\n")
    with pytest.raises(errors.SourceChanged):
        work.save_to_original()
    assert open(path, "rb").read() == b"a,b\nx,2\n3,y\n" and not [p for p in tmp_path.iterdir() if p.name.startswith(".")]
    with pytest.raises(errors.InvalidOption):
        again.save_to_original()
    os.symlink(path, tmp_path / "link.csv")
    with pytest.raises(errors.InvalidOption):
        Sheet.open(spark, str(tmp_path / "link.csv"), header="first-row").rename({0: "n"}).save()


def test_progress_counts_bytes_once(spark, file, tmp_path):
    path = file(b"".join(records(20_000)))
    sheet, seen = Sheet.open(spark, path, header="none", step=10_000), []
    job = Job(spark, lambda: sheet.save_as(str(tmp_path / "out.csv")))
    while not job.progress().done:
        seen.append(job.progress().bytes)
        time.sleep(0.05)
    assert job.wait()[0] == 20_000 and seen == sorted(seen) and job.progress().bytes == os.path.getsize(path) == (tmp_path / "out.csv").stat().st_size


def test_clipboard(spark, file, monkeypatch):
    sheet = Sheet.open(spark, file(b'a,"x\ty ""z"""\n\xff,\xc3\xa9\n'), header="none")
    assert sheet.clipboard_cell(0, 1) == 'x\ty "z"' and sheet.clipboard_row(0) == 'a\t"x\ty ""z"""' and sheet.clipboard_cell(1, 1) == "é" and sheet.clipboard_cell(0, 9) == ""
    assert sheet.edit({(0, 0): "new"}).clipboard_cell(0, 0) == "new"
    for copy in (lambda: sheet.clipboard_cell(1, 0), lambda: sheet.clipboard_row(1)):
        with pytest.raises(errors.InvalidData, match="not valid UTF-8"):
            copy()
    with pytest.raises(errors.RowNotIndexed):
        sheet.clipboard_row(2)
    monkeypatch.setattr("gridloom.sheet.CLIPBOARD", 7)
    assert sheet.clipboard_cell(0, 1) == 'x\ty "z"'
    with pytest.raises(errors.OperationRefused, match="clipboard limit"):
        sheet.clipboard_row(0)


def test_shown_columns_and_estimates(spark, file):
    from gridloom.operators import columns

    assert columns.window(64, 63) == range(64) and columns.window(100, 3) == range(64) and columns.window(100, 50) == range(18, 82) and columns.window(100, 99) == range(36, 100)
    sheet = Sheet.open(spark, file(b"a,b\n1,2\n3,4\n"), header="first-row")
    assert sheet.window(1) == range(2)
    assert sheet.sort_estimate() == 4 * (12 + 4) + 48 * 2
    assert sheet.edit({(1, 0): "abc"}).rename({0: "xy"}).sort_estimate() == 4 * (12 + 4 + 8 + 6) + 48 * 2


def test_filter_exports_in_parallel(spark, file, tmp_path):
    lines = records(3000)
    sheet = Sheet.open(spark, file(b"".join(lines)), header="none", step=3000)
    assert sheet.filter([Equals(1, "v2999")]).export(str(tmp_path / "one.csv")) == (1, len(lines[2999]))
    assert (tmp_path / "one.csv").read_bytes() == lines[2999]
    assert sheet.filter([Equals(1, "none")]).export(str(tmp_path / "none.csv")) == (0, 0)


def test_threads_share_nothing(spark, file, tmp_path):
    sheet = Sheet.open(spark, file(b"".join(records(300))), header="none", step=1000)
    threads = [threading.Thread(target=lambda i=i: sheet.edit({(i, 1): f"t{i}"}).save_as(str(tmp_path / f"{i}.csv"))) for i in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert all((tmp_path / f"{i}.csv").read_bytes() == b"".join(b"q%d,t%d\n" % (i, i) if j == i else line for j, line in enumerate(records(300))) for i in range(3))


def test_a_sorted_table_is_saved_and_checked(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(["é", "日本", "", 'a "b"', "z\nz", None, "é", "\ufeffmark", "😀"])]
    sheet = Sheet.from_dataframe(spark.createDataFrame(rows, "id int, text string"), ["id"])
    ordered, summary = sheet.sort(1)
    assert summary.rows == len(rows) and ordered.save_as(str(tmp_path / "out.csv"))[0] == len(rows) + 1
    again = Sheet.open(spark, str(tmp_path / "out.csv"), header="first-row", delimiter=b",")
    want = [[str(i), t or ""] for i, t in sorted(rows, key=lambda r: ((r[1] or "").encode(), r[0]))]
    assert [[v.encode("latin-1").decode() for v in r["fields"]] for r in again.rows_frame().orderBy("row").collect()] == want
    assert [r["fields"] for r in ordered.rows_frame().orderBy("row").collect()] == want
    edited = ordered.edit({(1, 1): "edited"})
    edited.save_as(str(tmp_path / "edited.csv"))
    assert (tmp_path / "edited.csv").read_bytes().count(b"edited") == 1
