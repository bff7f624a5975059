"""Sheets end to end: literal inputs, exact output bytes."""

import hashlib
import os
import time

import pytest
from gridloom import cli, errors, verify
from gridloom.operators.filters import Contains, Equals
from gridloom.sheet import Sheet
from gridloom.sources import generate
from gridloom.streaming.jobs import Job
from pyspark.sql import functions as F

BOM = b"\xef\xbb\xbf"


@pytest.fixture
def file(tmp_path):
    def make(data):
        path = tmp_path / f"in{len(list(tmp_path.iterdir()))}.csv"
        path.write_bytes(data)
        return str(path)

    return make


@pytest.fixture
def opened(spark, file):
    def make(data, **options):
        return Sheet.open(spark, file(data), **options)

    return make


def written(sheet, tmp_path, **options):
    out = tmp_path / "out.csv"
    if out.exists():
        out.unlink()
    before = sorted(p.name for p in tmp_path.iterdir())
    rows, size = sheet.save_as(str(out), **options)
    data = out.read_bytes()
    assert size == len(data) and sorted(p.name for p in tmp_path.iterdir()) == sorted([*before, "out.csv"])
    return data


def test_journey(opened, tmp_path):
    sheet = opened(b"key,name\nb,first-b\nA,upper\n,missing\na,lower\nb,second-b\n")
    out = written(sheet.edit({(1, 1): "first-b edited"}).sort(0)[0], tmp_path, mode=0o600)
    assert hashlib.sha256(out).hexdigest() == "903d15aad5251b9ade79aad1552bf1a27d4ba0eb37ae49a8f912f2fae3a20be4"
    assert os.stat(tmp_path / "out.csv").st_mode & 0o777 == 0o600


def test_generated_file(spark, tmp_path):
    path = str(tmp_path / "g.csv")
    _, rows = generate.generate(path, 300_000, 11, b",", 1)
    sheet = Sheet.open(spark, path, step=20_000)
    assert len(sheet.index.splits) > 5 and sheet.count() == rows + 1
    assert sheet.body.agg(F.min("row"), F.max("row"), F.countDistinct("row")).first() == (1, rows, rows)
    quotes, lines = Contains(0, 'with "quotes"'), Equals(1, "line one\nline two")
    assert sheet.filter([quotes]).count() == -(-rows // 97)
    assert sheet.filter([lines]).count() == -(-rows // 211)
    assert sheet.filter([quotes, lines]).count() == -(-rows // (97 * 211))
    hit = sheet.find('with "quotes"')
    assert (hit.row, hit.column, hit.offset) == (1, 0, 101)
    assert [r["row"] for r in sheet.rows(rows - 2, 10).collect()] == [rows - 2, rows - 1, rows]
    assert written(sheet, tmp_path) == open(path, "rb").read()
    verify.same_rows(sheet, sheet.sort(3, True)[0])


def test_ranges_and_errors(opened):
    sheet = opened(b"a,b\n1,2\n3,4\n")
    assert [r["fields"] for r in sheet.rows(0, 2).collect()] == [["a", "b"], ["1", "2"]]
    assert sheet.rows(9, 0).count() == 0
    with pytest.raises(errors.RowNotIndexed, match="row 3 is not indexed yet"):
        sheet.rows(3, 1)
    with pytest.raises(errors.BootstrapLimitExceeded):
        opened(b"x" * 1024, limit=64, sample_bytes=64, rows=2)
    with pytest.raises(errors.InvalidOption):
        opened(b"a", rows=0)


def test_first_error_is_reported(opened):
    sheet = opened(b'a,b\n1,2\n3,"x"y\n5,z"\n', rows=1, delimiter=b",", sample_bytes=4, limit=64)
    with pytest.raises(errors.UnexpectedAfterQuote, match="byte 13"):
        sheet.validate()


def test_missing_differs_from_empty(opened):
    sheet = opened(b"id,note\n3,\n4\n", header="first-row")
    assert [r["row"] for r in sheet.filter([Equals(1, "")]).rows(0, 9).collect()] == [1]
    with pytest.raises(errors.InvalidOption):
        sheet.filter([])
    with pytest.raises(errors.InvalidOption):
        sheet.filter([Contains(0, "")])


def test_match_ranges(opened):
    found = opened(b"value\nmiss\nhit\nmiss\nhit\nhit\nmiss\nhit", header="first-row", delimiter=b",").filter([Equals(0, "hit")])
    assert [(r["match"], r["row"]) for r in found.rows(0, 9).collect()] == [(0, 2), (1, 4), (2, 5), (3, 7)]
    assert [r["row"] for r in found.rows(2, 1).collect()] == [5] and found.rows(1, 0).count() == 0
    with pytest.raises(errors.MatchNotIndexed):
        found.rows(4, 1)


def test_search(opened):
    sheet = opened(b"needle,header\nNeedle,needle\nneedle,tail\n", header="first-row")
    at = lambda m: m and (m.row, m.column)
    assert at(sheet.find("needle", (0, 1))) == (1, 1) and at(sheet.find("needle", (1, 2))) == (2, 0) and sheet.find("none") is None
    with pytest.raises(errors.InvalidOption):
        sheet.find("")
    edited = opened(b"left,right\nsource-hit,plain\nother,source-only\n").edit({(1, 0): "gone", (2, 1): "overlay-hit"})
    assert edited.find("source-hit") is None and at(edited.find("overlay-hit")) == (2, 1)


def test_raw_export(opened, tmp_path):
    sheet = opened(b'id;note;kind\r\n1;"line one\nline ""two""";keep\r\n2;plain;drop\r\n3;"last;value";keep')
    out = tmp_path / "f.csv"
    assert sheet.filter([Equals(2, "keep")]).export(str(out))[0] == 3
    assert out.read_bytes() == b'id;note;kind\r\n1;"line one\nline ""two""";keep\r\n3;"last;value";keep'
    with pytest.raises(errors.DestinationExists):
        sheet.filter([Equals(2, "keep")]).export(str(out))
    with pytest.raises(errors.OperationRefused):
        sheet.edit({(1, 0): "x"}).filter([Equals(2, "keep")])
    with pytest.raises(errors.OperationRefused):
        sheet.rename({0: "x"}).filter([Equals(2, "keep")]).export(str(tmp_path / "g.csv"))


def test_columns(opened, tmp_path):
    sheet = opened(b"name,x\nAda::Augusta::Lovelace::Byron,1\nGrace\n", header="first-row")
    assert sheet.analyze_split(0, "::") == (2, 4)
    assert written(sheet.split(0, "::", 3), tmp_path) == b"name,,,x\nAda,Augusta,Lovelace::Byron,1\nGrace,,\n"
    assert sheet.split(0, "::").width == 5
    with pytest.raises(errors.InvalidOption):
        sheet.split(1, "::")
    people = opened(b"first,last,age,city\nAda,Lovelace,36,London\nGrace,,85\n", header="first-row")
    out = written(people.edit({(1, 3): "Paris"}).rename({2: "years"}).join([3, 0], ", ", "city and first"), tmp_path)
    assert out == b'city and first,last,years\n"Paris, Ada",Lovelace,36\n", Grace",,85\n'
    ragged = opened(b"id,name,x,y\n1,Ada,London,tail,unknown one,unknown two\n2\n", header="first-row")
    assert written(ragged.arrange([2, 0], 4), tmp_path) == b"x,id\nLondon,1,unknown one,unknown two\n,2\n"
    assert written(people.move([3], 0), tmp_path) == b"city,first,last,age\nLondon,Ada,Lovelace,36\n,Grace,,85\n"
    assert people.move([0], 0) is people
    assert written(people.delete([1, 2]), tmp_path) == b"first,city\nAda,London\nGrace,\n"
    with pytest.raises(errors.InvalidOption):
        people.delete([0, 1, 2, 3])


def test_replace_all(opened, tmp_path):
    sheet = opened(b'first,second,third\r\n"aba aba",before,tail\r\nnone,"aba,aba"\r\n').edit({(1, 1): "ababa"}).rename({0: "aba header"})
    out, n = sheet.replace_all("aba", "X")
    assert n == 5 and written(out, tmp_path) == b'aba header,second,third\r\nX X,Xba,tail\r\nnone,"X,X"\r\n'
    assert sheet.replace_all("absent", "X") is None and sheet.replace_all("aba", "aba") is None
    assert sheet.replace_in_cell(2, 1, "aba", "Y").edits[(2, 1)] == "Y,Y"


def test_edits_keep_endings_and_bytes(opened, tmp_path):
    sheet = opened(BOM + b'id;id;\xff\r\n1;"a";b\n2;c\r\n3;d', header="first-row")
    assert written(sheet.edit({(2, 1): 'q"'}), tmp_path) == BOM + b'id;id;\xff\r\n1;"a";b\n2;"q"""\r\n3;d'
    assert written(sheet.rename({1: "x;y"}), tmp_path) == BOM + b'id;"x;y";\xff\r\n1;"a";b\n2;c\r\n3;d'
    assert written(opened(BOM + b"1,old\r\n2,last", header="none").edit({(0, 1): "new\nline"}), tmp_path) == BOM + b'1,"new\nline"\r\n2,last'
    assert sheet.edit({(2, 1): "x"}).edit({(2, 1): "c"}).edits == {}
    for bad in ({(9, 0): "x"}, {(2, 2): "x"}, {(0, 0): "x"}):
        with pytest.raises(errors.InvalidOption):
            sheet.edit(bad)


def test_many_edits_join(spark, opened):
    sheet = opened(b"a,b\n" + b"".join(b"%d,x\n" % i for i in range(300)))
    edited = sheet.edit({(i, 1): f"v{i}" for i in range(1, 200)})
    got = {r["row"]: r["fields"] for r in edited.rows_frame().collect()}
    assert got[5] == ["4", "v5"] and got[250] == ["249", "x"]


def test_what_looks_like_structure_is_quoted(opened, tmp_path):
    assert written(opened(b'"' + BOM + b'one",two\n', header="none", delimiter=b",").join([0, 1], "|"), tmp_path) == b'"' + BOM + b'one|two"\n'
    assert written(opened(b",", header="none", delimiter=b",").join([0, 1], ""), tmp_path) == b'""'


def test_sort(opened, tmp_path):
    assert written(opened(BOM + b"one,b\ntwo,a\nthree,b", header="none").sort(1, True)[0], tmp_path) == BOM + b"one,b\nthree,b\ntwo,a\n"
    got = opened(b'id,key\n1,"z\nline"\n2,"a,comma"\n3,\n4,"z\nline"\n').sort(1)[0]
    assert [r["fields"][0] for r in got.body.orderBy("row").collect()] == ["3", "2", "1", "4"]
    assert verify.in_order(got, 1) == 4
    with pytest.raises(errors.InvalidData):
        verify.in_order(got, 0)


def test_save_in_place_and_guards(spark, file, tmp_path):
    path = file(b"a,b\n1,2\n")
    sheet = Sheet.open(spark, path)
    with pytest.raises(errors.OperationRefused):
        sheet.save()
    again = sheet.edit({(1, 1): "9"}).save()
    assert open(path, "rb").read() == b"a,b\n1,9\n" and again.count() == 2
    with pytest.raises(errors.SourceChanged):
        sheet.edit({(1, 0): "7"}).save_as(str(tmp_path / "x.csv"))
    assert not (tmp_path / "x.csv").exists()
    os.symlink(path, tmp_path / "link.csv")
    with pytest.raises(errors.InvalidOption):
        Sheet.open(spark, str(tmp_path / "link.csv")).edit({(1, 1): "z"}).save()


def test_undo_redo_discard(opened):
    sheet = opened(b"a,b\n1,2\n")
    changed = sheet.delete([0])
    assert changed.undo().names == ("a", "b") and changed.undo().redo().names == ("b",)
    with pytest.raises(errors.OperationRefused):
        sheet.undo()
    with pytest.raises(errors.OperationRefused):
        changed.edit({(1, 0): "x"}).undo()
    with pytest.raises(errors.OperationRefused):
        changed.undo().edit({(1, 0): "x"}).redo()
    assert changed.discard().names == ("a", "b")


def test_tables_as_sheets(spark, data):
    sheet = Sheet.from_dataframe(spark.read.parquet(f"{data}/nation.parquet"), ["n_nationkey"])
    name = spark.read.parquet(f"{data}/nation.parquet").where("n_nationkey = 7").first()["n_name"]
    assert sheet.count() == 25 and sheet.find(name).column == 1
    wide = sheet.rename({1: "title"}).wide()
    assert wide.columns == ["row", "n_nationkey", "title", "n_regionkey"]
    assert sheet.clipboard_row(0).count("\t") == 2


def test_jobs(spark, opened):
    job = Job(spark, lambda: spark.range(100).count())
    assert job.wait(60) == 100 and job.progress().done and job.progress().percent == 100
    slow = Job(spark, lambda: spark.range(10**12).selectExpr("max(hash(id))").collect())
    time.sleep(2)
    slow.cancel()
    assert slow.wait(60) is None and slow.cancelled
    with pytest.raises(ZeroDivisionError):
        Job(spark, lambda: 1 / 0).wait(10)


def test_cancelled_between_steps(spark, opened, tmp_path):
    import threading

    going, asked, ran = threading.Event(), threading.Event(), []

    def work():
        spark.range(10).count()
        going.set()
        asked.wait(20)
        spark.range(10).count()
        ran.append(1)
        return 7

    job = Job(spark, work)
    going.wait(20)
    assert job.cancel()
    asked.set()
    assert job.wait(30) is None and job.cancelled and not ran

    sheet, out = opened(b"a,b\n" + b"x,y\n" * 50), tmp_path / "late.csv"
    taken = {}
    monkey = sheet.ensure_source_unchanged

    def slow():  # the last check before the file gets its name
        monkey()
        if out.parent and any(p.name.startswith(".late") for p in tmp_path.iterdir()):
            taken["job"].cancel()

    object.__setattr__(sheet, "ensure_source_unchanged", slow)
    began = threading.Event()
    taken["job"] = Job(spark, lambda: began.wait(20) and sheet.save_as(str(out)))
    began.set()
    assert taken["job"].wait(60) is None and taken["job"].cancelled
    assert not out.exists() and not [p for p in tmp_path.iterdir() if p.name.startswith(".late")]
    done = Job(spark, lambda: opened(b"a,b\n1,2\n").save_as(str(out)))
    assert done.wait(60) and not done.cancel() and out.exists()


def test_progress_counts_its_own_stages(spark):
    import threading

    other = threading.Thread(target=lambda: spark.range(0, 4_000_000, 1, 40).selectExpr("sum(hash(id))").collect())
    other.start()
    job = Job(spark, lambda: spark.range(0, 100, 1, 3).count())
    job.wait(60)
    assert 3 <= job.progress().tasks <= 10 and job.progress().percent == 100.0
    other.join()


def test_output_records_have_a_limit(opened, tmp_path, monkeypatch):
    from gridloom.sources import grammar

    sheet = opened(b"a,b\nx,yy\n" + b"z" * 30 + b"," + b"w" * 30 + b"\n")
    monkeypatch.setattr(grammar, "MAX_RECORD", 61)
    with pytest.raises(errors.RecordTooLarge):
        sheet.save_as(str(tmp_path / "too.csv"))
    assert not (tmp_path / "too.csv").exists()
    monkeypatch.setattr(grammar, "MAX_RECORD", 62)
    assert sheet.save_as(str(tmp_path / "fits.csv"))[0] == 3


def test_search_and_matches_of_a_file_in_parts(spark, file):
    lines = [b"id,text\n"] + [b'%d,"%s\n%s"\n' % (i, b"hit" if i % 7 == 3 else b"miss", b"x" * 40) for i in range(300)]
    sheet = Sheet.open(spark, file(b"".join(lines)), step=512)
    assert len(sheet.index.splits) > 20
    found = sheet.filter([Contains(1, "hit")])
    want = [i + 1 for i in range(300) if i % 7 == 3]
    assert found.count() == len(want) and sum(found._by_part) == len(want)
    for start, count in ((0, 5), (20, 9), (40, 100), (len(want) - 1, 1)):
        assert [(r["match"], r["row"]) for r in found.rows(start, count).collect()] == list(enumerate(want))[start : start + count]
    with pytest.raises(errors.MatchNotIndexed):
        found.rows(len(want), 1)
    assert found.rows(0, 0).count() == 0
    for at in (1, 5, 150, 290):
        hit = sheet.find("hit", (at, 0))
        assert (hit.row, hit.column) == (next(r for r in want if r >= at), 1)
    assert sheet.find("hit", (299, 0)) is None and sheet.find("absent") is None
    edited = sheet.edit({(2, 1): "hit now"})
    assert edited.find("hit").row == 2


def test_commands(spark, file, tmp_path, capsys):
    path = file(b"name,city,state\nAda::Lovelace,London,UK\nGrace,Arlington,US\n")
    out = lambda n: str(tmp_path / n)
    assert cli.main(["open", path, "--jump", "1"]) == 0 and "3 records" in capsys.readouterr().out
    assert cli.main(["search", path, "--query", "Arl"]) == 0 and "data row 2, column 2" in capsys.readouterr().out
    assert cli.main(["filter", path, "--column", "3", "--operator", "equals", "--value", "UK", "--and", "1", "contains", "Ada"]) == 0 and "1 matches" in capsys.readouterr().out
    assert cli.main(["export", path, "--output", out("e.csv"), "--column", "3", "--operator", "equals", "--value", "US"]) == 0
    assert open(out("e.csv"), "rb").read() == b"name,city,state\nGrace,Arlington,US\n"
    assert cli.main(["edit-save-as", path, "--output", out("d.csv"), "--edit", "2", "1", "Hopper"]) == 0
    assert open(out("d.csv"), "rb").read().endswith(b"Hopper,Arlington,US\n")
    assert cli.main(["edit-save-as", path, "--output", out("z.csv"), "--edit", "2", "1", "a", "--edit", "2", "1", "b"]) == 1
    assert cli.main(["transform-save-as", path, "--output", out("t.csv"), "--split", "1", "::", "2", "--output-header", "first", "--output-header", "last"]) == 0
    assert open(out("t.csv"), "rb").read() == b"first,last,city,state\nAda,Lovelace,London,UK\nGrace,,Arlington,US\n"
    assert cli.main(["transform-save-as", path, "--output", out("j.csv"), "--join", "2,3", ", ", "--output-header", "place"]) == 0
    assert open(out("j.csv"), "rb").read() == b'name,place\nAda::Lovelace,"London, UK"\nGrace,"Arlington, US"\n'
    assert cli.main(["sort-save-as", path, out("s.csv"), "--column", "2"]) == 0
    assert open(out("s.csv"), "rb").read() == b"name,city,state\nGrace,Arlington,US\nAda::Lovelace,London,UK\n"
    assert cli.main(["sort-save-as", path, out("s.csv"), "--column", "2"]) == 1
    assert cli.main(["viewport", path, "--iterations", "1", "--rows", "2"]) == 0 and "p95" in capsys.readouterr().out
    assert cli.main(["generate", "--size", "10kB", "--columns", "3", "--output", out("g.csv")]) == 0 and os.path.getsize(out("g.csv")) >= 10_000
    assert cli.main(["open", out("missing.csv")]) == 1
