"""Grammar, dialect, generator, split points and files, by exact bytes."""

import hashlib
import os
import pickle

import pytest
from gridloom import errors
from gridloom.plans import split_index
from gridloom.sources import dialect, files, generate, grammar
from hypothesis import given, settings
from hypothesis import strategies as st


def records(chunks, delimiter=b","):
    framer = grammar.Framer(delimiter)
    out = [r for c in chunks for r in framer.feed(c)]
    return out + list(framer.finish())


def parsed(data, delimiter=b","):
    return [grammar.parse(r, delimiter, at) for at, r in records([data], delimiter)]


@pytest.mark.parametrize(
    ("data", "want"),
    [
        (b'"a ""quoted"" value",2,3\n', [[b'a "quoted" value', b"2", b"3"]]),
        (b"\n", [[b""]]),
        (b",a,,\n", [[b"", b"a", b"", b""]]),
        (b"", []),
        (b"a\rb,c\r\n", [[b"a\rb", b"c"]]),
        (b"a\xff\xfe,\n", [[b"a\xff\xfe", b""]]),
        (b'\xef\xbb\xbf"one\ncontinued",two\nlast,row\n', [[b"one\ncontinued", b"two"], [b"last", b"row"]]),
        (b" a , b \n", [[b" a ", b" b "]]),
        (b'1,"x\r\ny"\r\n2,3', [[b"1", b"x\r\ny"], [b"2", b"3"]]),
    ],
)
def test_parse(data, want):
    assert parsed(data) == want


def test_frames_at_every_split():
    data = b'a,b\n"quoted\nvalue","escaped ""quote"""\r\nx,y'
    for k in range(len(data) + 1):
        assert [at for at, _ in records([data[:k], data[k:]])] == [0, 4, 40]
    assert [at for at, _ in records([bytes([b]) for b in data])] == [0, 4, 40]


@pytest.mark.parametrize(
    ("data", "error", "offset"),
    [
        (b'bad"quote,2', errors.UnexpectedQuote, 3),
        (b'"bad"x,2', errors.UnexpectedAfterQuote, 5),
        (b'"unfinished', errors.UnterminatedQuote, 11),
        (b'"x"\ry', errors.ExpectedLfAfterCr, 4),
        (b'a,b\n\xef\xbb\xbf"c",d\n', errors.UnexpectedQuote, 7),
    ],
)
def test_malformed(data, error, offset):
    for chunks in ([data], [bytes([b]) for b in data]):
        with pytest.raises(error) as found:
            records(chunks)
        assert found.value.offset == offset


def test_errors_travel():
    for e in (errors.UnexpectedAfterQuote(0x78, 5), errors.FieldLimitExceeded(3, 1), errors.UnterminatedQuote(9)):
        back = pickle.loads(pickle.dumps(e))
        assert (type(back), str(back), back.offset) == (type(e), str(e), e.offset)


def test_limits():
    with pytest.raises(errors.FieldLimitExceeded):
        grammar.parse(b"a,b,c\n", b",", most=2)
    with pytest.raises(errors.RecordTooLarge):
        list(grammar.Framer(b",", limit=10).feed(b"x" * 30))
    for bad in (b'"', b"\r", b"\n", b"ab", b""):
        with pytest.raises(errors.InvalidDelimiter):
            grammar.check_delimiter(bad)


FIELD = st.binary(max_size=6) | st.sampled_from([b'"', b",", b"\n", b"\r", b"\r\n", b"", grammar.BOM])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(FIELD, min_size=1, max_size=4), min_size=1, max_size=6), st.sampled_from([b"\n", b"\r\n"]))
def test_written_records_are_read_back(rows, end):
    data = b"".join(grammar.write(r, b",", end, False) for r in rows)
    assert parsed(data) == rows
    last = b"".join(grammar.write(r, b",", end if i + 1 < len(rows) else b"", False) for i, r in enumerate(rows))
    assert parsed(last) == rows


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(FIELD, min_size=1, max_size=3), min_size=1, max_size=12), st.integers(1, 9))
def test_splits_begin_at_records(tmp_path_factory, rows, step):
    data = b"".join(grammar.write(r, b",", b"\n", False) for r in rows)
    path = tmp_path_factory.getbasetemp() / "s.csv"
    path.write_bytes(data)
    store, name = files.filesystem(str(path))
    found = [split_index.scan_range(store, name, b, min(b + step, len(data))) for b in range(0, len(data), step)]
    index = split_index.chain(found, len(data))
    starts = {at: i for i, (at, _) in enumerate(records([data]))}
    assert index.records == len(starts)
    for begin, end, row in index.splits:
        assert starts[begin] == row and (end in starts or end == len(data))
    assert [s[1] for s in index.splits][-1] == len(data)


def test_delimiter_detection():
    assert dialect.sniff_delimiter(b"a\tb\n1\t2\n") == b"\t"
    assert dialect.sniff_delimiter(b"a;b,c\n1;2\n3;4\n") == b";"
    assert dialect.sniff_delimiter(b"a|b") == b","  # a lone line without an end decides nothing
    assert dialect.sniff_delimiter(b'"a,b"|c\n"d,e"|f\n') == b"|"


@pytest.mark.parametrize(
    ("rows", "want"),
    [([[b"id", b"name"], [b"1", b"x"]], True), ([[b"a", b"a"], [b"1", b"2"]], False), ([[b"a", b""], [b"1", b"2"]], False), ([[b"a b", b"c d"], [b"e f", b"g h"]], False), ([[b"a", b"b"], [b"x y", b"z-z"]], True), ([[b"a", b"b"]], False), ([[b"a"], [b"1", b"2"]], False)],
)
def test_header_detection(rows, want):
    assert dialect.sniff_header(rows) is want


def test_generator_hash(tmp_path):
    path = str(tmp_path / "g.csv")
    assert generate.generate(path, 1_000_000, 40, b",", 40) == (1_000_404, 1_452)
    with open(path, "rb") as f:
        assert hashlib.sha256(f.read()).hexdigest() == "ac00fa3917a21b457cdb2fafc9ab7ba843334fdb946519644768918d85d84ef2"
    with pytest.raises(FileExistsError):
        generate.generate(path, 10, 2)


def test_publication(tmp_path):
    source, target = tmp_path / "a.csv", tmp_path / "b.csv"
    source.write_bytes(b"x")
    with pytest.raises(errors.DestinationIsSource):
        files.check_destination(str(source), str(tmp_path / "." / "a.csv"))
    os.symlink(source, tmp_path / "link")
    with pytest.raises(errors.DestinationIsSource):
        files.check_destination(str(source), str(tmp_path / "link"))
    assert files.publish(str(target), lambda f: f.write(b"abc"), mode=0o600) == 3
    assert target.read_bytes() == b"abc" and target.stat().st_mode & 0o777 == 0o600
    with pytest.raises(errors.DestinationExists):
        files.check_destination(str(source), str(target))
    with pytest.raises(errors.DestinationExists):
        files.publish(str(target), lambda f: f.write(b"new"))
    files.publish(str(target), lambda f: f.write(b"new"), replace=True)
    known = files.stamp(str(source))
    source.write_bytes(b"changed")
    with pytest.raises(errors.SourceChanged):
        files.publish(str(tmp_path / "c.csv"), lambda f: f.write(b"1"), lambda: files.check_stamp(str(source), known))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.csv", "b.csv", "link"]


def test_small_helpers():
    assert [dialect.parse_size(x) for x in ("10GB", "1MiB", "512", "3k")] == [10**10, 1 << 20, 512, 3000]
    assert dialect.parse_delimiter("\\t") == b"\t" and dialect.one_based("3", "row") == 2
    for bad in ("0", "x", "-1"):
        with pytest.raises(errors.InvalidOption):
            dialect.one_based(bad, "row")
    assert dialect.human_bytes(1536) == "1.50 KiB" and dialect.rate(100, 0) == 0
    assert dialect.nearest_rank([3, 1, 2], 50) == 2 and dialect.nearest_rank(list(range(1, 12)), 95) == 11
    assert dialect.fnv1a(b"a") == 0xAF63DC4C8601EC8C
    assert dialect.shown(b"a\nb\xff") == "a\\nb�" and len(dialect.shown(b"x" * 100)) == 80
    assert files.sibling("/a/b.csv", "filtered") == "/a/b-filtered.csv"


def test_runs_of_records_parse_as_each_record_alone(tmp_path, monkeypatch):
    import json
    import random

    from gridloom.sources import delimited

    class Wanted:
        def fieldNames(self):
            return ["row", "offset", "raw", "fields"]

    def one_by_one(path, size):
        out = []
        for row, (at, record) in enumerate(delimited.records(path, 0, size, b",")):
            raw = record[3:] if at == 0 and record.startswith(grammar.BOM) else record
            out.append((row, at, raw.decode("latin-1"), [v.decode("latin-1") for v in grammar.parse(record, b",", at)]))
        return out

    def result(run):
        try:
            return run()
        except errors.ParseError as e:
            return type(e), str(e)

    rng, path = random.Random(1), str(tmp_path / "in.csv")
    parts = [b"a", b"b,", b",", b"\n", b"\r\n", b"\r", b'"x"', b'"q""q"', b'"m\nn"', b"\xc3\xa9", b"\xff", b'"', b"long" * 4]
    for chunk in (7, 37, 1 << 20):
        monkeypatch.setattr(delimited, "CHUNK", chunk)
        for _ in range(400):
            data = (b"\xef\xbb\xbf" if rng.random() < 0.2 else b"") + b"".join(rng.choices(parts, k=rng.randint(0, 25)))
            with open(path, "wb") as f:
                f.write(data)
            reader = delimited.DelimitedReader({"path": path, "delimiter": ",", "splits": json.dumps([[0, len(data), 0]])}, Wanted())
            got = result(lambda: [tuple(r.values()) for b in reader.read(delimited.Part(0, len(data), 0)) for r in b.to_pylist()])
            assert got == result(lambda: one_by_one(path, len(data))), data
