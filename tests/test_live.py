"""Reading while an index or a filter is still at work."""

import random

import pytest
from gridloom import errors
from gridloom.operators.filters import Contains
from gridloom.sheet import Sheet
from gridloom.sources import generate
from gridloom.streaming import live
from gridloom.streaming.parts import PartLog


@pytest.fixture
def path(tmp_path):
    out = str(tmp_path / "in.csv")
    generate.generate(out, 300_000, 11, b",", 1)
    return out


def test_rows_are_there_before_the_index_ends(spark, path):
    whole = Sheet.open(spark, path, step=20_000)
    sheet = live.LiveSheet(spark, path, step=20_000, start=False)
    index, seen = sheet._index, []
    assert sheet.count() == 0
    with pytest.raises(errors.RowNotIndexed, match="0 rows available"):
        sheet.rows(0, 1)
    order = list(range(len(index.ranges)))
    random.Random(3).shuffle(order)
    order.remove(0)
    for part in [*order[:5], 0, *order[5:]]:  # tasks end in any order, and one runs twice
        index.scan(part)
        seen.append(sheet.count())
        if part == order[2]:
            index.scan(part)
        if 0 < seen[-1]:
            assert sheet.rows(0, 3).collect() == whole.rows(0, 3).collect() and sheet.rows(seen[-1] - 1, 1).collect() == whole.rows(seen[-1] - 1, 1).collect()
    assert seen == sorted(seen) and seen[4] == 0 and 0 < seen[-1] < whole.count()
    assert index.published().splits == whole.index.splits[:-1] and index.log.total("bytes") == whole.stamp[0]


def test_a_live_index_ends_as_the_index(spark, path):
    sheet = live.LiveSheet(spark, path, step=20_000)
    done = sheet.wait()
    assert done.index == Sheet.open(spark, path, step=20_000).index and sheet.done
    assert sheet.job.progress().bytes == done.stamp[0] and done.rows(5, 2).count() == 2
    with open(path, "ab") as f:
        f.write(b"no,end")
    assert live.LiveSheet(spark, path, step=20_000).wait().count() == done.count() + 1


def test_matches_are_there_before_the_filter_ends(spark, path):
    sheet = Sheet.open(spark, path, step=20_000)
    predicate = [Contains(0, 'with "quotes"')]
    whole = sheet.filter(predicate)
    counts = whole._by_part
    log = PartLog(spark, len(counts))
    found = live.LiveMatches(sheet, whole.matches, whole.predicates, None, log)
    for part in (2, 1):
        log.commit(part, matches=counts[part])
        assert found.count() == 0 and live.first_matches(found, 5) == []
    log.commit(0, matches=counts[0])
    assert found.count() == sum(counts[:3]) > 2
    assert found.rows(1, 2).collect() == whole.rows(1, 2).collect()
    with pytest.raises(errors.MatchNotIndexed):
        found.rows(sum(counts[:3]), 1)


def test_a_live_filter_ends_as_the_filter(spark, path):
    sheet = Sheet.open(spark, path, step=20_000)
    found = live.filter_live(sheet, [Contains(0, 'with "quotes"')])
    assert found.job.wait() == found.count() == sheet.filter([Contains(0, 'with "quotes"')]).count()
    progress = found.job.progress()
    assert (progress.bytes, progress.rows, progress.matches) == (sheet.stamp[0], sheet.count(), found.count())
    assert live.first_matches(found, 3) == sheet.filter([Contains(0, 'with "quotes"')]).rows(0, 3).collect()
    none = live.filter_live(sheet, [Contains(0, "this is nowhere")])
    assert none.job.wait() == 0 and none.count() == 0


def test_a_part_counts_once(spark):
    log = PartLog(spark, 3)
    for _ in range(3):
        log.commit(1, bytes=5)
    assert log.prefix() == [] and log.total("bytes") == 5
    log.commit(0, bytes=2)
    assert [p["bytes"] for p in log.prefix()] == [2, 5]
    log.remove()
    assert log.total("bytes") == 7  # what was read stays known
