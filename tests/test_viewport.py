"""Places of views, scroll fractions, samples of matches and their checksum; commands that use them."""

import pytest
from gridloom import cli
from gridloom.functions import viewport


def test_places_of_views():
    assert viewport.last_start(10, 4) == 6 and viewport.last_start(3, 4) == 0
    assert [viewport.start_of(r, 1, 10, 4) for r in (0, 1, 5, 7, 99)] == [1, 1, 5, 7, 7]
    assert [viewport.fraction_of(r, 1, 10, 4) for r in (0, 1, 4, 7, 99)] == [0, 0, 0.5, 1, 1] and viewport.fraction_of(5, 1, 3, 4) == 0
    for row in range(1, 8):
        assert viewport.row_at(viewport.fraction_of(row, 1, 10, 4), 1, 10, 4) == row
    assert viewport.row_at(2.0, 1, 10, 4) == 7 and viewport.row_at(-1.0, 1, 10, 4) == 1


def test_samples_overlap_nowhere():
    assert viewport.sample_ranges(0, 100) == [] and viewport.sample_ranges(50, 100) == [(0, 50)]
    assert viewport.sample_ranges(150, 100) == [(0, 100), (100, 50)] and viewport.sample_ranges(1000, 100) == [(0, 100), (500, 100), (900, 100)]
    for n in range(1, 400, 7):
        seen = [i for start, count in viewport.sample_ranges(n, 100) for i in range(start, start + count)]
        assert seen == sorted(set(seen)) and seen[0] == 0 and seen[-1] == n - 1


def test_checksum_goes_step_by_step():
    prime, whole = 1099511628211, 1 << 64

    def turned(v, by):
        return int(f"{v:064b}"[by:] + f"{v:064b}"[:by], 2)

    rows = [(0, 3, 17, [b"a", b"", b"\xff\x00"]), (1, 2**40, 2**63 + 5, [b"xyz"])]
    state = 0
    for match, row, offset, fields in rows:
        state = (turned(state, 7) + match) % whole ^ turned(row, 17) ^ offset
        for f in fields:
            for byte in f:
                state = state * prime % whole ^ byte
    assert viewport.matches_checksum(rows) == state == viewport.matches_checksum(rows[1:], viewport.matches_checksum(rows[:1]))
    assert viewport.matches_checksum(rows[::-1]) != state


@pytest.fixture
def path(tmp_path):
    out = tmp_path / "in.csv"
    out.write_bytes(b"id,text\n" + b"".join(b"%d,%s\n" % (i, b"hit" if i % 2 else b"miss") for i in range(1000)))
    return str(out)


def test_filter_prints_its_samples(spark, path, capsys):
    assert cli.main(["filter", path, "--column", "2", "--operator", "equals", "--value", "hit"]) == 0
    out = capsys.readouterr().out.splitlines()
    rows = [(i, 2 * i + 2, 0, [b"%d" % (2 * i + 1), b"hit"]) for i in range(500)]
    offsets, at = [], 8
    for i in range(1000):
        offsets.append(at)
        at += len(b"%d,%s\n" % (i, b"hit" if i % 2 else b"miss"))
    sampled = [(m, r, offsets[r - 1], f) for m, r, _, f in (*rows[:100], *rows[250:350], *rows[400:])]
    assert out[0] == "500 matches" and sum("\thit" in x for x in out) == 300
    assert out[-1] == f"300 sampled: match 0 in row 2 at byte {sampled[0][2]} to match 499 in row 1000 at byte {sampled[-1][2]}, checksum {viewport.matches_checksum(sampled):016x}"


def test_views_while_the_file_is_indexed(spark, path, capsys):
    assert cli.main(["viewport", path, "--live", "--iterations", "1", "--rows", "10"]) == 0
    out = capsys.readouterr().out
    assert "1001 records" in out and "reads while indexing" in out and "random: min" in out
