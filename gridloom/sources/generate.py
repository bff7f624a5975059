"""Deterministic delimited fixtures."""

from __future__ import annotations

from collections.abc import Iterator

from ..errors import InvalidOption
from .grammar import check_delimiter

_MASK = (1 << 64) - 1
#: Shifts of the generator, periods of the special rows, length of the wide cell.
SHIFTS, LINES_EVERY, QUOTES_EVERY, WIDE_EVERY, WIDE = (13, 7, 17), 211, 97, 503, 4096


def rows(columns: int, delimiter: bytes, seed: int) -> Iterator[bytes]:
    """Header, then data rows without end. Every cell takes one draw, also where a special value stands."""
    check_delimiter(delimiter)
    if columns < 1:
        raise InvalidOption("columns must be 1 or more")
    yield delimiter.join(b"column_%d" % (i + 1) for i in range(columns)) + b"\n"
    a, b, c = SHIFTS
    state, row, last = max(seed, 1) & _MASK, 0, columns - 1
    while True:
        cells = []
        for column in range(columns):
            state ^= state << a & _MASK
            state ^= state >> b
            state ^= state << c & _MASK
            if row % LINES_EVERY == 0 and column == 1:
                cells.append(b'"line one\nline two"')
            elif row % QUOTES_EVERY == 0 and column == 0:
                cells.append(b'"value%s%dwith ""quotes"""' % (delimiter, state))
            elif row % WIDE_EVERY == 0 and column == last:
                cells.append(b"x" * WIDE)
            else:
                cells.append(b"%016x" % state)
        yield delimiter.join(cells) + b"\n"
        row += 1


def generate(path: str, size: int, columns: int, delimiter: bytes = b",", seed: int = 1) -> tuple[int, int]:
    """Write rows up to the first that reaches ``size``; return bytes and data rows. An existing file is an error."""
    written = count = 0
    with open(path, "xb") as out:
        for i, row in enumerate(rows(columns, delimiter, seed)):
            out.write(row)
            written += len(row)
            count = i
            if i and written >= size:
                break
    return written, count
