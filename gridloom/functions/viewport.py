"""Where a view of some rows may begin, and what a scroll bar says of it."""

from __future__ import annotations

from collections.abc import Iterable

_ALL = (1 << 64) - 1
#: Fixed value: the multiplier of the checksum.
_PRIME = 0x100000001B3


def last_start(rows: int, visible: int) -> int:
    """The last row, counted from the first data row, at which a full view begins."""
    return max(0, rows - visible)


def start_of(wanted: int, data_start: int, rows: int, visible: int) -> int:
    """The nearest physical row to the wanted one at which a view may begin."""
    return data_start + min(max(0, wanted - data_start), last_start(rows, visible))


def fraction_of(row: int, data_start: int, rows: int, visible: int) -> float:
    """How far a view from this row is down, from 0 to 1; 0 where all rows are visible."""
    end = last_start(rows, visible)
    return min(max(0, row - data_start), end) / end if end else 0.0


def row_at(fraction: float, data_start: int, rows: int, visible: int) -> int:
    """The physical row at which a view begins when the scroll bar stands there."""
    return data_start + round(min(max(fraction, 0.0), 1.0) * last_start(rows, visible))


def _turned(value: int, by: int) -> int:
    value &= _ALL
    return (value << by | value >> 64 - by) & _ALL


def matches_checksum(matches: Iterable[tuple[int, int, int, list[bytes]]], state: int = 0) -> int:
    """A number for a sequence of matches ``(match, row, offset, fields)``: their places, then every byte, in order.

    The multiplication of each step takes in all that came before, so there
    are no partial results to combine: it goes over a bounded sample.
    """
    for match, row, offset, fields in matches:
        state = (_turned(state, 7) + match & _ALL) ^ _turned(row, 17) ^ offset
        for byte in b"".join(fields):
            state = state * _PRIME & _ALL ^ byte
    return state


def sample_ranges(matches: int, size: int) -> list[tuple[int, int]]:
    """Start and count of the first, the middle and the last matches, none of them twice."""
    out, reached = [], 0
    for start in sorted((0, matches // 2, max(0, matches - size))):
        start = max(start, reached)
        reached = max(reached, min(start + size, matches))
        if start < reached:
            out.append((start, reached - start))
    return out
