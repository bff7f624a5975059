"""Strict framing and parsing of delimited records, on bytes.

A quote may only open a field at its start; inside, two quotes are one; after
the closing one comes a delimiter or a line's end. Lines end with LF or CRLF;
another CR is data. A byte order mark is skipped at offset 0 alone.
"""

from __future__ import annotations

import re

from ..errors import ExpectedLfAfterCr, FieldLimitExceeded, InvalidDelimiter, RecordTooLarge, UnexpectedAfterQuote, UnexpectedQuote, UnterminatedQuote

BOM = b"\xef\xbb\xbf"
#: Fixed value: bytes of a record at most.
MAX_RECORD = 64 << 20


def check_delimiter(delimiter: bytes) -> bytes:
    if len(delimiter) != 1 or delimiter in b'"\r\n':
        raise InvalidDelimiter()
    return delimiter


class Framer:
    """Cuts a stream of chunks into records; what is left of one waits for the next chunk."""

    def __init__(self, delimiter: bytes, at: int = 0, limit: int = MAX_RECORD):
        self.delimiter = check_delimiter(delimiter)
        self.at = at  # offset of the first byte not yet given out
        self.limit = limit
        self.held = b""
        self._plain = re.compile(b'["\n]')
        self._field = re.compile(b"[" + re.escape(delimiter) + b'"\n]')

    def feed(self, chunk: bytes):
        """Complete records as (offset, bytes with their line's end)."""
        data = self.held + chunk
        start = 0
        while True:
            end = self._end(data, start)
            if end is None:
                break
            if end - start > self.limit:
                raise RecordTooLarge(self.limit)
            yield self.at + start, data[start:end]
            start = end
        self.at += start
        self.held = data[start:]
        if len(self.held) > self.limit + 1:
            raise RecordTooLarge(self.limit)

    def finish(self):
        """The last record, if it has no line's end."""
        if self.held:
            if len(self.held) > self.limit:
                raise RecordTooLarge(self.limit)
            parse(self.held, self.delimiter, self.at)
            yield self.at, self.held
            self.at, self.held = self.at + len(self.held), b""

    def _end(self, data: bytes, start: int) -> int | None:
        """Offset after the line's end of the record at ``start``; None if the data don't reach it."""
        line = data.find(b"\n", start)
        if line >= 0 and data.find(b'"', start, line) < 0:
            return line + 1
        if line < 0 and data.find(b'"', start) < 0:
            return None
        base = self.at
        i = start + 3 if base + start == 0 and data.startswith(BOM, start) else start
        if base + start == 0 and len(data) < 3 and BOM.startswith(data):
            return None
        while True:  # at the start of a field
            if i >= len(data):
                return None
            if data[i] != 0x22:
                hit = self._field.search(data, i)
                if not hit:
                    return None
                if hit[0] == b'"':
                    raise UnexpectedQuote(base + hit.start())
                if hit[0] == b"\n":
                    return hit.end()
                i = hit.end()
                continue
            i += 1
            while True:
                close = data.find(b'"', i)
                if close < 0 or close + 1 >= len(data):
                    return None
                if data[close + 1] != 0x22:
                    i = close + 1
                    break
                i = close + 2
            follow = data[i : i + 1]
            if follow == self.delimiter:
                i += 1
            elif follow == b"\n":
                return i + 1
            elif follow == b"\r":
                if i + 1 >= len(data):
                    return None
                if data[i + 1] != 0x0A:
                    raise ExpectedLfAfterCr(base + i + 1)
                return i + 2
            else:
                raise UnexpectedAfterQuote(follow[0], base + i)


def ending(record: bytes) -> bytes:
    return b"\r\n" if record.endswith(b"\r\n") else b"\n" if record.endswith(b"\n") else b""


def parse(record: bytes, delimiter: bytes, at: int = 0, most: int | None = None) -> list[bytes]:
    """Fields of one record. ``at`` is its offset in the source, for errors and for the byte order mark."""
    body, skip = record[: len(record) - len(ending(record))], 0
    if at == 0 and body.startswith(BOM):
        body, skip = body[3:], 3
    if b'"' not in body:
        out = body.split(delimiter)
        if most is not None and len(out) > most:
            raise FieldLimitExceeded(most, at)
        return out
    out, i, base = [], 0, at + skip
    while True:
        if most is not None and len(out) >= most:
            raise FieldLimitExceeded(most, base + i)
        if body[i : i + 1] == b'"':
            i, parts = i + 1, []
            while True:
                close = body.find(b'"', i)
                if close < 0:
                    raise UnterminatedQuote(base + len(body))
                parts.append(body[i:close])
                i = close + 1
                if body[i : i + 1] != b'"':
                    break
                parts.append(b'"')
                i += 1
            out.append(b"".join(parts))
            if i >= len(body):
                return out
            if body[i : i + 1] != delimiter:
                if body[i : i + 1] == b"\r":
                    raise ExpectedLfAfterCr(base + i + 1)
                raise UnexpectedAfterQuote(body[i], base + i)
        else:
            stop = body.find(delimiter, i)
            field = body[i:] if stop < 0 else body[i:stop]
            if (bad := field.find(b'"')) >= 0:
                raise UnexpectedQuote(base + i + bad)
            out.append(field)
            if stop < 0:
                return out
            i = stop
        i += 1


def quote(field: bytes, delimiter: bytes, force: bool = False) -> bytes:
    if force or any(b in field for b in (delimiter, b'"', b"\r", b"\n")):
        return b'"' + field.replace(b'"', b'""') + b'"'
    return field


def write(fields: list[bytes], delimiter: bytes, end: bytes, bom: bool = False) -> bytes:
    """One record that is read as it is written; see ``functions.cells.record`` for the same as an expression."""
    force = (not bom and bool(fields) and fields[0].startswith(BOM)) or (fields == [b""] and not end)
    return delimiter.join(quote(f, delimiter, force and i == 0) for i, f in enumerate(fields)) + end
