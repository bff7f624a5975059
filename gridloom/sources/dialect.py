"""Delimiter and header detection on a bounded head of a file, and the limits of reading."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from dataclasses import dataclass

from ..errors import BootstrapLimitExceeded, InvalidOption, ParseError, SheetError
from . import grammar

#: Bytes of the sample and of the head that is read at most, rows of the head, records and
#: delimiters that detection tries.
SAMPLE, HEAD_BYTES, HEAD_ROWS = 1 << 20, 64 << 20, 100
TRIED_RECORDS, DELIMITERS = 32, (b",", b"\t", b"|", b";")

_NAME = re.compile(rb"[A-Za-z_][A-Za-z0-9_]*\Z")
_NUMBER = re.compile(rb"[0-9+\-.eE]+\Z")


@dataclass(frozen=True)
class Dialect:
    delimiter: bytes
    has_header: bool


def kind(value: bytes) -> str:
    if not value:
        return "empty"
    return "number" if _NUMBER.match(value) and re.search(rb"[0-9]", value) else "text"


def sniff_delimiter(sample: bytes) -> bytes:
    """The delimiter under which most records have one same width over 1, the widest of equals, in the order tried."""
    best, found = (0, 0), DELIMITERS[0]
    for delimiter in DELIMITERS:
        try:
            records = list(grammar.Framer(delimiter).feed(sample))[:TRIED_RECORDS]
            widths = Counter(len(grammar.parse(r, delimiter, at)) for at, r in records)
        except (ParseError, SheetError):
            continue
        score = max(((n, w) for w, n in widths.items() if w > 1), default=(0, 0))
        if score > best:
            best, found = score, delimiter
    return found


def sniff_header(rows: list[list[bytes]]) -> bool:
    if len(rows) < 2:
        return False
    first, second = rows[:2]
    if len(first) != len(second) or len(set(first)) != len(first) or b"" in first:
        return False
    if sum(kind(a) != kind(b) for a, b in zip(first, second, strict=True)) >= max(1, len(first) // 4):
        return True
    named = sum(bool(_NAME.match(v)) for v in second)
    return all(_NAME.match(v) for v in first) and 4 * named < 3 * len(second)


def head(data: bytes, whole: bool, delimiter: bytes, rows: int, limit: int) -> list[tuple[int, bytes]]:
    """The first records with their offsets; ``whole`` says that ``data`` is all there is."""
    framer, out = grammar.Framer(delimiter), []
    for record in framer.feed(data):
        out.append(record)
        if len(out) == rows:
            return out
    if whole:
        out += framer.finish()
    elif len(data) >= limit:
        raise BootstrapLimitExceeded(limit, len(out))
    return out


def parse_size(text: str) -> int:
    """Bytes of ``10GB``, ``1MiB``, ``512``."""
    match = re.fullmatch(r"(\d+)\s*([kmgt]?)(i?)b?", text.strip(), re.IGNORECASE)
    if not match:
        raise InvalidOption(f"size {text!r}")
    step = 1024 if match[3] else 1000
    return int(match[1]) * step ** " kmgt".index(match[2].lower() or " ")


def parse_delimiter(text: str) -> bytes:
    return grammar.check_delimiter({"\\t": b"\t", "tab": b"\t"}.get(text, text.encode()))


def one_based(text: str, what: str) -> int:
    """A row or column as users count."""
    if not text.isdigit() or int(text) < 1:
        raise InvalidOption(f"{what} must be 1 or more")
    return int(text) - 1


def human_bytes(n: float) -> str:
    for unit in ("B", "KiB", "MiB", "GiB"):
        if n < 1024:
            return f"{n:.2f} {unit}"
        n /= 1024
    return f"{n:.2f} TiB"


def rate(n: int, seconds: float) -> int:
    return int(n / seconds) if seconds > 0 else 0


def nearest_rank(values: list[float], percent: int) -> float:
    ordered = sorted(values)
    return ordered[max(1, -(-len(ordered) * percent // 100)) - 1]


def fnv1a(data: bytes, state: int = 0xCBF29CE484222325) -> int:
    for b in data:
        state = (state ^ b) * 0x100000001B3 & (1 << 64) - 1
    return state


def digest_of(path: str) -> bytes:
    """What tells whether a file's bytes are as they were: quicker than the hash that is shown."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "blake2b").digest()


def fnv1a_of(path: str) -> int:
    """FNV-1a of a whole file, a chunk at a time."""
    state = fnv1a(b"")
    with open(path, "rb") as f:
        while data := f.read(1 << 20):
            state = fnv1a(data, state)
    return state


def shown(value: bytes, limit: int = 80) -> str:
    text = value.decode("utf-8", "replace").replace("\n", "\\n").replace("\r", "\\r")
    return text[: limit - 3] + "..." if len(text) > limit else text
