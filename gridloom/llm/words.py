"""Token ids of whole texts by way of their distinct words.

Both tokenizers used here never merge across the start of a run of blanks, so
a text is the sequence of its words and each distinct word is encoded once.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that a worker keeps with their ids, at most.
CACHE_WORDS = 500_000
#: Text bytes handled at a time.
SLICE_BYTES = 4 << 20

#: Characters that Unicode or Python call blank, other than the space.
_OTHER_BLANKS = "\\t\\n\\x0b\\x0c\\r\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each run, one run after the other."""
    lengths = lengths.astype(np.int64)
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts.astype(np.int64) - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)


class WordTable:
    """Ids by distinct word, kept over the batches that a Python worker sees."""

    def __init__(self, encode, limit: int = CACHE_WORDS):
        self.encode = encode  # array of words -> (flat ids, length of each)
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.words = pa.array([], pa.large_string())
        self.ids = np.zeros(0, np.uint32)
        self.lengths = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)

    def rows(self, distinct: pa.Array) -> np.ndarray:
        """Row of each distinct word in this table, which gains the missing ones."""
        distinct = distinct.cast(pa.large_string())
        if len(self.words) + len(distinct) > self.limit and len(self.words):
            self.clear()
        found = pc.index_in(distinct, value_set=self.words)
        missing = distinct.filter(pc.is_null(found))
        if len(missing):
            ids, lengths = self.encode(missing)
            start = len(self.ids)
            self.starts = np.concatenate([self.starts, start + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.ids = np.concatenate([self.ids, ids])
            first = len(self.words)
            self.words = pa.concat_arrays([self.words, missing])
            rows = found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            rows[rows < 0] = np.arange(first, first + len(missing))
            return rows
        return found.to_numpy(zero_copy_only=False).astype(np.int64)


def _gather(table: WordTable, rows: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words in ``rows``, and how many fall between neighbouring ``bounds``."""
    lengths = table.lengths[rows]
    flat = table.ids[ragged(table.starts[rows], lengths)]
    total = np.concatenate([[0], np.cumsum(lengths)])
    return flat, total[bounds[1:]] - total[bounds[:-1]]


class TextEncoder:
    """Encodes texts as the sequence of the ids of their units.

    ``odd`` is a RE2 pattern of texts whose words may not be cut at every
    space; ``split_odd`` cuts such a text into units. With ``first`` a text's
    first unit lacks the ``mark`` that later words begin with. With ``lines``
    a line's end begins a unit too, as the blank before the next word.
    """

    def __init__(self, encode, odd: str, split_odd, first: bool = False, lines: bool = False, mark: str = " "):
        def marked(words: pa.Array):
            units = pc.binary_join_element_wise(pa.scalar(mark, pa.large_string()), words, pa.scalar("", pa.large_string()))
            return encode(pc.if_else(pc.starts_with(words, "\n"), words, units) if lines else units)

        self.table = WordTable(marked)
        self.units = WordTable(encode)
        self.odd, self.split_odd, self.first, self.lines = odd, split_odd, first, lines

    def slices(self, texts: pa.Array):
        """Runs of at most about SLICE_BYTES, or of one text."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        at, held = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if held and held + size > SLICE_BYTES:
                yield texts.slice(at, i - at)
                at, held = i, 0
            held += size
        if at < len(texts):
            yield texts.slice(at)

    def encode_slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and, for each text, how many are its own. No text may be null."""
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        plain = np.flatnonzero(~odd)
        counts = np.zeros(len(texts), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(plain):
            flat, n = self._plain(texts if len(plain) == len(texts) else texts.take(pa.array(plain)))
            parts.append((plain, flat, n))
        if len(plain) < len(texts):
            strange = np.flatnonzero(odd)
            flat, n = self._strange(texts.take(pa.array(strange)).to_pylist())
            parts.append((strange, flat, n))
        if len(parts) == 1:
            return parts[0][1], parts[0][2]
        for rows, _, n in parts:
            counts[rows] = n
        out = np.empty(int(counts.sum()), np.uint32)
        begin = np.cumsum(counts) - counts
        for rows, flat, n in parts:
            out[ragged(begin[rows], n)] = flat
        return out, counts

    def _plain(self, texts: pa.Array):
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n") if self.lines else texts, " ")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        bounds = bounds - bounds[0]
        words = lists.flatten().dictionary_encode()
        rows = self.table.rows(words.dictionary)[words.indices.to_numpy(zero_copy_only=False)]
        if not self.first:
            flat, counts = _gather(self.table, rows, bounds)
            empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            if empty.any():
                keep = np.repeat(~empty, counts)
                flat, counts = flat[keep], np.where(empty, 0, counts)
            return flat, counts
        heads = lists.flatten().take(pa.array(bounds[:-1]))
        head = heads.dictionary_encode()
        head_rows = self.units.rows(head.dictionary)[head.indices.to_numpy(zero_copy_only=False)]
        later = np.ones(len(rows), bool)
        later[bounds[:-1]] = False
        flat, counts = _gather(self.table, rows[later], bounds - np.arange(len(bounds)))
        lead, n = _gather(self.units, head_rows, np.arange(len(head_rows) + 1))
        out = np.empty(len(flat) + len(lead), np.uint32)
        begin = np.cumsum(counts + n) - (counts + n)
        out[ragged(begin, n)] = lead
        out[ragged(begin + n, counts)] = flat
        return out, counts + n

    def _strange(self, texts: list[str]):
        units = [self.split_odd(x) for x in texts]
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in units])]).astype(np.int64)
        flat = pa.array([u for x in units for u in x], pa.large_string())
        words = flat.dictionary_encode()
        rows = self.units.rows(words.dictionary)[words.indices.to_numpy(zero_copy_only=False)]
        return _gather(self.units, rows, bounds)


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level tokenizers write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_SAFE_CUT = re.compile(r"(?<=\S)(?= )")

#: Fixed value: the pattern by which byte-level tokenizers of this family cut text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_bpe_encoder(path: str) -> TextEncoder:
    """Ids as ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)`` gives them.

    Each distinct piece goes through the library's model once; units with
    characters past U+024F go through the whole library, whose tables say what
    a letter is. So do the strings of added tokens, at which a text is cut, as
    the library does; a text with one that strips blanks or must be a whole
    word is not cut at all.
    """
    import regex
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    added = sorted(whole.get_added_tokens_decoder().values(), key=lambda t: -len(t.content))
    strings = [re.escape(t.content) for t in added if t.content]
    cut_at = re.compile("(" + "|".join(strings) + ")") if strings else None
    simple = not any(t.lstrip or t.rstrip or t.single_word for t in added)
    model = whole.model
    model._resize_cache(0)  # each piece comes once
    letters, find = _byte_letters(), regex.compile(PIECES).findall

    def of_pieces(pieces: pa.Array):
        tokenize, ids, lengths = model.tokenize, [], np.zeros(len(pieces), np.int64)
        for i, p in enumerate(pieces.to_pylist()):
            if p.isascii() and p.isprintable():
                got = tokenize(p.replace(" ", "\u0120"))
            else:
                got = tokenize(p.encode().decode("latin-1").translate(letters))
            lengths[i] = len(got)
            ids += [t.id for t in got]
        return np.array(ids, np.uint32), lengths

    pieces = WordTable(of_pieces)

    beyond = "|".join(["[^\\x00-\\x{24f}]", *strings])

    def split_odd(text: str) -> list[str]:
        if not cut_at or not cut_at.search(text):
            return _SAFE_CUT.split(text)
        if not simple:
            return [text]
        return [u for i, x in enumerate(cut_at.split(text)) if x for u in ([x] if i % 2 else _SAFE_CUT.split(x))]

    def encode(units: pa.Array):
        hard = pc.match_substring_regex(units, beyond).to_numpy(zero_copy_only=False)
        cut = list(map(find, units.filter(pa.array(~hard)).to_pylist()))
        words = pa.array([p for x in cut for p in x], pa.large_string()).dictionary_encode()
        rows = pieces.rows(words.dictionary)[words.indices.to_numpy(zero_copy_only=False)]
        bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)))])
        flat, n = _gather(pieces, rows, bounds)
        if not hard.any():
            return flat, n
        got = [e.ids for e in whole.encode_batch_fast(units.filter(pa.array(hard)).to_pylist(), add_special_tokens=False)]
        lengths = np.zeros(len(units), np.int64)
        lengths[~hard] = n
        lengths[hard] = [len(x) for x in got]
        out, begin = np.empty(int(lengths.sum()), np.uint32), np.cumsum(lengths) - lengths
        out[ragged(begin[~hard], n)] = flat
        out[ragged(begin[hard], lengths[hard])] = np.array([i for x in got for i in x], np.uint32)
        return out, lengths

    odd = "|".join([f"[ {_OTHER_BLANKS}] |[ {_OTHER_BLANKS}]\\n|\\n\\z", *strings])
    return TextEncoder(encode, odd, split_odd, first=True, lines=True)
