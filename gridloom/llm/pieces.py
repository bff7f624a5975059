"""SentencePiece BPE by vectorised merge rounds over the distinct words of a batch.

All symbols of all words lie in flat numpy arrays. A round looks up the rank
of every neighbouring pair, takes each word's smallest by a segmented minimum,
merges its leftmost occurrences in all words at once and closes the gaps;
words without a pair leave. A word's occurrences merge from the left as far as
the first whose merge makes a pair that would come next, so the result is that
of merging one pair at a time.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import spread, tidy
from .words import TextEncoder

#: Fixed value: the character that stands for a space in pieces.
SPACE = "▁"
_SHIFT = 21
_NONE = np.int64(1 << 40)


class PairTable:
    """Rank and result of a pair of symbols: open addressing in numpy arrays."""

    def __init__(self, keys: list[int], ranks: list[int], made: list[int]):
        self.bits = max(4, (4 * len(keys) + 1).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.rank = np.full(size, _NONE, np.int64)
        self.made = np.zeros(size, np.int64)
        self.probes = 1
        for key, rank, new, slot in zip(keys, ranks, made, self.slots(np.array(keys, np.int64)).tolist(), strict=True):
            step = 0
            while self.keys[(slot + step) % size] not in (-1, key):
                step += 1
            at = (slot + step) % size
            self.keys[at], self.rank[at], self.made[at] = key, rank, new
            self.probes = max(self.probes, step + 1)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; a slot of rank _NONE where there's none."""
        at, size = self.slots(keys), len(self.keys)
        seen = self.keys[at]
        open_ = np.flatnonzero((seen != keys) & (seen != -1))
        for _ in range(1, self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) % size
            seen = self.keys[at[open_]]
            open_ = open_[(seen != keys[open_]) & (seen != -1)]
        return at


class PieceModel:
    """What the model file says, as arrays. Other kinds of models are refused."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        plain = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or plain.precompiled_charsmap or plain.remove_extra_whitespaces or not plain.add_dummy_prefix or not plain.escape_whitespaces:
            raise ValueError("only BPE models without normalisation, with a dummy prefix, are read")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        kinds = [p.type for p in model.pieces]
        self.size = len(kinds)
        own = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (1, 4)}  # normal, user-defined
        if any(k == 4 for k in kinds) or any(SPACE in p[1:] and p.strip(SPACE) for p in own):
            raise ValueError("only models whose pieces don't go across words are read")
        scores = np.array([p.score for p in model.pieces])
        _, rank = np.unique(-scores, return_inverse=True)
        self.symbol = np.arange(0x110000, dtype=np.int64) + self.size
        for p, i in own.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        of = lambda s: own.get(s, self.size + ord(s) if len(s) == 1 else None)
        keys, ranks, made = [], [], []
        for p, i in own.items():
            for k in range(1, len(p)):
                a, b = of(p[:k]), of(p[k:])
                if a is not None and b is not None:
                    keys.append(a << _SHIFT | b)
                    ranks.append(int(rank[i]))
                    made.append(i)
        self.pairs = PairTable(keys, ranks, made)
        self.byte = np.array([next(i for i, p in enumerate(model.pieces) if p.type == 6 and p.piece == f"<0x{b:02X}>") for b in range(256)])

    def _rank(self, a: np.ndarray, b: np.ndarray, some: np.ndarray) -> np.ndarray:
        """Rank of each pair, _NONE where ``some`` is false or it makes no piece."""
        key = np.where(some, a << _SHIFT | b, -2)
        slot = self.pairs.find(key)
        return np.where(self.pairs.keys[slot] == key, self.pairs.rank[slot], _NONE)

    def encode(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and lengths of units in which spaces are already SPACE."""
        n = len(units)
        text = "".join(units.to_pylist())
        sym = self.symbol[np.frombuffer(text.encode("utf-32-le"), "<u4")]
        sizes = pc.utf8_length(units).to_numpy(zero_copy_only=False).astype(np.int64)
        word = np.repeat(np.arange(n), sizes)
        done_sym, done_word = [], []
        while len(sym):
            key = np.empty(len(sym), np.int64)
            key[:-1] = sym[:-1] << _SHIFT | sym[1:]
            inside = np.empty(len(sym), bool)
            inside[:-1] = word[:-1] == word[1:]
            key[-1], inside[-1] = -1, False
            slot = self.pairs.find(key)
            rank = np.where(inside & (self.pairs.keys[slot] == key), self.pairs.rank[slot], _NONE)
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            counts = np.diff(np.concatenate([starts, [len(sym)]]))
            best = np.repeat(np.minimum.reduceat(rank, starts), counts)
            finished = best == _NONE
            at = np.flatnonzero((rank == best) & ~finished)
            if len(at):
                # of overlapping occurrences every other one, from the left
                run = np.concatenate([[True], np.diff(at) != 1])
                nth = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
                at = at[nth % 2 == 0]
                new, own = self.pairs.made[slot[at]], word[at]
                # none after one whose merge makes a pair that comes before the others
                before = np.where(np.concatenate([[False], at[1:] == at[:-1] + 2]), np.concatenate([[0], new[:-1]]), sym[at - 1])
                after = np.minimum(at + 2, len(sym) - 1)
                left = self._rank(before, new, (at > 0) & (word[at - 1] == own))
                right = self._rank(new, sym[after], (at + 2 < len(sym)) & (word[after] == own))
                ahead = np.cumsum(np.minimum(left, right) <= best[at])
                first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                start = np.repeat(np.concatenate([[0], ahead])[first], np.diff(np.concatenate([first, [len(at)]])))
                take = np.concatenate([[0], ahead[:-1]]) <= start
                at, new = at[take], new[take]
                sym = sym.copy()
                sym[at] = new
            keep = ~finished
            keep[at + 1] = False
            done_sym.append(sym[finished])
            done_word.append(word[finished])
            sym, word = sym[keep], word[keep]
        sym, word = np.concatenate([*done_sym, sym]), np.concatenate([*done_word, word])
        order = np.argsort(word, kind="stable")
        sym, word = sym[order], word[order]
        if (strange := np.flatnonzero(sym >= self.size)).size:
            parts = [self.byte[list(chr(c).encode())] for c in (sym[strange] - self.size).tolist()]
            width = np.ones(len(sym), np.int64)
            width[strange] = [len(p) for p in parts]
            begin = np.cumsum(width) - width
            wide = np.empty(int(width.sum()), np.int64)
            plain = np.ones(len(sym), bool)
            plain[strange] = False
            wide[begin[plain]] = sym[plain]
            for s, p in zip(begin[strange].tolist(), parts, strict=True):
                wide[s : s + len(p)] = p
            sym, word = wide, np.repeat(word, width)
        return sym.astype(np.uint32), np.bincount(word, minlength=n).astype(np.int64)


_UNITS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
_models: dict = {}


def text_encoder(path: str) -> tuple[PieceModel, TextEncoder]:
    """One model and encoder per worker and model file."""
    if path not in _models:
        model = PieceModel(path)
        # pieces never go on past the start of a run of spaces, so a word with its space stands alone
        _models[path] = model, TextEncoder(model.encode, f"  |\\A {'|' + SPACE}", lambda t: _UNITS(SPACE + t.replace(" ", SPACE)) if t else [], mark=SPACE)
    return _models[path]


def encode_pieces(documents: DataFrame, model_path: str) -> DataFrame:
    """``(doc_id, ids, decoded)`` of every whole text, as the library encodes and decodes it.

    A null text is empty; an empty one has no ids and decodes to "". Each row
    gives a row, repeated ones too; other columns aren't read. Very long words
    take more rounds, not another result.
    """

    def run(batches):
        for batch in batches:
            model, code = text_encoder(model_path)
            at = 0
            for part in code.slices(batch.column(1)):
                flat, counts = code.encode_slice(part)
                bounds = np.concatenate([[0], np.cumsum(counts)])
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), lists, pa.array(_decode(model, flat, bounds), pa.string())], ["doc_id", "ids", "decoded"])
                at += len(part)

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "doc_id bigint, ids array<int>, decoded string")


def _decode(model: PieceModel, flat: np.ndarray, bounds: np.ndarray) -> list[str]:
    ids = flat.tolist()
    return [model.library.decode(ids[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


class DigitTable:
    """Decimal ids with a comma after each, as fixed-width rows of bytes."""

    def __init__(self, size: int):
        texts = [f"{i},".encode() for i in range(size)]
        self.width = max(map(len, texts))
        self.rows = np.array([list(t.ljust(self.width, b"\0")) for t in texts], np.uint8)
        self.lengths = np.array([len(t) for t in texts], np.int64)

    def join(self, flat: np.ndarray, bounds: np.ndarray):
        """The text of each run of ids, without the last comma."""
        for a in range(0, len(bounds) - 1, 256):
            cut = bounds[a : a + 257]
            ids = flat[cut[0] : cut[-1]]
            rows = self.rows[ids].ravel()
            data = memoryview(rows[rows > 0])
            ends = np.concatenate([[0], np.cumsum(self.lengths[ids])])[cut - cut[0]].tolist()
            for s, e in zip(ends[:-1], ends[1:], strict=True):
                yield data[s : max(s, e - 1)]


def digest_pieces(documents: DataFrame, model_path: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: what encode_pieces gives, digested where it is made."""

    def run(batches):
        digits = None
        for batch in batches:
            model, code = text_encoder(model_path)
            digits = digits or DigitTable(model.size)
            at = 0
            for part in code.slices(batch.column(1)):
                flat, counts = code.encode_slice(part)
                bounds = np.concatenate([[0], np.cumsum(counts)])
                ids = [hashlib.sha256(x).hexdigest() for x in digits.join(flat, bounds)]
                texts = [hashlib.sha256(x.encode()).hexdigest() for x in _decode(model, flat, bounds)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(counts), pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                at += len(part)

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: ids and decoded text of all documents, digested."""
    import public_tokenizers

    return digest_pieces(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), public_tokenizers.path("piece_bpe_32k.model"))
