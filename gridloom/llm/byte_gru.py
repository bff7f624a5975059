"""Language identification: a bidirectional gated recurrent network over bytes, trained in numpy.

The network reads the bytes of a running text, forwards and backwards, and
labels every position with probabilities of the languages; a document's
probabilities are the means over its positions. States go on from a text's first
byte to its last. So that many positions advance together, texts are cut into
segments, which are read at once and then again from the state in which the
segment before ended, for as long as that makes a difference: what comes out is
what one pass over the whole text gives, up to rounding.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .shared import byte_texts, runs, spread, tidy, whole_rows

#: Size of the network; bytes of a segment, bytes after which its state is compared, and the difference that rounding makes; segments that advance together, and numbers kept for positions, at most.
HIDDEN, SEGMENT, CHECK, NEAR, LANES, NUMBERS = 16, 2048, 64, 4e-6, 4096, 16 << 20
#: Bounds of the training: documents of a language, and bytes of those of them that are learned, all whole; bytes over which gradients go back; passes at least and at most, and the stretches that they are to come to; stretches in a step.
TRAIN_ROWS, TRAIN_BYTES, STRETCH, PASSES, STEPS, BATCH, RATE = 400, 300_000, 80, (2, 10), 30_000, 96, 0.02
SLICE_BYTES = 4 << 20
UNKNOWN = "und"


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Direction:
    """Weights of one direction: gates z, r, n. Inputs are bytes, so their products are rows of a table."""

    def __init__(self, rng: np.random.Generator, hidden: int):
        self.table = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
        self.own = (rng.normal(0, 1, (hidden, 3 * hidden)) / np.sqrt(hidden)).astype(np.float32)
        self.bias = np.zeros(hidden, np.float32)  # of the recurrent part of n

    def parameters(self):
        return [self.table, self.own, self.bias]

    def reader(self, h: np.ndarray):
        """``read(bytes, k)``: puts one more byte of each of the first ``k`` lanes into their states ``h``; buffers are kept between calls."""
        size, half = len(self.bias), np.float32(0.5)
        gate_table, table = np.ascontiguousarray(half * self.table[:, : 2 * size]), np.ascontiguousarray(self.table[:, 2 * size :])
        gate_own, own = np.ascontiguousarray(half * self.own[:, : 2 * size]), np.ascontiguousarray(self.own[:, 2 * size :])
        g, x, n, u = (np.empty((len(h), w), np.float32) for w in (2 * size, 2 * size, size, size))

        def read(byte: np.ndarray, k: int) -> np.ndarray:
            now, gates, more, new, inner = h[:k], g[:k], x[:k], n[:k], u[:k]
            np.take(gate_table, byte, axis=0, out=gates, mode="clip")
            gates += np.matmul(now, gate_own, out=more)
            np.tanh(gates, out=gates)  # a gate is half of this and a half
            gates += 1
            gates *= half
            np.matmul(now, own, out=inner)
            inner += self.bias
            inner *= gates[:, size:]
            np.take(table, byte, axis=0, out=new, mode="clip")
            new += inner
            np.tanh(new, out=new)
            now -= new
            now *= gates[:, :size]
            now += new
            return now

        return read

    def run(self, data: np.ndarray, keep: bool = False):
        """States (time, words, hidden) over ``data`` (words, time); with ``keep`` also what backpropagation needs."""
        h_size = len(self.bias)
        h = np.zeros((len(data), h_size), np.float32)
        states, held = np.empty((data.shape[1], len(data), h_size), np.float32), []
        for t in range(data.shape[1]):
            x = self.table[data[:, t]]
            u = h @ self.own
            gates = _sigmoid(x[:, : 2 * h_size] + u[:, : 2 * h_size])
            z, r = gates[:, :h_size], gates[:, h_size:]
            inner = u[:, 2 * h_size :] + self.bias
            n = np.tanh(x[:, 2 * h_size :] + r * inner)
            if keep:
                held.append((h, z, r, n, inner))
            h = n + z * (h - n)
            states[t] = h
        return (states, held) if keep else states

    def back(self, data: np.ndarray, held: list, pull: np.ndarray) -> list[np.ndarray]:
        """Gradients, through time, of the loss whose gradient by state is ``pull`` (time, words, hidden)."""
        h_size = len(self.bias)
        d_table, d_own, d_bias = np.zeros_like(self.table), np.zeros_like(self.own), np.zeros_like(self.bias)
        d_h, d_x = np.zeros(pull.shape[1:], np.float32), np.empty((data.shape[1], len(data), 3 * h_size), np.float32)
        for t in range(data.shape[1] - 1, -1, -1):
            h, z, r, n, inner = held[t]
            d_h = d_h + pull[t]
            d_n = d_h * (1 - z) * (1 - n * n)
            d_z = d_h * (h - n) * z * (1 - z)
            d_inner = d_n * r
            d_r = d_n * inner * r * (1 - r)
            d_u = np.concatenate([d_z, d_r, d_inner], 1)
            d_x[t] = np.concatenate([d_z, d_r, d_n], 1)
            d_own += h.T @ d_u
            d_bias += d_inner.sum(0)
            d_h = d_h * z + d_u @ self.own.T
        byte = data.T.ravel()
        order = np.argsort(byte, kind="stable")
        first = np.flatnonzero(np.diff(byte[order], prepend=-1))
        d_table[byte[order][first]] = np.add.reduceat(d_x.reshape(len(byte), -1)[order], first)
        return [d_table, d_own, d_bias]


class ByteGRU:
    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.there, self.back = Direction(rng, hidden), Direction(rng, hidden)
        self.out = rng.normal(0, 0.3, (2 * hidden, len(languages))).astype(np.float32)
        self.base = np.zeros(len(languages), np.float32)

    def parameters(self):
        return [*self.there.parameters(), *self.back.parameters(), self.out, self.base]

    def positions(self, data: np.ndarray) -> np.ndarray:
        """Probabilities (words, time, languages) of words of equal length."""
        both = np.concatenate([self.there.run(data), self.back.run(data[:, ::-1])[::-1]], 2)
        return _softmax(both @ self.out + self.base).transpose(1, 0, 2)

    def step(self, data: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
        """Gradients of the cross-entropy summed over all positions."""
        a, held_a = self.there.run(data, keep=True)
        mirrored = np.ascontiguousarray(data[:, ::-1])
        b, held_b = self.back.run(mirrored, keep=True)
        both = np.concatenate([a, b[::-1]], 2)
        miss = _softmax(both @ self.out + self.base)
        miss[:, np.arange(len(label)), label] -= 1
        d_out = both.reshape(-1, both.shape[2]).T @ miss.reshape(-1, miss.shape[2])
        pull = miss @ self.out.T
        half = len(self.there.bias)
        return [*self.there.back(data, held_a, pull[:, :, :half]), *self.back.back(mirrored, held_b, pull[::-1, :, half:]), d_out, miss.sum((0, 1))]

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, languages=np.array(self.languages), **{f"p{i}": p for i, p in enumerate(self.parameters())})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> ByteGRU:
        got = np.load(io.BytesIO(data))
        net = cls(got["languages"].tolist())
        for i, p in enumerate(net.parameters()):
            p[...] = got[f"p{i}"]
        return net

    def texts(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities over the positions of each text; a row of zeros where there is no position."""
        total = np.zeros((len(texts), len(self.languages)))
        most = max(SEGMENT, NUMBERS // len(self.languages) // SEGMENT * SEGMENT)
        place = {i: len(t) for i, t in enumerate(texts) if t}
        group: list[int] = []
        held = 0
        for i, size in sorted(place.items(), key=lambda x: x[1]):
            if held + size > most and group:
                total[group] = self._group([texts[j] for j in group])
                group, held = [], 0
            if size > most:
                total[i] = self._long(texts[i], most)
            else:
                group.append(i)
                held += size
        if group:
            total[group] = self._group([texts[j] for j in group])
        return total / np.maximum([len(t) for t in texts], 1)[:, None] if texts else total

    def _group(self, texts: list[bytes]) -> np.ndarray:
        """Sums of the probabilities of each text's positions, of texts with some."""
        size = np.array([len(t) for t in texts], np.int64)
        odds = self._odds(np.frombuffer(b"".join(texts), np.uint8), size)[0]
        return np.add.reduceat(self._pooled(odds), np.cumsum(size) - size, dtype=np.float64)

    def _long(self, text: bytes, most: int) -> np.ndarray:
        """The same of one text of any length: forward states at the ends of its parts first, then the parts from the last to the first."""
        begins = list(range(0, len(text), most))
        there = [np.zeros(len(self.there.bias), np.float32)]
        for a in begins[:-1]:
            there.append(self._odds(np.frombuffer(text[a : a + most], np.uint8), np.array([most]), there[-1], None, 1)[1])
        total, back = np.zeros(len(self.languages)), None
        for a, state in zip(begins[::-1], there[::-1], strict=True):
            part = np.frombuffer(text[a : a + most], np.uint8)
            odds, _, back = self._odds(part, np.array([len(part)]), state, back)
            total += self._pooled(odds).sum(0, dtype=np.float64)
        return total

    def _odds(self, data, size, there=None, back=None, ways: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Odds of every position, and the states at the end, forwards, and at the beginning, backwards, of the last and the first text."""
        begin = np.cumsum(size) - size
        owner, first, stop = segments(size)
        opens = first == 0
        half = len(self.there.bias)
        odds = np.repeat(self.base[None, :], len(data), 0)
        ahead = np.where(opens, -1, np.arange(len(owner)) - 1)
        ends = self._states(self.there, data, begin[owner] + first, 1, stop - first, ahead, there, self.out[:half], odds)
        if ways == 1:
            return odds, ends[-1], None
        closes = stop == size[owner]
        behind = np.where(closes, -1, np.arange(len(owner)) + 1)
        other = np.zeros_like(odds)
        starts = self._states(self.back, data, begin[owner] + stop - 1, -1, stop - first, behind, back, self.out[half:], other)
        odds += other
        return odds, ends[-1], starts[0]

    def _states(self, way: Direction, data, at, step, length, before, given, out, odds) -> np.ndarray:
        """The state in which each segment ends. ``before`` names the segment from whose end it goes on, or -1; ``odds`` of its positions are put in their places.

        All segments begin from nothing at first; those that should begin from
        another state are read again from it, until the state is the one that
        was there before at the same place. A segment of a text is right after
        as many readings as it has predecessors, at the latest.
        """
        hidden = len(way.bias)
        begin = np.zeros((len(at), hidden), np.float32)
        if given is not None:
            begin[before < 0] = given
        seen = np.full((len(at), -(-SEGMENT // CHECK), hidden), np.nan, np.float32)
        end = begin.copy()
        todo = np.arange(len(at))
        while len(todo):
            order = todo[np.argsort(-length[todo], kind="stable")]
            for a in range(0, len(order), LANES):
                lanes = order[a : a + LANES]
                h = begin[lanes]
                for c in range(seen.shape[1]):
                    low = c * CHECK
                    k = int(np.searchsorted(-length[lanes], -low, "left"))
                    end[lanes[k:]] = h[k:]
                    lanes, h = lanes[:k], np.ascontiguousarray(h[:k])
                    if not k:
                        break
                    steps = min(CHECK, int(length[lanes[0]]) - low)
                    alive = np.searchsorted(-length[lanes], -(low + np.arange(steps)), "left").tolist()
                    read, here = way.reader(h), at[lanes] + step * low
                    for t, k in enumerate(alive):
                        where = here[:k] + step * t
                        odds[where] = read(data[where], k) @ out
                    same = (np.abs(seen[lanes, c] - h) <= NEAR).all(1)
                    seen[lanes, c] = h
                    lanes, h = lanes[~same], h[~same]
                end[lanes] = h
            nexts = np.flatnonzero(before >= 0)
            wanted = end[before[nexts]]
            moved = (np.abs(begin[nexts] - wanted) > NEAR).any(1)
            todo = nexts[moved]
            begin[todo] = wanted[moved]
        return end

    def _pooled(self, odds: np.ndarray) -> np.ndarray:
        """Probabilities, in place of the odds."""
        for a in range(0, len(odds), 1 << 16):
            part = odds[a : a + (1 << 16)]
            part -= part.max(1, keepdims=True)
            np.exp(part, out=part)
            part /= part.sum(1, keepdims=True)
        return odds


def segments(size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first byte and byte after the last of each segment: texts cut into equal parts of SEGMENT bytes at most."""
    per = -(-size // SEGMENT)
    owner = np.repeat(np.arange(len(size)), per)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    return owner, size[owner] * nth // per[owner], size[owner] * (nth + 1) // per[owner]


def _softmax(x):
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(words: list[bytes], label: np.ndarray, languages: list[str], passes: int = PASSES[0], seed: int = 5) -> ByteGRU:
    """Adam over steps of words of one length, in an order fixed by ``seed``."""
    net, rng = ByteGRU(languages, seed=seed), np.random.default_rng(seed)
    size = np.array([len(w) for w in words])
    params = net.parameters()
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    count = 0
    for k in range(passes):
        order = rng.permutation(len(words))
        order = order[np.argsort(size[order], kind="stable")]
        cuts = [g[a : a + BATCH] for g in np.split(order, np.flatnonzero(np.diff(size[order])) + 1) for a in range(0, len(g), BATCH)]
        for i in rng.permutation(len(cuts)):
            rows = cuts[i]
            data = np.frombuffer(b"".join(words[j] for j in rows), np.uint8).reshape(len(rows), -1)
            count += 1
            rate = RATE / (1 + k)
            for p, g, m, v in zip(params, net.step(data, label[rows]), first, second, strict=True):
                g = g / data.size
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**count)) / (np.sqrt(v / (1 - 0.99**count)) + 1e-6)
    return net


def held_out() -> F.Column:
    """Whether a document is kept from learning by its id; a row without an id is not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def stretches(text: bytes) -> list[bytes]:
    """The whole text in stretches over which gradients go back: of equal size, STRETCH bytes at most."""
    n = -(-len(text) // STRETCH)
    return [text[len(text) * k // n : len(text) * (k + 1) // n] for k in range(n)]


def train(documents: DataFrame, rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES) -> ByteGRU | None:
    """Learn from a bounded hash sample of each language's documents that aren't held out.

    Every language counts alike: of each at most ``rows`` distinct documents
    are looked at, in the order of their hash, and those of them that fit into
    ``size`` bytes together are learned, each whole; of a language none of
    whose documents fits, the shortest of them. Only these texts travel to the
    driver. Null texts and languages are left out; without any case there's no
    model.
    """
    known = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null and doc_id is not null").where(~held_out())
    grain = 1 << 40
    ranked = known.withColumn("rank", F.pmod(F.xxhash64(F.lit(17), "doc_id", "text"), F.lit(grain)))
    distinct = ranked.groupBy("lang").agg(F.approx_count_distinct("rank").alias("n")).collect()  # a row for each language
    if not distinct:
        return None
    spark = documents.sparkSession
    keep = spark.createDataFrame([(r["lang"], int(grain * min(1.0, 1.5 * rows / max(r["n"], 1)))) for r in distinct], "lang string, keep bigint")
    near = ranked.join(F.broadcast(keep), "lang").where("rank <= keep")  # a row for each language
    nth = F.row_number().over(W.partitionBy("lang").orderBy("rank"))
    sizes = near.select("lang", "rank", F.octet_length("text").alias("size")).where("size > 0").dropDuplicates(["lang", "rank"]).withColumn("nth", nth).where(F.col("nth") <= rows).orderBy("lang", "nth").collect()  # ``rows`` numbers for each language
    chosen = []
    for name in {r["lang"] for r in sizes}:
        own = [r for r in sizes if r["lang"] == name]
        chosen += [(name, own[i]["rank"]) for i in whole_rows([r["size"] for r in own], size)]
    if not chosen:
        return None
    picked = F.broadcast(spark.createDataFrame(chosen, "lang string, rank bigint"))
    texts = ranked.join(picked, ["lang", "rank"]).dropDuplicates(["lang", "rank"]).select("lang", "text").toArrow()
    got = sorted((name, x) for name, text in zip(texts["lang"].to_pylist(), texts["text"].to_pylist(), strict=True) for x in stretches(text.encode()))
    languages = sorted({name for name, _ in got})
    place = {name: i for i, name in enumerate(languages)}
    passes = min(PASSES[1], max(PASSES[0], -(-STEPS // len(got))))
    return fit([x for _, x in got], np.array([place[name] for name, _ in got]), languages, passes=passes)


_nets: dict[bytes, ByteGRU] = {}


def identify(documents: DataFrame, net: ByteGRU | None) -> DataFrame:
    """Add ``lang_pred`` and ``score`` to ``documents``, in one pass without a shuffle.

    A null text or one without a letter is ``und`` with score 0, as is every
    text without a model. Every row stays, and repeated rows get the same;
    columns of those names are replaced; an empty table stays empty.
    """
    kept = documents.drop("lang_pred", "score")
    code = net.dump() if net else b""

    def run(batches):
        if code and code not in _nets:
            _nets.clear()
            _nets[code] = ByteGRU.load(code)
        for batch in batches:
            column = pc.fill_null(batch.column(batch.schema.names.index("text")).cast(pa.large_string()), "")
            some = pc.match_substring_regex(column, r"\pL").to_numpy(zero_copy_only=False) & bool(code)
            names, score = np.full(len(column), UNKNOWN, object), np.zeros(len(column))
            where = np.flatnonzero(some)
            for at, part in runs(byte_texts(column.filter(pa.array(some))), SLICE_BYTES):
                p = _nets[code].texts(part)
                best, rows = p.argmax(1), where[at : at + len(part)]
                names[rows] = np.array(_nets[code].languages, object)[best]
                score[rows] = np.clip(p[np.arange(len(part)), best], 0, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(score)], [*batch.schema.names, "lang_pred", "score"])

    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return kept.mapInArrow(tidy(run), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: language of all documents."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
    net = train(docs)
    return identify(docs.select("doc_id", "text"), net).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
