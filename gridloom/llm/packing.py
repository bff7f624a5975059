"""Packing by cutting-stock column generation.

A document's ids are cut into pieces of a whole sequence; what remains is cut
once more, at the last multiple of a quarter sequence, as pieces over half a
sequence would leave room that nothing fills. The histogram of the pieces'
lengths, fewer rows than a sequence has ids, is the demand of a cutting-stock problem. Its linear program is solved by
column generation: a knapsack dynamic program over the dual prices finds the
pattern to add. Patterns are rounded down, what is left of the demand is
packed best fit first, and the patterns' slots of a length go to the pieces of
that length by their rank. Only the histogram comes to the driver.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import bound_batches, settle, spread, tidy
from .token_shards import END_ID, encoder, with_end

LENGTH = 1024
#: Remainders are cut at multiples of this.
GRAIN = 256
#: Where column generation stops: distance from the bound, knapsacks at most; and columns that one knapsack may add.
#: None of them changes what is packed.
GAP, STEPS, ENTER = 5e-4, 300, 40
#: Ranks are counted in so many buckets of each length, at least, and in as many as leave so many pieces to a bucket, about.
BUCKETS, BUCKET_PIECES = 64, 100_000


def knapsack(lengths: np.ndarray, price: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: the best value of each capacity, and the length (or 0) that its pattern ends with."""
    value, last = np.zeros(size + 1), np.zeros(size + 1, np.int64)
    fits = np.searchsorted(lengths, np.arange(size + 1), "right")
    for w in range(1, size + 1):
        value[w] = value[w - 1]
        if k := fits[w]:
            got = price[:k] + value[w - lengths[:k]]
            i = int(got.argmax())
            if got[i] > value[w] + 1e-12:
                value[w], last[w] = got[i], lengths[i]
    return value, last


def _trace(last: np.ndarray, capacity: int, place: dict[int, int], first: int) -> np.ndarray:
    """The pattern of a piece of length ``first`` and the best of the rest."""
    column, w = np.zeros(len(place)), capacity - first
    column[place[first]] = 1
    while w > 0:
        n = int(last[w])
        if n:
            column[place[n]] += 1
        w -= n or 1
    return column


def _greedy(lengths: np.ndarray, need: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A first basis: each pattern, the fullest with the longest piece left, is used until a length runs out.

    Later patterns lack that length, so the columns are independent.
    """
    left, basis, x = need.copy(), np.zeros((len(need), len(need))), np.zeros(len(need))
    alive = np.arange(len(need))
    while len(alive):
        own, share = lengths[alive], left[alive] / left[alive].max()
        _, last = knapsack(own, own * (1 + 1e-4 * share), size)
        column = np.zeros(len(need))
        column[alive] = _trace(last, size, {int(n): i for i, n in enumerate(own)}, int(own[-1]))
        used = np.flatnonzero(column)
        out = int(used[(left[used] / column[used]).argmin()])
        times = left[out] / column[out]
        basis[:, out], x[out] = column, times
        left = np.maximum(left - times * column, 0)
        left[out] = 0
        alive = alive[(alive != out)]
        left[alive] = np.maximum(left[alive], 1e-9)
    return basis, x


def _times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Product without BLAS, whose threads cost more than they save at this size."""
    return (matrix * vector).sum(1)


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan elimination with row pivots, in numpy's own loops for the same reason."""
    n = len(matrix)
    work = np.concatenate([matrix, np.eye(n)], 1)
    for i in range(n):
        p = i + int(np.abs(work[i:, i]).argmax())
        work[[i, p]] = work[[p, i]]
        work[i] /= work[i, i]
        factor = work[:, i].copy()
        factor[i] = 0
        work -= factor[:, None] * work[i]
    return work[:, n:]


def solve(demand: dict[int, int], size: int = LENGTH) -> list[tuple[np.ndarray, float]]:
    """Patterns (count by length) and how often the linear program uses each.

    A knapsack's table prices a pattern for every first piece; the better ones
    enter the basis one after the other while they still lower the cost. Prices
    are blended with those of a perfect packing, which steadies them; when no
    column enters, the blend shrinks. Every price vector bounds the optimum.
    """
    lengths = np.array(sorted(demand))
    need = np.array([demand[n] for n in lengths], float)
    place = {int(n): i for i, n in enumerate(lengths)}
    basis, x = _greedy(lengths, need, size)
    inverse = _inverse(basis)
    x = np.maximum(_times(inverse, need), 0)
    pivots, blend, bound = 0, 0.9, need @ lengths / size
    for _ in range(STEPS):
        dual = np.maximum(inverse.sum(0), 0)
        price = blend * lengths / size + (1 - blend) * dual
        value, last = knapsack(lengths, price, size)
        worth = price + value[size - lengths]
        bound = max(bound, need @ price / max(float(worth.max()), 1))
        if x.sum() - bound <= GAP * x.sum():
            break
        before = pivots
        for i in np.argsort(-worth, kind="stable")[:ENTER].tolist():
            column = _trace(last, size, place, int(lengths[i]))
            if inverse.sum(0) @ column <= 1 + 1e-9:
                continue
            move = _times(inverse, column)
            up = move > 1e-9
            if not up.any():
                continue
            ratio = np.full(len(x), np.inf)
            ratio[up] = x[up] / move[up]
            out = int(ratio.argmin())
            basis[:, out] = column
            pivots += 1
            if pivots % 200 == 0:
                inverse = _inverse(basis)
                x = np.maximum(_times(inverse, need), 0)
                continue
            amount = ratio[out]
            x = np.maximum(x - amount * move, 0)
            x[out] = amount
            row = inverse[out] / move[out]
            inverse -= np.outer(move, row)
            inverse[out] = row
        if pivots == before:
            if blend < 1e-3:
                break
            blend = blend / 2 if blend > 0.01 else 0.0
    found = []
    for j in range(len(x)):
        counts = np.zeros(size, np.int64)
        counts[lengths] = np.round(basis[:, j]).astype(np.int64)
        found.append((counts, float(x[j])))
    return found


def best_fit(left: Counter, size: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """Sequences for what is left, longest piece first, each filled by the subset that leaves least room."""
    left, out = Counter({k: v for k, v in left.items() if v > 0}), []
    while left:
        # fullest pattern under the remaining counts: bounded subset sums that remember their last piece
        first = max(left)
        reach: dict[int, tuple[int, int]] = {first: (0, 0)}
        for n in sorted(left, reverse=True):
            for _ in range(min(left[n] - (n == first), (size - first) // n, 3)):
                fresh = {s + n: (s, n) for s in reach if s + n <= size and s + n not in reach}
                if not fresh:
                    break
                reach |= fresh
            if size in reach:
                break
        at, pattern = max(reach), [first]
        while at != first:
            at, n = reach[at]
            pattern.append(n)
        counts = Counter(pattern)
        times = min(left[n] // c for n, c in counts.items())
        if times < 1:  # a chain of sums used a length once too often
            pattern, times = [first], 1
            counts = Counter(pattern)
        out.append((tuple(sorted(pattern, reverse=True)), times))
        left = Counter({n: left[n] - times * counts.get(n, 0) for n in left if left[n] > times * counts.get(n, 0)})
    return out


def patterns(demand: dict[int, int], size: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """Lengths of the pieces of a sequence, and how many sequences are like it; they use up the demand exactly."""
    demand = {n: c for n, c in demand.items() if c > 0}
    if not demand:
        return []
    out: list[tuple[tuple[int, ...], int]] = []
    whole = demand.pop(size, 0)
    if whole:
        out.append(((size,), whole))
    left = Counter(demand)
    if demand:
        for counts, x in sorted(solve(demand, size), key=lambda p: -p[1]):
            used = np.flatnonzero(counts)
            times = min([int(x + 1e-6), *(left[n] // int(counts[n]) for n in used.tolist())]) if len(used) else 0
            if times > 0:
                pattern = tuple(n for n in sorted(used.tolist(), reverse=True) for _ in range(int(counts[n])))
                out.append((pattern, times))
                for n in used.tolist():
                    left[n] -= times * int(counts[n])
    return out + best_fit(left, size)


def slots(found: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """By length, runs of ranks: first rank, first sequence, pieces a sequence, offset of the first."""
    taken: Counter = Counter()
    rows: dict[int, list] = {}
    sequence = 0
    for pattern, times in found:
        offset = 0
        for n, c in sorted(Counter(pattern).items(), reverse=True):
            rows.setdefault(n, []).append((taken[n], sequence, c, offset))
            taken[n] += times * c
            offset += n * c
        sequence += times
    return {n: np.array(r, np.int64) for n, r in rows.items()}


def cut_documents(documents: DataFrame, vocabulary: str, size: int = LENGTH, end_id: int = END_ID, keep_ids: bool = False, grain: int = GRAIN) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens[, ids])``: the pieces of every whole text and its end id.

    A null text is empty: its end id alone is a piece. Each row is cut, rows
    of one id too; other columns aren't read.
    """

    def run(batches):
        code = encoder(vocabulary)
        for batch in batches:
            doc_ids, at = batch.column(0), 0
            for part in code.slices(batch.column(1)):
                flat, bounds = with_end(*code.encode_slice(part), end_id)
                flat = flat.astype("<u4")
                n = np.diff(bounds)
                rest = n % size
                extra = (rest // grain > 0) & (rest % grain > 0)
                per = -(-n // size) + extra
                owner = np.repeat(np.arange(len(n)), per)
                nth = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
                tail = extra[owner] & (nth == per[owner] - 1)
                start = np.where(tail, n[owner] - rest[owner] % grain, nth * size)
                length = np.minimum(n[owner] - start, size)
                length[tail[1:].nonzero()[0]] -= (rest % grain)[extra]
                begin = bounds[owner] + start
                data = memoryview(flat.tobytes())
                crc = np.fromiter((zlib.crc32(data[4 * b : 4 * (b + k)]) for b, k in zip(begin.tolist(), length.tolist(), strict=True)), np.int64, len(begin))
                columns = [doc_ids.slice(at, len(n)).take(pa.array(owner)), pa.array(start), pa.array(length), pa.array(crc), pa.array(n[owner])]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([begin, bounds[-1:]]), pa.int32()), pa.array(flat.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(columns)])
                at += len(n)

    bound_batches(documents.sparkSession)
    kind = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids array<int>" * keep_ids
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), kind)


def pack(pieces: DataFrame, size: int = LENGTH) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces that have a ``length`` from 1 to ``size``.

    Pieces of one length are alike, so their ranks are counted by length and
    hash bucket: a length that a third of all pieces share is spread over all
    buckets. The patterns, fewer than two for each length and what best fit
    adds, travel to the tasks. Pieces that agree in document, place and digest
    have some order among themselves and a place each. An empty table stays
    empty.
    """
    spark = pieces.sparkSession
    pieces = settle(pieces, "pieces")
    demand = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # `size` rows at most
    where = slots(patterns(demand, size))
    buckets = max(BUCKETS, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-max(demand.values(), default=0) // BUCKET_PIECES))
    keyed = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)).cast("int"))
    base = keyed.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    base = base.withColumn("_base", F.sum("_n").over(W.partitionBy("length").orderBy("_bucket")) - F.col("_n")).drop("_n")
    ranked = keyed.withColumn("_rank", F.row_number().over(W.partitionBy("length", "_bucket").orderBy("doc_id", "start", "ids_crc32")) - 1)
    ranked = ranked.join(base, ["length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_base")).select(*pieces.columns, "_rank")

    names = pieces.columns

    def place(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(rows):
                    n = int(length[rows[0]])
                    table = where[n]
                    run = table[np.searchsorted(table[:, 0], rank[rows], "right") - 1]
                    k = rank[rows] - run[:, 0]
                    sequence[rows], offset[rows] = run[:, 1] + k // run[:, 2], run[:, 3] + k % run[:, 2] * n
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    from pyspark.sql import types as T

    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(place, schema)


def pack_documents(documents: DataFrame, vocabulary: str, size: int = LENGTH, keep_ids: bool = False) -> DataFrame:
    """Cut and pack whole documents; with ``keep_ids`` each piece has its ids too."""
    return pack(cut_documents(documents, vocabulary, size, keep_ids=keep_ids), size)


def padding(packed: DataFrame, size: int = LENGTH) -> DataFrame:
    """``(sequences, tokens, padding)``: a sequence is padded to ``size`` unless its length is a power of two."""
    used = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    pad = F.when(F.bit_count("n") == 1, 0).otherwise(size - F.col("n"))
    return used.agg(F.count("*").alias("sequences"), F.sum("n").alias("tokens"), F.sum(pad).alias("padding"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: all documents packed."""
    import public_tokenizers

    return pack_documents(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), public_tokenizers.path("byte_bpe_50k.json"))
