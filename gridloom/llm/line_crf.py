"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Each line is described by the bins of a few byte statistics, its own and those
of the lines before and after it. The field labels every line good or bad;
forward-backward gives each line's marginal, and the marginals, weighted by
the lines' lengths, are the document's quality. Training lines take the label
of their document.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bound_batches, place_weights, sample_rows, text_runs, tidy, whole_rows
from .shared import spread as deal

#: Bounds of the training sample: rows of labelled documents, and lines of all of them, which are learned whole.
TRAIN_ROWS, TRAIN_LINES = 2500, 100_000
#: Lines of a chain that forward-backward goes through one by one; longer chains are cut into such pieces.
PIECE = 512
ROUNDS, RATE, L2 = 150, 0.15, 1e-3
KEEP = 0.7
SLICE_BYTES = 1 << 20

#: Classes of bytes: 0 other, 1 blank, 2 lower, 3 upper, 4 digit, 5 stop or comma, 6 shout, 7 pipe, 8 symbol, 9 beyond ASCII.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[9, 11, 12, 13, 32]] = 1
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 2, 3, 4, 9
_CLASS[list(b".,;:'\"-()")] = 5
_CLASS[list(b"!?")] = 6
_CLASS[list(b"|")] = 7
_CLASS[list(b"#*$%&<>@^~_=+{}[]\\/`")] = 8
_KINDS = 10

#: Upper bounds of the bins of each feature; a value over the last has a bin of its own.
_BINS = [
    [0, 20, 60, 160, 400],  # bytes
    [0, 2, 6, 14, 40],  # words
    [0.02, 0.1, 0.3, 0.6],  # upper among ASCII letters
    [0.0, 0.01, 0.04, 0.1, 0.2],  # symbols by byte
    [0.0, 0.02, 0.08],  # pipes by byte
    [0.0, 0.01, 0.05, 0.15],  # shouts by byte
    [0.0, 0.03, 0.15],  # digits by byte
    [0.0, 0.01, 0.03, 0.08],  # stops by byte
    [2.0, 4.0, 6.0, 9.0, 14.0],  # bytes by word
    [0.5],  # the line came before in the document
    [0.0, 0.02, 0.1, 0.4],  # words equal to the word before them, by word
]
_WIDTH = max(len(b) for b in _BINS) + 1
_FEATURES = len(_BINS)
#: Own bins, those of the line before and after (a bin more for "none"), and a constant.
SIZE = 3 * _FEATURES * (_WIDTH + 1) + 1


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Active features of each line (n, 3F + 1), lines of each text, and lengths of the lines in bytes."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = ends - starts
    n = len(ends)
    per = np.array([t.count(b"\n") + 1 for t in texts], np.int64)
    line = np.repeat(np.arange(n), size + 1)
    kinds = np.bincount(line * _KINDS + _CLASS[data], minlength=n * _KINDS).reshape(n, _KINDS).astype(np.float64)
    kinds[:, 0] -= 1  # the line's end
    print_ = np.add.reduceat(place_weights(np.arange(len(data)) - starts[line]) * (data.astype(np.uint64) + np.uint64(1)), starts)
    doc = np.repeat(np.arange(len(texts)), per)
    order = np.lexsort((np.arange(n), print_, doc))
    again = np.zeros(n, bool)
    again[order[1:]] = (print_[order[1:]] == print_[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]]) & (size[order[1:]] > 0)
    blank = (_CLASS[data] == 1) | (data == 10)
    first = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    echo = np.zeros(n)
    if len(first):
        mark = np.zeros(len(data), np.int64)
        mark[first] = first
        inside = np.arange(len(data)) - np.maximum.accumulate(mark)
        word = np.add.reduceat(np.where(blank, np.uint64(0), place_weights(inside) * (data.astype(np.uint64) + np.uint64(1))), first)
        echo = np.bincount(line[first[1:]], (word[1:] == word[:-1]) & (line[first[1:]] == line[first[:-1]]), n)
    words = kinds[:, 1] + (size > 0)
    by = lambda a, b: a / np.maximum(b, 1)
    values = [size, words, by(kinds[:, 3], kinds[:, 2] + kinds[:, 3]), by(kinds[:, 8], size), by(kinds[:, 7], size), by(kinds[:, 6], size), by(kinds[:, 4], size), by(kinds[:, 5], size), by(size, words), again, by(echo, words)]
    own = np.stack([np.searchsorted(b, v) for b, v in zip(_BINS, values, strict=True)], 1).astype(np.int32)
    begin = np.cumsum(per) - per
    before, after = np.vstack([own[:1], own[:-1]]), np.vstack([own[1:], own[-1:]])
    before[begin] = _WIDTH
    after[begin + per - 1] = _WIDTH
    offset = np.arange(_FEATURES, dtype=np.int32) * (_WIDTH + 1)
    third = _FEATURES * (_WIDTH + 1)
    active = np.concatenate([own + offset, before + offset + third, after + offset + 2 * third, np.full((n, 1), SIZE - 1, np.int32)], 1)
    return active, per, size


def marginals(odds: np.ndarray, per: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over ragged chains: P(good) of each line, expected pairs of labels, log partition less that of free lines.

    ``odds`` are the log-odds of good by line, ``pair`` the (2, 2) log weights
    of neighbouring labels (bad, good). All chains advance together. A chain
    of more than PIECE lines is cut into pieces: products of 2 x 2 matrices
    carry the messages from piece to piece, then all pieces advance together.
    """
    good = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    psi = np.stack([1 - good, good], 1)
    m = np.exp(pair)
    count = -(-per // PIECE)
    owner = np.repeat(np.arange(len(per)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    begin = (np.cumsum(per) - per)[owner] + nth * PIECE
    length = np.minimum(per[owner] - nth * PIECE, PIECE)
    before, after = _between(psi, m, begin, length, nth, count[owner]) if (count > 1).any() else (np.ones((len(nth), 2)), np.ones((len(nth), 2)))
    order = np.argsort(-length, kind="stable")
    begin, length, inner = begin[order], length[order], nth[order] > 0
    before, back = before[order], after[order]
    steps = int(length[0]) if len(length) else 0
    alive = np.searchsorted(-length, -np.arange(steps), "left")  # pieces longer than t
    forward = np.empty_like(psi)
    log_z = 0.0
    for t in range(steps):
        at = begin[: alive[t]] + t
        f = np.where(inner[:, None], (before @ m) * psi[at], psi[at]) if t == 0 else (forward[at - 1] @ m) * psi[at]
        total = f.sum(1, keepdims=True)
        log_z += float(np.log(total).sum())
        forward[at] = f / total
    out = np.empty(len(odds))
    pairs = np.zeros((2, 2))
    for t in range(steps - 1, -1, -1):
        k = alive[t]
        at = begin[:k] + t
        post = forward[at] * back[:k]
        post /= post.sum(1, keepdims=True)
        out[at] = post[:, 1]
        pull = psi[at] * back[:k]
        left = forward[at - 1] if t else before[:k][inner]
        joint = left[:, :, None] * m[None] * (pull if t else pull[inner])[:, None, :]
        pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        if t:
            nxt = pull @ m.T
            back[:k] = nxt / nxt.sum(1, keepdims=True)
    return out, pairs, log_z


def _between(psi, m, begin, length, nth, count) -> tuple[np.ndarray, np.ndarray]:
    """Forward message into each piece from the line before it, and backward message at its last line."""
    order = np.argsort(-length, kind="stable")
    alive = np.searchsorted(-length[order], -np.arange(int(length.max())), "left")
    product = np.tile(np.eye(2), (len(nth), 1, 1))
    for t, k in enumerate(alive):
        rows = order[:k]
        step = psi[begin[rows] + t]
        whole = product[rows] @ m if t else np.where(nth[rows, None, None] > 0, m, np.eye(2))
        whole = whole * step[:, None, :]
        product[rows] = whole / whole.sum((1, 2), keepdims=True)
    before, after = np.ones((len(nth), 2)), np.ones((len(nth), 2))
    last = int(count.max())
    by_place = [np.flatnonzero((nth == k) & (count > 1)) for k in range(last)]
    for k in range(1, last):
        rows = by_place[k]
        f = np.einsum("ni,nij->nj", before[rows - 1], product[rows - 1])
        before[rows] = f / f.sum(1, keepdims=True)
    for k in range(last - 1, 0, -1):
        rows = by_place[k]
        b = np.einsum("nij,nj->ni", product[rows], after[rows])
        after[rows - 1] = b / b.sum(1, keepdims=True)
    return before, after


def fit(active: np.ndarray, per: np.ndarray, label: np.ndarray) -> dict:
    """Maximum conditional likelihood with L2, by Adam on whole batches. ``label`` is 1 or 0 by chain."""
    weights, pair = np.zeros(SIZE), np.zeros((2, 2))
    truth = np.repeat(label, per)
    lines = max(len(truth), 1)
    share = 1 / np.maximum(np.bincount(label, minlength=2), 1) * len(label) / 2  # classes count alike
    worth = np.repeat(share[label] / per, per)
    same = np.zeros((2, 2))
    for y in (0, 1):
        same[y, y] = (per[label == y] - 1).sum()
    moment, square = np.zeros(SIZE + 4), np.zeros(SIZE + 4)
    for step in range(1, ROUNDS + 1):
        p, pairs, _ = marginals(weights[active].sum(1), per, pair)
        pull = ((truth - p) * worth)[:, None].repeat(active.shape[1], 1)
        grad = np.bincount(active.ravel(), pull.ravel(), SIZE) / len(label) - L2 * weights
        grad = np.concatenate([grad, ((same - pairs) / lines - 0.05 * pair).ravel()])
        moment, square = 0.9 * moment + 0.1 * grad, 0.99 * square + 0.01 * grad * grad
        move = RATE * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        weights += move[:SIZE]
        pair += move[SIZE:].reshape(2, 2)
    model = {"weights": weights, "pair": pair, "slope": 1.0, "shift": 0.0}
    scores = _pool(active, per, np.ones(len(truth)), model)
    return model | _calibrate(scores, label)


def _pool(active, per, size, model) -> np.ndarray:
    p, _, _ = marginals(model["weights"][active].sum(1), per, model["pair"])
    begin = np.cumsum(per) - per
    heavy = np.maximum(size, 1)
    return np.add.reduceat(p * heavy, begin) / np.add.reduceat(heavy, begin)


def _calibrate(scores: np.ndarray, label: np.ndarray) -> dict:
    """A logistic curve from pooled marginal to probability; it is increasing, so ranks stay."""
    x = np.log((scores + 1e-3) / (1 - scores + 1e-3))
    a, b = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-(a * x + b)))
        w = np.maximum(p * (1 - p), 1e-6)
        g = np.array([((label - p) * x).sum() - 0.1 * (a - 1), (label - p).sum()])
        h = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        move = np.clip(np.linalg.solve(h, g), -0.5, 0.5)
        a, b = max(a + move[0], 0.05), b + move[1]
    return {"slope": float(a), "shift": float(b)}


def score_texts(texts: list[bytes], model: dict) -> np.ndarray:
    active, per, size = line_features(texts)
    s = _pool(active, per, size.astype(float), model)
    x = np.log((s + 1e-3) / (1 - s + 1e-3))
    return 1 / (1 + np.exp(-(model["slope"] * x + model["shift"])))


def held_out() -> F.Column:
    """Whether a document is kept from learning by its id; a row without an id is not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> dict:
    """Fit on a bounded hash sample of labelled documents that aren't held out.

    Labels that are null are left out; of several for one id the smallest
    counts. At most ``rows`` rows are looked at, however often an id comes, in
    the order of their hash, and those that fit into TRAIN_LINES lines
    together are learned, each whole; only lines' features travel to the
    driver. Without both labels the
    model is flat: it gives every document the share of good labels, or 1
    where there are no labels at all.
    """
    bound_batches(documents.sparkSession)
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").cast("int").alias("y")).where(~held_out())
    picked = sample_rows(known, rows, "doc_id")  # at most `rows` rows: small enough to send to all
    chosen = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")

    most = TRAIN_LINES
    lines = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    texts = sample_rows(chosen.withColumn("lines", F.coalesce(lines, F.lit(1))).where(F.col("lines") <= most), rows, "doc_id", "text")
    name = F.xxhash64("doc_id", "text", "y")
    sizes = texts.select("doc_id", "lines", "y", name.alias("name")).orderBy(F.xxhash64(F.lit(17), "name"), "lines").collect()  # ``rows`` numbers at most
    known_names = texts.sparkSession.createDataFrame([(sizes[i]["name"],) for i in whole_rows([r["lines"] for r in sizes], most)], "name bigint")

    def features(batches):
        for batch in batches:
            for at, part in text_runs(batch.column(1), SLICE_BYTES):
                active, per, _ = line_features(part)
                begin = np.cumsum(per) - per
                x = [active[b : b + int(k)].astype("<i4").tobytes() for b, k in zip(begin, per, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(x, pa.binary()), batch.column(2).slice(at, len(part))], ["doc_id", "x", "y"])

    picked_texts = texts.withColumn("name", name).join(F.broadcast(known_names.distinct()), "name", "left_semi").select("doc_id", "text", "y")
    got = picked_texts.mapInArrow(tidy(features), "doc_id bigint, x binary, y int").limit(rows).toArrow()
    label = got["y"].to_numpy().astype(np.int64)
    if len(set(label.tolist())) < 2:
        share = float(label.mean()) if len(label) else 1.0
        return {"flat": share}
    chains = [np.frombuffer(x, "<i4").reshape(-1, 3 * _FEATURES + 1) for x in got["x"].to_pylist()]
    order = sorted(range(len(chains)), key=lambda i: (chains[i].tobytes(), label[i]))  # whatever order the rows came in
    return fit(np.concatenate([chains[i] for i in order]), np.array([len(chains[i]) for i in order]), label[order])


def score_documents(documents: DataFrame, model: dict) -> DataFrame:
    """Add ``score`` and ``predicted`` to ``documents``, in one pass without a shuffle.

    Null and empty texts are scored as one empty line. Scores depend on the
    text alone, so repeated rows score alike. Every row stays; columns of
    those names are replaced; an empty table stays empty.
    """
    bound_batches(documents.sparkSession)
    kept = documents.drop("score", "predicted")
    code = json.dumps({k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in model.items()})

    def run(batches):
        m = {k: np.array(v) if isinstance(v, list) else v for k, v in json.loads(code).items()}
        for batch in batches:
            if "flat" in m:
                s = np.full(len(batch), m["flat"])
            else:
                s = np.concatenate([np.zeros(0), *(score_texts(p, m) for _, p in text_runs(batch.column(batch.schema.names.index("text")), SLICE_BYTES))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64()), pa.array((s >= KEEP).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    from pyspark.sql import types as T

    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return kept.mapInArrow(tidy(run), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: quality of all documents."""
    docs = deal(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_documents(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
