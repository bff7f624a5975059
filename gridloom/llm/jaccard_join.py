"""N-gram Jaccard join in metric space: pivots, Voronoi regions, triangle-inequality windows.

A document is its set of word shingles; ``1 - Jaccard`` is a metric. Random
documents are all at distance 1 of each other, so pivots drawn from the corpus
alone would leave almost every document equally far from all of them. The
first pivots are therefore taken where documents are near: two sets within
the threshold differ in at most D shingles, so if shingles are dealt by hash
into more than D buckets, the sets agree on a whole bucket. Documents that share
a bucket form a region around the smallest of them, its pivot. Every pair
within the threshold lies in a common region.

A region too large for a task is joined by rounds over the cluster. Each round
takes pivots from its rows, measures the distances of all rows to them in as
many tasks as the rows need, and makes Voronoi cells: a row belongs to the cell
of the nearest pivot and is copied to each other cell whose pivot is at most
twice the threshold's distance farther. Rows that links to pivots connect are the core,
of which no pair need be compared; a cell without other rows is done, a small
one is left to a task, a large one goes into the next round. What windows don't
divide, near copies all around, is compared in blocks, each row outside the core
with all others. Within a task cells split by pivots in the same way until they
are compared directly. Only spanning edges leave a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bound_batches, connected_components, forest, mix, place_weights, sample_rows, settle, spread, text_runs, tidy

#: Defaults: words in a shingle; the similarity as a fraction of whole numbers.
WORDS, OVER, UNDER = 5, 80, 100
SLICE_BYTES = 1 << 20
#: Rows of a batch that are turned into Python objects at a time.
SLICE_ROWS = 512
#: A region of more documents or shingles than these is joined over the cluster; rows of a task that measures or compares.
REGION_ROWS, REGION_ITEMS, TASK_ROWS = 512, 1_000_000, 256
#: Rounds over the cluster, at most; a cell with more than this share of its region's rows hasn't shrunk.
ROUNDS, SHRUNK = 5, 0.8
#: Sample that tells keys which more than one document in RARE has; so many of them at most; salts of each.
SAMPLE_ROWS, RARE, COMMON, SALTS = 4000, 200, 4096, 64
#: Set names that a task remembers so that copies don't give their keys again.
REMEMBERED = 500_000
#: Size of a cell that is compared directly, and pivots of a split.
CELL, PIVOTS = 64, 8

_ORDER = np.random.default_rng(29).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingles of each text, one after the other, and their bounds.

    A text of fewer words has its whole sequence as one shingle, one without
    words has none. Two shingles are taken for equal when their hashes are.
    """
    data = _LOWER[np.frombuffer(b"\n" + b"".join(t + b"\n" for t in texts), np.uint8)]
    size = np.array([len(t) + 1 for t in texts], np.int64)
    begin = 1 + np.cumsum(size) - size
    blank = _BLANK[data]
    starts = np.flatnonzero(~blank[1:] & blank[:-1]) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    mark = np.zeros(len(data), np.int64)
    mark[starts] = starts
    value = np.where(blank, np.uint64(0), place_weights(np.arange(len(data)) - np.maximum.accumulate(mark)) * (data.astype(np.uint64) + np.uint64(1)))
    word = mix(np.add.reduceat(value, starts))
    first = np.searchsorted(starts, np.concatenate([begin, [len(data)]]))
    count = np.diff(first)
    take = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    doc = np.repeat(np.arange(len(texts)), take)
    at = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(take) - take, take)
    wide = np.minimum(words, count)[doc]
    h = wide.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(words):
        rows = wide > k
        h[rows] += word[at[rows] + k] * _ORDER[k % 64]
    h = mix(h)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
    h, doc = h[keep], doc[keep]
    return h, np.searchsorted(doc, np.arange(len(texts) + 1))


def set_names(flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """A 64-bit name of each set, by which candidates are found, and the 128-bit one that stands for it; zeros for the empty set."""
    n = np.diff(bounds)
    out = np.zeros((len(n), 2), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        for k, salt in enumerate((0x5851F42D4C957F2D, 0x2545F4914F6CDD1D)):
            out[some, k] = mix(np.add.reduceat(mix(flat ^ np.uint64(salt)), bounds[some]) + n[some].astype(np.uint64))
    data = out.astype(">u8").tobytes()
    return out[:, 0].copy().view(np.int64), [data[i : i + 16] for i in range(0, len(data), 16)]


class Classes:
    """Size classes such that partners lie in one class or in neighbouring ones.

    ``parts[c]`` is the number of buckets for class c and the next one,
    ``spare[c]`` how many of them may be empty in a set that doesn't say which.
    """

    def __init__(self, over: int, under: int, most: int = 1 << 26):
        self.over, self.under = over, under
        low = [1, 2]
        while low[-1] <= most:
            low.append(max(low[-1] + 1, (low[-1] - 1) * under // over + 1))
        self.low = np.array(low, np.int64)
        top = self.low[1:] - 1
        partner = np.minimum(top * under // over, np.concatenate([self.low[2:] - 1, [top[-1] * under // over]]))
        differ = (top + partner) * (under - over) // (under + over)
        self.spare = np.where(differ > 0, 1 + differ // 12, 0)
        self.parts = np.where(differ > 0, differ + 1 + self.spare, 0)

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, n, "right") - 1


def bucket_keys(flat: np.ndarray, bounds: np.ndarray, classes: Classes, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys that linked sets share at least one of, and the row that each belongs to."""
    n = np.diff(bounds)
    keys, owners = [], []
    kind = classes.of(n)
    for step in (0, 1):
        use = rows[(n[rows] > 0) & (kind[rows] >= step)]
        group = kind[use] - step
        parts = classes.parts[group]
        use, group, parts = use[parts > 0], group[parts > 0], parts[parts > 0]
        if not len(use):
            continue
        base = np.cumsum(parts) - parts
        own = np.repeat(np.arange(len(use)), n[use])
        h = flat[np.repeat(bounds[use] - (np.cumsum(n[use]) - n[use]), n[use]) + np.arange(len(own))]
        slot = base[own] + ((h >> np.uint64(33)) % parts[own].astype(np.uint64)).astype(np.int64)
        total = int(parts.sum())
        salted = mix(h + np.uint64(0xD1342543DE82EF95))
        low = np.bincount(slot, (salted & np.uint64(0xFFFFFFFF)).astype(np.float64), total).astype(np.uint64)
        high = np.bincount(slot, (salted >> np.uint64(32)).astype(np.float64), total).astype(np.uint64)
        filled = np.bincount(slot, minlength=total)
        owner = np.repeat(np.arange(len(use)), parts)
        empty = np.bincount(owner, filled == 0, len(use))
        give = (filled > 0) | (empty > classes.spare[group])[owner]
        nth = np.arange(total) - base[owner]
        key = mix((low + (high << np.uint64(32))) ^ mix(group[owner].astype(np.uint64) << np.uint64(32) | nth.astype(np.uint64)) + filled.astype(np.uint64))
        keys.append(key[give])
        owners.append(use[owner[give]])
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(keys).view(np.int64), np.concatenate(owners)


def _salted(key: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Another key for each salt of a key."""
    return mix(mix(key.view(np.uint64)) + salt.astype(np.uint64)).view(np.int64)


def _regions(common: np.ndarray):
    """(name, pivot) of the sets that share a key, from rows sorted by key and name; the pivot is the first. Of salted keys also the pivot itself, and the key."""
    salted = _salted(np.repeat(common, SALTS), np.tile(np.arange(SALTS), len(common)))
    order = np.argsort(salted)
    salted, of = salted[order], np.repeat(common, SALTS)[order]

    def run(batches):
        last = pivot = None
        for batch in batches:
            key, name = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(key):
                continue
            new = np.concatenate([[last is None or key[0] != last], key[1:] != key[:-1]])
            at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            first = np.where(at >= 0, name[at], pivot if pivot is not None else 0)
            last, pivot = key[-1], first[-1]
            if len(salted):
                place = np.minimum(np.searchsorted(salted, key), len(salted) - 1)
                spread, origin = salted[place] == key, of[place]
            else:
                spread, origin = np.zeros(len(key), bool), key
            rows = np.flatnonzero((name != first) | spread)
            if len(rows):
                found = np.unique(np.stack([name[rows], first[rows], np.where(spread[rows], origin[rows], 0), spread[rows]], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array(found[:, 2]), pa.array(found[:, 3] > 0)], ["name", "pivot", "key", "salted"])

    return run


class Region:
    """Exact join of a few thousand sets by recursive Voronoi cells."""

    def __init__(self, sets: list[np.ndarray], over: int, under: int, every: bool = False, core: np.ndarray | None = None):
        self.over, self.under = over, under
        self.reach = 1 - over / under
        self.n = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets)
        names, item, count = np.unique(flat, return_inverse=True, return_counts=True)
        shared = count > 1  # others are in no intersection
        dense = np.cumsum(shared) - 1
        keep = shared[item]
        self.items = dense[item[keep]]
        owner = np.repeat(np.arange(len(sets)), self.n)[keep]
        self.bounds = np.searchsorted(owner, np.arange(len(sets) + 1))
        self.width = int(shared.sum())
        self.label = np.arange(len(sets))
        if core is not None and core.any() and not every:
            self.label[core] = np.flatnonzero(core)[0]  # they are connected already
        self.start = self.label.copy()
        self.every, self.found = every, [np.zeros(0, np.int64)]

    def flat(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.bounds[rows + 1] - self.bounds[rows]
        owner = np.repeat(np.arange(len(rows)), size)
        return self.items[np.repeat(self.bounds[rows] - (np.cumsum(size) - size), size) + np.arange(len(owner))], owner

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        """Give all that the edges connect one label."""
        node, low = forest(self.label[a], self.label[b])
        if len(node):
            change = np.arange(len(self.label))
            change[node] = low
            self.label = change[self.label]

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """The edges hold: unite what they connect and, where every link is wanted, keep them."""
        self.unite(a, b)
        if self.every:
            self.found.append(np.unique((np.minimum(a, b) * len(self.label) + np.maximum(a, b))[a != b]))

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of linked sets, each once, if ``every``; else edges to the labels."""
        if not self.every:
            moved = np.flatnonzero((self.label != self.start) & (self.start == np.arange(len(self.label))))
            return moved, self.label[moved]
        return np.divmod(np.unique(np.concatenate(self.found)), len(self.label))

    def linked(self, common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.under * common >= self.over * (a + b - common)

    def join(self, rows: np.ndarray) -> None:
        """Connect all pairs of ``rows`` within the threshold."""
        todo = [rows]
        while todo:
            rows = todo.pop()
            if len(rows) < 2 or (not self.every and (self.label[rows] == self.label[rows[0]]).all()):
                continue
            if len(rows) <= CELL:
                self.compare(rows)
                continue
            items, owner = self.flat(rows)
            gap = np.empty((len(rows), PIVOTS))
            far = np.full(len(rows), np.inf)
            at = int(self.n[rows].argmax())
            for k in range(PIVOTS):
                mark = np.zeros(self.width, bool)
                mark[items[owner == at]] = True
                common = np.bincount(owner, mark[items], len(rows))
                own = self.n[rows[at]]
                gap[:, k] = 1 - common / (self.n[rows] + own - common)
                hit = self.linked(common, self.n[rows], own)
                hit[at] = False
                self.link(rows[hit], np.full(int(hit.sum()), rows[at]))
                far = np.minimum(far, gap[:, k])
                far[at] = -1
                at = int(far.argmax())
            home = gap.min(1)
            for k in range(PIVOTS):
                cell = rows[gap[:, k] <= home + 2 * self.reach + 1e-9]
                if len(cell) > 0.8 * len(rows):
                    self.compare(cell)
                else:
                    todo.append(cell)

    def compare(self, rows: np.ndarray, others: np.ndarray | None = None) -> None:
        """All pairs of a cell, or of two, by counting common shingles in dense blocks."""
        rows = rows[np.argsort(self.n[rows], kind="stable")]
        right_rows = rows if others is None else others[np.argsort(self.n[others], kind="stable")]
        n, m = self.n[rows], self.n[right_rows]
        for a in range(0, len(rows), 256):
            left, least = rows[a : a + 256], n[a]
            begin = a if others is None else int(np.searchsorted(m, -(-least * self.over // self.under), "left"))
            end = int(np.searchsorted(m, n[min(a + 255, len(rows) - 1)] * self.under // self.over, "right"))
            right = right_rows[begin:end]
            if not len(right) or (not self.every and (self.label[right] == self.label[left[0]]).all() and (self.label[left] == self.label[left[0]]).all()):
                continue
            used, column = np.unique(np.concatenate([self.flat(left)[0], self.flat(right)[0]]), return_inverse=True)
            owners = self.flat(left)[1], self.flat(right)[1]
            columns = column[: len(owners[0])], column[len(owners[0]) :]
            common = np.zeros((len(left), len(right)), np.float32)
            sides = []
            for own, col in zip(owners, columns, strict=True):
                order = np.argsort(col, kind="stable")
                sides.append((own[order], col[order]))
            for c in range(0, len(used), 2048):
                dense = []
                for (own, col), size in zip(sides, (len(left), len(right)), strict=True):
                    s, e = np.searchsorted(col, [c, c + 2048])
                    x = np.zeros((size, 2048), np.float32)
                    x[own[s:e], col[s:e] - c] = 1
                    dense.append(x)
                common += dense[0] @ dense[1].T
            i, j = np.nonzero(self.linked(common.astype(np.int64), self.n[left][:, None], self.n[right][None]))
            self.link(left[i], right[j])


def measure(items: list[np.ndarray], pivots: list[np.ndarray], over: int, under: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each set: distances to the pivots, bits of the pivots it links with, bits of the cells it belongs to or is copied to."""
    size = np.array([len(x) for x in items], np.int64)
    flat, owner = np.concatenate(items), np.repeat(np.arange(len(items)), size)
    gap, links, cells = np.empty((len(items), len(pivots))), np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
    for k, pivot in enumerate(pivots):
        at = np.minimum(np.searchsorted(pivot, flat), len(pivot) - 1)
        common = np.bincount(owner, pivot[at] == flat, len(items)).astype(np.int64)
        union = size + len(pivot) - common
        gap[:, k] = 1 - common / union
        links |= (under * common >= over * union).astype(np.int64) << k
    near = gap <= gap.min(1)[:, None] + 2 * (1 - over / under) + 1e-9
    for k in range(len(pivots)):
        cells |= near[:, k].astype(np.int64) << k
    return gap, links, cells


def _candidates(source: DataFrame, words: int, classes: Classes) -> DataFrame:
    """``(name, pivot)``: sets that share a key with a pivot, and every pivot with itself."""

    def keys(common: np.ndarray):
        def run(batches):
            done: set[int] = set()
            for batch in batches:
                for _, part in text_runs(batch.column(0), SLICE_BYTES):
                    if len(done) > REMEMBERED:
                        done.clear()
                    flat, bounds = shingle_sets(part, words)
                    name, _ = set_names(flat, bounds)
                    rows = np.array([i for i, k in enumerate(name.tolist()) if not (k in done or done.add(k))], np.int64)
                    key, owner = bucket_keys(flat, bounds, classes, rows)
                    own = name[owner]
                    hot = np.isin(key, common)
                    key[hot] = _salted(key[hot], mix(own[hot].view(np.uint64)) % np.uint64(SALTS))
                    for a in range(0, len(key), 200_000):
                        yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 200_000]) for x in (key, own)], ["key", "name"])

        return tidy(run)

    kind = "key bigint, name bigint"
    texts = source.where("text is not null")
    # keys that many sets have, by a bounded sample: these are dealt by key and salt
    seen = sample_rows(texts, SAMPLE_ROWS, "text").select("text").mapInArrow(keys(np.zeros(0, np.int64)), kind).distinct().groupBy("key").agg(F.count("*").alias("n"))
    least = max(20, SAMPLE_ROWS // RARE)
    common = np.array(sorted(r["key"] for r in seen.where(F.col("n") >= least).orderBy(F.desc("n"), "key").limit(COMMON).collect()), np.int64)
    found = texts.select("text").mapInArrow(keys(common), kind).repartition("key").sortWithinPartitions("key", "name")
    found = settle(found.mapInArrow(_regions(common), "name bigint, pivot bigint, key bigint, salted boolean").distinct(), "regions")
    top = found.where("salted").groupBy("key").agg(F.min("pivot").alias("top"))  # a row for each salted key, of which there are at most COMMON
    salted = found.where("salted").join(F.broadcast(top), "key").select("name", F.col("top").alias("pivot"))
    pairs = found.where("not salted").select("name", "pivot").union(salted).where("name <> pivot").distinct()
    return pairs.union(pairs.select(F.col("pivot").alias("name"), "pivot")).distinct()


_EDGES = "src binary, dst binary"


def _sets(column) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u8") for x in column]


def _grouped(batches, width: int):
    """Rows of sorted batches by their first ``width`` columns: the key and a list for each other column."""
    last, held = None, None
    for batch in (b.slice(at, SLICE_ROWS) for b in batches for at in range(0, b.num_rows, SLICE_ROWS)):
        columns = [c.to_pylist() for c in batch.columns]
        for i, key in enumerate(zip(*columns[:width], strict=True)):
            if key != last:
                if held:
                    yield last, held
                last, held = key, [[] for _ in columns[width:]]
            for values, column in zip(held, columns[width:], strict=True):
                values.append(column[i])
    if held:
        yield last, held


def _edges(node: list[bytes], a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([node[i] for i in a.tolist()], pa.binary()), pa.array([node[i] for i in b.tolist()], pa.binary())], ["src", "dst"])


def _with_items(rows: DataFrame, sets: DataFrame) -> DataFrame:
    return rows.join(sets.select("node", "items"), "node")


def _small(cells: DataFrame, over: int, under: int, every: bool, few: bool = False) -> DataFrame:
    """Edges of regions that a task holds."""

    def compare(batches):
        for _, (node, items, core) in _grouped(batches, 1):
            if len(node) > 1 and (every or not all(core)):
                region = Region(_sets(items), over, under, every, np.array(core))
                region.join(np.arange(len(node)))
                yield _edges(node, *region.links())

    rows = cells.select("region", "node", "items", "core")
    dealt = rows.repartitionByRange("region") if few else rows.repartition("region")  # a hash deals a few hundred regions unevenly
    return dealt.sortWithinPartitions("region", "node").mapInArrow(tidy(compare), _EDGES)


def _measured(cells: DataFrame, sets: DataFrame, over: int, under: int, turn: int) -> DataFrame:
    """Rows of large regions with what ``measure`` says; the pivots come from rows outside the core."""
    rank = F.xxhash64(F.lit(turn), "node")
    chosen = cells.where("not core").groupBy("region", F.pmod(rank, F.lit(PIVOTS)).alias("k")).agg(F.min_by("node", rank).alias("node"))
    part = F.pmod(F.xxhash64(F.lit(-1), "node"), F.col("parts")).cast("int")
    rows = cells.select("region", part.alias("part"), F.lit(1).alias("side"), "node", "core")
    counts = cells.groupBy("region").agg(F.first("parts").alias("parts"))
    guests = chosen.join(counts, "region").select("region", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"), "node", F.lit(False).alias("core"))

    def run(batches):
        for (region, _), (side, node, core, items) in _grouped(batches, 2):
            k = side.count(0)
            if k == len(side):
                continue
            sets = _sets(items)
            _, links, cells = measure(sets[k:], sets[:k], over, under)
            to = [[node[j] for j in range(k) if x >> j & 1 and node[j] != own] for own, x in zip(node[k:], links.tolist(), strict=True)]
            n = len(side) - k
            yield pa.RecordBatch.from_arrays(
                [pa.array([region] * n, pa.int64()), pa.array(node[k:], pa.binary()), pa.array(core[k:]), pa.array(links), pa.array(cells), pa.array(to, pa.list_(pa.binary()))],
                ["region", "node", "core", "links", "cells", "to"],
            )

    # the parts' rows and, in each part, all pivots of the region
    dealt = _with_items(rows.union(guests), sets).select("region", "part", "side", "node", "core", "items").repartition("region", "part").sortWithinPartitions("region", "part", "side", "node")
    return dealt.mapInArrow(tidy(run), "region bigint, node binary, core boolean, links bigint, cells bigint, to array<binary>")


def _blocks(cells: DataFrame, sets: DataFrame, over: int, under: int, every: bool) -> DataFrame:
    """Edges of cells that windows don't divide: each block of rows outside the core meets every other, and every block of the core."""
    part = lambda n: F.pmod(F.xxhash64(F.lit(-2), "node"), n).cast("int")
    rows = cells.withColumns({"groups": F.ceil(F.col("open") / TASK_ROWS).cast("int"), "blocks": F.ceil((F.col("n") - F.col("open")) / TASK_ROWS).cast("int")})
    loose = rows.where("not core").withColumn("own", part(F.col("groups"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("groups") + F.col("blocks") - 1)))
    inside = F.col("other") < F.col("groups")
    loose = loose.select("region", F.when(inside, F.least("own", "other")).otherwise(F.col("own")).alias("a"), F.when(inside, F.greatest("own", "other")).otherwise(F.col("other")).alias("b"), "own", "node")
    bound = rows.where("core").withColumn("own", F.col("groups") + part(F.col("blocks"))).withColumn("a", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    bound = bound.select("region", "a", F.col("own").alias("b"), "own", "node")

    def compare(batches):
        for (_, a, b), (own, node, items) in _grouped(batches, 3):
            own = np.array(own)
            region = Region(_sets(items), over, under, every)
            if a == b:
                region.join(np.arange(len(node)))
            else:
                region.compare(np.flatnonzero(own == a), np.flatnonzero(own == b))
            yield _edges(node, *region.links())

    dealt = _with_items(loose.union(bound), sets).select("region", "a", "b", "own", "node", "items")
    return dealt.repartitionByRange("region", "a", "b").sortWithinPartitions("region", "a", "b", "node").mapInArrow(tidy(compare), _EDGES)


def _large(cells: DataFrame, sets: DataFrame, over: int, under: int, every: bool, counts: dict) -> list[DataFrame]:
    """Edges of large regions, by rounds of distributed Voronoi cells; ``parts`` of ``cells`` says among how many tasks a region's rows are dealt."""
    out, sizes = [], sets.select("node", (F.length("items") / 8).alias("m"))
    for turn in range(ROUNDS + 1):
        measured = settle(_measured(cells, sets, over, under, turn), "measured")
        out.append(measured.select(F.col("node").alias("src"), F.explode("to").alias("dst")))
        # Pivots that rows link with are connected, and so is all that links with these: what holds most rows is the core.
        # Where a cell holds nearly all of a region, its windows don't divide it, and it stays one cell.
        inside = [F.col("cells").bitwiseAND(1 << k) != 0 for k in range(PIVOTS)]
        alike = measured.groupBy("region", "links", "core").agg(F.count("*").alias("n"), *(F.count_if(x).alias(f"c{k}") for k, x in enumerate(inside)))
        told = alike.groupBy("region").agg(
            F.coalesce(F.expr("bit_or(CASE WHEN core THEN links END)"), F.lit(0)).alias("known"), F.max("core").alias("any"), F.max_by("links", F.when(F.col("links") != 0, F.col("n"))).alias("most"),
            F.collect_set("links").alias("bits"), (F.greatest(*(F.sum(f"c{k}") for k in range(PIVOTS))) > SHRUNK * F.sum("n")).alias("whole"),
        )
        seed = F.when(F.col("any"), F.col("known")).otherwise(F.coalesce("most", F.lit(0)))
        reach = F.aggregate(F.flatten(F.array_repeat("bits", PIVOTS)), seed, lambda acc, x: F.when(acc.bitwiseAND(x) != 0, acc.bitwiseOR(x)).otherwise(acc))
        kept = measured.drop("to").join(told.select("region", (F.lit(0).cast("bigint") if every else reach).alias("reach"), "whole"), "region")
        kept = kept.withColumn("core", F.col("core") | (F.col("links").bitwiseAND(F.col("reach")) != 0))
        into = F.when(F.col("whole"), F.array(F.lit(0))).otherwise(F.array_compact(F.array(*(F.when(x, k) for k, x in enumerate(inside)))))
        split = kept.withColumn("k", F.explode(into)).select(F.xxhash64("region", F.lit(turn), "k").alias("region"), "node", "core", "whole")
        split = settle(split, "cells")
        sized = split.join(sizes, "node").groupBy("region").agg(F.count("*").alias("n"), F.count_if(~F.col("core")).alias("open"), F.sum("m").alias("m"), F.max("whole").alias("whole"))
        fits = (F.col("n") <= REGION_ROWS) & (F.col("m") <= REGION_ITEMS)
        stuck = F.col("whole") & (F.lit(every) | (8 * F.col("open") <= F.col("n")))
        sized = sized.where("open > 0").withColumn("how", F.when(fits, "task").when(stuck | F.lit(turn == ROUNDS), "blocks").otherwise("round"))
        found = {r["how"]: r for r in sized.groupBy("how").agg(F.count("*").alias("regions"), F.sum("n").alias("rows"), F.sum("open").alias("open")).collect()}
        counts[f"round {turn + 1}"] = {k: (r["regions"], r["rows"], r["open"]) for k, r in found.items()}
        placed = split.join(sized.select("region", "n", "open", "how"), "region")
        if "task" in found:
            out.append(_small(_with_items(placed.where("how = 'task'"), sets), over, under, every, few=True))
        if "blocks" in found:
            out.append(_blocks(placed.where("how = 'blocks'"), sets, over, under, every))
        if "round" not in found:
            return out
        cells = placed.where("how = 'round'").select("region", "node", "core", F.ceil(F.col("n") / TASK_ROWS).cast("int").alias("parts"))
    return out


def twin(text: Column) -> Column:
    """What tells rows of one id apart: a 64-bit hash of the text."""
    return F.xxhash64(text.cast("string"))


#: Columns without nulls that tell rows apart; a join by them needs no other shuffle after ``dropDuplicates`` of them.
ROW_KEY = ["_id", "_nameless", "_twin"]


def row_key(doc_id: Column, twin: Column) -> list[Column]:
    """ROW_KEY of a row with this id, or null, and this ``twin``."""
    return [F.coalesce(doc_id.cast("bigint"), F.lit(0)).alias("_id"), doc_id.isNull().alias("_nameless"), twin.alias("_twin")]


def _compared(documents: DataFrame, words: int, over: int, under: int, every: bool = False, counts: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows ``(doc_id, twin, node, n_shingles)`` and edges ``(src, dst)`` between nodes: all links if ``every``, else enough to connect them.

    ``counts`` takes regions, rows and rows outside the core of each way that regions go.
    """
    bound_batches(documents.sparkSession)
    counts = counts if counts is not None else {}
    classes = Classes(over, under)
    source = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    told = source.select("doc_id", twin(F.col("text")).alias("twin"), "text")

    def name(batches):
        for batch in batches:
            for at, part in text_runs(batch.column(2), SLICE_BYTES):
                flat, bounds = shingle_sets(part, words)
                short, node = set_names(flat, bounds)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), batch.column(1).slice(at, len(part)), pa.array(short), pa.array(node, pa.binary()), pa.array(np.diff(bounds))], ["doc_id", "twin", "name", "node", "n_shingles"])

    rows = settle(told.mapInArrow(tidy(name), "doc_id bigint, twin bigint, name bigint, node binary, n_shingles bigint"), "sets")
    members = settle(_candidates(source, words, classes), "members")

    first = rows.groupBy("name", "node").agg(F.min(F.struct("doc_id", "twin")).alias("first"), F.first("n_shingles").alias("m"))
    first = settle(first.join(members.select("name").distinct(), "name", "left_semi"), "first")

    sized = members.join(first.select("name", "m"), "name").groupBy("pivot").agg(F.count("*").alias("total"), F.sum("m").alias("m"))
    sized = settle(sized.withColumn("large", (F.col("total") > REGION_ROWS) | (F.col("m") > REGION_ITEMS)), "sizes")
    found = {r["large"]: r for r in sized.groupBy("large").agg(F.count("*").alias("regions"), F.sum("total").alias("rows")).collect()}
    counts["regions"] = {"large" if k else "task": (r["regions"], r["rows"]) for k, r in found.items()}
    placed = members.join(sized, "pivot")

    # Each set is made once and carries its regions, of which it has two for each of its keys at most, so sets are shuffled by region alone.
    regions = placed.groupBy("name").agg(F.collect_list(F.when(~F.col("large"), F.col("pivot"))).alias("regions"), F.max("large").alias("large"))
    wanted = first.join(regions, "name").select("name", "node", "regions", "large", *row_key(F.col("first.doc_id"), F.col("first.twin")))

    def fetch(batches):
        for batch in batches:
            for at, part in text_runs(batch.column(4), SLICE_BYTES):
                flat, bounds = shingle_sets(part, words)
                data = [flat[a:b].astype("<u8").tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(at, len(part)) for k in range(4)), pa.array(data, pa.binary())], ["name", "node", "regions", "large", "items"])

    texts = told.where("text is not null").select(*row_key(F.col("doc_id"), F.col("twin")), "text").dropDuplicates(ROW_KEY)  # rows that are repeated have one set
    texts = texts.join(wanted, ROW_KEY).select("name", "node", "regions", "large", "text")
    sets = settle(texts.mapInArrow(tidy(fetch), "name bigint, node binary, regions array<bigint>, large boolean, items binary"), "items")

    little = sets.select(F.explode("regions").alias("region"), "node", "items", F.lit(False).alias("core"))
    edges = _small(little, over, under, every)
    if True in found:
        big = settle(placed.where("large").select("name", F.col("pivot").alias("region"), F.ceil(F.col("total") / TASK_ROWS).cast("int").alias("parts")), "large")
        # often a few rows of many files: as many files as tasks run at a time, or as the rows need
        files = max(documents.sparkSession.sparkContext.defaultParallelism, -(-found[True]["rows"] // (16 * TASK_ROWS)))
        some = settle(sets.where("large").select("name", "node", "items").coalesce(files), "large-sets")
        cells = settle(big.join(some.select("name", "node"), "name").select("region", "node", F.lit(False).alias("core"), "parts"), "cells")
        for more in _large(cells, some, over, under, every, counts):
            edges = edges.union(more)
    return rows, edges


def _settled_links(links: DataFrame) -> DataFrame:
    """Links as a table of a few files, though hundreds of tasks find a few each; without one a task holds two Python workers, one that compares and one that shrinks the edges."""
    return settle(links.repartition("src", "dst"), "links")


def _named(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``(node, lowest, lowest_twin)``: the smallest id in the group of each set, and the least twin of its rows there."""
    parts = connected_components(links)
    told = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "twin")
    nodes = rows.where("n_shingles > 0").groupBy("node").agg(F.min(told).alias("low")).join(parts.withColumnRenamed("id", "node"), "node", "left").withColumn("component_id", F.coalesce("component_id", "node"))
    least = nodes.groupBy("component_id").agg(F.min("low").alias("least"))
    return nodes.join(least, "component_id").select("node", F.col("least.doc_id").alias("lowest"), F.col("least.twin").alias("lowest_twin"))


def _group() -> Column:
    return F.when(F.col("n_shingles") > 0, F.col("lowest")).otherwise(F.col("doc_id")).alias("component_id")


def similar_groups(documents: DataFrame, words: int = WORDS, over: int = OVER, under: int = UNDER) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row: the smallest id that links lead to.

    Two documents link when ``under * |intersection| >= over * |union|`` of
    their distinct shingles. A document without words or text links with
    nothing. Equal sets are compared once, however many documents have them.
    Rows of one id are separate documents that may lie in different groups; a
    row without an id takes part but never names a group of others. Other
    columns aren't read; an empty table gives an empty result.
    """
    rows, links = _compared(documents, words, over, under)
    links = _settled_links(links)
    return rows.join(_named(rows, links), "node", "left").select("doc_id", "n_shingles", _group())


def first_rows(documents: DataFrame, words: int = WORDS, over: int = OVER, under: int = UNDER) -> DataFrame:
    """``(doc_id, twin)``, each once, of the first row of every group; rows without a shingle are their own."""
    rows, links = _compared(documents, words, over, under)
    links = _settled_links(links)
    alone = rows.where("n_shingles = 0").select("doc_id", "twin")
    return _named(rows, links).select(F.col("lowest").alias("doc_id"), F.col("lowest_twin").alias("twin")).union(alone).distinct()


def similar_links(documents: DataFrame, words: int = WORDS, over: int = OVER, under: int = UNDER) -> DataFrame:
    """``similar_groups`` with ``n_links``: how many other rows a row links with, rows of an equal set among them.

    Links are found between distinct sets and weighted by the rows that have
    each, so the pairs compared and kept are those of different texts.
    """
    rows, links = _compared(documents, words, over, under, every=True)
    links = settle(links.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src <> dst").distinct(), "links")
    copies = rows.where("n_shingles > 0").groupBy("node").agg(F.count("*").alias("copies"))
    both = links.union(links.select("dst", "src")).toDF("node", "other")
    others = both.join(copies.toDF("other", "weight"), "other").groupBy("node").agg(F.sum("weight").alias("others"))
    counted = copies.join(others, "node", "left").select("node", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    out = rows.join(_named(rows, links), "node", "left").join(counted, "node", "left")
    return out.select("doc_id", "n_shingles", _group(), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: four-word shingles, similarity of 0.85, all documents."""
    return similar_groups(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), words=4, over=85, under=100)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.c >= 85 * (x.n + y.n - p.c)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
)
SELECT r.a AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a
"""
