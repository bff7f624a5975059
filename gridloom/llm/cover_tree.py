"""Embedding near-duplicates: exact threshold pairs by dual traversal of cover trees.

On unit vectors a cosine of at least c is a distance of at most
``sqrt(2 - 2c)``. A first level of centres, taken from a bounded sample, gives
regions with covering radii. Neighbouring small regions make a block together,
a region of many vectors is cut into several by a hash. Two blocks meet once: in
one of them arrive those vectors of the other that can be within the threshold
of one of its regions, by the covering-radius bound. Inside a task, nested
levels with halving radii go on from there: pairs of nodes farther apart than
their radii and the threshold are pruned, the others are opened, and leaves are
compared in blocks, which counts the links of both sides; of the links
themselves only a spanning forest leaves a task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import connected_components, mix, sample_rows, settle

COSINE = 0.95
#: Vectors of a block, about, and of a region; sampled vectors for each centre, and centres at most; size of a leaf.
BLOCK, REGION, SAMPLE, CENTRES, LEAF = 6000, 64, 8, 4096, 64
#: Bound of the error of a single-precision cosine; what lies this near the threshold is computed in double.
SLACK = 2e-5


def units(raw: np.ndarray) -> np.ndarray:
    """Vectors of length 1 in double precision; the largest component goes first, so no square over- or underflows."""
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Node:
    __slots__ = ("centre", "children", "radius", "rows")

    def __init__(self, centre, radius, rows, children):
        self.centre, self.radius, self.rows, self.children = centre, radius, rows, children


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ y.T), 0))


def cover_tree(x: np.ndarray, rows: np.ndarray | None = None, reach: float = 2.0, leaf: int = LEAF) -> Node:
    """Nested levels over the rows of ``x``: a node's children are a net of half its reach, its own centre first.

    ``radius`` is the true covering radius, rounded up. A node becomes a leaf
    when it is small, or when a level would give most rows a child of their own.
    """
    rows = np.arange(len(x)) if rows is None else rows
    centre = x[rows[0]]
    radius = float(_distances(x[rows], centre[None]).max()) + 1e-3
    while reach / 2 >= radius and reach > 1e-3:
        reach /= 2  # levels that have this one node
    if len(rows) <= leaf or reach <= 1e-3:
        return Node(centre, radius, rows, None)
    left, groups = rows, []
    while len(left):
        head = left[:128]
        near = _distances(x[head], x[head]) <= reach / 2
        net: list[int] = []
        for i in range(len(head)):
            if not net or not near[i, net].any():
                net.append(i)
        if len(net) > len(head) / 2 and len(head) > 16:  # nothing to gain at this level
            if not groups:
                return Node(centre, radius, rows, None)
            groups.append(left)
            break
        d = _distances(x[left], x[head[net]])
        best = d.argmin(1)
        own = d[np.arange(len(left)), best] <= reach / 2
        groups += [g for j in range(len(net)) if len(g := left[own & (best == j)])]
        left = left[~own]
    if len(groups) == 1:
        return Node(centre, radius, rows, None)
    return Node(centre, radius, rows, [cover_tree(x, g, reach / 2, leaf) for g in groups])


def dual_leaves(a: Node, b: Node, limit: float):
    """Pairs of row sets that the bounds can't tell apart."""
    stack = [(a, b)]
    while stack:
        p, q = stack.pop()
        gap = math.sqrt(max(0.0, 2 - 2 * float(p.centre @ q.centre)))
        if gap > p.radius + q.radius + limit + 1e-3:
            continue
        if p.children and (not q.children or p.radius >= q.radius):
            stack += [(c, q) for c in p.children]
        elif q.children:
            stack += [(p, c) for c in q.children]
        else:
            yield p.rows, q.rows


class Block:
    """The vectors of a block with their links so far."""

    def __init__(self, ids: np.ndarray, raw: np.ndarray, copies: np.ndarray, cosine: float):
        self.ids, self.copies, self.cosine = ids, copies, cosine
        self.exact = units(raw)
        self.x = self.exact.astype(np.float32)
        self.limit = math.sqrt(2 - 2 * cosine)
        self.tree = cover_tree(self.x)
        self.links = np.zeros(len(ids), np.int64)
        self.label = ids.copy()
        self.seen: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []
        self._meet(self.ids, self.exact, self.copies)

    def meet(self, ids: np.ndarray, raw: np.ndarray, copies: np.ndarray) -> np.ndarray:
        """Count the links with vectors of another block; theirs are returned."""
        return self._meet(ids, units(raw), copies)

    def _meet(self, ids, exact, copies) -> np.ndarray:
        x = exact.astype(np.float32)
        label = np.array([self.find(i) for i in ids.tolist()])
        back = np.zeros(len(ids), np.int64)
        for rows, others in dual_leaves(self.tree, self.tree if exact is self.exact else cover_tree(x), self.limit):
            for a in range(0, len(rows), 512):
                mine = rows[a : a + 512]
                for b in range(0, len(others), 2048):
                    theirs = others[b : b + 2048]
                    near = self.x[mine] @ x[theirs].T
                    hit = near >= self.cosine - SLACK
                    if not hit.any():
                        continue
                    i, j = np.nonzero(hit & (near <= self.cosine + SLACK))
                    for s in range(0, len(i), 100_000):
                        u, v = i[s : s + 100_000], j[s : s + 100_000]
                        hit[u, v] = np.einsum("ij,ij->i", self.exact[mine[u]], exact[theirs[v]]) >= self.cosine
                    hit &= self.ids[mine][:, None] != ids[theirs][None]
                    self.links[mine] += hit @ copies[theirs]
                    back[theirs] += self.copies[mine] @ hit
                    i, j = np.nonzero(hit & (self.label[mine][:, None] != label[theirs][None]))
                    if len(i):
                        self.join(mine[i], ids[theirs[j]])
                        label = np.array([self.find(k) for k in ids.tolist()])
        return back

    def find(self, node: int) -> int:
        root = node
        while self.seen.get(root, root) != root:
            root = self.seen[root]
        while self.seen.get(node, node) != root:
            self.seen[node], node = root, self.seen[node]
        return root

    def join(self, mine: np.ndarray, other: np.ndarray) -> None:
        for p, q in zip(self.ids[mine].tolist(), other.tolist(), strict=True):
            a, b = self.find(p), self.find(q)
            if a != b:
                self.seen[max(a, b)] = min(a, b)
                self.edges.append((p, q))
        self.label = np.array([self.find(i) for i in self.ids.tolist()])


def _vectors(embeddings: DataFrame, kind: str) -> DataFrame:
    """``(vec_id, raw)``: components as bytes, null for a vector that links with nothing."""

    def run(batches):
        for batch in batches:
            raw = []
            for v in batch.column(1):
                x = None if not v.is_valid or not len(v) or v.values.null_count else v.values.to_numpy(zero_copy_only=False).astype(kind)
                raw.append(x.tobytes() if x is not None and np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["vec_id", "raw"])

    return embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding")).mapInArrow(run, "vec_id bigint, raw binary")


def _matrix(raw, kind: str) -> np.ndarray:
    raw = list(raw)
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1)


def _centres(reps: DataFrame, kind: str) -> dict[int, np.ndarray]:
    """By vector width, centres of a bounded sample: farthest first."""
    total = reps.count()
    want = min(CENTRES, max(1, total // REGION))
    found: dict[int, np.ndarray] = {}
    sample = sample_rows(reps.select("key", "raw"), SAMPLE * want, "key", seed=29).orderBy("key").toPandas()
    for width, part in sample.groupby(sample["raw"].map(len)):
        x = units(_matrix(part["raw"], kind)).astype(np.float32)
        most = max(1, want * len(x) // len(sample))
        picked = [0]
        far = _distances(x, x[:1])[:, 0]
        while len(picked) < most and far.max() > 0:
            picked.append(int(far.argmax()))
            far = np.minimum(far, _distances(x, x[picked[-1:]])[:, 0])
        found[int(width)] = x[picked].astype(np.float64)
    return found


def _blocks(centres: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Regions that make a block together: halved between two far centres until small enough, or a single one."""
    todo, out = [np.flatnonzero(counts)], []
    while todo:
        rows = todo.pop()
        if len(rows) > 1 and counts[rows].sum() > BLOCK:
            a = rows[_distances(centres[rows], centres[rows[:1]])[:, 0].argmax()]
            d = _distances(centres[rows], centres[[a]])[:, 0]
            b = rows[d.argmax()]
            order = np.argsort(d - _distances(centres[rows], centres[[b]])[:, 0], kind="stable")
            cut = int(np.clip(np.searchsorted(np.cumsum(counts[rows[order]]), counts[rows].sum() / 2), 1, len(rows) - 1))
            todo += [rows[order[cut:]], rows[order[:cut]]]
        elif len(rows):
            out.append(rows)
    return out


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Vectors that are null, empty, zero or have a null or non-finite component
    link with nothing, nor do vectors of different lengths. Equal vectors are
    compared once and counted as often as they come, so rows of one id count
    apart but share a component. A row without an id has no links and no
    component and is kept. Other columns aren't read; an empty table gives an
    empty result. At random directions the bounds prune little: then all blocks
    meet, exactly, and the work grows with the square of the distinct vectors.
    """
    limit = math.sqrt(2 - 2 * cosine)
    kind = "<f4" if embeddings.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"
    rows = settle(_vectors(embeddings, kind).withColumn("key", F.when(F.col("vec_id").isNotNull(), F.md5("raw"))), "vectors")
    reps = settle(rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("raw").alias("raw")), "reps")
    # distinct vectors may share an id, so a node of the graph is the smallest key's row
    centres = _centres(reps, kind)

    def assign(batches):
        for pdf in batches:
            out = []
            for width, part in pdf.groupby(pdf["raw"].map(len)):
                d = _distances(units(_matrix(part["raw"], kind)), centres[width]) if width in centres else np.zeros((len(part), 1))
                home = d.argmin(1)
                out.append(part.assign(width=width, region=home, gap=d[np.arange(len(part)), home]))
            yield pd.concat(out) if out else pdf.assign(width=0, region=0, gap=0.0).iloc[:0]

    homes = settle(reps.mapInPandas(assign, "key string, rep bigint, copies bigint, raw binary, width int, region int, gap double"), "homes")
    sized = homes.groupBy("width", "region").agg(F.max("gap").alias("radius"), F.count("*").alias("n")).collect()  # a row for each centre
    # by width: regions in the order of their blocks, their radii, where a block's regions begin, the block of each region, cuts and first node of a block
    plan, nodes = {}, 0
    for width in {r["width"] for r in sized}:
        of = {r["region"]: r for r in sized if r["width"] == width}
        x = centres.get(width, np.zeros((1, 1)))
        counts = np.array([of[i]["n"] if i in of else 0 for i in range(len(x))])
        blocks = _blocks(x, counts)
        order = np.concatenate(blocks)
        cuts = np.array([-(-int(counts[g].sum()) // BLOCK) if len(g) == 1 else 1 for g in blocks])
        block_of = np.zeros(len(x), np.int64)
        block_of[order] = np.repeat(np.arange(len(blocks)), [len(g) for g in blocks])
        begin = np.cumsum([0, *(len(g) for g in blocks[:-1])])
        plan[width] = order, np.array([of[i]["radius"] for i in order]), begin, block_of, cuts, nodes + np.cumsum(cuts) - cuts
        nodes += int(cuts.sum())

    def spread(batches):
        for pdf in batches:
            out = []
            for width, part in pdf.groupby("width"):
                order, radius, begin, block_of, cuts, base = plan[width]
                d = _distances(units(_matrix(part["raw"], kind)), centres[width][order]) if width in centres else np.zeros((len(part), 1))
                near = np.logical_or.reduceat(d <= radius + limit + 1e-6, begin, axis=1)
                own = block_of[part["region"].to_numpy()]
                node = base[own] + (mix(part["rep"].to_numpy().astype(np.uint64)) % cuts[own].astype(np.uint64)).astype(np.int64)
                columns = part[["rep", "copies", "raw"]]
                out.append(columns.assign(node=node, guest=False))
                for b in range(len(cuts)):
                    rows = np.flatnonzero(near[:, b])
                    for there in range(base[b], base[b] + cuts[b]) if len(rows) else ():
                        # of two blocks the one that lies less than half the circle ahead receives
                        ahead = (there - node[rows]) % nodes
                        sent = rows[(ahead > 0) & ((2 * ahead < nodes) | ((2 * ahead == nodes) & (node[rows] < there)))]
                        if len(sent):
                            out.append(columns.iloc[sent].assign(node=there, guest=True))
            got = pd.concat(out) if out else pd.DataFrame({"rep": [], "copies": [], "raw": [], "node": [], "guest": []})
            yield got[["node", "guest", "rep", "copies", "raw"]]

    def compare(batches):
        node, block, waiting = None, None, []

        def opened():
            joined = pd.concat(waiting)
            return Block(joined["rep"].to_numpy(), _matrix(joined["raw"], kind), joined["copies"].to_numpy(), cosine)

        def result(block):
            return pd.DataFrame({"rep": np.concatenate([block.ids, [p for p, _ in block.edges]]).astype(np.int64), "links": np.concatenate([block.links, np.full(len(block.edges), -1)]).astype(np.int64), "other": np.concatenate([block.ids, [q for _, q in block.edges]]).astype(np.int64)})

        for pdf in batches:
            for name, part in pdf.groupby("node", sort=False):
                if name != node:
                    if waiting:
                        yield result(block or opened())
                    node, block, waiting = name, None, []
                own = part[~part["guest"]]
                if len(own):
                    waiting.append(own)
                guests = part[part["guest"]]
                if len(guests) and waiting:
                    block = block or opened()
                    ids = guests["rep"].to_numpy()
                    theirs = block.meet(ids, _matrix(guests["raw"], kind), guests["copies"].to_numpy())
                    yield pd.DataFrame({"rep": ids, "links": theirs, "other": ids})[theirs > 0]
        if waiting:
            yield result(block or opened())

    met = settle(
        homes.mapInPandas(spread, "node int, guest boolean, rep bigint, copies bigint, raw binary").repartition(max(nodes, 1), "node").sortWithinPartitions("node", "guest").mapInPandas(compare, "rep bigint, links bigint, other bigint"),
        "links",
    )
    links = met.where("links >= 0").groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(met.where("links < 0").select(F.col("rep").alias("src"), F.col("other").alias("dst")))
    known = reps.select("key", "rep", "copies").join(links, "rep", "left").join(parts.withColumnRenamed("id", "rep"), "rep", "left")
    known = known.select("key", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    out = rows.select("vec_id", "key").join(known, "key", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: near-duplicate vectors of the whole table."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[64]) AS e,
    embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok
  FROM embeddings
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b
  WHERE a.ok AND b.ok AND a.vec_id <> b.vec_id AND array_cosine_similarity(a.e, b.e) >= 0.95
), r AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c USING (vec_id)
"""
