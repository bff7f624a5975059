"""A Merkle tree over a dataset: a leaf for each row, a tree for each group, a tree over the groups' roots, and a proof for each row.

Leaves are range-sorted by group and id. Counts by partition and group give each
partition the ordinals of its leaves, so it builds every subtree that lies in it
whole, where the coordinates are those of the whole tree. What is left at its
edges, a few nodes for each level, is shuffled by the parent's coordinate, level
by level, until each group has its root; the roots' own tree is made likewise.
On the way back the siblings of those edge nodes, from their level to the root,
go to the partition that has the node, which puts proofs together. The rows are
sorted as a DataFrame and go through tasks as Arrow batches, not as an RDD of
Python rows.
"""

from __future__ import annotations

import hashlib
import itertools

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..plans.ordinals import with_ordinal
from .shared import settle, spread

#: Children of a node, the columns of a leaf in their order, and the divisor that picks rows to tamper with.
ARITY, LEAF, TAMPERED = 8, ("doc_id", "source", "lang", "n_chars", "text"), 3
#: Leaves that a partition holds, about: a task keeps them in memory, some 200 bytes each.
LEAVES = 200_000


def node(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def height(leaves: int) -> int:
    """Levels above the leaves until one node is left."""
    out = 0
    while leaves > 1:
        leaves, out = -(-leaves // ARITY), out + 1
    return out


def subtrees(digests: list[str], start: int, total: int) -> list[list[str]]:
    """The nodes, by level, that the leaves from ordinal ``start`` of ``total`` make alone; level l begins at the first coordinate whose leaves are all here."""
    levels, first, end = [digests], start, start + len(digests)
    while total > 1:
        last = end == total  # the last run may be shorter
        low, high = -(-first // ARITY), -(-end // ARITY) if last else end // ARITY
        own = levels[-1]
        levels.append([node(own[c * ARITY - first : min((c + 1) * ARITY, end) - first]) for c in range(low, high)])
        total = -(-total // ARITY)
        first, end = low, max(low, high)
    return levels


def firsts(start: int, levels: int) -> list[int]:
    """First coordinate of each level of ``subtrees``."""
    out = [start]
    for _ in range(levels - 1):
        out.append(-(-out[-1] // ARITY))
    return out


def encoded(*columns: Column) -> Column:
    """Values as a leaf has them: ``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    texts = [c.cast("string") for c in columns]
    return F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))


def leaves(documents: DataFrame) -> DataFrame:
    """``(doc_id, grp, leaf, changed)``: the leaf of each row and that of its tampered form, null where the row isn't tampered with."""
    digest = lambda text: F.sha2(F.encode(encoded(*(text if c == "text" else F.col(c) for c in LEAF)), "UTF-8"), 256)
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(TAMPERED)) == 0
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return documents.select("doc_id", F.col("lang").alias("grp"), digest(F.col("text")).alias("leaf"), F.when(tampered, digest(lowered)).alias("changed"))


_SORTED = "part int, place bigint, doc_id bigint, grp string, leaf string, changed string"


def range_sorted(found: DataFrame) -> DataFrame:
    """Leaves with their partition and place in it, in the order of group, id and leaf, written.

    Equal rows are interchangeable, so a row's number in the scan, which lets
    many of them part, changes no digest.
    """
    parts = max(1, -(-found.count() // LEAVES), min(found.sparkSession.sparkContext.defaultParallelism, -(-found.count() // 1000)))
    order = ["grp", "doc_id", "leaf", "_tie"]
    placed = found.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("_tie")

    def number(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array(range(at, at + n), pa.int64()), *batch.columns], ["part", "place", "doc_id", "grp", "leaf", "changed"])
            at += n

    return settle(placed.mapInArrow(number, _SORTED), "merkle-leaves")


def offsets(placed: DataFrame) -> DataFrame:
    """``(part, grp, start, total)``: the ordinal in its group of a partition's first leaf of it, and the group's leaves. A row for each partition and each group, about."""
    counted = placed.groupBy("part", "grp").agg(F.count("*").alias("n"))
    own = W.partitionBy("grp")
    return counted.select("part", "grp", (F.sum("n").over(own.orderBy("part")) - F.col("n")).alias("start"), F.sum("n").over(own).alias("total"))


def _by_part(rows: DataFrame, parts: int) -> DataFrame:
    """All that belongs to a partition in one task, leaves last and in order."""
    return rows.repartition(parts, "part").sortWithinPartitions("part", "kind", "place")


_MIXED = ["part", "kind", "place", "doc_id", "grp", "leaf", "changed", "level", "coord", "start", "total", "left", "right", "subroot", "root"]


def _mixed(rows: DataFrame, kind: int) -> DataFrame:
    """``rows`` with all columns of the rows that tasks get, in their order."""
    types = {"part": "int", "place": "bigint", "doc_id": "bigint", "level": "int", "coord": "bigint", "start": "bigint", "total": "bigint", "left": "array<string>", "right": "array<string>"}
    given = [F.lit(kind).alias("kind") if c == "kind" else (F.col(c) if c in rows.columns else F.lit(None)).cast(types.get(c, "string")).alias(c) for c in _MIXED]
    return rows.select(*given)


def _parts_of(batches):
    """For each partition in turn: its rows that come before the leaves, and its leaves as columns."""
    rows = ((r, b) for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(2)), range(b.num_rows), strict=True))
    for _, of in itertools.groupby(rows, lambda x: x[0][0]):
        before, doc_ids, groups, digests, changed = [], [], [], [], []
        for kind, same in itertools.groupby(of, lambda x: (x[0][1], id(x[1]))):
            same = list(same)
            batch, low = same[0][1], same[0][0][2]
            batch = batch.slice(low, same[-1][0][2] - low + 1)
            if kind[0] < 2:
                before += batch.to_pylist()
                continue
            for out, name in ((doc_ids, "doc_id"), (groups, "grp"), (digests, "leaf"), (changed, "changed")):
                out += batch.column(name).to_pylist()
        yield before, doc_ids, groups, digests, changed


def _runs(before: list[dict], groups: list):
    """Group, first ordinal, total, and from and to which leaf of the partition it goes."""
    known = {r["grp"]: r for r in before if r["kind"] == 0}
    at = 0
    for grp, same in itertools.groupby(groups):
        n = sum(1 for _ in same)
        yield grp, known[grp]["start"], known[grp]["total"], at, at + n
        at += n


_EDGES = "part int, grp string, level int, coord bigint, digest string, total bigint"


def edge_nodes(batches):
    """Nodes whose parent needs leaves of another partition, or which have none."""
    for before, _, groups, digests, _ in _parts_of(batches):
        out = []
        part = before[0]["part"] if before else None
        for grp, start, total, low, high in _runs(before, groups):
            levels = subtrees(digests[low:high], start, total)
            first = firsts(start, len(levels))
            for level, own in enumerate(levels):
                above = range(first[level + 1], first[level + 1] + len(levels[level + 1])) if level + 1 < len(levels) else range(0)
                # all but the nodes at both ends have their parent here
                inner = (max(0, above.start * ARITY - first[level]), min(len(own), above.stop * ARITY - first[level])) if above else (0, 0)
                edge = [*range(inner[0]), *range(max(inner[1], inner[0]), len(own))]
                out += [(part, grp, level, first[level] + i, own[i], total) for i in edge]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["part", "grp", "level", "coord", "digest", "total"])


def finished(edges: DataFrame, levels: int) -> tuple[DataFrame, DataFrame]:
    """From nodes ``(grp, level, coord, digest, total)`` without a parent, all nodes above them; and each group's root.

    The children of a missing node are all among the given ones and those
    made before it, at most ARITY in a group of this shuffle.
    """
    nodes = edges.select("grp", "level", "coord", "digest", "total")
    for level in range(levels):
        here = nodes.where(f"level = {level} AND total > {ARITY**level}")
        run = here.groupBy("grp", F.expr(f"coord div {ARITY}").alias("coord")).agg(F.array_sort(F.collect_list(F.struct("coord", "digest"))).alias("of"), F.first("total").alias("total"))
        digest = F.sha2(F.array_join(F.transform("of", lambda x: x["digest"]), "").cast("binary"), 256)
        made = run.select("grp", F.lit(level + 1).alias("level"), "coord", digest.alias("digest"), "total")
        nodes = settle(nodes.union(made), "merkle-nodes")
    top = nodes.where(f"coord = 0 AND level = {_height_sql('total')}").select("grp", F.col("digest").alias("subroot"))
    return nodes, top


def _height_sql(total: str, most: int = 21) -> str:
    """``height`` as an expression."""
    return "CASE " + " ".join(f"WHEN {total} <= {ARITY**i} THEN {i}" for i in range(most)) + f" ELSE {most} END"


def paths(nodes: DataFrame, levels: int, above: DataFrame) -> DataFrame:
    """``(grp, level, coord, left, right)`` of all ``nodes``: the siblings on either side, joined, of every level from the node's own up to the root.

    ``above`` has ``(grp, left, right)``, what follows a group's root.
    """
    of = nodes.select("grp", "level", "coord", "digest", "total", F.expr(f"coord div {ARITY}").alias("parent"))
    run = of.groupBy("grp", "level", "parent").agg(F.array_sort(F.collect_list(F.struct("coord", "digest"))).alias("run"), F.first("total").alias("total"))
    side = lambda keep: F.array_join(F.transform(F.filter("run", keep), lambda x: x["digest"]), "")
    each = run.select("grp", "level", "parent", "total", "run", F.explode("run").alias("own")).select("grp", "level", "parent", "total", F.col("own.coord").alias("coord"), side(lambda x: x["coord"] < F.col("own.coord")).alias("l"), side(lambda x: x["coord"] > F.col("own.coord")).alias("r"))
    each = settle(each, "merkle-siblings")
    root = each.where(f"coord = 0 AND level = {_height_sql('total')}")
    done = root.join(above, root["grp"].eqNullSafe(above["grp"])).select(root["grp"], "level", "coord", "left", "right")
    for level in reversed(range(levels)):
        here, up = each.where(f"level = {level} AND total > {ARITY**level}"), done.where(f"level = {level + 1}")
        up = up.select(F.col("grp").alias("_grp"), F.col("coord").alias("_coord"), F.col("left").alias("_left"), F.col("right").alias("_right"))
        joined = here.join(up, here["grp"].eqNullSafe(up["_grp"]) & (F.col("parent") == F.col("_coord")))
        made = joined.select("grp", "level", "coord", F.concat(F.array("l"), F.col("_left")).alias("left"), F.concat(F.array("r"), F.col("_right")).alias("right"))
        done = settle(done.union(made), "merkle-paths")
    return done


_PROOFS = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def fold(digest: str, sides: list[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings give."""
    for left, right in sides:
        digest = hashlib.sha256(f"{left}{digest}{right}".encode()).hexdigest()
    return digest


def proofs(batches):
    for before, doc_ids, groups, digests, changed in _parts_of(batches):
        ends = {(r["grp"], r["level"], r["coord"]): r for r in before if r["kind"] == 1}
        for grp, start, total, low, high in _runs(before, groups):
            levels = subtrees(digests[low:high], start, total)
            first, size = firsts(start, len(levels)), [total]
            for _ in range(len(levels) - 1):
                size.append(-(-size[-1] // ARITY))
            known: dict[tuple[int, int], tuple] = {}

            def path(level: int, coord: int) -> tuple:
                """Siblings from a node up, its group's root and the root."""
                found = known.get((level, coord))
                if found is None:
                    if end := ends.get((grp, level, coord)):  # noqa: B023
                        found = list(zip(end["left"], end["right"], strict=True)), end["subroot"], end["root"]
                    else:
                        own, at = levels[level], coord - first[level]  # noqa: B023
                        begin = coord // ARITY * ARITY - first[level]  # noqa: B023
                        rest, subroot, root = path(level + 1, coord // ARITY)  # noqa: B023
                        found = [("".join(own[begin:at]), "".join(own[at + 1 : min(begin + ARITY, size[level] - first[level])])), *rest], subroot, root  # noqa: B023
                    if level:  # of leaves each is asked for once
                        known[level, coord] = found
                return found

            for begin in range(low, high, 4096):
                rows = []
                for i in range(begin, min(begin + 4096, high)):
                    sides, subroot, root = path(0, start + i - low)
                    folded = fold(changed[i] or digests[i], sides)
                    proof = hashlib.sha256("".join([x for side in sides for x in side]).encode()).hexdigest()
                    rows.append((doc_ids[i], digests[i], subroot, root, proof, folded, folded == root))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), *[pa.string()] * 5, pa.bool_()), strict=True)], ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def manifest(documents: DataFrame) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)`` of every row.

    Groups are the values of ``lang``, a null one first; within one, rows go
    by ``doc_id``, null ids first, and rows of one id by their leaf's digest,
    so repeated rows stand next to each other and each has a leaf and a proof
    of its own. A null in any column is a ``-`` in its leaf. A group of one
    row has its leaf as its root, one group's root is the root, and a dataset
    of one row has empty proofs. Rows without an id aren't tampered with; a
    null text stays null. Other columns have no part in it. An empty table
    gives no rows and has no root.
    """
    placed = range_sorted(leaves(documents))
    parts = placed.agg(F.max("part")).first()[0]
    if parts is None:
        return placed.select("doc_id", "leaf", *(F.lit(None).cast("string").alias(c) for c in ("subroot", "root", "proof_sha256", "folded_root")), F.lit(None).cast("boolean").alias("verified"))
    parts += 1
    starts = settle(offsets(placed), "merkle-offsets")
    local = _mixed(starts, 0).union(_mixed(placed, 2))
    edges = settle(_by_part(local, parts).mapInArrow(edge_nodes, _EDGES), "merkle-edges")
    levels = height(starts.agg(F.max("total")).first()[0])
    nodes, subroots = finished(edges, levels)

    subroots = settle(with_ordinal(subroots, ["grp"], "coord"), "merkle-subroots")
    n = subroots.count()
    tops = subroots.select(F.lit("").alias("grp"), F.lit(0).alias("level"), "coord", F.col("subroot").alias("digest"), F.lit(n).cast("bigint").alias("total"))
    top_nodes, top = finished(tops, height(n))
    root = top.first()["subroot"]
    none = F.array().cast("array<string>")
    top_paths = paths(top_nodes, height(n), top.select("grp", none.alias("left"), none.alias("right")))
    above = top_paths.where("level = 0").select("coord", "left", "right").join(subroots, "coord").select("grp", "left", "right")
    found = paths(nodes, levels, above).where("level >= 0")

    same = edges["grp"].eqNullSafe(F.col("_grp"))
    of = found.select(F.col("grp").alias("_grp"), F.col("level").alias("_level"), F.col("coord").alias("_coord"), "left", "right")
    ends = edges.join(of, same & (F.col("level") == F.col("_level")) & (F.col("coord") == F.col("_coord"))).drop("_grp")
    tree = subroots.select(F.col("grp").alias("_grp"), "subroot")
    ends = ends.join(tree, ends["grp"].eqNullSafe(tree["_grp"])).withColumn("root", F.lit(root))
    every = local.union(_mixed(ends, 1))
    return _by_part(every, parts).mapInArrow(proofs, _PROOFS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: leaf, roots and proof of every document, and whether its tampered form still folds to the root."""
    return manifest(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select(*LEAF)))


def _encoded_sql(*columns: str) -> str:
    return " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in columns)


_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TREE = """
  SELECT 0 AS level, grp, coord, digest, total FROM {of}
  UNION ALL
  SELECT level + 1, grp, coord // 8, sha256(string_agg(digest, '' ORDER BY coord)), (total + 7) // 8 FROM {name} WHERE total > 1 GROUP BY level, grp, coord // 8, total
"""
_SIDES = """
  SELECT a.level, a.grp, a.coord, coalesce(string_agg(b.digest, '' ORDER BY b.coord) FILTER (b.coord < a.coord), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.coord) FILTER (b.coord > a.coord), '') AS r
  FROM {name} a JOIN {name} b ON a.level = b.level AND a.grp = b.grp AND a.coord // 8 = b.coord // 8 WHERE a.total > 1 GROUP BY ALL
"""
#: CRC-32 a byte and eight bits at a time; its reversed polynomial is 3988292384.
SQL = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, *, sha256({_encoded_sql(*LEAF)}) AS leaf, sha256({_encoded_sql(*LEAF[:-1], _LOWERED)}) AS lowered,
    coalesce(xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295) % 3 = 0, false) AS tampered FROM documents
), l AS (
  SELECT rid, doc_id, leaf, CASE WHEN tampered THEN lowered ELSE leaf END AS x, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS grp,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS coord, count(*) OVER (PARTITION BY lang) AS total FROM d
), leaves AS (
  SELECT grp, coord, leaf AS digest, total FROM l
), tree AS ({_TREE.format(of="leaves", name="tree")}
), sides AS ({_SIDES.format(name="tree")}
), subroots AS (
  SELECT 0 AS grp, grp AS coord, digest, count(*) OVER () AS total FROM tree WHERE total = 1
), top AS ({_TREE.format(of="subroots", name="top")}
), topsides AS ({_SIDES.format(name="top")}
), up AS (
  SELECT rid, grp, 0 AS level, coord, x, '' AS proof FROM l
  UNION ALL
  SELECT rid, up.grp, up.level + 1, up.coord // 8, sha256(s.l || x || s.r), proof || s.l || s.r FROM up JOIN sides s ON s.level = up.level AND s.grp = up.grp AND s.coord = up.coord
), reached AS (
  SELECT rid, grp, max_by(x, level) AS x, max_by(proof, level) AS proof FROM up GROUP BY rid, grp
), over AS (
  SELECT rid, 0 AS level, grp AS coord, x, proof FROM reached
  UNION ALL
  SELECT rid, over.level + 1, over.coord // 8, sha256(s.l || x || s.r), proof || s.l || s.r FROM over JOIN topsides s ON s.level = over.level AND s.coord = over.coord
), folded AS (
  SELECT rid, max_by(x, level) AS x, max_by(proof, level) AS proof FROM over GROUP BY rid
)
SELECT l.doc_id, l.leaf, s.digest AS subroot, t.digest AS root, sha256(f.proof) AS proof_sha256, f.x AS folded_root, f.x = t.digest AS verified
FROM l JOIN folded f USING (rid) JOIN subroots s ON s.coord = l.grp CROSS JOIN (SELECT digest FROM top WHERE total = 1) t
"""
