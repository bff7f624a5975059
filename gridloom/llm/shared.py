"""What the operators share: the cluster's shared folder, lineage cuts, bounded samples and components."""

from __future__ import annotations

import contextlib
import ctypes
import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_dir


#: Bytes of whole texts that a task hands to its Python worker at a time, at most or one text.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Let Arrow batches of this session hold BATCH_BYTES at most, unless they are smaller already.

    Spark's 10,000 rows or 64 MB of texts are held several times over, in the
    executor and in its worker. No result depends on the size of a batch.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    found = re.fullmatch(r"\s*(-?\d+)\s*([kmgtp]?)b?\s*", (spark.conf.get(key, None) or "").lower())
    now = int(found[1]) << 10 * " kmgtp".index(found[2] or " ") if found else 0
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/gridloom/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps survive lost executors."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly where it comes as fewer parts than the cluster runs tasks, such as one file with one row group.

    Of larger inputs, which come as many parts, nothing is moved.
    """
    tasks = df.sparkSession.sparkContext.defaultParallelism
    parts = df.select(F.spark_partition_id().alias("p")).distinct().count()
    return df.repartition(tasks) if 2 * parts <= tasks else df


def sample_rows(df: DataFrame, rows: int, *keys: str, seed: int = 17) -> DataFrame:
    """At most ``rows`` rows of ``df``: all of them, or of more the distinct ones whose hash of ``keys`` is least.

    Rows with equal keys count as one there, so a row that comes thousands of
    times neither breaks the bound nor fills the sample. The same table gives
    the same sample however it is partitioned.
    """
    grain = 1 << 40
    ranked = df.withColumn("__rank", F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(grain)))
    total, distinct = ranked.agg(F.count("*"), F.approx_count_distinct("__rank")).first()
    if total <= rows:
        return df
    near = ranked.where(F.col("__rank") <= int(grain * min(1.0, 1.5 * rows / max(distinct, 1))))
    return near.dropDuplicates(["__rank"]).orderBy("__rank").limit(rows).drop("__rank")


def whole_rows(sizes: list[int], budget: int) -> list[int]:
    """Which of some rows, in their order, to take whole so that their sizes come to ``budget`` at most: each that still fits; if none does, the smallest."""
    out, left = [], budget
    for i, size in enumerate(sizes):
        if size <= left:
            out.append(i)
            left -= size
    return out or ([min(range(len(sizes)), key=sizes.__getitem__)] if sizes else [])


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; a null one is empty."""
    return pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary()).to_pylist()


def text_runs(column: pa.Array, size: int):
    """Place and UTF-8 of runs of a column's texts, of about ``size`` bytes at most or of one text; only one run at a time is copied out of the column."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield at, byte_texts(column.slice(at, stop - at))
        at = stop


def runs(texts: list[bytes], size: int):
    """Place and texts of runs of about ``size`` bytes at most, or of one text."""
    at = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > size:
            yield at, texts[at:i]
            at, held = i, 0
        held += len(t)
    if at < len(texts):
        yield at, texts[at:]


_PLACE = np.random.default_rng(23).integers(1, 1 << 63, 1 << 12, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def place_weights(place: np.ndarray) -> np.ndarray:
    """An odd 64-bit weight for each place in a word, line or chunk; no two places of it share one but by chance."""
    out = _PLACE[place & (len(_PLACE) - 1)]
    if (far := np.flatnonzero(place >= len(_PLACE))).size:
        out[far] = mix(place[far].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return out


def tidy(run):
    """``run`` over a task's batches, then memory it has freed goes back: workers live on between tasks."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its tree) that connect what the given edges connect."""
    if not len(a):
        return a, b
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        before = label.copy()
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        np.minimum.at(label, u, low)
        np.minimum.at(label, v, low)
        label = label[label]
        if np.array_equal(label, before):
            break
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


_NAME = np.dtype([("a", np.uint64), ("b", np.uint64)])


def _forest_batches(batches):
    """Reduce each run of edges to a forest, a bounded number of edges at a time."""
    held: list[pa.RecordBatch] = []
    size = 0

    def reduced():
        edges = pa.Table.from_batches(held).combine_chunks()
        a, b = edges["src"], edges["dst"]
        if pa.types.is_binary(a.type):  # names of 16 bytes
            a, b = forest(*(np.frombuffer(b"".join(x.to_pylist()), _NAME) for x in (a, b)))
            a, b = ([x.tobytes() for x in y] for y in (a, b))
        else:
            a, b = forest(a.to_numpy(), b.to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(a, edges.schema.field(0).type), pa.array(b, edges.schema.field(1).type)], ["src", "dst"])

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= 1_000_000:
            tree = reduced()
            held, size = [tree], tree.num_rows
            if size >= 500_000:
                yield tree
                held, size = [], 0
    if size:
        yield reduced()


def connected_components(edges: DataFrame) -> DataFrame:
    """``(id, component_id)`` of every node of ``edges (src, dst)``: both bigint, or binary names of 16 bytes.

    Each task first shrinks its edges to a forest. Then large-star and
    small-star rounds alternate, each written to the shared folder, until
    every node points at the smallest id of its component. Only the number of
    changed edges reaches the driver. A hub's edges are aggregated by ``min``
    and joined back, which never gathers them into one row; the join's rows of
    a hub are split over tasks by the adaptive engine's handling of skew. Nodes without an edge aren't returned;
    an empty input gives an empty result.
    """
    spark = edges.sparkSession
    of = "binary" if edges.schema["src"].dataType.simpleString() == "binary" else "bigint"
    kind = f"src {of}, dst {of}"
    tree = settle(
        edges.select(F.col("src").cast(of), F.col("dst").cast(of))
        .where("src <> dst")
        .mapInArrow(tidy(_forest_batches), kind)
        .select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        .distinct(),
        "edges",
    )
    while True:
        both = tree.union(tree.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low"))
        large = (
            both.join(low, "src")
            .where("dst > src")
            .select(F.col("dst").alias("src"), F.col("low").alias("dst"))
            .where("src <> dst")
            .distinct()
        )
        down = large.groupBy("src").agg(F.min("dst").alias("low"))
        small = (
            large.join(down, "src")
            .select(F.explode(F.array(F.struct("src", F.col("low").alias("dst")), F.struct(F.col("dst").alias("src"), F.col("low").alias("dst")))).alias("e"))
            .select("e.*")
            .where("src <> dst")
            .distinct()
        )
        small = settle(small, "edges")
        # stars: no node is both a leaf and a centre, and every leaf has one centre
        leaves = small.select(F.col("src").alias("dst")).distinct()
        nested = small.join(leaves, "dst", "left_semi").limit(1).count()
        twice = 0 if nested else small.groupBy("src").count().where("count > 1").limit(1).count()
        tree = small
        if not nested and not twice:
            break
    roots = tree.select(F.col("dst").alias("id"), F.col("dst").alias("component_id")).distinct()
    return tree.select(F.col("src").alias("id"), F.col("dst").alias("component_id")).union(roots)
