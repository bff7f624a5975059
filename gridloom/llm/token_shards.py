"""Token-id shards: zstandard frames that share a trained dictionary, with an offset index.

A shard file holds, in this order: the magic ``TIDS0001``; one zstandard frame
per document (its ids as little-endian unsigned 32-bit integers, compressed
alone with the shared dictionary); the index (doc ids as int64, null flags as
bytes, frame offsets as n + 1 uint64, token counts as uint32); and a footer:
number of documents (uint64), offset of the index (uint64), SHA-256 of the
dictionary (32 bytes), the magic again. One short document costs the footer,
its index entry and its frame. The dictionary is a file beside the shards.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import fresh_path, sample_rows, tidy, whole_rows
from .words import byte_bpe_encoder

MAGIC = b"TIDS0001"
FOOTER = struct.Struct("<QQ32s8s")
#: Documents that are looked at for the dictionary, bytes of text of those of them that it's trained on, all whole, and its size in bytes, at most.
DICTIONARY_ROWS, DICTIONARY_TEXT, DICTIONARY_BYTES = 400, 4 << 20, 32 << 10
#: Bytes of frames after which a task begins another file.
SHARD_BYTES = 128 << 20
END_ID = 0
MANIFEST = "task int, file int, path string, n_docs bigint, n_tokens bigint"

_encoders: dict = {}


def encoder(path: str):
    """One encoder per worker and vocabulary file."""
    if path not in _encoders:
        _encoders[path] = byte_bpe_encoder(path)
    return _encoders[path]


def filesystem(uri: str):
    """Any store that Arrow reaches: local or mounted folders, HDFS, object stores."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def with_end(flat: np.ndarray, counts: np.ndarray, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end_id`` after each document, and the documents' bounds."""
    bounds = np.concatenate([[0], np.cumsum(counts + 1)])
    out = np.full(bounds[-1], end_id, np.uint32)
    keep = np.ones(len(out), bool)
    keep[bounds[1:] - 1] = False
    out[keep] = flat
    return out, bounds


def train_dictionary(documents: DataFrame, vocabulary: str) -> bytes:
    """Dictionary from a bounded hash sample of documents; empty where they're too few to train on.

    At most DICTIONARY_ROWS rows are looked at, in the order of their hash;
    those that fit into DICTIONARY_TEXT bytes together are learned, each
    whole. Equal rows, ids or texts change nothing but how often a row
    counts; an empty table gives an empty dictionary.
    """
    import zstandard

    def whole(batches):
        code = encoder(vocabulary)
        for batch in batches:
            for part in code.slices(batch.column(0)):
                ids, bounds = with_end(*code.encode_slice(part))
                yield pa.RecordBatch.from_arrays([pa.array([ids[a:b].astype("<u4").tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary())], ["ids"])

    fits = F.octet_length("text") <= DICTIONARY_TEXT
    sample = sample_rows(documents.select("doc_id", "text").where(F.col("text").isNotNull() & fits), DICTIONARY_ROWS, "doc_id", "text").withColumn("name", F.xxhash64("doc_id", "text"))
    sizes = sample.select("name", F.octet_length("text").alias("size")).distinct().orderBy(F.xxhash64(F.lit(17), "name")).collect()  # DICTIONARY_ROWS numbers at most
    names = documents.sparkSession.createDataFrame([(sizes[i]["name"],) for i in whole_rows([r["size"] for r in sizes], DICTIONARY_TEXT)], "name bigint")
    learned = sample.join(F.broadcast(names), "name", "left_semi").select("text")
    samples = sorted(learned.mapInArrow(tidy(whole), "ids binary").toArrow()["ids"].to_pylist())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


class ShardWriter:
    """One file; it appears under its name only when it is complete."""

    def __init__(self, folder: str, name: str, dictionary: bytes):
        import zstandard

        store, root = filesystem(folder)
        self.name, self.store, self.path = name, store, f"{root}/{name}"
        self.out = store.open_output_stream(f"{self.path}.part")
        self.press = zstandard.ZstdCompressor(level=1, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_content_size=True)
        self.digest = hashlib.sha256(dictionary).digest()
        self.ids, self.null, self.counts, self.offsets = [], [], [], [len(MAGIC)]
        self.out.write(MAGIC)

    def add(self, doc_id: int | None, tokens: np.ndarray) -> None:
        frame = self.press.compress(tokens.astype("<u4").tobytes())
        self.out.write(frame)
        self.offsets.append(self.offsets[-1] + len(frame))
        self.ids.append(doc_id or 0)
        self.null.append(doc_id is None)
        self.counts.append(len(tokens))

    def close(self) -> None:
        for values, kind in ((self.ids, "<i8"), (self.null, "u1"), (self.offsets, "<u8"), (self.counts, "<u4")):
            self.out.write(np.array(values, kind).tobytes())
        self.out.write(FOOTER.pack(len(self.ids), self.offsets[-1], self.digest, MAGIC))
        self.out.close()
        self.store.move(f"{self.path}.part", self.path)


class Shard:
    """Random access to the documents of a file."""

    def __init__(self, folder: str, name: str):
        import zstandard

        store, root = filesystem(folder)
        self.file = store.open_input_file(f"{root}/{name}")
        size = self.file.size()
        self.n, at, digest, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{name} is not a complete shard")
        with store.open_input_stream(f"{root}/dictionary") as f:
            dictionary = f.read()
        if hashlib.sha256(dictionary).digest() != digest:
            raise ValueError(f"{name} was written with another dictionary")
        index = self.file.read_at(size - FOOTER.size - at, at)
        n, cut = self.n, 0
        for name_, kind, k in (("ids", "<i8", n), ("null", "u1", n), ("offsets", "<u8", n + 1), ("counts", "<u4", n)):
            setattr(self, name_, np.frombuffer(index, kind, k, cut))
            cut += k * np.dtype(kind).itemsize
        self.press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def tokens(self, i: int) -> np.ndarray:
        begin, end = int(self.offsets[i]), int(self.offsets[i + 1])
        return np.frombuffer(self.press.decompress(self.file.read_at(end - begin, begin)), "<u4")

    def blocks(self, size: int = 16 << 20):
        """Each document's position and ids bytes, read in long runs."""
        at = 0
        while at < self.n:
            end = max(at + 1, int(np.searchsorted(self.offsets, self.offsets[at] + size, "right")) - 1)
            begin = int(self.offsets[at])
            data = memoryview(self.file.read_at(int(self.offsets[end]) - begin, begin))
            for i in range(at, end):
                yield i, self.press.decompress(data[int(self.offsets[i]) - begin : int(self.offsets[i + 1]) - begin])
            at = end


def write_shards(documents: DataFrame, vocabulary: str, folder: str | None = None, end_id: int = END_ID) -> tuple[str, DataFrame]:
    """Encode every whole text, in ascending ``doc_id`` order, into shard files; return folder and manifest.

    A null text is empty and gives the end id alone. Null ids come first;
    rows of one id are in the order of their texts and each has its frame.
    Other columns aren't read. An empty table gives no file and an empty
    manifest ``(task, file, path, n_docs, n_tokens)``. A task that runs twice
    writes other files; only the manifest, committed by Spark, says which count.
    """
    import zstandard  # noqa: F401

    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    folder = folder or fresh_path(spark, "tokens")
    dictionary = train_dictionary(docs, vocabulary)
    store, root = filesystem(folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/dictionary") as f:
        f.write(dictionary)

    def write(batches):
        task, attempt, file = TaskContext.get().partitionId(), uuid.uuid4().hex[:12], 0
        out = None
        code = encoder(vocabulary)
        row = lambda: pa.RecordBatch.from_pydict({"task": pa.array([task], pa.int32()), "file": pa.array([file], pa.int32()), "path": [out.name], "n_docs": [len(out.ids)], "n_tokens": [sum(out.counts)]})
        for batch in batches:
            doc_ids, texts, at = batch.column(0).to_pylist(), batch.column(1), 0
            for part in code.slices(texts):
                ids, bounds = with_end(*code.encode_slice(part), end_id)
                for i in range(len(part)):
                    if out is None:
                        out = ShardWriter(folder, f"{task:06d}-{file:04d}-{attempt}.tids", dictionary)
                    out.add(doc_ids[at + i], ids[bounds[i] : bounds[i + 1]])
                    if out.offsets[-1] >= SHARD_BYTES:
                        out.close()
                        yield row()
                        out, file = None, file + 1
                at += len(part)
        if out is not None:
            out.close()
            yield row()

    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(tidy(write), MANIFEST).write.parquet(f"{folder}/manifest")
    return folder, spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_shards(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, read from the files.

    ``start`` counts the ids of all documents before it: the files' bases are
    a running sum over the manifest, which has a row for each file.
    """
    bases = manifest.withColumn("base", F.sum("n_tokens").over(W.orderBy("task", "file")) - F.col("n_tokens"))
    files = max(1, manifest.count())

    def read(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(folder, path)
                crc = np.fromiter((zlib.crc32(x) for _, x in shard.blocks()), np.int64, shard.n)
                counts = shard.counts.astype(np.int64)
                starts = base + np.cumsum(counts) - counts
                for a in range(0, shard.n, 10_000):
                    cut = slice(a, a + 10_000)
                    yield pa.RecordBatch.from_arrays([pa.array(shard.ids[cut], pa.int64(), mask=shard.null[cut] > 0), pa.array(starts[cut], pa.int64()), pa.array(counts[cut], pa.int64()), pa.array(crc[cut], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return bases.select("path", "base").repartition(files).mapInArrow(tidy(read), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: all documents into shards and back."""
    import public_tokenizers

    return read_shards(spark, *write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json")))
