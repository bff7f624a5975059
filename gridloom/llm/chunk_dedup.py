"""Substring dedup: content-defined chunks cut by a gear rolling hash.

A gear hash over the last sixteen bytes decides after which words a chunk
ends, so cuts depend on nearby bytes alone and fall in step again after an
insertion. Neighbouring chunks that span RUN_WORDS words make a group, and one
digest stands for them together. A group stays where its digest comes first, by
document id, and is cut out elsewhere; chunks that repeat without such a group
are common phrases and stay.

Groups meet by digest. A passage that a large share of all documents has would
send a row of each to one task; a bounded sample tells such digests. Of these
each task sends its first document alone, dealt by digest and a salt, and the
first of all, a row for each of them, goes to all tasks: they mark these groups
as they cut the texts, so no row of them is joined or gathered by document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import bound_batches, mix, place_weights, sample_rows, settle, spread, text_runs, tidy

#: A chunk ends after one word in EVERY by hash, and after MOST words in any case.
EVERY, MOST = 4, 64
#: Words of a group of neighbouring chunks, at least: shorter repeats stay.
RUN_WORDS = 20
#: Words longer than this also end where the hash says so, one byte in EVERY_BYTE.
LONG, EVERY_BYTE = 64, 32
SLICE_BYTES = 1 << 20
#: Sample that tells digests which more than one document in RARE has; so many of them at most; salts of each.
SAMPLE_ROWS, RARE, COMMON, SALTS = 4000, 200, 4096, 64

_WINDOW = 16
_RNG = np.random.default_rng(11)
_GEAR = _RNG.integers(0, 1 << 32, 256, dtype=np.uint32)
#: Odd numbers whose powers make the two digests of a group.
_BASES = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def gear(data: np.ndarray) -> np.ndarray:
    """``h = (h << 2) + GEAR[byte]`` of each position, over its last sixteen bytes, by doubling the window."""
    h = _GEAR[data]
    width = 1
    while width < _WINDOW:
        older = np.zeros_like(h)
        older[width:] = h[:-width] << np.uint32(2 * width)
        h = h + older
        width *= 2
    return (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(8)


def chunks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text of each chunk, first byte in its text, digest, words. A chunk goes on to the next one; texts without a word have none."""
    gap = b"\n" * _WINDOW
    data = np.frombuffer(gap + b"".join(t + gap for t in texts), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(size + _WINDOW) - size
    blank = _BLANK[data]
    h = gear(data)
    starts = np.flatnonzero(~blank[1:] & blank[:-1]) + 1
    ends = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1  # after the last byte
    if (wide := np.flatnonzero(ends - starts > LONG)).size:
        more = [np.flatnonzero((h[s : e - 1] % EVERY_BYTE == 0) & (data[s + 1 : e] & 0xC0 != 0x80)) + s + 1 for s, e in zip(starts[wide].tolist(), ends[wide].tolist(), strict=True)]
        cuts = np.concatenate(more)
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    owner = np.searchsorted(begin, starts, "right") - 1
    new = np.concatenate([[True], (h[ends[:-1] - 1] % EVERY == 0) | (owner[1:] != owner[:-1])])
    first = np.flatnonzero(new)
    nth = np.arange(len(starts)) - np.maximum.accumulate(np.where(new, np.arange(len(starts)), 0))
    head = np.flatnonzero(nth % MOST == 0) if nth.max() >= MOST else first
    words = np.diff(np.concatenate([head, [len(starts)]]))
    at, doc = starts[head], owner[head]
    stop = ends[np.concatenate([head[1:], [len(starts)]]) - 1]
    edges = np.stack([at, stop], 1).ravel()
    inside = np.zeros(len(data), np.int64)
    inside[at] = at
    place = np.arange(len(data)) - np.maximum.accumulate(inside)
    value = np.where(blank, np.uint64(0), place_weights(place) * (data.astype(np.uint64) + np.uint64(1)))
    digest = np.add.reduceat(value, edges[edges < len(data)])[::2]
    digest = (digest ^ (digest >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    digest = (digest ^ (digest >> np.uint64(32))).view(np.int64)
    return doc, at - begin[doc], digest, words


def groups(doc: np.ndarray, digest: np.ndarray, words: np.ndarray, least: int = RUN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First chunk, chunk after the last, and digest of each group, by first chunk.

    From each chunk on the shortest group of ``least`` words, and up to each
    chunk the shortest: so the groups within a repeated passage cover all its
    chunks. A group doesn't leave its text.
    """
    n = len(doc)
    total = np.concatenate([[0], np.cumsum(words)])
    bound = np.searchsorted(doc, doc, "right")
    after = np.searchsorted(total, total[:-1] + least)
    ahead = np.flatnonzero(after <= bound)
    before = np.searchsorted(total, total[1:] - least, "right") - 1
    up_to = np.flatnonzero((before >= 0) & (before >= np.searchsorted(doc, doc)))
    up_to = up_to[after[before[up_to]] != up_to + 1]
    first, stop = np.concatenate([ahead, before[up_to]]), np.concatenate([after[ahead], up_to + 1])
    order = np.lexsort((stop, first))
    first, stop = first[order], stop[order]
    return first, stop, _fold(digest, first, stop, _BASES[0])


def _fold(digest: np.ndarray, first: np.ndarray, stop: np.ndarray, base: int) -> np.ndarray:
    """One digest for the chunks from ``first`` to ``stop`` of each group, by powers of ``base``."""
    power, back = np.full(len(digest), np.uint64(base)), np.full(len(digest), np.uint64(pow(base, -1, 1 << 64)))
    power[:1] = back[:1] = 1
    power, back = np.cumprod(power, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)
    up = np.concatenate([np.zeros(1, np.uint64), np.cumsum(digest.view(np.uint64) * power, dtype=np.uint64)])
    return mix((up[stop] - up[first]) * back[first]).view(np.int64)


_ROWS = "digest bigint, check int, salt smallint, doc_id bigint, twin bigint, nth int"


def _checks(chunk: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Another digest of each group, to tell groups of one digest apart."""
    return (_fold(mix(chunk.view(np.uint64)), first, stop, _BASES[1]) >> 32).astype(np.int32)


def _digests(common: np.ndarray):
    """A row for each distinct group of each text; of each of ``common`` digests only a task's first document, with a salt from 1 on and no place."""

    def batch_of(digest, check, salt, doc, twin, nth):
        kinds = pa.int64(), pa.int32(), pa.int16(), pa.int64(), pa.int64(), pa.int32()
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((digest, check, salt, doc, twin, nth), kinds, strict=True)], ["digest", "check", "salt", "doc_id", "twin", "nth"])

    def run(batches):
        least: dict[tuple[int, int], tuple[int, int]] = {}
        for batch in batches:
            ids, twins = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
            for at, part in text_runs(batch.column(2), SLICE_BYTES):
                doc, _, chunk, words = chunks(part)
                first, stop, digest = groups(doc, chunk, words)
                if not len(digest):
                    continue
                check = _checks(chunk, first, stop)
                doc = doc[first]
                nth = np.arange(len(doc)) - np.searchsorted(doc, doc)
                order = np.lexsort((nth, check, digest, doc))
                d, c, o = digest[order], check[order], doc[order]
                keep = order[np.concatenate([[True], (d[1:] != d[:-1]) | (c[1:] != c[:-1]) | (o[1:] != o[:-1])])]
                own = at + doc[keep]
                d, c, i, w = digest[keep], check[keep], ids[own], twins[own]
                hot = np.isin(d, common)
                rest = ~hot
                yield batch_of(d[rest], c[rest], np.zeros(int(rest.sum()), np.int16), i[rest], w[rest], nth[keep][rest])
                if hot.any():
                    d, c, i, w = d[hot], c[hot], i[hot], w[hot]
                    order = np.lexsort((w, i, c, d))
                    d, c, i, w = d[order], c[order], i[order], w[order]
                    lead = np.concatenate([[True], (d[1:] != d[:-1]) | (c[1:] != c[:-1])])
                    for key, found in zip(zip(d[lead].tolist(), c[lead].tolist(), strict=True), zip(i[lead].tolist(), w[lead].tolist(), strict=True), strict=True):
                        least[key] = min(least.get(key, found), found)
        if least:
            (d, c), (i, w) = np.array(list(least)).T, np.array(list(least.values())).T
            salt = 1 + (mix(i.astype(np.uint64) ^ mix(w.view(np.uint64))) % np.uint64(SALTS)).astype(np.int16)
            yield batch_of(d, c.astype(np.int32), salt, i, w, np.zeros(len(d), np.int32))

    return tidy(run)


def _later(batches):
    """Of rows sorted by digest, check, salt and document: all but those of the first document, with its id; of salted ones only the first, as ``lead``."""
    last = owner = None
    for batch in batches:
        digest, check, salt, doc, twin, nth = (batch.column(c).to_numpy() for c in range(6))
        if not len(digest):
            continue
        new = np.concatenate([[last is None or (digest[0], check[0], salt[0]) != last], (digest[1:] != digest[:-1]) | (check[1:] != check[:-1]) | (salt[1:] != salt[:-1])])
        at = np.maximum.accumulate(np.where(new, np.arange(len(digest)), -1))
        first, first_twin = (np.where(at >= 0, x[at], owner[i] if owner else 0) for i, x in enumerate((doc, twin)))
        last, owner = (digest[-1], check[-1], salt[-1]), (first[-1], first_twin[-1])
        lead = (doc == first) & (twin == first_twin)  # a repeated row is its own first
        rows = np.flatnonzero(np.where(salt > 0, new, ~lead))
        yield pa.RecordBatch.from_arrays([*(pa.array(x[rows]) for x in (doc, twin, nth, first, digest, check)), pa.array(salt[rows] > 0)], _MARKS_NAMES)


_MARKS_NAMES = ["doc_id", "twin", "nth", "first_id", "digest", "check", "lead"]
_MARKS = "doc_id bigint, twin bigint, nth int, first_id bigint, digest bigint, check int, lead boolean"


class Firsts:
    """The first document of each salted group."""

    def __init__(self, rows: list[tuple[int, int, int, int]]):
        """``rows``: digest, check, id and twin."""
        table = np.array(sorted(rows), np.int64).reshape(-1, 4)
        self.digest, self.check, self.doc, self.twin = table.T.copy()
        self.deep = int(np.unique(self.digest, return_counts=True)[1].max(initial=0))

    def of(self, digest: np.ndarray, chunk: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Row of each group here, or -1."""
        out = np.full(len(digest), -1)
        hot = np.flatnonzero(np.isin(digest, self.digest))
        if len(hot):
            check = _checks(chunk, first, stop)[hot]
            begin = np.searchsorted(self.digest, digest[hot])
            for k in range(self.deep):
                at = np.minimum(begin + k, len(self.digest) - 1)
                same = (self.digest[at] == digest[hot]) & (self.check[at] == check)
                out[hot[same]] = at[same]
        return out


def _common(source: DataFrame) -> np.ndarray:
    """Digests that more than one document in RARE of a bounded sample has, at most COMMON: they only say what is salted."""
    sample = sample_rows(source, SAMPLE_ROWS, "doc_id", "twin")
    seen = sample.mapInArrow(_digests(np.zeros(0, np.int64)), _ROWS).groupBy("digest").agg(F.count("*").alias("n"))
    least = max(20, SAMPLE_ROWS // RARE)
    return np.array(sorted(r["digest"] for r in seen.where(F.col("n") >= least).orderBy(F.desc("n"), "digest").limit(COMMON).collect()), np.int64)


def cut_text(text: bytes, start: np.ndarray, words: np.ndarray, duplicate: np.ndarray, least: int = RUN_WORDS) -> tuple[bytes, np.ndarray]:
    """The text without its runs of duplicate chunks of ``least`` words or more; and which chunks went."""
    edge = np.concatenate([[True], duplicate[1:] != duplicate[:-1]])
    run = np.cumsum(edge) - 1
    total = np.bincount(run, words)
    gone = duplicate & (total[run] >= least)
    if not gone.any():
        return text, gone
    stop = np.concatenate([start[1:], [len(text)]])
    kept = [text[: start[0]], *(text[a:b] for a, b in zip(start[~gone].tolist(), stop[~gone].tolist(), strict=True))]
    return b"".join(kept), gone


def dedup_substrings(documents: DataFrame) -> DataFrame:
    """Add ``n_chunks``, ``n_removed``, ``removed_words`` and ``first_ids`` to ``documents``, whose ``text`` loses its repeats.

    Of a passage the copy in the lowest ``doc_id`` stays, in one document the
    first. A passage is cut where its chunks repeat together, as groups of
    RUN_WORDS words. ``first_ids`` lists the documents that have them first.
    Every row stays, also one whose text becomes empty. Null texts stay null;
    a row without an id is not changed and no other for its sake. Rows of one
    id and text are one document and keep the same. Columns of ``documents``
    that have the names of added ones are replaced. An empty table stays empty.
    """
    bound_batches(documents.sparkSession)
    added = ["n_chunks", "n_removed", "removed_words", "first_ids"]
    kept = documents.drop(*added)
    names = kept.columns
    twin = F.xxhash64(F.col("text").cast("string"))
    source = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), twin.alias("twin"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    rows = source.mapInArrow(_digests(_common(source)), _ROWS)
    found = settle(rows.repartition("digest", "salt").sortWithinPartitions("digest", "check", "salt", "doc_id", "twin", "nth").mapInArrow(_later, _MARKS), "later")
    # the first of all salts: a row for each salted digest, of which there are at most COMMON
    top = found.where("lead").groupBy("digest", "check").agg(F.min(F.struct("doc_id", "twin")).alias("top")).select("digest", "check", "top.doc_id", "top.twin")
    firsts = Firsts([tuple(r) for r in top.collect()])
    later = found.where("not lead").select("doc_id", "twin", "nth", "first_id")
    marks = settle(later.groupBy("doc_id", "twin").agg(F.collect_set(F.struct("nth", "first_id")).alias("__gridloom_marks")), "marks")
    marks = marks.select(F.col("doc_id").alias("__gridloom_id"), F.col("twin").alias("__gridloom_twin"), F.transform("__gridloom_marks", lambda m: m["nth"]).alias("__gridloom_nth"), F.transform("__gridloom_marks", lambda m: m["first_id"]).alias("__gridloom_first"))
    joined = kept.withColumns({"__gridloom_key": F.col("doc_id").cast("bigint"), "__gridloom_of": twin}).join(marks, (F.col("__gridloom_key") == F.col("__gridloom_id")) & (F.col("__gridloom_of") == F.col("__gridloom_twin")), "left").select(*names, "__gridloom_nth", "__gridloom_first", "__gridloom_key", "__gridloom_of")

    where = names.index("text")

    def rebuild(batches):
        for batch in batches:
            for at, part in text_runs(batch.column(where), SLICE_BYTES):
                yield rebuilt(batch.slice(at, len(part)), part)

    def rebuilt(batch, part):
        marked, first, key, of = (batch.column(len(names) + k).to_pylist() for k in range(4))
        out, n, removed, lost, lists = list(part), np.zeros(len(part), np.int32), np.zeros(len(part), np.int32), np.zeros(len(part), np.int64), [[] for _ in part]
        doc, start, chunk, words = chunks(part)
        head, stop, digest = groups(doc, chunk, words)
        salted = firsts.of(digest, chunk, head, stop)
        bound = np.searchsorted(doc, np.arange(len(part) + 1))
        reach = np.searchsorted(head, bound)
        for row in range(len(part)):
            a, b = int(bound[row]), int(bound[row + 1])
            n[row] = b - a
            if a == b or key[row] is None:
                continue
            p, q = int(reach[row]), int(reach[row + 1])
            again = np.ones(q - p, bool)
            _, once = np.unique(digest[p:q], return_index=True)
            again[once] = False
            owners = set()
            if marked[row]:
                again[marked[row]] = True
                owners.update(first[row])
            hot = np.flatnonzero(salted[p:q] >= 0)
            if len(hot):
                at = salted[p:q][hot]
                other = (firsts.doc[at] != key[row]) | (firsts.twin[at] != of[row])
                again[hot[other]] = True
                owners.update(firsts.doc[at[other]].tolist())
            edge = np.zeros(b - a + 1, np.int64)
            np.add.at(edge, head[p:q][again] - a, 1)
            np.add.at(edge, stop[p:q][again] - a, -1)
            duplicate = np.cumsum(edge)[:-1] > 0
            if not duplicate.any():
                continue
            out[row], gone = cut_text(part[row], start[a:b], words[a:b], duplicate)
            removed[row], lost[row] = gone.sum(), words[a:b][gone].sum()
            lists[row] = sorted(owners) if gone.any() else []
        nulls = batch.column(where).is_null().to_numpy(zero_copy_only=False)
        text = pa.array([None if x else t for t, x in zip(out, nulls, strict=True)], pa.binary()).cast(pa.string())
        columns = [text if j == where else batch.column(j) for j in range(len(names))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(n), pa.array(removed), pa.array(lost), pa.array(lists, pa.list_(pa.int64()))], [*names, *added])

    schema = T.StructType([*(T.StructField("text", T.StringType()) if f.name == "text" else f for f in kept.schema.fields), *T._parse_datatype_string("n_chunks int, n_removed int, removed_words bigint, first_ids array<bigint>").fields])
    return joined.mapInArrow(tidy(rebuild), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: all documents without the passages that earlier ones have."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return dedup_substrings(docs).select("doc_id", "n_chunks", "n_removed", "removed_words", "first_ids", "text")
