"""How sources of a language differ in their words: rates of terms by source, the most telling terms and the distance of any two sources.

Tasks count terms of whole texts in numpy and Arrow; the rest is columns. The
terms that stand out most in a source are found by radix select: histograms over
the bits of the value, all groups at a time, narrow down each group's kth value,
and histograms over bytes of the term part those that share it. The distance of
two sources is a sum over all kept terms, most of which neither has: it's the
difference of their baseline rates for every term, corrected at the terms that
one of the two has, in blocks of sources and terms.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..plans.ordinals import with_ordinal
from .shared import settle, spread, text_runs, tidy

#: Documents of its language that a kept term is in, what is added to a count, and the whole that rates are of; ranks of terms.
DOCUMENTS, ADDED, WHOLE, RANKS = 30, 5, 1_000_000_000, 50
#: Text bytes handled at a time, and rows of counts that a task holds before it merges or hands them on.
SLICE_BYTES, HELD_ROWS = 4 << 20, 400_000
#: Sources and kept terms of a block, about as many terms: what one row of a task holds.
SOURCES, TERMS = 32, 256
#: Bits of a digit of the radix select, and rows that a group may have when it ends.
DIGIT, FEW = 10, 1000

_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_GROUP = ["lang", "source"]


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each byte whether it belongs to a term, and what it is there: ASCII letters in lower case and all of other characters."""
    code = np.arange(256, dtype=np.uint8)
    capital = (code >= 65) & (code <= 90)
    return capital | ((code >= 97) & (code <= 122)) | (code > 127), np.where(capital, code + 32, code).astype(np.uint8)


_IN_TERM, _LOWER = _tables()


def terms_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of the terms of some texts, in order: which text, which entry of the distinct terms, and these."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    inside = _IN_TERM[data]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
    begin, end = edge[::2], edge[1::2]  # every text ends with a line's end, so each term does too
    offsets = np.concatenate([[0], np.cumsum(end - begin)])
    flat = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(_LOWER[data[inside]])).dictionary_encode()
    ends = np.cumsum([len(t) + 1 for t in texts])
    return np.searchsorted(ends, begin, "right"), flat.indices.to_numpy(), flat.dictionary


def counted(texts: list[bytes], groups: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Group, term, occurrences and documents of each pair of group and term; ``groups`` gives each text's."""
    text, code, distinct = terms_of(texts)
    width = max(1, len(distinct))
    one, times = np.unique(text * width + code, return_counts=True)
    pair, at = np.unique(groups[one // width] * width + one % width, return_inverse=True)
    n = np.zeros(len(pair), np.int64)
    np.add.at(n, at, times)
    return pair // width, distinct.take(pa.array(pair % width)), n, np.bincount(at, minlength=len(pair))


def count_terms(batches):
    """Counts by language, source and term, merged over what a task reads; a row without a term for each group stands for its being there."""
    held: list[pa.Table] = []
    rows = 0

    def merged() -> pa.Table:
        return pa.concat_tables(held).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")]).select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(_COUNTS.names).cast(_COUNTS) if held else _COUNTS.empty_table()

    def named(batch) -> tuple[np.ndarray, pa.Array, pa.Array]:
        both = [batch.column(i).fill_null("").dictionary_encode() for i in (0, 1)]
        a, b = (x.indices.to_numpy() for x in both)
        wide = max(1, len(both[1].dictionary))
        pair, group = np.unique(a.astype(np.int64) * wide + b, return_inverse=True)
        return group, both[0].dictionary.take(pa.array(pair // wide)), both[1].dictionary.take(pa.array(pair % wide))

    for batch in batches:
        if not batch.num_rows:
            continue
        group, langs, sources = named(batch)
        here = len(langs)
        held.append(pa.Table.from_arrays([langs, sources, pa.array([""] * here), pa.array([0] * here, pa.int64()), pa.array([0] * here, pa.int64())], schema=_COUNTS))
        rows += here
        for at, texts in text_runs(batch.column(2), SLICE_BYTES):
            g, term, n, docs = counted(texts, group[at : at + len(texts)])
            held.append(pa.Table.from_arrays([langs.take(pa.array(g)), sources.take(pa.array(g)), term.cast(pa.string()), pa.array(n), pa.array(docs.astype(np.int64))], schema=_COUNTS))
            rows += len(g)
            if rows > 2 * HELD_ROWS:
                held = [merged()]
                rows = held[0].num_rows
                if rows > HELD_ROWS:
                    yield from held[0].to_batches(max_chunksize=50_000)
                    held, rows = [], 0
    yield from merged().to_batches(max_chunksize=50_000)


def term_counts(documents: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)``, written; nulls are empty text, and a term of no characters marks each group that occurs."""
    given = documents.select("lang", "source", F.col("text").cast("string").alias("text"))
    parts = given.mapInArrow(tidy(count_terms), "lang string, source string, term string, n bigint, docs bigint")
    return settle(parts.groupBy(*_GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "divergence-counts")


def rate(n: str, total: str, terms: str) -> Column:
    """``1 + floor(WHOLE * (n + ADDED) / (total + ADDED * terms))`` in whole numbers of up to 38 digits."""
    return F.expr(f"1 + (CAST({n} + {ADDED} AS DECIMAL(20, 0)) * CAST({WHOLE} AS DECIMAL(10, 0))) div CAST({total} + {ADDED} * {terms} AS DECIMAL(20, 0))")


def radix_top(rows: DataFrame, group: list[str], value: str, name: str, k: int, bits: int = 30, few: int = FEW) -> DataFrame:
    """The ``k`` rows of each group with the greatest ``value``, of equal ones those with the least ``name`` by bytes, with their ``rank``.

    ``value`` is a whole number from 0 to below ``2 ** bits``; a name comes
    once in a group. Each round writes a histogram of the next digit of all
    groups' open rows, finds the digit in which the kth lies, takes the rows
    of better digits, drops those of worse ones and goes on with the rest,
    for as long as a group has more than ``few`` of them.
    """
    own = [F.col(c) for c in group]
    open_rows = rows.select(*group, value, name, F.lit(False).alias("taken"), F.lit(k).cast("bigint").alias("need"))

    def narrowed(state: DataFrame, digits: DataFrame, better_first: bool) -> DataFrame:
        """``digits`` are the open rows with their ``digit``."""
        histogram = digits.groupBy(*group, "digit").agg(F.count("*").alias("n"), F.first("need").alias("need"))
        before = W.partitionBy(*group).orderBy(F.col("digit").desc() if better_first else F.col("digit").asc())
        run = histogram.withColumn("upto", F.sum("n").over(before))
        cut = run.where("upto >= need AND upto - n < need").select(*(c.alias(f"_{n}") for n, c in zip(group, own, strict=True)), F.col("digit").alias("at"), (F.col("need") - F.col("upto") + F.col("n")).alias("left"), (F.col("upto") == F.col("need")).alias("whole"))
        same = F.lit(True)
        for c in group:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        met = digits.join(cut, same, "left")
        better = (F.col("digit") > F.col("at")) if better_first else (F.col("digit") < F.col("at"))
        kept = met.where(F.col("at").isNull() | better | (F.col("digit") == F.col("at")))
        taken = F.col("at").isNull() | better | F.col("whole")
        out = kept.select(*group, value, name, taken.alias("taken"), F.when(taken, F.col("need")).otherwise(F.col("left")).alias("need"))
        return settle(state.where("taken").unionByName(out), "radix")

    def crowded(state: DataFrame) -> bool:
        return bool(state.where("NOT taken").groupBy(*group).count().where(F.col("count") > few).limit(1).count())

    state = open_rows
    for shift in range((bits - 1) // DIGIT * DIGIT, -1, -DIGIT):
        state = narrowed(state, state.where("NOT taken").withColumn("digit", F.shiftright(value, shift).bitwiseAND((1 << DIGIT) - 1)), True)
        if not crowded(state):
            break
    else:
        while True:  # open rows of a group share their value; their first and last name tell the first byte in which they differ
            ends = state.where("NOT taken").groupBy(*group).agg(F.min(name).alias("low"), F.max(name).alias("high"))
            fields = ", ".join(f"{c} string" for c in group) + ", _skip int"
            ends = ends.select(*(c.cast("string").alias(n) for n, c in zip(group, own, strict=True)), "low", "high").mapInArrow(shared_prefix(len(group)), fields).select(*(F.col(c).alias(f"_{c}") for c in group), "_skip")
            same = F.lit(True)
            for c in group:
                same = same & F.col(c).cast("string").eqNullSafe(F.col(f"_{c}"))
            byte = F.hex(F.expr(f"substring(CAST({name} AS BINARY), _skip + 1, 1)"))
            state = narrowed(state, state.where("NOT taken").join(ends, same).select(*state.columns, byte.alias("digit")), False)
            if not crowded(state):
                break
    order = W.partitionBy(*group).orderBy(F.col(value).desc(), F.col(name).asc())
    return state.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(*group, value, name, "rank")


def shared_prefix(groups: int):
    """Bytes that the first and the last name of a group share, so all of them."""

    def run(batches):
        for batch in batches:
            low, high = ([x.encode() for x in batch.column(groups + i).to_pylist()] for i in (0, 1))
            skip = []
            for a, b in zip(low, high, strict=True):
                n = min(len(a), len(b))
                differ = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))
                skip.append(int(differ[0]) if len(differ) else n)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(groups)), pa.array(skip, pa.int32())], [*batch.schema.names[:groups], "_skip"])

    return run


def corrections(batches):
    """From rows of a block of kept terms and two blocks of sources: what the terms add to each two sources' distance beyond the difference of their baselines."""
    for batch in batches:
        out: list[list[np.ndarray]] = [[], [], []]
        for r in range(batch.num_rows):
            mine, other, low_bases, high_bases = (batch.column(i)[r].values for i in range(4))
            sides, place = [], {}
            for entries, bases in ((mine, low_bases), (other, high_bases)):
                base = bases.field("base").to_numpy()
                column = [place.setdefault(t, len(place)) for t in entries.field("term").to_pylist()] if entries is not None else []
                sides.append((base, column, entries))
            dense = []
            for base, column, entries in sides:
                p = np.repeat(base[None, :], len(place), 0)
                if column:
                    p[column, entries.field("place").to_numpy()] = entries.field("p").to_numpy()
                dense.append(p)
            (a_base, _, _), (b_base, _, _) = sides
            a, b = dense
            sums = np.stack([np.abs(a - b[:, j : j + 1]).sum(0) for j in range(b.shape[1])], 1) - len(place) * np.abs(a_base[:, None] - b_base[None, :])
            i, j = np.nonzero(sums)
            first, second = low_bases.field("ordinal").to_numpy()[i], high_bases.field("ordinal").to_numpy()[j]
            keep = first < second
            for o, x in zip(out, (first[keep], second[keep], sums[i, j][keep]), strict=True):
                o.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o) if o else np.zeros(0, np.int64), pa.int64()) for o in out], ["first", "second", "more"])


def distances(held: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, source, item, value)`` for each source and each other one of its language.

    ``groups`` has an ``ordinal`` for each, and blocks of them are ranges of
    it. ``held`` is sparse: a row for each term that a source has.
    """
    blocked = groups.withColumn("block", F.expr(f"ordinal div {SOURCES}"))
    wide = blocked.groupBy("lang").agg(F.min("block").alias("low"), F.max("block").alias("high"))
    bases = blocked.groupBy("lang", "block").agg(F.array_sort(F.collect_list(F.struct("ordinal", "base"))).alias("bases"))  # SOURCES at most
    slices = F.greatest(F.lit(1), F.expr(f"terms div {TERMS}"))
    at = F.col("ordinal") - F.greatest(F.col("block") * SOURCES, F.col("first"))
    first = blocked.groupBy("lang", "block").agg(F.min("ordinal").alias("first"))
    placed = held.join(blocked.join(first, ["lang", "block"]).select(*_GROUP, "block", at.cast("int").alias("place")), _GROUP)
    packed = placed.groupBy("lang", "block", F.pmod(F.xxhash64("term"), slices).alias("slice")).agg(F.collect_list(F.struct("term", "place", "p")).alias("of"))
    # a block of sources meets every other one of its language, and itself
    met = packed.join(wide, "lang").select("lang", "block", "slice", "of", F.explode(F.sequence("low", "high")).alias("other"))
    sided = met.select("lang", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "slice", F.when(F.col("block") <= F.col("other"), F.col("of")).alias("mine"), F.when(F.col("block") >= F.col("other"), F.col("of")).alias("others"))
    cells = sided.groupBy("lang", "low", "high", "slice").agg(F.first("mine", True).alias("mine"), F.first("others", True).alias("others"))
    cells = cells.join(bases.select("lang", F.col("block").alias("low"), F.col("bases").alias("low_bases")), ["lang", "low"])
    cells = cells.join(bases.select("lang", F.col("block").alias("high"), F.col("bases").alias("high_bases")), ["lang", "high"])
    more = cells.select("mine", "others", "low_bases", "high_bases").mapInArrow(tidy(corrections), "first bigint, second bigint, more bigint").groupBy("first", "second").agg(F.sum("more").alias("more"))
    # every source with each block of its language, and with the sources of that block
    each = blocked.join(wide, "lang").select("lang", "source", "ordinal", "base", "terms", F.explode(F.sequence("low", "high")).alias("block"))
    other = blocked.select("lang", "block", F.col("source").alias("item"), F.col("ordinal").alias("_ordinal"), F.col("base").alias("_base"))
    both = each.join(other, ["lang", "block"]).where("ordinal <> _ordinal").withColumns({"first": F.least("ordinal", "_ordinal"), "second": F.greatest("ordinal", "_ordinal")})
    value = F.col("terms") * F.abs(F.col("base") - F.col("_base")) + F.coalesce("more", F.lit(0))
    return both.join(more, ["first", "second"], "left").select("lang", "source", "item", value.cast("bigint").alias("value"))


def audit(documents: DataFrame, at_least: int = DOCUMENTS, ranks: int = RANKS, few: int = FEW) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: how each source of a language differs from the others, and in which terms from all of it.

    Null texts, languages and sources are empty. A source without a text or
    a term still has its distances; a language of one source has none, and
    one without a kept term gives distances of 0 and no terms. Each row of
    ``documents`` counts, repeated ones too; other columns have no part in
    it, and ties of a value go by the item's bytes. An empty table gives no
    rows.
    """
    counts = term_counts(documents)
    kept = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("every"), F.sum("docs").alias("docs")).where(F.col("docs") >= at_least).drop("docs")
    held = settle(counts.join(kept, ["lang", "term"]).select(*_GROUP, "term", "n", "every"), "divergence-held")
    langs = held.groupBy("lang", "term").agg(F.first("every").alias("every")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("every").alias("lang_n"))
    totals = held.groupBy(*_GROUP).agg(F.sum("n").alias("total"))
    groups = counts.select(*_GROUP).distinct().join(totals, _GROUP, "left").join(langs, "lang", "left").fillna(0, ["total", "terms", "lang_n"])
    base = F.when(F.col("terms") > 0, rate("0", "total", "greatest(terms, 1)")).otherwise(F.lit(0))
    groups = settle(with_ordinal(groups.withColumn("base", base), _GROUP, "ordinal"), "divergence-groups")
    own = held.join(groups.select(*_GROUP, "total", "terms", "lang_n"), _GROUP)
    rated = settle(own.select(*_GROUP, "term", "terms", rate("n", "total", "terms").alias("p"), rate("every", "lang_n", "terms").alias("q")), "divergence-rates")
    told = rated.where("p > q").select(*_GROUP, F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = radix_top(told, _GROUP, "value", "item", ranks, few=few)
    pairs = distances(rated.drop("q"), groups).withColumn("rank", F.row_number().over(W.partitionBy(*_GROUP).orderBy(F.col("value").desc(), F.col("item").asc())))
    columns = lambda part: [*_GROUP, F.lit(part).alias("part"), "item", F.col("value").cast("bigint").alias("value"), F.col("rank").cast("int").alias("rank")]
    return pairs.select(*columns("pair")).union(terms.select(*columns("term")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: distances of sources and the terms that tell them apart."""
    return audit(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "text")))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents
), t AS (
  SELECT rid, lang, source, unnest(ts) AS term FROM d
), k AS (
  SELECT lang, term, count(*) AS every FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 30
), c AS (
  SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL
), g AS (
  SELECT lang, source, coalesce(any_value(x.total), 0) AS total FROM d LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) x USING (lang, source) GROUP BY ALL
), v AS (
  SELECT lang, count(*) AS terms, sum(every) AS lang_n FROM k GROUP BY lang
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.total + 5 * v.terms)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (k.every + 5)) // (v.lang_n + 5 * v.terms)::HUGEINT AS q
  FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pair AS (
  SELECT a.lang, a.source, b.source AS item, CAST(coalesce(s.f, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source AS sa, y.source AS sb, sum(abs(x.p - y.p)) AS f FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
    ON s.lang = a.lang AND s.sa = a.source AND s.sb = b.source
), r AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pair
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q
), o AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r
)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 50
"""
