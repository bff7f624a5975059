"""Quality rules as a short-circuit cascade of native column expressions.

Each rule is an expression with the statistics it needs inside. A sample tells
what a rule costs, its statistics included, and how much it rejects, and the
rules run in order of rejections per cost inside one CASE: ``passing`` gives the
verdict alone, and a document that an early rule rejects never pays for a later
one. ``apply_rules`` is for who wants the statistics too: it computes them for
every document, and the rules compare them. The order changes the cost alone: a
document is kept if no rule rejects it.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import sample_rows, spread

#: Characters between words, and characters counted as symbols.
BLANKS, SYMBOLS = "\t\n\x0b\x0c\r ", "#*$%&|<>"
_BLANK, _SYMBOL = r"[\x20\x09-\x0D]", f"[{SYMBOLS}]"
#: Letters and the marks that belong to them, in any script.
LETTERS, CAPITALS = r"[\p{L}\p{M}]+", r"\p{Lu}+"
#: Documents in the sample by which the rules are ordered, at most.
SAMPLE_ROWS = 1000

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, and only where the whole is."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _text(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def _words(t: Column) -> Column:
    return F.array_remove(F.split(t, _BLANK + "+"), "")


def _with_windows(words: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of the 64-bit hashes of a text's three-word windows, in order. Two windows of a text of n words share one by chance with n * n / 2**65."""
    hashes = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return _let(F.when(F.size(words) >= 3, F.slice(hashes, 1, F.size(words) - 2)).otherwise(F.array().cast("array<bigint>")), use)


def _covered(windows: Column) -> Column:
    """Words in windows found twice or more: hashes are sorted with their places, neighbours with one hash are repeats, and the places of these say what they cover."""

    def of_sorted(x: Column) -> Column:
        twice = F.filter(x, lambda v, k: (v["h"] == F.get(x, k + 1)["h"]) | (v["h"] == F.get(x, k - 1)["h"]))
        places = F.sort_array(F.transform(twice, lambda v: v["i"]))
        gaps = lambda p: F.transform(p, lambda v, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - v, F.lit(3))))
        return _let(places, lambda p: F.aggregate(gaps(p), F.lit(0).cast("bigint"), lambda total, v: total + v))

    return _let(F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), of_sorted)


def _spare(windows: Column) -> Column:
    """Windows beyond the first of each kind."""
    return F.size(windows) - F.size(F.array_distinct(windows))


def _repeat_words(words: Column) -> Column:
    return _with_windows(words, lambda x: F.when(_spare(x) > 0, _covered(x)).otherwise(F.lit(0).cast("bigint")))


def _mostly_repeated(words: Column) -> Column:
    """``100 * n_repeat_words > 50 * n_words``. Of k spare windows at most 2 k repeat, and cover 6 k words at most; so with few nothing need be sorted."""
    return _with_windows(words, lambda x: F.when(12 * _spare(x) <= F.size(words), F.lit(False)).otherwise(2 * _covered(x) > F.size(words)))


def _plain_statistics(t: Column) -> dict[str, Column]:
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "word_chars": (F.length(t) - F.regexp_count(t, F.lit(_BLANK))).cast("bigint"),
        "n_symbols": F.regexp_count(t, F.lit(_SYMBOL)).cast("bigint"),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint"),
    }


def with_statistics(documents: DataFrame, text: str = "text") -> DataFrame:
    """Add the statistics to ``documents``; null texts have no words."""
    t = _text(text)
    counted = documents.withColumns({"__gridloom_counts": _let(_words(t), lambda w: F.struct(F.size(w).cast("bigint").alias("n"), _repeat_words(w).alias("r"))), **_plain_statistics(t)})
    return counted.withColumns({"n_words": F.col("__gridloom_counts.n"), "n_repeat_words": F.col("__gridloom_counts.r")}).drop("__gridloom_counts")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rules(text: str = "text", has: Mapping[str, Column] | None = None) -> dict[str, Column]:
    """Each rule is true where it rejects, in whole numbers, so SQL says the same. ``has`` are statistics, by default columns of their names."""
    t = _text(text)
    of = has or {n: F.col(n) for n in STATISTICS}
    repeated = of["repeated"] if "repeated" in of else 100 * of["n_repeat_words"] > 50 * of["n_words"]
    gone = lambda pattern: F.length(t) - F.length(F.regexp_replace(t, pattern, ""))
    return {
        "few_words": of["n_words"] < 50,
        "repeated_words": repeated,
        "symbols": 10 * of["n_symbols"] > 4 * of["n_words"],
        "repeated_lines": 2 * of["n_dup_lines"] > F.size(F.split(t, "\n")),
        "word_length": (of["word_chars"] < 2 * of["n_words"]) | (of["word_chars"] > 20 * of["n_words"]),
        "shouting": 10 * gone(CAPITALS) > 5 * of["word_chars"],
        "few_letters": 2 * gone(LETTERS) < of["word_chars"],
    }


def _alone(words: Column, text: str) -> dict[str, Column]:
    """The rules with their statistics inside; only the text's words are there before."""
    return rules(text, {"n_words": F.size(words), "repeated": _mostly_repeated(words), **_plain_statistics(_text(text))})


def order_rules(documents: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS) -> list[str]:
    """Names of the rules by rejections per second on a bounded sample, best first.

    A rule's cost, its statistics included, is the time of a scan that
    evaluates it less that of a scan that cuts texts into words. Without rows
    the given order stays.
    """
    names = list(rules(text))
    sample = sample_rows(documents.where(F.col(text).isNotNull()).select("doc_id", text), rows, "doc_id", text).persist()
    try:
        total = sample.count()
        if not total:
            return names

        def run(name: str | None) -> tuple[float, int]:
            began = time.perf_counter()
            found = sample.agg(F.count_if(_let(_words(_text(text)), lambda w: _alone(w, text)[name] if name else F.size(w) < 0))).first()[0]
            return time.perf_counter() - began, found

        run(None)
        idle = run(None)[0]
        value = {}
        for name in names:
            cost, found = run(name)
            value[name] = found / total / max(cost - idle, 1e-3)
        return sorted(names, key=lambda n: -value[n])
    finally:
        sample.unpersist()


def passing(documents: DataFrame, order: list[str] | None = None, text: str = "text") -> DataFrame:
    """The documents that no rule rejects, by the cascade: rules after the first that rejects aren't computed.

    Rows, repeated ones too, are judged one by one; null and empty texts have
    too few words. Columns stay as they are; an empty table stays empty.
    """
    order = order if order is not None else order_rules(documents, text)

    def verdict(words: Column) -> Column:
        given = _alone(words, text)
        out = F.when(given[order[0]], F.lit(False))
        for name in order[1:]:
            out = out.when(given[name], F.lit(False))
        return out.otherwise(F.lit(True))

    return documents.where(_let(_words(_text(text)), verdict))


def apply_rules(documents: DataFrame, order: list[str] | None = None, text: str = "text") -> DataFrame:
    """Add the statistics, ``base_failed``, ``rejected_by`` (null if kept) and ``kept``.

    A null or empty text has no words, so it fails. Rows are neither merged
    nor dropped, repeated ids stay as they are, and an empty table stays
    empty. Columns of ``documents`` that have the names of added ones are
    replaced. Which rule ``rejected_by`` names depends on the order, ``kept``
    doesn't.
    """
    order = order if order is not None else order_rules(documents, text)
    given = rules(text)
    rest = [n for n in order if n not in ("few_words", "repeated_words")]
    counted = with_statistics(documents, text)
    # observing the rows keeps a later filter from being pushed below: there it would take
    # the statistics' expressions with it and cut the text into words once more
    counted = counted.observe(f"rules-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("documents"))
    out = counted.withColumn("base_failed", base_failed())
    first = F.when(F.col("base_failed"), F.when(given["few_words"], "few_words").otherwise("repeated_words"))
    for name in rest:
        first = first.when(given[name], name)
    return out.withColumn("rejected_by", first).withColumn("kept", F.col("rejected_by").isNull())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: the statistics and verdict of every document."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return apply_rules(docs).select("doc_id", *STATISTICS, "base_failed", "kept")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, string_split(t, chr(10)) AS ls FROM d
), s AS (
  SELECT rid, doc_id, t, ws, len(ls) AS n_lines, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(len(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines
  FROM w
), p AS (
  SELECT rid, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM s WHERE len(ws) >= 3)
), g AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM p) WHERE n >= 2
), r AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM g, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid
), f AS (
  SELECT s.*, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words FROM s LEFT JOIN r USING (rid)
), v AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM f
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 4 * n_words OR 2 * n_dup_lines > n_lines
    OR word_chars < 2 * n_words OR word_chars > 20 * n_words
    OR 10 * (length(t) - length(regexp_replace(t, '\p{Lu}+', '', 'g'))) > 5 * word_chars
    OR 2 * (length(t) - length(regexp_replace(t, '[\p{L}\p{M}]+', '', 'g'))) < word_chars) AS kept
FROM v
"""
