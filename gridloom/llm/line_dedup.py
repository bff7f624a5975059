"""Lines that many documents share go from every document, by native column expressions.

A line's key is the line without blanks at its ends, A-Z in lower case, and it
travels as a hash of 128 bits. Every document gives each of its keys once, so
counting rows by hash counts documents. Places of lines whose key is common come
back to their document, and what isn't among them is put together by position.
Texts themselves are neither exploded nor grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import settle, spread

#: Characters that are no part of a key at its ends, and letters that are put in lower case.
BLANKS, CAPITALS = " \t\n\x0b\x0c\r", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Documents from which on a key's lines go, and code points that a key must have to go.
DOCUMENTS, POINTS = 10, 1
#: A key is hot if it makes more than one in HOT of all keys of documents, so at most HOT keys are; rows of a hot key are dealt over SALTS.
HOT, SALTS = 2000, 64

_KEY = ["h1", "h2"]
_DOC = ["d0", "d1", "d2"]


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "\n")


def _lower(line: Column) -> Column:
    """A-Z in lower case. Of a line of ASCII alone that is its lower case, which is quicker."""
    return F.when(F.octet_length(line) == F.length(line), F.lower(line)).otherwise(F.translate(line, CAPITALS, CAPITALS.lower()))


def _keys(lines: Column, points: int) -> Column:
    """The key of each line as its hash, null where it's too short to go."""

    def hashed(line: Column) -> Column:
        key = F.get(F.transform(F.array(F.btrim(line, F.lit(BLANKS))), _lower), F.lit(0))
        of = F.get(F.transform(F.array(key), lambda k: F.when(F.length(k) >= points, F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(29), k).alias("h2")))), F.lit(0))
        return of

    return F.transform(lines, hashed)


def _document(id_column: str, text: str) -> list[Column]:
    """What tells rows apart: id and a hash of the text. Rows that agree in both lose the same lines."""
    return [F.col(id_column).cast("string").alias("d0"), F.xxhash64(F.lit(1), text).alias("d1"), F.xxhash64(F.lit(2), text).alias("d2")]


def common_keys(documents: DataFrame, text: str = "text", at_least: int = DOCUMENTS, points: int = POINTS) -> DataFrame:
    """``(h1, h2, n, hot)``: keys found in at least so many documents. Every row counts as a document."""
    keys = documents.select(F.explode(F.array_distinct(_keys(_lines(text), points))).alias("k")).where("k IS NOT NULL").select("k.*")
    counted = settle(keys.groupBy(*_KEY).agg(F.count("*").alias("n")).where(F.col("n") >= at_least), "line-keys")
    every = counted.agg(F.sum("n")).first()[0] or 0  # at most all keys of documents, so no more than HOT keys are hot
    return counted.withColumn("hot", F.col("n") * HOT > every)


def common_places(documents: DataFrame, common: DataFrame, id_column: str = "doc_id", text: str = "text", points: int = POINTS) -> DataFrame:
    """``(d0, d1, d2, places)``: of documents that have common lines, where these are."""
    at = documents.select(*_document(id_column, text), F.posexplode(_keys(_lines(text), points)).alias("place", "k")).where("k IS NOT NULL").select(*_DOC, "place", "k.*")
    hot = common.where("hot").select(*_KEY, F.lit(True).alias("_hot"))  # HOT rows at most
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*_DOC, "place"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    at = at.join(F.broadcast(hot), _KEY, "left").withColumn("salt", salt).drop("_hot")
    salted = common.select(*_KEY, F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    return at.join(salted, [*_KEY, "salt"], "left_semi").groupBy(*_DOC).agg(F.collect_list("place").alias("places"))


def drop_common_lines(documents: DataFrame, id_column: str = "doc_id", text: str = "text", at_least: int = DOCUMENTS, points: int = POINTS) -> DataFrame:
    """``documents`` with ``n_lines``, ``n_dropped`` and ``kept_text``.

    Lines end at LF alone. A key of at least ``points`` code points that at
    least ``at_least`` rows have loses all its lines everywhere, also the ones
    a document has it more than once; other lines stay in their order. A null
    or empty text is one empty line, so its kept text is empty; with all lines
    gone it's empty too. Every row comes back, repeated ones each with its own
    result, null ids too, and columns of ``documents`` that have the names of
    added ones are replaced. An empty table stays empty.
    """
    added = ("n_lines", "n_dropped", "kept_text")
    row = F.struct(*(F.col(f"`{c}`") for c in documents.columns if c not in added or c in (id_column, text))).alias("row")
    gone = common_places(documents, common_keys(documents, text, at_least, points), id_column, text, points)
    named = documents.select(*_document(id_column, text), row)
    same = F.lit(True)
    for c in _DOC:
        same = same & named[c].eqNullSafe(gone[c])
    lines = _lines(f"row.{text}")
    dropped = F.coalesce(F.array_distinct("places"), F.array().cast("array<int>"))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), dropped)
    whole = F.coalesce(F.col(f"row.{text}").cast("string"), F.lit(""))
    out = named.join(gone, same, "left").select(
        "row.*",
        F.size(lines).cast("bigint").alias("n_lines"),
        F.size(dropped).cast("bigint").alias("n_dropped"),
        F.when(F.size(dropped) == 0, whole).otherwise(F.get(F.transform(F.array(lines), lambda of: F.array_join(F.transform(kept, lambda i: F.get(of, i)), "\n")), F.lit(0))).alias("kept_text"),
    )
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: every document's lines before, those dropped, and the digest of the rest."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return drop_common_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT rid, unnest(ls) AS line, unnest(range(len(ls))) AS place FROM d
), k AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), c AS (
  SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT rid) >= 10
), r AS (
  SELECT rid, count(*) AS n_lines, count(c.key) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (c.key IS NULL), '') AS kept
  FROM k LEFT JOIN c USING (key) GROUP BY rid
)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM d JOIN r USING (rid)
"""
