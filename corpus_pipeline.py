"""Corpus pipeline: from raw documents to packed training sequences.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that its
predecessor kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import chunk_dedup, jaccard_join, line_crf, packing, quality_rules
from gridloom.llm.shared import settle, spread

#: The classifier's field can't be written in SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that a rule rejects go, repeated rows each for itself; null and empty texts have too few words."""
    return quality_rules.passing(docs)


def keep_by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier, trained on a bounded sample of labelled raw documents: predicted bad ones go.

    Rows are judged by their text alone, so repeated ones share a verdict; an empty table stays empty.
    """
    raw = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = line_crf.train(raw, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return line_crf.score_documents(docs, model).where("predicted = 1").select(*docs.columns)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join, five words and 0.8: of each group the row with the lowest id stays.

    Rows are told apart by id and text. Of equal rows one stays; of one id's
    texts in a group the one of the least hash; a text whose group has a
    lower id goes, also where the id's other text heads a group. Rows without
    a word are in no group; an empty table stays empty.
    """
    key = jaccard_join.ROW_KEY
    first = jaccard_join.first_rows(docs).select(*jaccard_join.row_key(F.col("doc_id"), F.col("twin")))
    rows = docs.select(*jaccard_join.row_key(F.col("doc_id"), jaccard_join.twin(F.col("text"))), F.struct("*").alias("row"))
    return rows.dropDuplicates(key).join(first, key, "left_semi").select("row.*")



def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup: passages that an earlier document has are cut out; every row stays, repeated ones alike, a null text too, and an empty table stays empty."""
    out = chunk_dedup.dedup_substrings(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack_all(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing into sequences of at most 1024 tokens: every row is packed, a null or empty text as its end id alone."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", keep_by_rules),
    ("quality classifier", keep_by_classifier),
    ("n-gram Jaccard join", keep_one_of_similar),
    ("substring dedup", cut_repeats),
    ("packing", pack_all),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each stage's rows are written before the next begins."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
