"""The corpus pipeline: from the documents table to packed training sequences.

Every stage works on all that the one before kept. All but the last return the columns of ``documents``
(doc_id, text, lang, source, n_chars), with ``n_chars`` of the text as it then is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exhume.llm import decontamination, language_id, line_dedup, near_duplicates, packing
from exhume.llm.tokens import vocabulary
from exhume.session import Scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; those without letters go. A missing ``lang`` is filled in."""
    judged = language_id.predict(docs, language_id.train(docs))
    known = judged.filter(F.col("lang_pred") != language_id.UNKNOWN)
    return known.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, later copies of repeated line runs cut out of their texts."""
    return line_dedup.dedup_lines(docs, whole_runs=True).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, and all without words."""
    return near_duplicates.one_of_each(docs).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with the benchmark."""
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return decontamination.without_contaminated(docs, items).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in the training sequences."""
    return packing.pack(docs, vocabulary())


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("best_fit_packing", pack_sequences),
]
# language models, token ids and the packing plan are beyond SQL; the tests set the stages beside brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return docs
