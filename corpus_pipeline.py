"""The corpus pipeline: raw documents to packed training sequences.

Each stage reads all rows the one before kept, as Parquet, and returns the columns of ``documents``; the last
returns the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirepoix.llm.common import table
from mirepoix.llm.decontaminate import with_leaks
from mirepoix.llm.language import UNDETERMINED, fit, with_language
from mirepoix.llm.near_dedup import near_duplicates
from mirepoix.llm.packing import pack
from mirepoix.llm.pii import redact
from mirepoix.sources import stage

#: Language predictions below this score are no decision; four languages guessed alike have 0.25.
LEAST_SCORE = 0.3

#: No stage but exact counting could be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language the labelled ones are in: texts without a letter, and undecided ones."""
    labelled = docs.filter(F.col("lang").isNotNull())
    predicted = with_language(docs, fit(labelled, "doc_id", "text", "lang"))
    kept = (F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SCORE)
    return predicted.filter(kept).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies; documents without a word are no copies."""
    kept = near_duplicates(docs).filter("kept").select("doc_id")
    return docs.join(kept, "doc_id", "left_semi").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    found = with_leaks(docs, table(spark, sf_dir, "benchmark"), column="__found")
    return found.filter(F.size("__found") == 0).select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind and brings ``n_chars`` up to date."""
    clean = redact(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    return clean.select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
