"""A corpus pipeline over ``documents`` from operators of ``feloom.llm``.

Each stage takes what its predecessor kept, written as Parquet and read again.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feloom.llm.common import cut, drop, scratch, table
from feloom.llm.language_id import reject_unidentified
from feloom.llm.line_dedup import dedup_lines
from feloom.llm.mixing import emit, mix
from feloom.llm.near_dedup import without_near_duplicates
from feloom.llm.packing import pack


#: Similarity from which documents are near-duplicates in the pipeline; 85 is the contract of op9 alone.
NEAR_PERCENT = 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified."""
    return reject_unidentified(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated or similar lines; a document that loses all its lines goes.

    A text without a line, null ones too, stays as it is; rows that repeat ``doc_id`` and text lose the same lines.
    """
    columns = docs.columns
    cleaned = dedup_lines(docs)
    kept = cleaned.where("n_removed = 0 or text <> ''")
    changed = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", changed).select(*columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates.

    Texts without words, null ones too, and rows without ``doc_id`` stay; rows that repeat ``doc_id`` and text stay or go together.
    """
    return without_near_duplicates(docs, NEAR_PERCENT)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of their sources asks for.

    A null source is a source; each of repeated rows counts for itself, and a text without words has no size and takes part by its rank alone.
    """
    columns = docs.columns
    return emit(mix(docs)).select(*columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences; a null text is an empty one, and repeated rows are packed each."""
    return pack(docs)


STAGES = [("language_id", language), ("line_dedup", lines), ("near_dedup", near), ("mixing", mixture), ("packing", packed)]

#: The stages of MinHash search and tokenisation have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        keep: list[DataFrame] = []
        with scratch(spark, keep):  # what a stage wrote on its way goes when its result is written
            docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
            keep.append(docs)
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
