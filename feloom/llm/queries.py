"""The contract queries of this subpackage: thin wrappers around its operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, language_id, mixing
from .common import table
from .html_extract import extract
from .line_dedup import dedup_lines
from .media import media_columns
from .near_dedup import near_duplicates
from .packing import pack
from .quality import quality
from .token_counts import count_edited


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = language_id.document_evidence(table(spark, sf_dir, "documents"))
    return language_id.identify(rows, ["doc_id", "lang", "source"])


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator where markup and addresses are at hand."""
    rows = language_id.page_evidence(table(spark, sf_dir, "pages"))
    return language_id.identify(rows.withColumnRenamed("_fl_host", "host").withColumn("_fl_host", F.col("host")), ["page_id", "host"])


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_edited(table(spark, sf_dir, "documents"))


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql("SELECT -1L AS conv_id, CAST(id AS BIGINT) AS turn, IF(id = 0, 'user', 'assistant') AS role FROM range(2)")
    probe = probe.withColumn("text", F.lit(chat_format.PROBE))
    read = chat_format.read_back(chat_format.format_chats(rows.unionByName(probe)))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def queries() -> dict:
    return {
        "op1_language_id": op1_language_id,
        "op2_packing": op2_packing,
        "op3_mixing": op3_mixing,
        "op4_quality": op4_quality,
        "op5_token_counts": op5_token_counts,
        "op6_html_extract": op6_html_extract,
        "op7_media": op7_media,
        "op8_line_dedup": op8_line_dedup,
        "op9_near_dedup": op9_near_dedup,
        "op10_chat_format": op10_chat_format,
        "language_id_pages": language_id_pages,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": mixing.oracle_sql(), "op10_chat_format": chat_format.oracle_sql()}
