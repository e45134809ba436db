"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagelume.llm import chat, exact, lines, mixing, packing, pii, quality, runindex, simhash, warc

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations delivered in several layouts, back as canonical turns."""
    records = chat.scattered(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return chat.canonical_turns(records, "conv_id")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(_documents(spark, sf_dir))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir))


def op5_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.private_data(_documents(spark, sf_dir))


def op6_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runindex.repeated_passages(_documents(spark, sf_dir))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_documents(spark, sf_dir))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.remove_shared_lines(_documents(spark, sf_dir))


def op9_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir))


QUERIES = (
    op1_packing,
    op2_chat_format,
    op3_exact_dedup,
    op4_mixing,
    op5_private_data,
    op6_run_index,
    op7_quality_rules,
    op8_line_dedup,
    op9_warc_archive,
    op10_simhash_dedup,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_chat_format": chat.chat_sql(),
        "op3_exact_dedup": exact.duplicates_sql(),
        "op4_mixing": mixing.mix_sql(columns="doc_id, text, lang, source, n_chars"),
        "op7_quality_rules": quality.rules_sql(),
        "op8_line_dedup": lines.shared_lines_sql(),
        "op9_warc_archive": warc.pages_sql(),
    }
