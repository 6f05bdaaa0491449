"""Queries of the training-data operators over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexaloom.llm import chat, decontaminate, fingerprints, language, mixing, near_join, passage_dedup, substring_dedup, token_files, url_filter
from lexaloom.sources.tables import table as _table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_language_id": lambda spark, d: language.query(_table(spark, d, "documents")),
        "op2_chat_format": lambda spark, d: chat.query(_table(spark, d, "conversations")),
        "op3_suffix_dedup": lambda spark, d: substring_dedup.query(_table(spark, d, "documents")),
        "op4_source_mixing": lambda spark, d: mixing.query(_table(spark, d, "documents")),
        "op5_decontaminate": lambda spark, d: decontaminate.query(_table(spark, d, "documents"), _table(spark, d, "benchmark")),
        "op6_token_files": lambda spark, d: token_files.query(_table(spark, d, "documents")),
        "op7_url_filter": lambda spark, d: url_filter.query(_table(spark, d, "pages")),
        "op8_fingerprints": lambda spark, d: fingerprints.query(_table(spark, d, "documents")),
        "op9_substring_dedup": lambda spark, d: passage_dedup.query(_table(spark, d, "documents")),
        "op10_ngram_join": lambda spark, d: near_join.query(_table(spark, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": chat.SQL, "op4_source_mixing": mixing.SQL, "op5_decontaminate": decontaminate.SQL, "op9_substring_dedup": passage_dedup.SQL}
