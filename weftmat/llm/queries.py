"""The training-data queries and their SQL, for __spark_entry__.py, which adds the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftmat.llm import chat, exact_dedup, licenses, near_dedup, packing, quality_model, quality_rules, secrets, sentence_pieces, token_counts
from weftmat.llm.common import table
from weftmat.llm.sql import ORACLE


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    docs = lambda f: lambda spark, sf_dir: f(table(spark, sf_dir, "documents"))
    return {
        "op1_secrets": docs(secrets.secret_report),
        "op2_quality_model": lambda spark, sf_dir: quality_model.score_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
        "op3_sentence_pieces": docs(sentence_pieces.piece_report),
        "op4_exact_dedup": docs(exact_dedup.dedup_report),
        "op5_packing": docs(packing.pack),
        "op6_near_dedup": docs(near_dedup.near_report),
        "op7_token_counts": docs(token_counts.token_report),
        "op8_quality_rules": docs(quality_rules.quality_report),
        "op9_chat": lambda spark, sf_dir: chat.chat_report(spark, table(spark, sf_dir, "conversations")),
        "op10_licenses": docs(licenses.license_report),
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
