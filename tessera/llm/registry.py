"""Queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontamination, filter_audit, hard_negatives, html_text, jaccard_join, media, mixing, nearest, quality, secrets, span_dedup, token_count, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_span_dedup": span_dedup.op1_span_dedup,
        "op2_jaccard_join": jaccard_join.op2_jaccard_join,
        "op3_mixing": mixing.op3_mixing,
        "op4_quality": quality.op4_quality,
        "op5_html_text": html_text.op5_html_text,
        "op6_token_counts": token_count.op6_token_counts,
        "op7_decontamination": decontamination.op7_decontamination,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_media": media.op9_media,
        "op10_secrets": secrets.op10_secrets,
        "op11_filter_audit": filter_audit.op11_filter_audit,
        "op12_nearest": nearest.op12_nearest,
        "op13_hard_negatives": hard_negatives.op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_jaccard_join": jaccard_join.ORACLE_SQL,
        "op3_mixing": mixing.ORACLE_SQL,
        "op7_decontamination": decontamination.ORACLE_SQL,
        "op11_filter_audit": filter_audit.ORACLE_SQL,
        "op13_hard_negatives": hard_negatives.ORACLE_SQL,
    }
