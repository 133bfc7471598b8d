"""Queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, chat, importance, langid, media, ngram_join, packing, quality, secret_scan, sentencepiece_codec, sharding, suffix_dedup, token_output


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_output": token_output.op1_token_output,
        "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
        "op3_language_id": langid.op3_language_id,
        "op4_quality_rules": quality.op4_quality_rules,
        "op5_media_columns": media.op5_media_columns,
        "op6_chat_format": chat.op6_chat_format,
        "op7_ngram_jaccard": ngram_join.op7_ngram_jaccard,
        "op8_best_fit_packing": packing.op8_best_fit_packing,
        "op9_sentencepiece": sentencepiece_codec.op9_sentencepiece,
        "op10_secret_scan": secret_scan.op10_secret_scan,
        "op11_importance_resampling": importance.op11_importance_resampling,
        "op12_sharding": sharding.op12_sharding,
        "op13_token_alignment": alignment.op13_token_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_chat_format": chat.ORACLE, "op11_importance_resampling": importance.ORACLE}
