"""The queries of the training-data operators and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from lorekeep.llm import q_dedup, q_pii, q_quality, q_scoring, q_tokens, q_urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": q_quality.op1_quality_rules,
        "op2_packing": q_tokens.op2_packing,
        "op3_sentencepiece": q_tokens.op3_sentencepiece,
        "op4_lm_scoring": q_scoring.op4_lm_scoring,
        "op5_pii": q_pii.op5_pii,
        "op6_url_filters": q_urls.op6_url_filters,
        "op7_minhash_near_dedup": q_dedup.op7_minhash_near_dedup,
        "op8_line_dedup": q_dedup.op8_line_dedup,
        "op9_fingerprints": q_dedup.op9_fingerprints,
        "op10_substring_dedup": q_dedup.op10_substring_dedup,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": q_quality.SQL, "op6_url_filters": q_urls.SQL, "op8_line_dedup": q_dedup.OP8_SQL, "op10_substring_dedup": q_dedup.OP10_SQL}
