from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorekeep.llm import scoring


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
