from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm import pii


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pii.find(docs).select(
        "doc_id",
        *[c.alias(k) for k, c in pii.counts().items()],
        F.sha2(pii.joined(pii.BASE), 256).alias("base_sha256"),
        pii.joined(tuple(k.name for k in pii.KINDS)).alias("spans"),
    )
