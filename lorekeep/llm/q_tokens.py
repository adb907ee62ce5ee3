from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lorekeep.llm import packing, pieces


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return packing.documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pieces.digests(docs, public_tokenizers.path("piece_bpe_32k.model"))
