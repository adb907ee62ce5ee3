"""The engine's tables, built from parquet: atoms, vectors, tags, mounts, entities, facts, signals and transcripts.

Every loader takes (spark, folder) and stays lazy, so filters and column choices reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "2024-01-01 00:00:00"
# The six labels of an atom.
LABELS = ("fact", "judgment", "experience", "summary", "preference", "event")
# Which log stream an event type belongs to.
STREAMS = {"view": "recall_hits", "click": "confirm_arrivals", "purchase": "citations", "signup": "agent_crud", "error": "contradiction_pending"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _after(days) -> F.Column:
    return F.expr(f"timestamp_seconds(unix_seconds(timestamp '{EPOCH}') + cast({days} as bigint))")


def atoms(spark: SparkSession, folder: str) -> DataFrame:
    """Text records with validity, durability and scope."""
    d = table(spark, folder, "documents").select("doc_id", "text", "source")
    q = table(spark, folder, "labels").select("doc_id", "quality")
    rows = d.join(q, "doc_id", "left")
    return rows.select(
        F.col("doc_id").alias("id"),
        "text",
        F.element_at(F.array(*map(F.lit, LABELS)), (F.col("doc_id") % 6 + 1).cast("int")).alias("label"),
        F.when(F.col("quality").isNull(), 0.0).when(F.col("quality") == 1, 0.8).otherwise(0.3).alias("p_dur"),
        F.concat(F.lit("/ws/"), "source").alias("source_cwd"),
        _after("doc_id * 3600").alias("valid_from"),
        F.when(F.col("doc_id") % 7 == 0, _after("doc_id * 3600 + 2592000")).alias("valid_to"),
        F.when(F.col("doc_id") % 3 == 0, _after("doc_id * 3600 + (doc_id % 40) * 86400")).alias("last_seen_at"),
        F.col("quality").isNull().alias("needs_audit"),
    )


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """``id`` and ``v``, in double."""
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").alias("tag_id"))


def tags(spark: SparkSession, folder: str) -> DataFrame:
    """One semantic tag for each vector label, under two parents."""
    t = table(spark, folder, "embeddings").select(F.col("label").cast("long").alias("tag_id")).distinct()
    return t.select("tag_id", F.concat(F.lit("tag"), "tag_id").alias("name"), F.lit("semantic").alias("kind"), (100 + F.col("tag_id") % 2).alias("parent_id"))


def facts(spark: SparkSession, folder: str) -> DataFrame:
    """Supplier-part facts with access statistics."""
    li = table(spark, folder, "lineitem")
    g = li.groupBy("l_suppkey", "l_partkey").agg(
        F.count("*").alias("access_count"), F.countDistinct("l_orderkey").alias("sessions"), F.max("l_shipdate").cast("timestamp").alias("last_accessed_at"), F.min("l_shipdate").cast("timestamp").alias("valid_from")
    )
    names = ("supplies", "uses", "avoids", "likes", "dislikes")
    return g.select(
        F.concat(F.lit("f:"), "l_suppkey", F.lit(":"), "l_partkey").alias("id"),
        F.concat(F.lit("s:"), "l_suppkey").alias("subject_id"),
        F.element_at(F.array(*map(F.lit, names)), (F.col("l_partkey") % 5 + 1).cast("int")).alias("predicate"),
        F.concat(F.lit("p:"), "l_partkey").alias("object_id"),
        F.element_at(F.array(*map(F.lit, ("ephemeral", "stable", "permanent"))), (F.col("l_partkey") % 3 + 1).cast("int")).alias("fact_type"),
        F.element_at(F.array(*map(F.lit, ("regex", "llm", "human", "vote", "agent"))), ((F.col("l_suppkey") + F.col("l_partkey")) % 5 + 1).cast("int")).alias("extractor"),
        "access_count", "sessions", "last_accessed_at", "valid_from",
        F.when(F.col("l_partkey") % 11 == 0, F.expr("valid_from + interval 365 days")).alias("valid_to"),
        F.when(F.col("l_partkey") % 11 == 0, "superseded").when(F.col("l_partkey") % 13 == 0, "deprecated").otherwise("active").alias("status"),
        ((F.col("l_suppkey") * 7 + F.col("l_partkey")) % 10 / 10.0).alias("confidence"),
    )


def entities(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "supplier").select(F.concat(F.lit("s:"), "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("supplier").alias("entity_type"))
    p = table(spark, folder, "part").select(F.concat(F.lit("p:"), "p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit("part").alias("entity_type"))
    return s.unionByName(p)


def signals(spark: SparkSession, folder: str) -> DataFrame:
    """Log records: stream, time, fact, session, score."""
    e = table(spark, folder, "events")
    stream = F.create_map(*[F.lit(x) for kv in STREAMS.items() for x in kv])
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), stream[F.col("event_type")].alias("stream"), (F.col("user_id") % 50).alias("fact_no"), F.col("user_id").alias("session_id"), F.col("value").alias("score"))


def transcripts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations")
