"""Streaming: windows with a watermark, and a ledger that applies each record once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators import graph


def windowed(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by tumbling window and type. Times without zone are UTC; on a stream, later records than ``late`` are dropped."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", late) if events.isStreaming else e
    g = e.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", "total")


def once(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct records of the events files, read as a stream. Each batch skips what the ledger already has, so replays change nothing."""
    base = graph.scratch(spark, "ledger")
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    ledger = f"{base}/ledger"
    kinds = "sha string, event_id bigint, event_type string, user_id bigint"
    spark.createDataFrame([], kinds).write.parquet(ledger)

    def apply(batch: DataFrame, epoch: int) -> None:
        rows = batch.withColumn("sha", F.sha2(F.concat_ws("|", "event_id", "ts", "user_id", "event_type"), 256)).dropDuplicates(["sha"])
        seen = spark.read.schema(kinds).parquet(ledger).select("sha")
        rows.join(seen, "sha", "left_anti").select("sha", "event_id", "event_type", "user_id").write.mode("append").parquet(ledger)

    # A stream reads folders; a table of one file is found in its parent by name.
    single = all(f.endswith("/events.parquet") for f in spark.read.parquet(f"{folder}/events.parquet").inputFiles())
    reader = spark.readStream.schema(schema)
    source = reader.option("pathGlobFilter", "events.parquet").parquet(folder) if single else reader.parquet(f"{folder}/events.parquet")
    q = source.writeStream.foreachBatch(apply).option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(kinds).parquet(ledger)
