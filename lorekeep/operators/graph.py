"""Graph operators over edge tables (``a``, ``b``, ``w``), undirected, one row for each pair."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """``df`` without its lineage, by way of the shared checkpoint folder. The folder goes when the driver ends."""
    spark = df.sparkSession
    path = scratch(spark, "graph")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one that the cluster names; a session within one process may do without that."""
    named, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not named and master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = f"{(named or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def edges(facts: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """Entity graph of facts with an object; a pair's weight is 1 or the largest of its extra edges, if that is more."""
    e = facts.filter("object_id is not null and subject_id <> object_id").select("subject_id", "object_id", F.lit(1.0).alias("w"))
    if extra is not None:
        e = e.unionByName(extra.select("subject_id", "object_id", "w"))
    return e.groupBy(F.least("subject_id", "object_id").alias("a"), F.greatest("subject_id", "object_id").alias("b")).agg(F.max("w").alias("w"))


def both_ways(e: DataFrame) -> DataFrame:
    return e.select(F.col("a").alias("u"), F.col("b").alias("v"), "w").unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v"), "w"))


def degrees(e: DataFrame) -> DataFrame:
    return both_ways(e).groupBy("u").agg(F.count("*").alias("degree")).withColumnRenamed("u", "id")


def pagerank(e: DataFrame, rounds: int = 5, alpha: float = 0.85, every: int = 4) -> DataFrame:
    """``id``, ``rank`` after a fixed number of rounds, from equal ranks. Nodes come from edges, so none dangles."""
    two = cut(both_ways(e))
    out = two.groupBy("u").agg(F.sum("w").alias("total"))
    n = out.count()
    rank = out.select(F.col("u").alias("id"), "total", F.lit(1.0 / max(n, 1)).alias("rank"))
    for k in range(rounds):
        sent = two.join(rank, F.col("u") == F.col("id")).groupBy("v").agg(F.sum(F.col("rank") * F.col("w") / F.col("total")).alias("got"))
        rank = out.join(sent, F.col("u") == F.col("v"), "left").select(F.col("u").alias("id"), "total", (F.lit((1 - alpha) / max(n, 1)) + alpha * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if k % every == every - 1 and k + 1 < rounds:
            rank = cut(rank)
    return rank.select("id", "rank")


def centrality(e: DataFrame, tolerance: float = 1e-6, most: int = 100, alpha: float = 0.85) -> DataFrame:
    """``id``, ``rank``: PageRank until the ranks change by less than ``tolerance`` a node on average, or ``most`` rounds, divided by the largest."""
    two = cut(both_ways(e))
    out = cut(two.groupBy("u").agg(F.sum("w").alias("total")))
    n = max(out.count(), 1)
    rank = out.select(F.col("u").alias("id"), F.lit(1.0 / n).alias("rank"))
    for _ in range(most):
        sent = two.join(rank.join(out.withColumnRenamed("u", "id"), "id"), F.col("u") == F.col("id")).groupBy("v").agg(F.sum(F.col("rank") * F.col("w") / F.col("total")).alias("got"))
        new = rank.join(sent, F.col("id") == F.col("v"), "left").select("id", (F.lit((1 - alpha) / n) + alpha * F.coalesce("got", F.lit(0.0))).alias("new"), "rank")
        new = cut(new)
        off = new.agg(F.sum(F.abs(F.col("new") - F.col("rank")))).first()[0] or 0.0
        rank = new.select("id", F.col("new").alias("rank"))
        if off < n * tolerance:
            break
    most_ = rank.agg(F.max("rank").alias("m"))
    return rank.withColumn("rank", F.col("rank") / most_.scalar())


def fact_centrality(facts: DataFrame, ranks: DataFrame) -> DataFrame:
    """Facts with ``centrality``, the larger of their ends' ranks; 0 for ends without one."""
    x = facts.join(ranks.select(F.col("id").alias("subject_id"), F.col("rank").alias("_rs")), "subject_id", "left").join(ranks.select(F.col("id").alias("object_id"), F.col("rank").alias("_ro")), "object_id", "left")
    return x.withColumn("centrality", F.greatest(F.coalesce("_rs", F.lit(0.0)), F.coalesce("_ro", F.lit(0.0)))).drop("_rs", "_ro")


def bfs(e: DataFrame, seeds: DataFrame, hops: int = 2, cap: int | None = 50) -> DataFrame:
    """``id``, ``hop``: least distance from any seed; of more than ``cap`` nodes the nearest (by hop, then id) stay."""
    two = both_ways(e).select("u", "v")
    seen = seeds.select("id").distinct().withColumn("hop", F.lit(0))
    edge = seen
    for h in range(1, hops + 1):
        new = two.join(edge.select(F.col("id").alias("u")), "u").select(F.col("v").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        edge = cut(new.withColumn("hop", F.lit(h)))
        seen = seen.unionByName(edge)
    return seen if cap is None else seen.orderBy("hop", "id").limit(cap)


def components(e: DataFrame) -> DataFrame:
    """``id``, ``root`` (least id), by passing least labels along edges and from labels to their own labels."""
    two = cut(both_ways(e).select("u", "v"))
    label = two.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("root"))
    while True:
        near = two.join(label.withColumnRenamed("u", "x"), F.col("v") == F.col("x")).groupBy("u").agg(F.min("root").alias("r"))
        step = label.join(near, "u").select("u", F.least("root", "r").alias("new"), "root")
        jump = step.select(F.col("u").alias("y"), F.col("new").alias("far"))
        new = cut(step.join(jump, F.col("new") == F.col("y"), "left").select("u", F.least("new", F.coalesce("far", "new")).alias("new"), "root"))
        if new.filter("new <> root").isEmpty():
            return new.select(F.col("u").alias("id"), F.col("new").alias("root"))
        label = new.select("u", F.col("new").alias("root"))


def quotient(e: DataFrame, member: DataFrame, more_than: int = 2) -> DataFrame:
    """Edges between groups (``id``, ``community``) that more than so many member edges join."""
    x, y = member.select(F.col("id").alias("a"), F.col("community").alias("p")), member.select(F.col("id").alias("b"), F.col("community").alias("q"))
    j = e.join(x, "a").join(y, "b").filter("p <> q")
    return j.groupBy(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).agg(F.count("*").alias("w")).filter(F.col("w") > more_than)
