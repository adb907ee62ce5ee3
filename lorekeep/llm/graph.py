"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm import blocks


def _to_least(links: DataFrame, larger_only: bool) -> DataFrame:
    """Links every neighbour of a node (the smaller ones and itself, or the larger ones) to the least of its neighbourhood."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if larger_only:
        both = both.unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    out = both.join(least, "u")
    out = out.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")) if larger_only else out.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b")


def forest_roots(links: DataFrame) -> DataFrame:
    """The same as ``components`` for links in which every node has at most one smaller neighbour.

    Each round halves the depth with one join (every node takes the parent of its parent) and is written to the shared folder.
    """
    now = blocks.saved(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    while True:
        up = now.select(F.col("a").alias("_a"), F.col("b").alias("_b"))
        now = blocks.saved(now.join(up, F.col("b") == F.col("_a"), "left").select("a", F.coalesce("_b", "b").alias("b"), F.col("_a").isNotNull().alias("moved")))
        if not now.agg(F.max("moved")).first()[0]:
            return now.select("a", "b")
        now = now.select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """``a``, ``b``: every linked node but the roots, and the root (least node) of its component.

    Alternates the two star steps, which halve distances, until the links no longer change. Each round is written to the shared
    checkpoint folder, so a lost executor costs one round at most.
    """
    now = blocks.saved(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    mark = None
    while True:
        stamp = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if stamp == mark or stamp[0] == 0:
            return now
        mark = stamp
        now = blocks.saved(_to_least(_to_least(now, True), False).distinct())
