"""Maintenance: trust, decay, dedup, promotion, replay, votes and queues. Each returns new rows; nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions import scores
from lorekeep.operators import temporal


def with_lif(facts: DataFrame, now: str) -> DataFrame:
    """Adds ``lif``. Siblings are the subject's facts, so one aggregation by subject gives them all."""
    kin = facts.groupBy("subject_id").agg(F.collect_set("predicate").alias("_kinds"), F.count("*").alias("_n"))
    x = facts.join(kin, "subject_id")
    value = scores.lif(F.col("access_count"), F.col("last_accessed_at"), F.col("sessions"), F.col("_kinds"), F.col("_n"), F.col("extractor"), F.col("fact_type"), temporal.at(now))
    return x.withColumn("lif", value).drop("_kinds", "_n")


def decay(facts: DataFrame, now: str, least: float = 0.1) -> DataFrame:
    """Active facts get their trust anew; those below ``least`` become deprecated."""
    x = with_lif(temporal.live_facts(facts), now)
    return x.withColumn("status", F.when(F.col("lif") < least, "deprecated").otherwise(F.col("status")))


def promote(facts: DataFrame) -> DataFrame:
    """``fact_type`` one step up where trust reaches the step's threshold."""
    up = F.when((F.col("fact_type") == "ephemeral") & (F.col("lif") >= scores.PROMOTE["ephemeral"]), "stable")
    up = up.when((F.col("fact_type") == "stable") & (F.col("lif") >= scores.PROMOTE["stable"]), "permanent").otherwise(F.col("fact_type"))
    return facts.withColumn("fact_type", up)


def merge_duplicates(facts: DataFrame, keys: list[str], oldest: str = "valid_from") -> DataFrame:
    """One row for each key: the oldest fact's id, largest counts, and how many it stands for."""
    first = F.min_by("id", F.struct(oldest, "id")).alias("id")
    return facts.groupBy(*keys).agg(first, F.max("access_count").alias("access_count"), F.max("confidence").alias("confidence"), F.count("*").alias("merged"))


def churn(facts: DataFrame) -> DataFrame:
    """Counts by status and their rates; an empty table has rates of 0."""
    n = F.count("*")
    of = lambda s: F.count_if(F.col("status") == s)
    rate = lambda s: F.when(n == 0, 0.0).otherwise(F.round(of(s) / n, 6))
    return facts.agg(n.alias("total"), of("active").alias("active"), of("superseded").alias("superseded"), of("deprecated").alias("deprecated"), rate("superseded").alias("supersede_rate"), rate("active").alias("active_ratio"))


def replay(signals: DataFrame) -> DataFrame:
    """What a log of hits adds to each fact."""
    return signals.filter("stream = 'recall_hits'").groupBy("fact_no").agg(F.count("*").alias("hits"), F.countDistinct("session_id").alias("sessions"), F.max("ts").alias("last_at"))


def vote(votes: DataFrame, wings: int) -> DataFrame:
    """Triples (``s``, ``p``, ``o``, ``wing``, ``confidence``) with a majority, regardless of case; first surface and largest confidence."""
    low = [F.lower(c).alias(f"_{c}") for c in "spo"]
    g = votes.groupBy(*low).agg(*[F.min_by(c, "wing").alias(c) for c in "spo"], F.max("confidence").alias("confidence"), F.count("*").alias("n"))
    return g.filter(F.col("n") >= -(-wings // 2)).select(*"spo", "confidence", "n")


def dequeue(queue: DataFrame, k: int = 20) -> DataFrame:
    return queue.filter("status = 'pending'").orderBy(F.desc("priority"), "created_at", "id").limit(k)


def decide(new: DataFrame, old: DataFrame, single: tuple[str, ...] = ("supplies",)) -> DataFrame:
    """What an incoming triple (``subject_id``, ``predicate``, ``value``) does: UPDATE an equal one, SUPERSEDE where a predicate holds one value, else ADD."""
    same = old.select("subject_id", "predicate", "value").distinct().withColumn("_same", F.lit(True))
    kin = old.select("subject_id", "predicate").distinct().withColumn("_kin", F.lit(True))
    x = new.join(same, ["subject_id", "predicate", "value"], "left").join(kin, ["subject_id", "predicate"], "left")
    verdict = F.when(F.col("_same"), "UPDATE").when(F.col("_kin") & F.col("predicate").isin(*single), "SUPERSEDE").otherwise("ADD")
    return x.withColumn("decision", verdict).drop("_same", "_kin")


def scenes(turns: DataFrame) -> DataFrame:
    """Turns up to and with an assistant's make a scene: ``conv_id``, ``scene``, ``n``, ``first_turn``, ``last_turn``."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    ended = F.coalesce(F.sum((F.col("role") == "assistant").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return turns.withColumn("scene", ended).groupBy("conv_id", "scene").agg(F.count("*").alias("n"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))


def within_budget(df: DataFrame, by: str, order: list, size: str, budget: int) -> DataFrame:
    """The longest prefix of each group, in order, whose sizes add up to at most the budget."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_sum", F.sum(size).over(w)).filter(F.col("_sum") <= budget).drop("_sum")


def counted(df: DataFrame, by: str) -> DataFrame:
    """Rows by a column, unknown for null, most first."""
    return df.groupBy(F.coalesce(by, F.lit("unknown")).alias(by)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by)


def predicates(facts: DataFrame) -> DataFrame:
    """How often each predicate is used, by how many subjects, and its share of all facts."""
    total = facts.agg(F.count("*").alias("n"))
    return facts.groupBy("predicate").agg(F.count("*").alias("n"), F.countDistinct("subject_id").alias("subjects")).withColumn("share", F.round(F.col("n") / total.scalar(), 6))


def audit(mounts: DataFrame, judged: DataFrame, least: float = 0.3, most: int = 200, reweight=lambda w, j: j) -> DataFrame:
    """Mounts after a judge (``tag_id``, ``atom_id``, ``judged``): the worst ones below ``least`` go, at most so many in a run, others get a new weight."""
    gone = judged.filter(F.col("judged") < least).orderBy("judged", "atom_id", "tag_id").limit(most).select("tag_id", "atom_id")
    x = mounts.join(judged, ["tag_id", "atom_id"], "left").join(gone, ["tag_id", "atom_id"], "left_anti")
    return x.withColumn("w", F.when(F.col("judged").isNull(), F.col("w")).otherwise(reweight(F.col("w"), F.col("judged")))).select(*mounts.columns)


def reuse(members: DataFrame, mounts: DataFrame, share: float = 0.5) -> DataFrame:
    """``k``, ``tag_id``: the tag that holds the most, and at least a share, of each new group's members (``k``, ``atom_id``)."""
    size = members.groupBy("k").agg(F.countDistinct("atom_id").alias("_size"))
    both = members.distinct().join(mounts.select("tag_id", "atom_id").distinct(), "atom_id").groupBy("k", "tag_id").agg(F.count("*").alias("_n"))
    return both.join(size, "k").filter(F.col("_n") >= share * F.col("_size")).groupBy("k").agg(F.min_by("tag_id", F.struct(-F.col("_n"), F.col("tag_id"))).alias("tag_id"))


def covers(asked: DataFrame, answered: DataFrame) -> DataFrame:
    """``key``, ``covered``: whether the answers (``key``, ``id``) are about exactly what was asked."""
    x = asked.select("key", "id").distinct().withColumn("_a", F.lit(1)).join(answered.select("key", "id").distinct().withColumn("_b", F.lit(1)), ["key", "id"], "full")
    return x.groupBy("key").agg(F.min(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("covered"))
