"""Taking in facts and entities: defaults, resolution, aliases, verdicts on what is new, queues, settlement and reinforcement.

Judges are columns of verdicts or functions of columns, so a model, a rule or a stub may give them; where one is missing nothing is overruled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions import extract, scores
from lorekeep.operators import graph, temporal

# Predicates that hold many values at once, and how often a job is tried.
MULTIVALUE = ("uses", "depends_on", "contains", "implements", "connected_to", "part_of", "relates_to")
TRIES, ALIASES, SAMPLE = 3, 32, 5


def with_defaults(new: DataFrame, now: str) -> DataFrame:
    """Facts (``id``, ``subject_id``, ``predicate``, ``value``, ``extractor``, ``provenance``) with a start, a source weight and a veracity where they have none."""
    have = lambda c: F.col(c) if c in new.columns else F.lit(None)
    more = {
        "valid_from": F.coalesce(have("valid_from").cast("timestamp"), temporal.at(now)),
        "status": F.coalesce(have("status").cast("string"), F.lit("active")),
        "lif_source": F.coalesce(have("lif_source").cast("double"), scores.trust(F.col("extractor"))),
        "veracity": F.coalesce(have("veracity").cast("double"), extract.veracity(F.col("provenance"))),
    }
    return new.withColumns(more)


def resolve(names: DataFrame, entities: DataFrame, near: DataFrame | None = None, least: float = 0.5) -> DataFrame:
    """``name``, ``entity_type``, ``id`` (null: to be created), ``how``: an exact name, else an alias, else the most likely of ``near`` (``name``, ``id``, ``confidence``, a judge's choice).

    Of entities that share a name or alias the oldest counts; case does not matter.
    """
    known = entities.select(F.lower("name").alias("_k"), "id", "created_at", F.lit(0).alias("_way"))
    known = known.unionByName(entities.select(F.explode(F.transform("aliases", F.lower)).alias("_k"), "id", "created_at", F.lit(1).alias("_way")))
    first = known.groupBy("_k").agg(F.min(F.struct("_way", "created_at", "id")).alias("_e"))
    x = names.select("name", "entity_type").distinct().join(first, F.lower("name") == F.col("_k"), "left")
    way = F.when(F.col("_e._way") == 0, "name").when(F.col("_e._way") == 1, "alias")
    if near is None:
        return x.select("name", "entity_type", F.col("_e.id").alias("id"), F.coalesce(way, F.lit("create")).alias("how"))
    best = near.filter(F.col("confidence") >= least).groupBy("name").agg(F.max_by("id", F.struct("confidence", "id")).alias("_near"))
    x = x.join(best, "name", "left")
    return x.select("name", "entity_type", F.coalesce("_e.id", "_near").alias("id"), F.coalesce(way, F.when(F.col("_near").isNotNull(), "judge"), F.lit("create")).alias("how"))


def aliases(old: Column, add: Column | None = None, remove: Column | None = None, name: Column | None = None, most: int = ALIASES) -> Column:
    """A list of aliases with more and less: in order, once each, without the entity's own name, ``most`` at the longest."""
    out = F.coalesce(old, F.array().cast("array<string>"))
    out = F.concat(out, add) if add is not None else out
    out = F.filter(F.array_distinct(out), lambda a: F.trim(a) != "")
    out = F.array_except(out, remove) if remove is not None else out
    out = F.array_except(out, F.array(name)) if name is not None else out
    return F.slice(out, 1, most)


def dictionary(entities: DataFrame) -> DataFrame:
    """``surface`` (lower case), ``id``, ``name``: every name and alias once, of the oldest entity that has it."""
    both = entities.select("id", "name", "created_at", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("surface"))
    return both.groupBy(F.lower("surface").alias("surface")).agg(F.min(F.struct("created_at", "id", "name")).alias("e")).select("surface", "e.id", "e.name")


def decide(new: DataFrame, old: DataFrame) -> DataFrame:
    """What each incoming triple (``subject_id``, ``predicate``, ``value``, ``extractor``, ``contradicts``: a judge's verdict) does to the live ones.

    UPDATE where the value is known; ADD where the predicate holds many values, has none yet or the judge sees no contradiction; SUPERSEDE where it does,
    but NOOP (a pending signal) where any contradicted fact has a source of more trust.
    """
    key = ["subject_id", "predicate"]
    same = old.select(*key, "value").distinct().withColumn("_same", F.lit(True))
    kin = old.groupBy(*key).agg(F.max(scores.trust(F.col("extractor"))).alias("_trust"))
    x = new.join(same, [*key, "value"], "left").join(kin, key, "left")
    clash = F.coalesce(F.col("contradicts"), F.lit(False)) & ~F.col("predicate").isin(*MULTIVALUE) & F.col("_trust").isNotNull()
    verdict = F.when(F.col("_same"), "UPDATE").when(~clash, "ADD").when(scores.trust(F.col("extractor")) < F.col("_trust"), "NOOP").otherwise("SUPERSEDE")
    return x.withColumn("decision", verdict).drop("_same", "_trust")


def refreshed(facts: DataFrame, hits: DataFrame) -> DataFrame:
    """Facts with the recalls of ``hits`` (``id``, ``session_id``, ``at``): counts, the last instant and the sessions grow; a restricted fact only gains observed sessions.

    Hits on facts that are not there are dropped, however late they come.
    """
    g = hits.groupBy("id").agg(F.count("*").alias("_n"), F.max("at").alias("_at"), F.collect_set("session_id").alias("_s"))
    x = facts.join(g, "id", "left")
    full = F.col("_n").isNotNull() & ~extract.restricted(F.col("extractor"), F.lit(None).cast("double"), F.lit(0))
    out = {
        "access_count": F.col("access_count") + F.when(full, F.col("_n")).otherwise(0),
        "last_accessed_at": F.when(full, F.greatest("last_accessed_at", "_at")).otherwise(F.col("last_accessed_at")),
        "seen_sessions": F.coalesce(F.size("_s"), F.lit(0)).cast("long"),
    }
    return x.withColumns(out).drop("_n", "_at", "_s")


def human_edits(facts: DataFrame, edits: DataFrame, more: float = 0.05) -> DataFrame:
    """Facts after people deleted their files (superseded) or changed them (more confidence, 1 at most); live ones only. ``edits``: ``id``, ``op``."""
    op = edits.groupBy("id").agg(F.max((F.col("op") == "deleted").cast("int")).alias("_gone"))
    x = facts.join(op, "id", "left")
    live = (F.col("status") == "active") & F.col("_gone").isNotNull()
    out = {
        "confidence": F.when(live & (F.col("_gone") == 0), F.least(F.lit(1.0), F.col("confidence") + more)).otherwise(F.col("confidence")),
        "status": F.when(live & (F.col("_gone") == 1), "superseded").otherwise(F.col("status")),
    }
    return x.withColumns(out).drop("_gone")


def step(queue: DataFrame, outcomes: DataFrame) -> DataFrame:
    """A queue (``id``, ``status``, ``attempts``) after some of its running jobs ended: ``outcomes`` has ``id`` and ``result`` (done, failed, suspended).

    A failed job waits again until it failed TRIES times, then it is dead; a suspended one waits without losing a try.
    """
    x = queue.join(outcomes.select("id", "result"), "id", "left")
    tried = F.col("attempts") + F.when(F.col("result") == "failed", 1).otherwise(0)
    status = F.when(F.col("result") == "done", "done").when((F.col("result") == "failed") & (tried >= TRIES), "dead").when(F.col("result").isNotNull(), "pending").otherwise(F.col("status"))
    return x.withColumns({"status": status, "attempts": tried}).drop("result")


def settle(proposals: DataFrame, atoms: DataFrame, near: DataFrame | None = None, least: float = 0.9) -> DataFrame:
    """Pairs ``old_id``, ``new_id`` of live atoms for proposals (``old_text``, ``new_text``): by their exact texts (of equal ones the oldest), or else, for
    the old one, the nearest of ``near`` (``old_text``, ``id``, ``sim``) that is similar enough."""
    live = temporal.live_atoms(atoms).groupBy("text").agg(F.min("id").alias("id"))
    x = proposals.join(live.select(F.col("text").alias("old_text"), F.col("id").alias("_old")), "old_text", "left").join(live.select(F.col("text").alias("new_text"), F.col("id").alias("new_id")), "new_text")
    if near is not None:
        best = near.filter(F.col("sim") >= least).groupBy("old_text").agg(F.max_by("id", F.struct("sim", -F.col("id"))).alias("_near"))
        x = x.join(best, "old_text", "left").withColumn("_old", F.coalesce("_old", "_near"))
    return x.filter("_old is not null and _old <> new_id").select(F.col("_old").alias("old_id"), "new_id").distinct()


def all_sources_gone(items: DataFrame, gone: DataFrame) -> DataFrame:
    """``id`` of items (``id``, ``source_refs``) that have sources, all of them among ``gone`` (``ref``)."""
    refs = items.select("id", F.explode(F.array_distinct("source_refs")).alias("ref"))
    left = refs.join(gone.select("ref").distinct().withColumn("_g", F.lit(1)), "ref", "left")
    return left.groupBy("id").agg(F.min(F.coalesce("_g", F.lit(0))).alias("_all")).filter("_all = 1").select("id")


def merged(facts: DataFrame, now: str, key: list[str]) -> DataFrame:
    """One fact for each key (of live ones): the oldest id, the largest of each measure, all sessions and references, the extractor of most trust, and trust (``lif``) anew."""
    tiers = F.struct(scores.trust(F.col("extractor")).alias("t"), "extractor")
    lists = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("session_ids", "source_refs") if c in facts.columns]
    g = facts.groupBy(*key).agg(
        F.min_by("id", F.struct("valid_from", "id")).alias("id"), F.max("access_count").alias("access_count"), F.max("sessions").alias("sessions"), F.max("last_accessed_at").alias("last_accessed_at"),
        F.max("confidence").alias("confidence"), F.max(tiers).alias("_e"), F.min_by("fact_type", F.struct("valid_from", "id")).alias("fact_type"), F.count("*").alias("merged"), *lists,
    )
    g = g.withColumn("extractor", F.col("_e.extractor")).drop("_e")
    lif = scores.lif(F.col("access_count"), F.col("last_accessed_at"), F.col("sessions"), F.array("predicate"), F.lit(1), F.col("extractor"), F.col("fact_type"), temporal.at(now))
    return g.withColumn("lif", lif)


def extractor_quality(facts: DataFrame, least: int = SAMPLE) -> DataFrame:
    """``extractor``, ``n``, ``upgraded``, ``contradicted`` (rates) and what its weight should change by; few samples say nothing."""
    rate = lambda s: F.avg((F.col("status") == s).cast("int"))
    g = facts.groupBy("extractor").agg(F.count("*").alias("n"), F.avg((F.col("fact_type") != "ephemeral").cast("int")).alias("upgraded"), rate("superseded").alias("contradicted")).filter(F.col("n") >= least)
    weight = scores.trust(F.col("extractor"))
    change = F.when(F.col("contradicted") >= 0.3, F.greatest(F.lit(0.1), weight - 0.05) - weight).when(F.col("upgraded") >= 0.5, 0.05).otherwise(0.0)
    return g.withColumn("change", F.round(change, 6))


def vote(votes: DataFrame, wings: int) -> DataFrame:
    """Triples (``s``, ``p``, ``o``, ``wing``, ``topic``, ``confidence``) that at least half of the wings give, regardless of case: first surface, first topic that says anything, largest confidence."""
    low = [F.lower(c).alias(f"_{c}") for c in "spo"]
    g = votes.groupBy(*low).agg(*[F.min_by(c, "wing").alias(c) for c in "spo"], F.min_by("topic", F.when(F.trim(F.coalesce("topic", F.lit(""))) != "", F.col("wing"))).alias("topic"), F.max("confidence").alias("confidence"), F.count("*").alias("n"))
    return g.filter(F.col("n") >= -(-wings // 2)).select(*"spo", "topic", "confidence", "n")


def majority(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``key``, ``value``: the value that most rows of a key have, the least of equals."""
    g = rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_n"))
    return g.groupBy(key).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(value))


def distribution(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Count, mean, ends and quartiles (the element at that share of the way through the sorted values)."""
    w = Window.partitionBy(*(by or [])).orderBy(value)
    g = df.groupBy(*(by or []))
    at = lambda p: F.get(F.col("_v"), F.floor(F.size("_v") * p).cast("int"))
    if by:
        g = df.withColumns({"_r": F.row_number().over(w) - 1, "_n": F.count("*").over(Window.partitionBy(*by))}).groupBy(*by)
        pick = lambda p: F.max(F.when(F.col("_r") == F.least(F.floor(F.col("_n") * p), F.col("_n") - 1), F.col(value)))
        return g.agg(F.count("*").alias("n"), F.min(value).alias("least"), pick(0.25).alias("p25"), pick(0.5).alias("median"), pick(0.75).alias("p75"), F.max(value).alias("most"), F.avg(value).alias("mean"))
    q = g.agg(F.count("*").alias("n"), F.min(value).alias("least"), F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"), F.max(value).alias("most"), F.avg(value).alias("mean"))
    return q.select("n", "least", F.col("_q")[0].alias("p25"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("p75"), "most", "mean")


def capped(df: DataFrame, order: list, most: int) -> tuple[DataFrame, Column]:
    """The first ``most`` rows, and how many a later run has left to do."""
    return df.orderBy(*order).limit(most), F.greatest(F.lit(0), F.count("*") - most)


def sample(df: DataFrame, key: str, seed: int, most: int) -> DataFrame:
    """``most`` rows that depend on the seed alone, by the order of their keys' hashes."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(most)


def stride(groups: DataFrame, order: str, every: int) -> DataFrame:
    """Every so many-th group in order, nulls last. Numbers come from counts of ranges of the order, so no task sees all groups.

    The ranges are written once: their ends come from a sample and their number from their sizes, so they may differ each time they are made.
    """
    by = F.col(order).asc_nulls_last()
    parts = groups.repartitionByRange(by).sortWithinPartitions(by).withColumn("_i", F.monotonically_increasing_id())
    numbered = graph.cut(parts).withColumns({"_p": F.shiftright("_i", 33), "_o": F.col("_i").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = sorted((r["_p"], r["count"]) for r in numbered.groupBy("_p").count().collect())  # one row for each range
    before, total = [], 0
    for p, n in sizes:
        before.append((p, total))
        total += n
    starts = groups.sparkSession.createDataFrame(before, "_p long, _b long")
    return numbered.join(F.broadcast(starts), "_p").filter((F.col("_o") + F.col("_b")) % every == 0).drop("_i", "_p", "_o", "_b")
