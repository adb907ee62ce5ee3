"""Ranked retrieval: candidate legs, scores, floor, rank, and the wings that widen a result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions import scores, text
from lorekeep.operators import temporal

FLOOR, SIM_LEAST, EDGE_LEAST, PER_HIT, WING = 0.3, 0.30, 0.5, 4, 8


def text_leg(atoms: DataFrame, query: str) -> DataFrame:
    """Atoms that hold any token of the query, with their match."""
    q = F.lit(query)
    tokens = text.query_tokens(q)
    hit = F.exists(tokens, lambda t: F.contains(F.lower("text"), t))
    return atoms.filter(hit).withColumn("match", text.match_item(F.col("text"), tokens, q))


def rank(df: DataFrame, k: int | None) -> DataFrame:
    out = df.orderBy(F.desc("score"), "id")
    return out if k is None else out.limit(k)


def recall(atoms: DataFrame, query: str, now: str, *, as_of: str | None = None, cwd: str | None = None, sims: DataFrame | None = None, k: int | None = 10) -> DataFrame:
    """Atom recall: text leg and, with ``sims`` (``id``, ``sim``), the vector leg; freshness, score, floor, rank."""
    a = temporal.live_atoms(atoms, as_of)
    a = temporal.in_scope(a, cwd) if cwd else a
    hits = text_leg(a, query).withColumn("leg_text", F.lit(True))
    if sims is not None:
        found = a.join(sims.filter(F.col("sim") >= SIM_LEAST), "id")
        hits = hits.join(sims, "id", "left").unionByName(found.join(hits.select("id"), "id", "left_anti").withColumns({"match": F.lit(0.0), "leg_text": F.lit(False)}))
    else:
        hits = hits.withColumn("sim", F.lit(0.0))
    fresh = scores.freshness(F.col("label"), F.coalesce("last_seen_at", "valid_from"), temporal.at(now))
    mem = scores.mem_score(F.col("p_dur") * fresh, F.col("p_dur") * fresh)
    score = scores.fact_score(F.col("match"), F.lit(0.0), mem, F.coalesce("sim", F.lit(0.0)), F.lit(0.0))
    return rank(hits.withColumn("score", F.round(score, 6)).filter((F.col("score") >= FLOOR) | ~F.col("leg_text")), k)


def tag_wing(hits: DataFrame, mounts: DataFrame, per_atom: int = 2, total: int = WING) -> DataFrame:
    """Siblings of the hits under their strongest tags, hits excluded: ``id``, ``w``. ``mounts``: ``tag_id``, ``atom_id``, ``w``."""
    own = mounts.join(hits.select(F.col("id").alias("atom_id")), "atom_id").withColumn("r", F.row_number().over(Window.partitionBy("atom_id").orderBy(F.desc("w"), "tag_id"))).filter(F.col("r") <= per_atom)
    found = mounts.join(own.select("tag_id").distinct(), "tag_id", "left_semi").groupBy(F.col("atom_id").alias("id")).agg(F.max("w").alias("w"))
    return found.join(hits.select("id"), "id", "left_anti").filter("w > 0").orderBy(F.desc("w"), "id").limit(total)


def edge_wing(hits: DataFrame, edges: DataFrame, least: float = EDGE_LEAST, per_hit: int = PER_HIT, total: int = WING) -> DataFrame:
    """Neighbours of the hits over strong edges: at most so many for a hit, each once with its strongest edge."""
    two = edges.select(F.col("a").alias("hit"), F.col("b").alias("id"), "w").unionByName(edges.select(F.col("b").alias("hit"), F.col("a").alias("id"), "w"))
    near = two.filter(F.col("w") >= least).join(hits.select(F.col("id").alias("hit")), "hit", "left_semi").join(hits.select("id"), "id", "left_anti")
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("hit").orderBy(F.desc("w"), "id"))).filter(F.col("r") <= per_hit)
    return near.groupBy("id").agg(F.max("w").alias("w")).orderBy(F.desc("w"), "id").limit(total)


def parent_climb(hits: DataFrame, mounts: DataFrame, tags: DataFrame, total: int = WING) -> DataFrame:
    """Atoms under the other children of the parents of the hits' tags, hits excluded: ``id``, ``w``."""
    own = mounts.join(hits.select(F.col("id").alias("atom_id")), "atom_id", "left_semi").select("tag_id").distinct()
    up = tags.join(own, "tag_id", "left_semi").select("parent_id").distinct()
    kin = tags.join(up, "parent_id", "left_semi").join(own, "tag_id", "left_anti").select("tag_id")
    found = mounts.join(kin, "tag_id", "left_semi").groupBy(F.col("atom_id").alias("id")).agg(F.max("w").alias("w"))
    return found.join(hits.select("id"), "id", "left_anti").orderBy(F.desc("w"), "id").limit(total)


def quota(df: DataFrame, anchor: str, each: int = 3, total: int = WING) -> DataFrame:
    """The best rows by ``score``, at most ``each`` for an anchor."""
    own = df.withColumn("_r", F.row_number().over(Window.partitionBy(anchor).orderBy(F.desc("score"), "id"))).filter(F.col("_r") <= each).drop("_r")
    return own.orderBy(F.desc("score"), "id").limit(total)


def fact_recall(facts: DataFrame, entities: DataFrame, query: str, k: int | None = 10, floor: float = 0.0) -> DataFrame:
    """Live facts about the entities that the query names, and about their neighbours: ``id``, ``match``, ``hop``, ``score``.

    An entity is named where its name holds a token of the query. A fact's match counts both of its names, its hop is 0 where an end
    is named and 1 where an end is a neighbour of a named one.
    """
    live = temporal.live_facts(facts).select("id", "subject_id", "predicate", "object_id", "confidence")
    tokens = text.query_tokens(F.lit(query))
    named = entities.filter(F.exists(tokens, lambda t: F.contains(F.lower("name"), t))).select("id")
    touched = temporal.touching(live, named)
    near = touched.select(F.col("subject_id").alias("id")).unionByName(touched.select(F.col("object_id").alias("id"))).distinct()
    hits = temporal.touching(live, near).join(touched.select("id").withColumn("hop", F.lit(0)), "id", "left").withColumn("hop", F.coalesce("hop", F.lit(1)))
    names = entities.select("id", "name")
    hits = hits.join(names.select(F.col("id").alias("subject_id"), F.col("name").alias("_s")), "subject_id", "left").join(names.select(F.col("id").alias("object_id"), F.col("name").alias("_o")), "object_id", "left")
    hits = hits.withColumn("match", text.match_item(F.concat_ws(" ", "_s", "predicate", "_o"), tokens, F.lit(query)))
    score = scores.fact_score(F.col("match"), F.lit(0.0), scores.mem_score(F.col("confidence"), F.col("confidence")), F.lit(0.0), scores.hop_decay(F.col("hop")))
    out = hits.withColumn("score", F.round(score, 6)).filter(F.col("score") >= floor)
    return rank(out.select("id", F.round("match", 6).alias("match"), "hop", "score"), k)


def named(entities: DataFrame, tokens: list[str]) -> DataFrame:
    """Entities whose name holds a token; in a token _ and % stand for any character and any characters."""
    hit = F.lit(False)
    for t in tokens:
        hit = hit | F.lower("name").like(f"%{t.lower()}%")
    return entities.filter(hit)


def value_leg(facts: DataFrame, tokens: list[str]) -> DataFrame:
    """Facts whose value holds a token."""
    return facts.filter(F.exists(F.array(*[F.lit(t.lower()) for t in tokens]), lambda t: F.contains(F.lower("value"), t)))


def anchored(subjects: Column, query: Column, tokens: Column) -> Column:
    """Whether any subject stands in the query or holds one of its tokens."""
    low = F.lower(query)
    return F.exists(F.transform(subjects, F.lower), lambda s: (s != "") & (F.contains(low, s) | F.exists(tokens, lambda t: F.contains(s, t))))


def lanes(atoms: DataFrame, now: str, budget: int = 400, each: int = 3) -> DataFrame:
    """What is always shown: the most durable preferences and the events nearest to now, as far as the bytes of their texts fit."""
    live, t = temporal.live_atoms(atoms), temporal.at(now)
    keep = live.filter("label = 'preference'").orderBy(F.desc("p_dur"), "id").limit(each).select("id", "text", F.lit("preference").alias("lane"), F.lit(0).alias("_l"), (-F.col("p_dur")).alias("_o"))
    far = F.abs(F.unix_seconds("valid_from") - F.unix_seconds(t)).cast("double")
    soon = live.filter((F.col("label") == "event") & F.col("valid_from").between(t - F.expr("interval 7 days"), t + F.expr("interval 21 days")))
    soon = soon.orderBy(far, "id").limit(each).select("id", "text", F.lit("event").alias("lane"), F.lit(1).alias("_l"), far.alias("_o"))
    w = Window.partitionBy(F.lit(1)).orderBy("_l", "_o", "id").rowsBetween(Window.unboundedPreceding, 0)  # six rows
    return keep.unionByName(soon).withColumn("_s", F.sum(F.octet_length("text")).over(w)).filter(F.col("_s") <= budget).drop("_s", "_l", "_o")


def unmounted(atoms: DataFrame, mounts: DataFrame) -> DataFrame:
    return atoms.join(mounts.select(F.col("atom_id").alias("id")), "id", "left_anti")


def with_names(facts: DataFrame, subjects: DataFrame, objects: DataFrame) -> DataFrame:
    """Facts with the names of their ends; one whose subject is not there goes, one whose object is not there stays."""
    x = facts.join(subjects.select(F.col("id").alias("subject_id"), F.col("name").alias("subject")), "subject_id")
    return x.join(objects.select(F.col("id").alias("object_id"), F.col("name").alias("object")), "object_id", "left")


def as_facts(atoms: DataFrame) -> DataFrame:
    """Atoms in the shape of facts."""
    return atoms.select(F.concat(F.lit("atom:"), "id").alias("id"), F.col("text").alias("value"), F.col("p_dur").alias("LIF"), F.col("p_dur").alias("confidence"), "label", "source_cwd", "valid_from", "valid_to")


def json_paths(df: DataFrame, needle: str) -> DataFrame:
    """The scalar members of objects (column ``json``) whose name or value holds the needle: ``key``, ``value``, with the other columns."""
    members = F.explode(F.from_json("json", "map<string,string>")).alias("key", "value")
    return df.select(*[c for c in df.columns if c != "json"], members).filter(F.contains("key", F.lit(needle)) | F.contains("value", F.lit(needle)))
