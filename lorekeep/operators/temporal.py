"""Scans: live rows, rows as of an instant, and rows in scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def at(instant: str | Column) -> Column:
    return F.lit(instant).cast("timestamp") if isinstance(instant, str) else instant


def valid(as_of: str | Column | None = None) -> Column:
    """Valid now, or at an instant: from its start (null: always) up to but without its end."""
    if as_of is None:
        return F.col("valid_to").isNull()
    t = at(as_of)
    return (F.col("valid_from").isNull() | (F.col("valid_from") <= t)) & (F.col("valid_to").isNull() | (F.col("valid_to") > t))


def live_facts(facts: DataFrame, as_of: str | Column | None = None) -> DataFrame:
    """Past instants count superseded facts too, so the status matters only now."""
    return facts.filter(valid(as_of) if as_of is not None else valid() & (F.col("status") == "active"))


def live_atoms(atoms: DataFrame, as_of: str | Column | None = None) -> DataFrame:
    return atoms.filter(valid(as_of))


def in_scope(df: DataFrame, cwd: str, column: str = "source_cwd") -> DataFrame:
    """Rows of a folder, of folders below it, and of none."""
    c = F.col(column)
    return df.filter(c.isNull() | (c == "") | (c == cwd) | c.startswith(cwd + "/"))


def touching(facts: DataFrame, ids: DataFrame) -> DataFrame:
    """Facts whose subject or object is among ``ids`` (``id``). Two equality joins, not one with OR; the second leaves out what the first has."""
    named = lambda c: ids.select(F.col("id").alias(c)).distinct()
    a = facts.join(named("subject_id"), "subject_id", "left_semi")
    b = facts.join(named("object_id"), "object_id", "left_semi").join(named("subject_id"), "subject_id", "left_anti")
    return a.unionByName(b).select(*facts.columns)


def ttl_expired(atoms: DataFrame, now: str, days: int = 21, exempt: tuple[str, ...] = ("judgment", "experience", "summary", "preference", "event")) -> DataFrame:
    """Audited atoms of low durability that nothing renewed for a while."""
    seen = F.coalesce("last_seen_at", "valid_from")
    return atoms.filter((F.col("p_dur") < 0.35) & ~F.col("needs_audit") & (seen < at(now) - F.expr(f"interval {days} days")) & ~F.col("label").isin(*exempt))


def by_id(df: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose ``id`` is asked for."""
    return df.join(ids.select("id").distinct(), "id", "left_semi")


def both_live(edges: DataFrame, a: str, b: str, live: DataFrame) -> DataFrame:
    """Edges with both ends among the live rows (``id``)."""
    return edges.join(live.select(F.col("id").alias(a)), a, "left_semi").join(live.select(F.col("id").alias(b)), b, "left_semi")


def low_value(atoms: DataFrame, exempt: tuple[str, ...], least: float = 0.6) -> DataFrame:
    """Live atoms of little durability without a gist, of no exempt label and from no markdown file."""
    live = live_atoms(atoms)
    return live.filter((F.col("p_dur") < least) & F.col("gist").isNull() & ~F.col("label").isin(*exempt) & ~F.col("from_markdown"))
