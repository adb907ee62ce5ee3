"""Score expressions. All are pure: the instant is an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Trust by extractor, half-lives in days, and weights.
TRUST = {"regex": 0.4, "llm": 0.7, "human": 0.9, "vote": 0.85}
HALF_LIFE = {"ephemeral": 7.0, "stable": 90.0}
OPPOSITE = (("likes", "dislikes"), ("uses", "avoids"), ("prefers", "rejects"), ("supports", "opposes"), ("enabled", "disabled"))
PROMOTE = {"ephemeral": 0.7, "stable": 0.85}


def within(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def trust(extractor: Column) -> Column:
    out = F.lit(0.4)
    for name, w in TRUST.items():
        out = F.when(extractor == name, w).otherwise(out)
    return out


def recency(at: Column, kind: Column, now: Column) -> Column:
    hours = F.greatest(F.lit(0.0), (F.unix_seconds(now) - F.unix_seconds(at)) / 3600.0)
    half = F.when(kind == "ephemeral", HALF_LIFE["ephemeral"]).otherwise(HALF_LIFE["stable"]) * 24.0
    return F.when(kind == "permanent", 1.0).when(at.isNull(), 0.5).otherwise(F.exp(-F.log(F.lit(2.0)) * hours / half))


def coherence(predicates: Column, n: Column) -> Column:
    """One less the share of conflicts among n sibling facts that have these distinct predicates."""
    pairs = F.lit(0)
    for a, b in OPPOSITE:
        pairs = pairs + (F.array_contains(predicates, a) & F.array_contains(predicates, b)).cast("int")
    return F.when(n == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - pairs / F.greatest(F.lit(1), n)))


def lif(count: Column, at: Column, sessions: Column, predicates: Column, n: Column, extractor: Column, kind: Column, now: Column) -> Column:
    """The five-part trust of a fact: frequency, recency, spread, coherence and source."""
    freq = 1 - F.exp(-count / 5.0)
    spread = F.least(F.lit(1.0), sessions / 5.0)
    return within(0.25 * within(freq) + 0.30 * within(recency(at, kind, now)) + 0.15 * spread + 0.15 * coherence(predicates, n) + 0.15 * trust(extractor))


def mem_score(lif: Column, confidence: Column, mode: str = "weighted") -> Column:
    if mode == "lif":
        return within(lif)
    if mode == "harmonic":
        return within(F.when(lif + confidence == 0, 0.0).otherwise(2 * lif * confidence / (lif + confidence)))
    return within(0.7 * lif + 0.3 * confidence)


def fact_score(match: Column, centrality: Column, mem: Column, sim: Column, hop: Column) -> Column:
    return 0.5 * match + 0.3 * centrality + 0.2 * mem + 0.3 * sim + 0.1 * hop


def hop_decay(hop: Column) -> Column:
    return F.when(hop < 0, 0.0).otherwise(F.pow(F.lit(0.5), hop))


def freshness(label: Column, at: Column, now: Column) -> Column:
    days = F.greatest(F.lit(0.0), (F.unix_seconds(now) - F.unix_seconds(at)) / 86400.0)
    return F.when(label == "fact", F.greatest(F.lit(0.25), F.pow(F.lit(0.5), days / 90.0))).otherwise(1.0)


def source_modifier(source: Column) -> Column:
    """What a candidate found by its neighbourhood keeps of its score, by the trust in its source."""
    return 0.5 + 0.5 * F.least(F.lit(1.0), source / 0.7)


def reranked(score: Column, match: Column) -> Column:
    return score * (0.5 + 0.5 * match)


def bumped(current: Column, by: Column, cap: float = 2.0) -> Column:
    """A gate score after another hit."""
    return F.least(F.lit(cap), current + by)


def shards(size: Column, budget: int) -> Column:
    """How many calls a text of ``size`` characters takes, at a quarter of a token each and ``budget`` tokens a call."""
    return F.ceil(F.greatest(F.lit(1), F.floor(size / 4)) / budget)


def normalised(answer: Column, n: int) -> Column:
    """An answer on a scale of n steps, between 0 and 1."""
    return answer / (n - 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def priority(novelty: Column, structural: Column, alpha: float = 1.0) -> Column:
    return F.when(novelty.isNull(), 0.0).otherwise(F.pow(F.abs(F.least(F.lit(1.2), novelty + 0.2 * structural)), F.lit(alpha)))
