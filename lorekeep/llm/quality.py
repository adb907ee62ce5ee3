"""Quality rules as a bitmask ledger.

``ledger`` evaluates every rule once and stores its measurements and one failure bit per rule. A ``Policy`` is a versioned mask over
those bits, so policies can be changed or compared without reading text again, and ``ablation`` counts from the ledger what each rule
of a policy removes on its own. Everything is built from Spark SQL functions.

Defined results: a null or empty text has no words and fails ``few_words``; repeated rows are judged alike; an empty table gives an
empty ledger; a null id is as good as another; very long texts are measured whole; columns of the input whose names clash with the
ledger's are replaced (``clean`` gives the input's own back).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm import blocks

# Characters that divide words, and those counted as symbols.
WORD = r"[^\x20\x09-\x0D]"
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    name: str
    bit: int
    fails: str  #: SQL over the measurements


RULES = (
    Rule("few_words", 0, "n_words < 10"),
    Rule("repeated_words", 1, "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", 2, "10 * n_symbols > n_words"),
    Rule("repeated_lines", 3, "10 * n_dup_lines > 3 * n_text_lines"),
    Rule("long_words", 4, "word_chars > 20 * n_words"),
    Rule("shouting", 5, "10 * n_marks > 3 * n_words"),
)
BASE = 0b11


@dataclass(frozen=True)
class Policy:
    """A document passes when none of the policy's bits is set. ``version`` names the policy in reports."""

    version: str
    mask: int

    def kept(self, failed: Column | str = "failed") -> Column:
        failed = F.col(failed) if isinstance(failed, str) else failed
        return failed.bitwiseAND(F.lit(self.mask).cast("long")) == 0


STRICT = Policy("2024-1", reduce(lambda m, r: m | 1 << r.bit, RULES, 0))
MILD = Policy("2024-0", BASE)


def measured(docs: DataFrame, low_bits: int = 24) -> DataFrame:
    """Adds the measurements of every rule to ``docs`` (which needs ``text``).

    For words in repeated five-word windows, each window becomes one long: its position in the low ``low_bits`` (30 in texts with more
    words), bits of its hash above. One primitive sort then puts equal windows side by side, and neighbours with equal hash bits are compared
    word by word. Where such neighbours differ, equal windows may stand apart: the text's windows are then sorted by two whole
    hashes instead, so the short ones never decide.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    low = F.when(F.size("_w") < 1 << low_bits, (1 << low_bits) - 1).otherwise((1 << max(30, low_bits)) - 1).cast("long")
    packed = F.expr(
        "case when size(_w) < 5 then array() else sort_array(transform(slice(_w, 1, size(_w) - 4), (x, i) -> "
        "(xxhash64(x, _w[i + 1], _w[i + 2], _w[i + 3], _w[i + 4]) & ~_low) | cast(i as bigint))) end"
    )
    out = docs.withColumn("_w", F.filter(F.split(text, SPACES, -1), lambda x: x != ""))
    out = out.withColumn("_low", low).withColumn("_p", packed)
    equal = "slice(_w, cast(_p[i] & _low as int) + 1, 5) = slice(_w, cast(x & _low as int) + 1, 5)"
    # Of each position in hash order: does it equal the next one? Most texts have no equal neighbours at all. -2: equal bits, other words.
    out = out.withColumn("_twin", F.expr(f"filter(transform(slice(_p, 2, greatest(size(_p) - 1, 0)), (x, i) -> if((_p[i] & ~_low) = (x & ~_low), if({equal}, cast(i as int), -2), -1)), x -> x <> -1)"))
    whole = (
        "case when array_contains(_twin, -2) then sort_array(transform(slice(_w, 1, size(_w) - 4), (x, i) -> named_struct('a', xxhash64(x, _w[i + 1], _w[i + 2], _w[i + 3], _w[i + 4]), "
        "'b', xxhash64('second', _w[i + 4], _w[i + 3], _w[i + 2], _w[i + 1], x), 'i', cast(i as int)))) end"
    )
    out = out.withColumn("_whole", F.expr(whole))
    apart = "flatten(transform(slice(_whole, 2, size(_whole) - 1), (x, i) -> if(_whole[i].a = x.a and _whole[i].b = x.b, array(_whole[i].i, x.i), cast(array() as array<int>))))"
    near = "flatten(transform(_twin, i -> array(cast(_p[i] & _low as int), cast(_p[i + 1] & _low as int))))"
    out = out.withColumn("_at", F.expr(f"sort_array(array_distinct(if(_whole is not null, {apart}, {near})))"))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    out = out.withColumn("_lines", lines)
    return out.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.regexp_replace(text, SPACES, "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long"),
            "n_marks": F.regexp_count(text, F.lit("!!")).cast("long"),
            "n_text_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.expr("coalesce(aggregate(transform(_at, (s, i) -> least(5, coalesce(get(_at, i + 1) - s, 5))), 0L, (a, x) -> a + x), 0L)"),
        }
    ).drop("_w", "_low", "_p", "_twin", "_whole", "_at", "_lines")


def ledger(docs: DataFrame) -> DataFrame:
    """``docs`` with the measurements and ``failed``, the OR of the bits of the rules that fail."""
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)) for r in RULES]
    return measured(docs).withColumn("failed", reduce(lambda a, b: a.bitwiseOR(b), bits).cast("long"))


def ablation(entries: DataFrame, policy: Policy) -> DataFrame:
    """One row: how many documents the policy drops, and for each rule how many fail it and how many only it drops."""
    hit = F.col("failed").bitwiseAND(F.lit(policy.mask).cast("long"))
    aggs = [F.count("*").alias("n"), F.count_if(hit != 0).alias("dropped"), F.bit_or("failed").alias("seen")]
    for r in RULES:
        if policy.mask >> r.bit & 1:
            aggs += [F.count_if(hit.bitwiseAND(F.lit(1 << r.bit).cast("long")) != 0).alias(f"{r.name}_fails"), F.count_if(hit == 1 << r.bit).alias(f"{r.name}_only")]
    return entries.agg(*aggs).withColumn("policy", F.lit(policy.version))


def clean(docs: DataFrame, policy: Policy = STRICT) -> DataFrame:
    """The rows of ``docs`` that pass, with its own columns."""
    names = docs.columns
    # The ledger is written: a filter over it would be pushed into the measurements and repeat them beyond measure.
    entries = blocks.saved(ledger(docs.select(F.struct("*").alias("_row"), "text")).select("_row", "failed"))
    return entries.filter(policy.kept()).select("_row.*").select(*names)
