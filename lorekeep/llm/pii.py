"""Personal data: patterns propose spans, checksums confirm them, words nearby move the score.

Built from Spark SQL functions alone. Positions come from splitting a text at its matches: the lengths of the pieces and of the matches
give every start. Patterns are written so that a failing start is never tried again inside the same run of characters, which keeps very
long tokens linear; the matches are those of the plain patterns in ``KINDS``.

Lists are summed up in runs of CHUNK matches, as an array that grows by one each time would be copied as often as it has elements.

Defined results: a null or empty text has no spans (``redact`` leaves it as it is); repeated rows get equal spans; spans of one kind never
overlap; null ids are as good as others; a very long text is searched whole; input columns that clash with working columns (``_text``) stay, one
named ``pii`` is replaced by ``find``; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOCAL = "A-Za-z0-9._%+-"


@dataclass(frozen=True)
class Kind:
    name: str
    needs: str  #: a text without a match of this cheap pattern has no span
    pattern: str
    valid: str  #: SQL over ``m``, the match, and ``d``, its digits
    score: float = 1.0
    near: str = ""  #: words that raise the score when they stand within WINDOW characters before the span


WINDOW, RAISE, LEAST, CHUNK = 40, 0.35, 0.6, 128
LUHN = (
    "aggregate(sequence(1, length(d)), 0, (a, i) -> a + if((length(d) - i) % 2 = 0, cast(substring(d, i, 1) as int), "
    "element_at(array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9), cast(substring(d, i, 1) as int) + 1))) % 10 = 0"
)
#: The country code and check digits go to the end, letters count 10 to 35, and the number must leave 1 when divided by 97.
MOD97 = (
    "length(replace(m, ' ', '')) between 15 and 34 and aggregate(split(concat(substring(replace(m, ' ', ''), 5), substring(replace(m, ' ', ''), 1, 4)), ''), 0, "
    "(a, x) -> if(x = '', a, if(x between '0' and '9', (a * 10 + cast(x as int)) % 97, (a * 100 + ascii(x) - 55) % 97))) = 1"
)
BASE = ("email", "ip", "card", "phone")
KINDS = (
    Kind("email", "@", rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "true"),
    Kind("ip", r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "forall(split(m, '[.]'), x -> length(ltrim('0', x)) < 3 or length(ltrim('0', x)) = 3 and cast(ltrim('0', x) as int) <= 255)"),
    Kind("card", r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])", LUHN),
    Kind("phone", r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", "length(d) between 8 and 15"),
    Kind("iban", "[A-Z][A-Z][0-9][0-9]", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?:\x20[A-Z0-9]{4}){2,7}+(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])", MOD97),
    Kind("ssn", "[0-9]-[0-9][0-9]-[0-9]", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "not (m like '000%' or m like '666%' or m like '9%' or m like '%-00-%' or m like '%0000')", 0.4, r"(?i)\b(ssn|social security|tax id|taxpayer)\b"),
    Kind("secret", "AKIA|(?i:token)", r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|(?<=token\x20{0,3}=\x20{0,3}\x22)[0-9a-f]{32,64}(?=\x22)", "true"),
)


def _bound(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` for ``value``, which is worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _chunks(values: str) -> str:
    return f"transform(sequence(0, cast((size({values}) - 1) div {CHUNK} as int)), i -> slice({values}, i * {CHUNK} + 1, {CHUNK}))"


def _starts(step: str) -> str:
    """What ``step`` (of the state so far, ``a.at``, and a chunk ``y``) comes to before each chunk of ``c``."""
    return f"aggregate(c, named_struct('at', 0, 'out', cast(array() as array<int>)), (a, y) -> named_struct('at', {step}, 'out', concat(a.out, array(a.at))), a -> a.out)"


def _spans(kind: Kind, text: str) -> Column:
    """Confirmed spans of one kind, in order: struct(s, e, score), in code points, e exclusive."""
    p = f"r'{kind.pattern}'"
    none = "cast(array() as array<struct<s: int, e: int, m: string, b: string>>)"
    # Gap before each match, length of the match, and the match.
    lengths = f"transform(arrays_zip(f, slice(split({text}, {p}, -1), 1, size(f))), x -> named_struct('g', length(x.`1`), 'n', length(x.f), 'm', x.f))"
    total = "aggregate(y, 0, (b, x) -> b + x.g + x.n)"
    before = f"substring(t, a.at + x.g - least(a.at + x.g, {WINDOW}) - greatest(0, st[k] - {WINDOW}) + 1, least(a.at + x.g, {WINDOW}))" if kind.near else "''"
    placed = (
        f"aggregate(y, named_struct('at', st[k], 'out', {none}), (a, x) -> named_struct('at', a.at + x.g + x.n, 'out', concat(a.out, "
        f"array(named_struct('s', a.at + x.g, 'e', a.at + x.g + x.n, 'm', x.m, 'b', {before})))), a -> a.out)"
    )
    if kind.near:
        placed = _bound("t", f"substring({text}, greatest(0, st[k] - {WINDOW}) + 1, {total} + {WINDOW})", placed)
    placed = _bound("c", f"{_bound('l', lengths, _chunks('l'))}", _bound("st", _starts(f"a.at + {total}"), f"flatten(transform(c, (y, k) -> {placed}))"))
    placed = _bound("f", f"regexp_extract_all({text}, {p}, 0)", f"if(size(f) = 0, {none}, {placed})")
    near = f"{kind.score}D" + (f" + if(x.b rlike r'{kind.near}', {RAISE}D, 0D)" if kind.near else "")
    return F.expr(
        f"case when {text} rlike r'{kind.needs}' then transform(filter(transform({placed}, x -> named_struct('s', x.s, 'e', x.e, 'ok', {_bind(kind.valid)}, 'score', {near})), "
        f"x -> x.ok and x.score >= {LEAST}), x -> named_struct('s', x.s, 'e', x.e, 'score', x.score)) else cast(array() as array<struct<s: int, e: int, score: double>>) end"
    )


def _bind(valid: str) -> str:
    """``valid`` for the match ``x.m``."""
    own = re.sub(r"(?<![\w.'%])(m|d)(?![\w.'%:])", r"y.\1", valid)
    return f"exists(array(named_struct('m', x.m, 'd', regexp_replace(x.m, '[^0-9]', ''))), y -> {own})"


def find(docs: DataFrame) -> DataFrame:
    """Adds ``pii``: a struct with one array of spans for each kind."""
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "pii"]).alias("_row"), F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    return out.select("_row.*", F.struct(*[_spans(k, "_text").alias(k.name) for k in KINDS]).alias("pii"))


def joined(kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` of all spans, comma-joined, by kind as given and then by start."""
    each = [F.expr(f"transform(pii.{k}, x -> concat('{k}:', x.s, ':', x.e))") for k in kinds]
    return F.array_join(F.concat(*each), ",")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; overlapping spans become one, named after the first."""
    names = docs.columns
    every = F.expr("array_sort(concat(" + ", ".join(f"transform(pii.{k.name}, x -> named_struct('s', x.s, 'e', x.e, 'k', '{k.name}'))" for k in KINDS) + "))")
    none = "cast(array() as array<string>)"
    # From where text before a span is kept: the largest end so far. Text is cut in two steps, as finding a place in it takes as long as what stands before.
    piece = "substring(t, a.at - st[k] + 1, x.s - a.at)"
    kept = (
        f"aggregate(y, named_struct('at', st[k], 'out', {none}), (a, x) -> if(x.s < a.at, named_struct('at', greatest(a.at, x.e), 'out', a.out), "
        f"named_struct('at', x.e, 'out', concat(a.out, array({piece}, concat('<', x.k, '>'))))), a -> a.out)"
    )
    last = "array_max(transform(y, x -> x.e))"
    kept = _bound("t", f"substring(text, st[k] + 1, {last} - st[k])", kept)
    kept = _bound("c", _chunks("_all"), _bound("st", _starts(f"greatest(a.at, {last})"), f"flatten(transform(c, (y, k) -> {kept}))"))
    cut = f"case when size(_all) = 0 then text else concat(array_join({kept}, ''), substring(text, array_max(transform(_all, x -> x.e)) + 1)) end"
    out = find(docs.select(F.struct("*").alias("_row"), "text")).withColumn("_all", every).withColumn("_new", F.expr(cut))
    keep = [F.col("_new").alias(c) if c == "text" else F.length("_new").cast("long").alias(c) if c == "n_chars" else F.col(f"_row.`{c}`") for c in names]
    return out.select(*keep)


def counts() -> dict[str, Column]:
    return {f"n_{k}": F.size(f"pii.{k}").cast("long") for k in BASE}
