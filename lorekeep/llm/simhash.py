"""Document fingerprints: SimHash and a search within a Hamming radius.

Terms are pairs of neighbouring words (the word itself in a text of one), weighted by the bytes of their words, as longer ones are rarer; a
word counts LONGEST bytes at most, so that one long token can't outvote a text. Each bit of a term's hash votes with its weight for or
against the fingerprint's bit. Permuted block tables find all fingerprints within RADIUS: 64 bits make five blocks, three differing bits leave
two blocks equal, so each fingerprint stands in ten tables, one for every two blocks.

Documents meet their next ones in order: rows are dealt by ranges of ids and sorted there; what a range can't settle are the rows of its
smallest id, which take the first row of a range below.

Defined results: every row is returned; a null or empty text, or one without words, has fingerprint 0; a null id comes after all others; rows
with equal ids (null ids too) have the same next document, and as another's next one that with the least hash of its text serves; a document
alone is its own next one; a very long text is taken whole, by itself; only ``doc_id`` and ``text`` are read, so other columns can't clash; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm import arrow, blocks

RADIUS = 3
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))  #: first bit and width
TABLES = tuple(combinations(range(len(BLOCKS)), 2))
CELL = 2048  #: entries of a table that meet others in one task
LONGEST = 24  #: bytes of a word that count


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """64 bits for each text."""
    words = arrow.Words(texts)
    h, size = words.hashes(), np.minimum(words.ends - words.starts, LONGEST)
    n = np.diff(words.bounds)
    out = np.zeros(len(texts), np.uint64)
    if not len(h):
        return out
    pair, whole = words.windows(2, h)
    weight = size.copy()
    weight[:-1] += size[1:]
    alone = np.repeat(n == 1, n)
    pair[alone], weight[alone], whole = h[alone], size[alone], whole | alone
    # A text's last word starts no pair, so it votes with no weight and every text with words keeps a row.
    weight[~whole] = 0
    full = np.flatnonzero(n)
    at = words.bounds[:-1][full]
    total = np.add.reduceat(weight, at)
    for b in range(64):
        ones = np.add.reduceat(np.where((pair >> np.uint64(b)) & np.uint64(1), weight, 0), at)
        out[full] |= (2 * ones > total).astype(np.uint64) << np.uint64(b)
    return out


def _likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 - np.bitwise_count(a ^ b) / 64


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint long, edited_fingerprint long, near_edited double, near_next double"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def _compared(ids: list, own: list[str], after: list[str]) -> list[pa.Array]:
    """The columns of SCHEMA for texts and their next ones."""
    raw = [(t[: len(t) - len(t) // 2] + x[: len(t) // 2]).encode() for t, x in zip(own, after, strict=True)]
    f, g, h = fingerprints([t.encode() for t in own]), fingerprints(raw), fingerprints([t.encode() for t in after])
    columns = (pa.array(ids, pa.int64()), pa.array(map(len, own), pa.int64()), [hashlib.sha256(t).hexdigest() for t in raw], f.view(np.int64), g.view(np.int64), _likeness(f, g), _likeness(f, h))
    return [pa.array(c) for c in columns]


def edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text: its last half gives way to the beginning of the next document.

    The table written on the way has finished rows, and for each range a row with its first document (``head``) and the rows of its
    smallest id with their texts (``tail``). Rows of one id that are more than should be held at once are tails too, with their next
    document after them (``inner``).
    """
    columns = pa.schema([(c, pa.string() if c == "edited_sha256" else pa.float64() if c.startswith("near") else pa.int64()) for c in NAMES])
    whole = columns.append(pa.field("part", pa.int64())).append(pa.field("kind", pa.string())).append(pa.field("text", pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, waiting = TaskContext.get().partitionId(), []  # rows of the last id so far, whose next one has not come yet
        edge = lambda kind, rows: pa.RecordBatch.from_pylist([{"doc_id": i, "part": part, "kind": kind, "text": t} for i, t in rows], whole)
        started, held, spilled = False, 0, False
        for rb in arrow.slices(batches):
            own, after = [], []
            for row in zip(rb["doc_id"].to_pylist(), rb["text"].to_pylist(), strict=True):
                if not started:
                    yield edge("head", [row])
                    started, last = True, row[0]
                if row[0] != last:
                    if spilled:
                        yield edge("inner", [(last, row[1])])
                    own += waiting
                    after += [row[1]] * len(waiting)
                    waiting, held, spilled, last = [], 0, False, row[0]
                elif held > arrow.SLICE:
                    yield edge("tail", waiting)
                    waiting, held, spilled = [], 0, True
                waiting.append(row)
                held += len(row[1]) + 100
            if own:
                done = _compared([i for i, _ in own], [t for _, t in own], after)
                none = [pa.nulls(len(own), t) for t in (pa.int64(), pa.string(), pa.string())]
                yield pa.RecordBatch.from_arrays([*done, *none], schema=whole)
        if waiting:
            yield edge("tail", waiting)

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_h", F.xxhash64("text")).withColumn("_n", F.monotonically_increasing_id())
    order = (F.desc("doc_id"), F.asc("_h"), F.asc("_n"))  # copies of an id are dealt to several ranges
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    first = blocks.saved(dealt.mapInArrow(run, SCHEMA + ", part long, kind string, text string"))

    tails = first.filter("kind = 'tail'").select("part", "doc_id", "text")
    inner = first.filter("kind = 'inner'").select(F.col("part").alias("_p"), F.col("doc_id").alias("_i"), F.col("text").alias("after"))
    same = (F.col("part") == F.col("_p")) & F.col("doc_id").eqNullSafe(F.col("_i"))
    rest = tails.join(inner, same, "left_anti")
    # One id for each range, no text: the next range of a range is the nearest below with another id.
    heads = sorted((r["part"], r["doc_id"]) for r in first.filter("kind = 'head'").select("part", "doc_id").collect())
    ends = {r["part"]: r["doc_id"] for r in rest.select("part", "doc_id").distinct().collect()}
    follow = {p: next((q for q, i in heads if q > p and i != ends[p]), heads[0][0]) for p in ends}
    pairs = docs.sparkSession.createDataFrame(list(follow.items()), "part long, next long")
    heads_ = first.filter("kind = 'head'").select(F.col("part").alias("next"), F.col("text").alias("after"))
    open_ = rest.join(F.broadcast(pairs), "part").join(heads_, "next").select("doc_id", "text", "after").unionByName(tails.join(inner, same).select("doc_id", "text", "after"))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in arrow.slices(batches):
            yield pa.RecordBatch.from_arrays(_compared(rb["doc_id"].to_pylist(), rb["text"].to_pylist(), rb["after"].to_pylist()), schema=columns)

    return first.filter("kind is null").select(NAMES).unionByName(open_.mapInArrow(close, SCHEMA))


def near(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``fingerprint``, ``n_near``: how many rows of ``prints`` have one within the radius (itself included), for every distinct one.

    The tables hold distinct fingerprints with their counts. Entries of a table with equal blocks meet in cells of bounded size, and only
    sums leave a cell, so a group of copies costs no list of pairs. A pair counts in the first table that shows it.
    """
    assert radius <= RADIUS
    own = prints.groupBy("fingerprint").agg(F.count("*").alias("n"))
    entries = []
    for k, (x, y) in enumerate(TABLES):
        (p, w), (q, v) = BLOCKS[x], BLOCKS[y]
        key = F.shiftleft(F.shiftrightunsigned("fingerprint", p).bitwiseAND(F.lit((1 << w) - 1)), v).bitwiseOR(F.shiftrightunsigned("fingerprint", q).bitwiseAND(F.lit((1 << v) - 1)))
        entries.append(F.struct(F.lit(k).alias("table"), key.alias("key")))
    rows = own.withColumn("_e", F.explode(F.array(*entries))).select(F.col("_e.table").alias("table"), F.col("_e.key").alias("key"), "fingerprint", "n")
    sizes = rows.groupBy("table", "key").agg(F.count("*").alias("m")).filter("m > 1").withColumn("cells", F.ceil(F.col("m") / CELL))
    rows = rows.join(sizes, ["table", "key"]).withColumn("cell", F.pmod(F.xxhash64("fingerprint"), F.col("cells")))
    upto = F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)
    left = rows.withColumns({"i": F.col("cell"), "side": F.lit(0)}).withColumn("j", F.explode(upto))
    right = rows.withColumns({"j": F.col("cell"), "side": F.lit(1)}).withColumn("i", F.explode(upto))
    cells = left.select("table", "key", "i", "j", "side", "fingerprint", "n").unionByName(right.select("table", "key", "i", "j", "side", "fingerprint", "n"))
    cells = cells.repartition("table", "key", "i", "j").sortWithinPartitions("table", "key", "i", "j", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sides = None, ([], [])

        def done() -> list[tuple[int, int]]:
            if not (sides[0] and sides[1]):
                return []
            a, b = (np.array(s, np.int64) for s in sides)
            first, out = np.array([_mask(t) for t in TABLES[: at[0]]], np.uint64), []
            for f, _ in a.tolist():
                d = (b[:, 0] ^ f).view(np.uint64)
                ok = (np.bitwise_count(d) <= radius) & (d != 0)
                for m in first:
                    ok &= (d & m) != 0
                if ok.any():
                    out.append((f, int(b[ok, 1].sum())))
            return out

        for rb in batches:
            out = []
            for t, k, i, j, side, f, n in zip(*(rb[c].to_pylist() for c in ("table", "key", "i", "j", "side", "fingerprint", "n")), strict=True):
                if (t, k, i, j) != at:
                    out += done()
                    at, sides = (t, k, i, j), ([], [])
                sides[side].append((f, n))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in (0, 1)], names=["fingerprint", "n"])
        if out := done():
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in (0, 1)], names=["fingerprint", "n"])

    return cells.mapInArrow(run, "fingerprint long, n long").unionByName(own).groupBy("fingerprint").agg(F.sum("n").alias("n_near"))


def _mask(table: tuple[int, int]) -> int:
    return sum(((1 << BLOCKS[b][1]) - 1) << BLOCKS[b][0] for b in table)


def report(docs: DataFrame) -> DataFrame:
    """All columns of ``edited``, fingerprints as 16 hex digits, and ``n_near``, how many other rows lie within the radius."""
    rows = blocks.saved(edited(docs))
    # Both sides of the join come from a table: the rows of a very common fingerprint are then split over tasks.
    out = rows.join(blocks.saved(near(rows.select("fingerprint"))), "fingerprint")
    hexed = {c: F.lower(F.lpad(F.hex(c), 16, "0")) for c in ("fingerprint", "edited_fingerprint")}
    return out.withColumn("n_near", F.col("n_near") - 1).withColumns(hexed).select(*NAMES, "n_near")
