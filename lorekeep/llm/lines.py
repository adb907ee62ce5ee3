"""Line dedup by winnowing.

Lines with a word are hashed, and of every RUN neighbouring ones the least hash is selected as the fingerprint (the last of equals). Only
selected positions are written, with the windows of RUN lines around them that selected them. Any repeated run of RUN lines or more
selects the same places, so positions meet by fingerprint, and those that occur once go no further. A match is extended both ways by the
windows around its position: each window that occurred before (in a document with a smaller id, or further up in the same one) is a repeat, and
overlapping ones make up the run as far as it matches. Its lines are deleted; the first occurrence stays.

The length in lines only guards against short ones that recur by chance: a single line, or a pair of neighbouring ones, of LONG words or more
is a window of its own and a repeat wherever it occurred before.

Defined results: lines without a word are never deleted and don't interrupt a run; shorter repeats with fewer than LONG words stay; a
null text stays null; a row with a null id loses nothing and costs no other row anything; rows with equal ids count as one document, so
neither repeats the other; a document of which nothing is left stays, with an empty text; a very long text is taken whole, by itself; input
columns named like the operator's own (``n_lines``, ``n_removed``) are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm import arrow, blocks

RUN = 3
LONG = 20  #: words that make a run of fewer lines a repeat


def line_hashes(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each line."""
    both = np.frombuffer(b"".join([hashlib.blake2b(x, digest_size=16).digest() for x in lines]), "<u8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def winnow(h: np.ndarray, run: int = RUN) -> np.ndarray:
    """Where the fingerprint of each window of ``run`` hashes is: its least one, the last of equals."""
    n = max(len(h) - run + 1, 0)
    least, where = h[:n], np.arange(n)
    for k in range(1, run):
        below = h[k : k + n] <= least
        least, where = np.where(below, h[k : k + n], least), np.where(below, np.arange(n) + k, where)
    return where


def _selected(docs: DataFrame, run: int, long: int | None) -> DataFrame:
    """``doc_id``, ``at`` (the selected line, counted among lines with a word), ``fingerprint``, and ``around``: the windows that selected it, by
    first line, number of lines (``size``) and 128 bits that name the lines (``a``, ``b``)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in arrow.slices(batches):
            spots: list[list[np.ndarray]] = [[], [], [], []]  # document, selected line, fingerprint, number of windows
            around: list[list[np.ndarray]] = [[], [], [], []]
            lines, words, ends = [], [], []  # lines with a word of all texts, their numbers of words, where each text's lines end
            for text in arrow.utf8(rb["text"]):
                for line in text.split(b"\n"):
                    if n := len(line.split()):
                        lines.append(line)
                        words.append(n)
                ends.append(len(lines))
            h, other = line_hashes(lines)
            count = np.diff(ends, prepend=0)
            doc, end = np.repeat(rb["doc_id"].to_numpy(), count), np.repeat(ends, count)
            place, words = np.arange(len(lines)) - (end - np.repeat(count, count)), np.array(words, np.int64)
            for size in range(run if long is None else 1, run + 1):
                where = winnow(h, size)
                # Windows lie in one text.
                at = np.flatnonzero(np.arange(len(where)) + size <= end[: len(where)])
                if size < run:
                    at = at[sum(words[at + k] for k in range(size)) >= long]
                if not len(at):
                    continue
                a, b = np.full(len(at), run - size, np.uint64), np.ones(len(at), np.uint64)
                for k in range(size):
                    a = arrow.mix(a + h[at + k])
                    b = arrow.mix(b * np.uint64(0xD1342543DE82EF95) ^ other[at + k])
                # Windows select places in order, so those of one place stand together.
                first = np.flatnonzero(np.concatenate([[True], np.diff(where[at]) != 0]))
                spot = where[at][first]
                # Windows of different lengths don't meet.
                fingerprint = h[spot] ^ np.uint64(run - size)
                for column, v in zip(spots, (doc[spot], place[spot], fingerprint.view(np.int64), np.diff(np.append(first, len(at)))), strict=True):
                    column.append(v)
                for column, v in zip(around, (place[at], np.full(len(at), size), a.view(np.int64), b.view(np.int64)), strict=True):
                    column.append(v)
            if spots[0]:
                *own, n = (np.concatenate(c) for c in spots)
                windows = pa.StructArray.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in around], names=["at", "size", "a", "b"])
                nested = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), windows)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in own), nested], names=["doc_id", "at", "fingerprint", "around"])

    kinds = "doc_id long, at long, fingerprint long, around array<struct<at: long, size: long, a: long, b: long>>"
    return docs.filter("doc_id is not null").select("doc_id", "text").mapInArrow(work, kinds)


def repeats(docs: DataFrame, run: int = RUN, long: int | None = LONG) -> DataFrame:
    """``doc_id``, ``gone``: the windows of each document that occurred before, by first line and number of lines (``at``, ``size``)."""
    spots = blocks.saved(_selected(docs, run, long))
    place = F.struct("doc_id", "at")
    # Both sides of each join come from a table: a fingerprint or window that is very common is then split over tasks.
    again = blocks.saved(spots.groupBy("fingerprint").agg(F.min(place).alias("x"), F.max(place).alias("y")).filter("x <> y").select("fingerprint"))
    met = spots.join(again, "fingerprint", "left_semi").select("doc_id", F.inline("around"))
    first = blocks.saved(met.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last").select("a", "b", "first"))
    return met.join(first, ["a", "b"]).filter(place > F.col("first")).groupBy("doc_id").agg(F.collect_set(F.struct("at", "size")).alias("gone"))


def dedup(docs: DataFrame, run: int = RUN, long: int | None = LONG) -> DataFrame:
    """``docs`` with ``text`` without repeated runs, and ``n_lines`` and ``n_removed`` (lines, blank ones included in the first). With
    ``long`` None only runs of ``run`` lines count, however long the lines."""
    names = docs.columns
    rows = docs.select(F.col("doc_id").alias("_id"), F.struct(*[F.col(f"`{c}`") for c in names if c != "text"]).alias("_row"), F.col("text"))
    rows = rows.join(repeats(docs, run, long).withColumnRenamed("doc_id", "_id"), "_id", "left").select("_row", "text", "gone")
    kinds = rows.select("_row", "text").schema.add("n_lines", "long").add("n_removed", "long")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in arrow.slices(batches):
            texts, n, removed = [], [], []
            for text, gone in zip(rb["text"].to_pylist(), rb["gone"].to_pylist(), strict=True):
                lines = (text or "").split("\n")
                n.append(len(lines))
                drop: set[int] = set()
                if gone:
                    live = [i for i, x in enumerate(lines) if x.encode().split()]
                    drop = {live[g["at"] + k] for g in gone for k in range(g["size"])}
                removed.append(len(drop))
                texts.append("\n".join(x for i, x in enumerate(lines) if i not in drop) if drop else text)
            yield pa.RecordBatch.from_arrays([rb["_row"], pa.array(texts, rb["text"].type), pa.array(n, pa.int64()), pa.array(removed, pa.int64())], names=["_row", "text", "n_lines", "n_removed"])

    out = rows.mapInArrow(work, kinds)
    own = [F.col("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in names if c not in ("n_lines", "n_removed")]
    return out.select(*own, "n_lines", "n_removed")


def clean(docs: DataFrame) -> DataFrame:
    """``docs`` without repeated runs of lines, with its own columns; ``n_chars`` follows the text."""
    names = docs.columns
    rows = docs.select(F.struct("*").alias("_all"), "doc_id", "text")
    out = dedup(rows).select(*[F.col("text") if c == "text" else F.col(f"_all.`{c}`").alias(c) for c in names])
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*names) if "n_chars" in names else out
