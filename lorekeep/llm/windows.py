"""Substring dedup: windows of WINDOW words that occur in an earlier document are removed.

Every window of every text gets a Rabin-Karp hash, and Spark counts them. Hashes travel as packed lists, one for each unit of the input (some
MB of text, written once) and each range of hash values, not as rows. Three passes, none of which holds more than a unit or a range:

1. each unit sends its distinct hashes (the 32 bits below those that name the range) and learns, one bit each, which may occur in another
   unit too;
2. for those, and those that two documents of the unit share, it sends the full hash, a second hash of independent word hashes and the
   smallest document, and learns, one bit each, whether a smaller document has that window elsewhere;
3. windows found in a smaller document merge into maximal intervals, and the words they cover go. What a unit sent is worked out again
   rather than sent back.

A hot window is one entry for each unit that has it, never one for each document. The number of ranges follows the bytes of text, so a range
has about the same size at any scale. Text travels compressed.

Defined results: a null or empty text, or one with fewer than WINDOW words, loses nothing; rows with equal ids count as one document, so
their common windows stay; a null id is neither smaller nor larger than another, so its row loses nothing and costs no other row anything; a
very long text is a unit by itself; only ``doc_id`` and ``text`` are read, so other columns can't clash; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm import arrow, blocks

WINDOW = 13
RANGE = 16 << 20  #: bytes of text for each range of hash values
SECOND = 0xD1342543DE82EF95
LAST = np.iinfo(np.int64).max  #: stands for a null id, which comes after all others


class Block:
    """The windows of the documents of one unit, in reading order."""

    def __init__(self, batches: list[pa.RecordBatch], size: int, second: bool = False):
        docs, hashes, others, bounds, known = [], [], [], [], []
        self.slices = []
        for rb in batches:
            ids = pc.fill_null(rb["doc_id"], LAST).to_numpy(zero_copy_only=False)
            named = pc.is_valid(rb["doc_id"]).to_numpy(zero_copy_only=False)
            words = arrow.Words(arrow.utf8(rb["text"]))
            w, whole = words.windows(size, words.hashes())
            at = words.doc_of()[whole]
            docs.append(ids[at])
            known.append(named[at])
            hashes.append(w[whole])
            if second:
                others.append(words.windows(size, words.hashes(1), SECOND)[0][whole])
            self.slices.append((rb["doc_id"].to_pylist(), words, whole))
            bounds.append(int(whole.sum()))
        self.doc, self.named = np.concatenate(docs), np.concatenate(known)
        self.hash = np.concatenate(hashes)
        self.other = np.concatenate(others) if second else None
        self.bounds = np.concatenate([[0], np.cumsum(bounds)])

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes, sorted; for each window which one it has; and for each whether two documents have it."""
        first, which = arrow.distinct(self.hash)
        least, most = np.full(len(first), LAST), np.full(len(first), np.iinfo(np.int64).min)
        np.minimum.at(least, which, self.doc)
        np.maximum.at(most, which, self.doc)
        return self.hash[first], which, least != most

    def sent(self, elsewhere: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First and second hash and smallest document of the windows that another unit or another document here may have too, by hashes; then all
        occurrences of these in order, and which of them each one is."""
        _, which, shared = self.distinct()
        take = np.flatnonzero((shared | elsewhere)[which])
        order = take[np.lexsort((self.other[take], self.hash[take]))]
        a, b = self.hash[order], self.other[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(a)]
        first = np.flatnonzero(new)
        least = np.minimum.reduceat(self.doc[order], first) if len(first) else self.doc[:0]
        return a[first], b[first], least, order, np.cumsum(new) - 1


def _ranges(h: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(range, from, to) of sorted hashes, by their top bits; none of no hashes."""
    top = (h >> np.uint64(64 - bits)).astype(np.int64)
    at = np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1]])[: len(top)]).tolist()
    return [(int(top[a]), a, b) for a, b in zip(at, [*at[1:], len(top)], strict=False)]


def _in_other_block(lists: list[np.ndarray]) -> list[np.ndarray]:
    """For each value of each list (distinct in itself), whether another list has it."""
    every = np.sort(np.concatenate(lists))
    more = np.unique(every[1:][every[1:] == every[:-1]])
    return [_member(x, more) for x in lists]


def _member(x: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(values):
        return np.zeros(len(x), bool)
    i = np.minimum(np.searchsorted(values, x), len(values) - 1)
    return values[i] == x


def _bits(replies: pa.Table) -> np.ndarray:
    """The flags of what a unit sent, from the replies of all ranges in order."""
    order = np.argsort(replies["range"].to_numpy())
    flags = replies["flags"].to_pylist()
    sizes = replies["n"].to_pylist()
    return np.concatenate([np.unpackbits(np.frombuffer(flags[i], np.uint8), count=sizes[i]).astype(bool) for i in order.tolist()] or [np.zeros(0, bool)])


FIRST = "unit long, range long, n long, low binary"
SENT = "unit long, range long, n long, a binary, b binary, d binary"
REPLY = "unit long, range long, n long, flags binary"


def _reply(block: list[int], at: int, flags: list[np.ndarray]) -> pa.Table:
    return pa.table({"unit": pa.array(block, pa.int64()), "range": pa.array([at] * len(block), pa.int64()), "n": pa.array(map(len, flags), pa.int64()), "flags": pa.array([np.packbits(f).tobytes() for f in flags], pa.binary())})


def dedup(docs: DataFrame, size: int = WINDOW, texts: bool = False, unit: int = blocks.UNIT) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256`` (and ``text``, the kept words, if asked for) of every row of ``docs``."""
    units = blocks.units(docs, unit)
    # 32 bits below those that name a range are sent, so that 32 at most may name it: enough for 2^32 ranges.
    bits = max(1, min(32, ((units.agg(F.sum("bytes")).first()[0] or 0) // RANGE).bit_length()))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for at, blob in zip(rb["unit"].to_pylist(), rb["blob"], strict=True):
                h, _, _ = Block(blocks.opened(blob), size).distinct()
                low = (h >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)
                yield _rows(FIRST, [(at, r, b - a, arrow.packed(low[a:b])) for r, a, b in _ranges(h, bits)])

    def count(t: pa.Table) -> pa.Table:
        # Values whose low 32 bits meet within a block may stand for different windows; each keeps its place.
        lists = [arrow.unpacked(x, n) for x, n in zip(t["low"].to_pylist(), t["n"].to_pylist(), strict=True)]
        flags = _in_other_block([np.unique(x) for x in lists])
        return _reply(t["unit"].to_pylist(), t["range"][0].as_py(), [f[np.searchsorted(np.unique(x), x)] for f, x in zip(flags, lists, strict=True)])

    counted = blocks.saved(units.mapInArrow(first, FIRST).groupBy("range").applyInArrow(count, REPLY))

    def second(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        own = Block(blocks.opened(left["blob"][0]), size, second=True)
        a, b, d, _, _ = own.sent(_bits(right))
        rows = [(key[0].as_py(), r, y - x, arrow.packed(a[x:y]), b[x:y].tobytes(), arrow.packed(d[x:y])) for r, x, y in _ranges(a, bits)]
        return pa.Table.from_batches([_rows(SENT, rows)])

    def smallest(t: pa.Table) -> pa.Table:
        lists = _opened(t)
        a, b, d = (np.concatenate(c) for c in zip(*lists, strict=True))
        order = np.lexsort((d, b, a))
        new = np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])])
        least = np.empty(len(d), np.int64)
        least[order] = d[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        cuts = np.cumsum([len(x[0]) for x in lists])[:-1]
        return _reply(t["unit"].to_pylist(), t["range"][0].as_py(), np.split(least < d, cuts))

    shared = units.groupBy("unit").cogroup(counted.groupBy("unit")).applyInArrow(second, SENT)
    kinds = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * texts

    def third(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        own = Block(blocks.opened(left["blob"][0]), size, second=True)
        again = right["last"].to_numpy(zero_copy_only=False).astype(bool)
        _, _, d, order, which = own.sent(_bits(right.filter(pa.array(~again))))
        flags = _bits(right.filter(pa.array(again)))
        gone = np.zeros(len(own.doc), bool)
        gone[order] = own.named[order] & (flags[which] | (d[which] < own.doc[order]))
        out = {c.split()[0]: [] for c in kinds.split(", ")}
        for (ids, words, whole), x in zip(own.slices, own.bounds[:-1].tolist(), strict=True):
            hit = np.zeros(len(whole), np.int64)
            hit[np.flatnonzero(whole)] = gone[x : x + int(whole.sum())]
            sums = np.concatenate([[0], np.cumsum(hit)])
            n = np.arange(len(hit))
            # A window that covers a word starts at most size - 1 words before it, in the same text.
            cover = sums[n + 1] - sums[np.maximum(n + 1 - size, np.repeat(words.bounds[:-1], np.diff(words.bounds)))] > 0
            data = words.data.tobytes()
            for k, doc in enumerate(ids):
                p, q = int(words.bounds[k]), int(words.bounds[k + 1])
                keep = ~cover[p:q]
                all_words = data[words.starts[p] : words.ends[q - 1]].split() if q > p else []
                kept = b" ".join(all_words if keep.all() else [all_words[j] for j in np.flatnonzero(keep).tolist()])
                row = (doc, q - p, int((~keep).sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if texts else None)
                for c, v in zip(out, row, strict=False):
                    out[c].append(v)
        return pa.table({c: pa.array(v, pa.string() if c in ("kept_sha256", "text") else pa.int64()) for c, v in out.items()})

    verdicts = shared.groupBy("range").applyInArrow(smallest, REPLY)
    both = counted.withColumn("last", F.lit(False)).unionByName(verdicts.withColumn("last", F.lit(True)))
    return units.groupBy("unit").cogroup(both.groupBy("unit")).applyInArrow(third, kinds)


def _rows(kinds: str, rows: list[tuple]) -> pa.RecordBatch:
    names, types = zip(*(c.split() for c in kinds.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], pa.binary() if t == "binary" else pa.int64()) for i, t in enumerate(types)], names=list(names))


def _opened(sent: pa.Table) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """First and second hashes and documents of each row."""
    a, n, b, d = (sent[c].to_pylist() for c in ("a", "n", "b", "d"))
    return [(arrow.unpacked(x, k).view(np.uint64), np.frombuffer(y, "<u8"), arrow.unpacked(z, k)) for x, k, y, z in zip(a, n, b, d, strict=True)]
