"""Packing of documents into training sequences.

Each text is tokenised where it is read; a document's ids, with the end id, are cut into pieces of at most one sequence, and only what
describes a piece is written and shuffled. Pieces meet in randomised groups of bounded size, and first-fit decreasing places them: a
tournament tree over the bins' free room finds the first bin that still takes a piece in logarithmic time.

Defined results: a null text is empty and has just the end id; rows with equal ids, equal rows too, are separate documents, and a piece's
group depends on its row and not on its content, so copies don't meet in one group; a very long text is cut into as many pieces as it
needs; only ``doc_id`` and ``text`` are read, so other columns can't clash; an empty table packs into nothing.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm import arrow, blocks

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
END, LENGTH, GROUP, CACHED, LONG = 2, 4096, 4096, 800_000, 64
#: Words that the library encodes itself: characters beyond ASCII and the Latin-1 letters, marks of special tokens, and more than LONG characters.
ODD = re.compile(f"[^\x00-\x7fÀ-ÖØ-öø-ÿ]|<\\||[^\n]{{{LONG + 1}}}")
# How the vocabulary divides lower-case words.
PART = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\x09-\x0d\x20a-z0-9ß-öø-ÿ]+|\n")


class Merges:
    """Byte-pair merges of many short parts at once: in each round every part joins its best-ranked pair, the leftmost of equals."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
        others = [b for b in range(256) if b not in shown]
        sign = dict(zip(shown, map(chr, shown), strict=True)) | {b: chr(256 + i) for i, b in enumerate(others)}
        self.inner = np.array([vocab[sign[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[sign[b] + suffix] for b in range(256)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.key, self.rank = key[order], order
        self.new = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.none = len(pairs)
        # Pairs of bytes, by far the most that are looked up, have a table of their own.
        self.bytes = self.ranks(self.inner[:, None], np.concatenate([self.inner, self.last])[None])

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pair = a << 32 | b
        i = np.minimum(np.searchsorted(self.key, pair), len(self.key) - 1)
        return np.where(self.key[i] == pair, self.rank[i], self.none)

    def __call__(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts, and how many each one has."""
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        data = np.frombuffer(b"".join(parts), np.uint8)
        ends = np.cumsum(size)
        ids = self.inner[data]
        ids[ends - 1] = self.last[data[ends - 1]]
        own = np.repeat(np.arange(len(parts)), size)
        last = np.zeros(len(data), np.int64)
        last[ends - 1] = 256
        rank = np.append(self.bytes[data[:-1], data[1:] + last[1:]], self.none)
        rank[ends - 1] = self.none
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            best = np.minimum.reduceat(rank << 32 | np.arange(len(ids)), first)
            live = best >> 32 < self.none
            at = best[live] & 0xFFFFFFFF
            ids[at] = self.new[best[live] >> 32]
            # The second of each joined pair goes, and so do parts without a pair left.
            stay = np.repeat(live, np.diff(np.append(first, len(ids))))
            done.append((own[~stay], ids[~stay]))
            stay[at + 1] = False
            place = np.cumsum(stay) - 1
            ids, own, rank, at = ids[stay], own[stay], rank[stay], place[at]
            for x in (at[at > 0] - 1, at):
                y = np.minimum(x + 1, len(ids) - 1)
                rank[x] = np.where((own[y] == own[x]) & (y > x), self.ranks(ids[x], ids[y]), self.none)
        own, ids = (np.concatenate(c) for c in zip(*done, strict=True))
        return ids[np.argsort(own, kind="stable")], np.bincount(own, minlength=len(parts))


class Encoder:
    """Ids of whole texts. Texts are divided at spaces, which the vocabulary's own rules always divide at, and equal words are encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.merges, self.known = Tokenizer.from_file(path), Merges(path), {}

    def _plain(self, words: list[bytes]) -> None:
        """Ids of words without odd characters, all at once: a line for each word, divided into parts, and equal parts once."""
        parts = PART.findall(b"\n".join(words).decode().lower() + "\n")
        index = {p: i for i, p in enumerate(dict.fromkeys(parts))}
        which = np.fromiter(map(index.__getitem__, parts), np.int64, len(parts))
        ids, n = self.merges([p.encode() for p in index])
        end = index["\n"]  # ends a word and has no id itself
        starts = np.cumsum(n) - n
        n[end] = 0
        flat = arrow.gathered(ids, starts[which], n[which]).astype("<u4").tobytes()
        cuts = (4 * np.cumsum(n[which])[which == end]).tolist()
        self.known.update(zip(words, [flat[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)], strict=True))

    def _add(self, words: list[bytes]) -> None:
        text = b"\n".join(words).decode()
        ends = np.cumsum([len(w) + 1 for w in words]) if text.isascii() else np.cumsum([len(w.decode()) + 1 for w in words])
        odd = {words[int(np.searchsorted(ends, m.start(), "right"))] for m in ODD.finditer(text)}
        for w in odd:
            self.known[w] = np.array(self.tokenizer.encode(w.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        if plain := [w for w in words if w not in odd] if odd else words:
            self._plain(plain)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts; text i has those from bounds[i] to bounds[i + 1]."""
        words, known = arrow.Words(texts), self.known
        here, which = words.distinct()
        if len(known) > CACHED:
            known.clear()
        if new := [w for w in here if w not in known]:
            self._add(new)
        flat, at = arrow.taken([known[w] for w in here], which)
        return np.frombuffer(flat, "<u4"), at[words.bounds] // 4


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    """One for each worker, so that later tasks find its words."""
    return Encoder(path)


def cut(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """The pieces of every document of ``docs`` (``doc_id``, ``text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = encoder(tokenizer), np.array([end], "<u4").tobytes()
        for rb in arrow.slices(batches):
            out = []
            flat, bounds = encode(arrow.utf8(rb["text"]))
            for doc, x, y in zip(rb["doc_id"].to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                ids, n = flat[x:y].tobytes() + last, y - x + 1
                out += [(doc, a, min(length, n - a), zlib.crc32(ids[4 * a : 4 * (a + length)]), n) for a in range(0, n, length)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def first_fit(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, in the order given. The tree's leaves are bins with their free room; an inner node has the larger of two."""
    leaves = 1 << max(0, len(sizes) - 1).bit_length()
    tree = [room] * (2 * leaves)
    where, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i, n in enumerate(sizes.tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < n:
                node += 1
        where[i], offset[i] = node - leaves, room - tree[node]
        tree[node] -= n
        while node > 1:
            node //= 2
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
    return where, offset


def pack(pieces: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Adds ``sequence_id`` and ``offset``. The pieces are written first, with a number for each that deals them to groups of about ``group``."""
    written = blocks.saved(pieces.withColumn("_row", F.monotonically_increasing_id()))
    groups = max(1, -(-written.count() // group))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        where, offset = first_fit(pdf["length"].to_numpy(), length)
        return pdf.assign(sequence_id=pdf["_group"].to_numpy() * (1 << 32) + where, offset=offset).drop(columns=["_group", "_row"])

    # A full piece fills a sequence by itself, but takes part so that numbers come from one place.
    dealt = written.withColumn("_group", F.pmod(F.xxhash64("_row", F.lit("pack")), F.lit(groups)))
    return dealt.groupBy("_group").applyInPandas(place, PIECES + ", sequence_id long, offset long")


def documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    return pack(cut(docs, tokenizer))
