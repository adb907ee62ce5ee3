"""SentencePiece encoding and decoding without its library's search.

A byte-pair vocabulary has one right tokenisation of a text, and every neighbouring pair of its tokens is compatible: encoding the pair's
own text gives back the pair. So each prefix has a unique last token: the match that ends there and is compatible with the last token of
the prefix before it. ``Encoder`` fills that table with the matches of an automaton over the vocabulary and recovers the ids backwards.

Pieces never have a space mark after another character, nor a newline (both are checked when a vocabulary is read), so parts that begin with
space marks or a newline are encoded independently, and equal parts once. The table of all new parts of up to LONG characters is filled at
once, position by position; longer parts have one each. Characters outside the vocabulary become one byte token for each UTF-8 byte and join
nothing.

Defined results: a null or empty text has no ids and decodes to an empty text; a literal space mark decodes to a space, as in the library;
repeated rows have equal results; a very long text is taken whole, by itself; only ``doc_id`` and ``text`` are read, so other columns
can't clash; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lorekeep.llm import arrow

MARK = "▁"
CACHED, LONG, SLOTS = 800_000, 32, 1 << 20
NEVER = float("-inf")


class Parts(arrow.Spans):
    """Parts of some texts that are encoded independently: each begins with spaces (one more stands before a text; marks count as spaces) or with a newline."""

    def __init__(self, texts: list[bytes]):
        mark = MARK.encode()
        texts = [b" " + (t.replace(mark, b" ") if mark in t else t) if t else t for t in texts]
        self.data = np.frombuffer(b"".join([*texts, b" " * 8]), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        own = self.data[: offsets[-1]]
        space = own == 32
        start = own == 10
        start[1:] |= space[1:] & ~space[:-1]
        start[offsets[:-1][np.diff(offsets) > 0]] = True
        self.starts = np.flatnonzero(start)
        self.ends = np.append(self.starts[1:], offsets[-1])[: len(self.starts)]
        self.bounds = np.searchsorted(self.starts, offsets)



class Encoder:
    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score, self.ids, self.surface, self.bytes = {}, {}, {}, {}
        self.automaton = ahocorasick.Automaton()
        self.piece = [""] * sp.get_piece_size()
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.surface[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[piece], self.score[piece] = i, sp.get_score(i)
                self.surface[i] = piece.replace(MARK, " ").encode()
                self.piece[i] = piece
                self.automaton.add_word(piece, i)
                if "\n" in piece or MARK in piece.lstrip(MARK):
                    raise ValueError(f"piece {i} goes on after a space mark or newline")
        self.automaton.make_automaton()
        self.size = np.array([len(p) for p in self.piece], np.int64)
        self.decimal = [str(i).encode() for i in range(len(self.piece))]
        self.shown = [self.surface.get(i, b"") for i in range(len(self.piece))]
        self.other: dict[str, int] = {}  # characters outside the vocabulary, numbered above its ids
        self.pair = np.full(SLOTS, -1, np.int64)
        self.pair_fits = np.zeros(SLOTS, bool)
        self.fits: dict[tuple[str, str], bool] = {}
        self.steps: dict[str, list[tuple[float, str, str]]] = {}
        self.known: dict[bytes, tuple[bytes, bytes]] = {}  # ids with a comma after each, and the text

    def merged(self, text: str) -> list[str]:
        """The definition: join the best-scored neighbouring pair, the leftmost of equals, until none is in the vocabulary."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def states(self, piece: str) -> list[tuple[float, str, str]]:
        """How a piece comes together alone: before each join its score, the first part and the last. Empty if it doesn't."""
        got = self.steps.get(piece)
        if got is None:
            got, parts = [], list(piece)
            while True:
                best, at = None, -1
                for i in range(len(parts) - 1):
                    x = self.score.get(parts[i] + parts[i + 1])
                    if x is not None and (best is None or x > best):
                        best, at = x, i
                if at < 0:
                    got = [*got, (NEVER, piece, piece)] if len(parts) == 1 else []
                    break
                got.append((best, parts[0], parts[-1]))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.steps[piece] = got
        return got

    def compatible(self, a: str, b: str) -> bool:
        """Whether encoding a + b gives a, b: no join across them comes first while each side goes through its own states."""
        left, right, i, j = self.states(a), self.states(b), 0, 0
        got = bool(left and right)
        while got:
            (x, _, end), (y, start, _) = left[i], right[j]
            across = self.score.get(end + start, NEVER)
            if across > x and across >= y and across > NEVER:
                got = False
            elif x == y == NEVER:
                break
            elif x >= y:
                i += 1
            else:
                j += 1
        if len(self.fits) > 4 * CACHED:
            self.fits.clear()
        self.fits[a, b] = got
        return got

    def tokens(self, part: str) -> list[str]:
        last: list[str] = [""] * (len(part) + 1)  # empty after a character outside the vocabulary
        fits = self.fits.get
        for end, i in self.automaton.iter(part):
            end, piece = end + 1, self.piece[i]
            if last[end]:
                continue
            a = last[end - len(piece)]
            ok = not a or fits((a, piece))
            if ok or ok is None and self.compatible(a, piece):
                last[end] = piece
        out, at = [], len(part)
        while at:
            t = last[at] or part[at - 1]
            out.append(t)
            at -= len(t)
        return out[::-1]

    def encode_part(self, part: str) -> list[int]:
        out: list[int] = []
        for t in self.tokens(part):
            i = self.ids.get(t)
            out += [i] if i is not None else [self.bytes[b] for b in t.encode()]
        return out

    def _fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``compatible`` for many pairs of ids, through a table with a place for each pair; what another pair has taken is worked out again."""
        pair = a << 32 | b
        slot = (arrow.mix(pair.view(np.uint64)) & np.uint64(SLOTS - 1)).astype(np.int64)
        ok = self.pair_fits[slot]
        miss = np.flatnonzero(self.pair[slot] != pair)
        if len(miss):
            few, which = np.unique(pair[miss], return_inverse=True)
            fits = np.fromiter((self.compatible(self.piece[x >> 32], self.piece[x & 0xFFFFFFFF]) for x in few.tolist()), bool, len(few))
            ok[miss] = fits[which]
            slot = (arrow.mix(few.view(np.uint64)) & np.uint64(SLOTS - 1)).astype(np.int64)
            # Of pairs with one place the last stays, in both columns alike.
            slot, last = np.unique(slot[::-1], return_index=True)
            last = len(few) - 1 - last
            self.pair[slot], self.pair_fits[slot] = few[last], fits[last]
        return ok

    def _table(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all parts one after the other, and how many each has. Characters outside the vocabulary have numbers above its ids."""
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        first = np.cumsum(size + 1) - size - 1
        text = "\n".join(parts)
        found = np.fromiter(chain.from_iterable(self.automaton.iter(text)), np.int64).reshape(-1, 2)
        end, token = found[:, 0] + 1, found[:, 1]
        inside = end - first[np.searchsorted(first, end - 1, "right") - 1]
        order = np.argsort(inside.astype(np.int16), kind="stable")
        end, token = end[order], token[order]
        start = end - self.size[token]
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(inside[order]) != 0, [True]])) if len(end) else []
        last = np.full(len(text) + 1, -1, np.int64)
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            before = last[start[x:y]]
            ok = before < 0
            ok[~ok] = self._fit(before[~ok], token[x:y][~ok])
            last[end[x:y][ok]] = token[x:y][ok]
        # The ids are read backwards, of all parts at once; what has no token is a character outside the vocabulary.
        own, at, out = np.arange(len(parts)), first + size, []
        while len(own):
            t = last[at]
            none = np.flatnonzero(t < 0)
            for i in none.tolist():
                t[i] = self._other(text[at[i] - 1])
            out.append((own, t))
            step = self.size[np.minimum(t, len(self.size) - 1)]
            step[none] = 1
            at = at - step
            on = at > first[own]
            own, at = own[on], at[on]
        own, tokens = (np.concatenate(c[::-1]) for c in zip(*out, strict=True))
        return tokens[np.argsort(own, kind="stable")], np.bincount(own, minlength=len(parts))

    def _other(self, char: str) -> int:
        i = self.other.get(char)
        if i is None:
            i = self.other[char] = len(self.decimal)
            self.decimal.append(b",".join(str(self.bytes[b]).encode() for b in char.encode()))
            self.shown.append(char.encode())
        return i

    def _add(self, keys: list[bytes]) -> None:
        keys.sort()  # neighbours walk the same way through the automaton
        parts = [k.decode().replace(" ", MARK) for k in keys]
        short = [i for i, p in enumerate(parts) if len(p) <= LONG]
        if short:
            tokens, n = self._table([parts[i] for i in short])
            ends = np.cumsum(n)
            got = zip(_cut([x + b"," for x in self.decimal], tokens, ends), _cut(self.shown, tokens, ends), strict=True)
            self.known.update(zip([keys[i] for i in short], got, strict=True))
        for i, p in enumerate(parts):
            if len(p) > LONG:
                ids = self.encode_part(p)
                self.known[keys[i]] = ("".join(f"{x}," for x in ids).encode(), b"".join(map(self.surface.__getitem__, ids)))

    def encode(self, texts: list[bytes]) -> Iterator[tuple[memoryview, memoryview, int]]:
        """For each text its ids, in decimal and comma-joined, the text that they decode to, and how many ids there are."""
        parts, known = Parts(texts), self.known
        here, which = parts.distinct()
        if len(known) > CACHED:
            known.clear()
        if new := [k for k in here if k not in known]:
            self._add(new)
        got = [known[k] for k in here]
        n = np.concatenate([[0], np.cumsum(np.fromiter((i.count(b",") for i, _ in got), np.int64, len(got))[which])])[parts.bounds]
        (ids, a), (text, b) = (arrow.taken([g[k] for g in got], which) for k in (0, 1))
        a, b = a[parts.bounds].tolist(), b[parts.bounds].tolist()
        for i in range(len(texts)):
            yield ids[a[i] : max(a[i], a[i + 1] - 1)], text[min(b[i] + 1, b[i + 1]) : b[i + 1]], int(n[i + 1] - n[i])


def _cut(values: list[bytes], which: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The values of each run of ``which`` in one."""
    flat, at = arrow.taken(values, which)
    to = at[ends].tolist()
    return [bytes(flat[a:b]) for a, b in zip([0, *to[:-1]], to, strict=True)]


@functools.lru_cache(2)
def encoder(model: str) -> Encoder:
    """One for each worker, so that later tasks find its parts."""
    return Encoder(model)


def digests(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` of every row of ``docs`` (``doc_id``, ``text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model)
        for rb in arrow.slices(batches):
            n, ids, decoded = [], [], []
            for i, d, k in own.encode(arrow.utf8(rb["text"])):
                n.append(k)
                ids.append(hashlib.sha256(i).hexdigest())
                decoded.append(hashlib.sha256(d).hexdigest())
            yield pa.RecordBatch.from_arrays([rb["doc_id"], pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id`` and ``ids``, an array, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model)
        for rb in arrow.slices(batches):
            ids = [[int(x) for x in bytes(i).split(b",")] if k else [] for i, _, k in own.encode(arrow.utf8(rb["text"]))]
            yield pa.RecordBatch.from_arrays([rb["doc_id"], pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")
