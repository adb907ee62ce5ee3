"""Language-model scores by context-tree weighting.

A text is its lowercased words with a space after each, and the end token; a byte's contexts are the up to DEPTH bytes before it in this running
text, across words (spaces stand before the first). A byte is eight binary decisions, and each decision has a context tree with a
Krichevsky-Trofimov estimator in every node; a node's probability is half its own estimate and half the product of its children's, so all
depths are mixed by how well they coded the corpus. Scoring walks the frozen trees: weight * own estimate + (1 - weight) * the deeper
node's. A node that the corpus never reached gives its parent's estimate (one half above the root), so a new context costs no more than the
shorter one that is known.

Running texts are written once in units of some MB. A unit counts its distinct contexts with their bytes before anything is exchanged; these meet
in buckets by the hash of the two nearest bytes, and a unit gets back one probability for each of its own. Nothing of the corpus's size meets
in one place; only the top of the trees (contexts of none and one byte: at most 257 * 255 nodes) goes through the driver. Word counts,
for the base score, travel in parts by hash of the word.

Defined results: a null or empty text is the end token alone; without training documents every estimate is uniform; repeated rows count
each time.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm import arrow, blocks

DEPTH = 5  #: seven and the byte itself would fill a 64-bit key; each byte more doubles the distinct contexts
END = b"\n"  #: no word has a newline
PART_DOCS = 16_384
UNIT = 8 << 20  #: bytes of text in a unit
STEP = 1 << 20  #: bytes of a unit's text of which all contexts are held at once, at some 60 bytes each
BUCKETS = 8  #: buckets of contexts for each part of words
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"

_TABLE = 1 << 16
_HALF = np.concatenate([[0.0], np.cumsum(np.log(np.arange(_TABLE) + 0.5))])
_WHOLE = np.concatenate([[0.0], np.cumsum(np.log(np.arange(_TABLE) + 1.0))])


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def _rising(n: np.ndarray, table: np.ndarray, add: float) -> np.ndarray:
    """log of add * (1 + add) * ... of n factors."""
    out = table[np.minimum(n, _TABLE)]
    far = n > _TABLE
    if far.any():
        stirling = lambda x: (x - 0.5) * np.log(x) - x + 1 / (12 * x)  # noqa: E731  log gamma but for a constant
        out[far] = table[_TABLE] + stirling(n[far] + add) - stirling(np.float64(_TABLE) + add)
    return out


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """log of the KT probability of n0 zeros and n1 ones."""
    return _rising(n0, _HALF, 0.5) + _rising(n1, _HALF, 0.5) - _rising(n0 + n1, _WHOLE, 1.0)


def contexts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of every text, with its closing space unless END closes it: the context, nearest byte first, above the byte itself; and where each text starts."""
    gap = b" " * 7
    size = np.fromiter((len(t) + (not t.endswith(END)) for t in texts), np.int64, len(texts))
    raw = np.fromiter(map(len, texts), np.int64, len(texts))
    first = 7 + np.concatenate([[0], np.cumsum(raw + 7)[:-1]])
    starts = np.concatenate([[0], np.cumsum(size)[:-1]])
    data = gap + gap.join(texts) + gap
    edges = np.zeros(len(data) + 1, np.int8)  # 1 where a text starts, -1 behind its last byte
    edges[first], edges[first + size] = 1, -1
    here = np.cumsum(edges[7:-1], dtype=np.int8).view(bool)
    # The eight bytes that end at each byte, the byte itself on top; turned, it comes last and the nearest one first.
    past = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))[here]
    last = np.frombuffer(data, np.uint8)[7:][here]
    past <<= np.uint64(8)
    past >>= np.uint64(8 * (8 - DEPTH))
    past <<= np.uint64(8)
    past |= last
    return past.view(np.int64), starts


def _summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, sorted, with sums."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], *[np.add.reduceat(v[order], first) if len(key) else v for v in values]


def _new(a: np.ndarray) -> np.ndarray:
    """Whether a run of equal values starts here."""
    return np.concatenate([[True], a[1:] != a[:-1]])[: len(a)]


def _runs(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal values starts, and each value's run."""
    new = _new(a)
    return np.flatnonzero(new), np.cumsum(new) - 1


def _sums(n: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(n, first) if len(n) else n


def _counted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and how often each one stands in ``key``, which is put in order."""
    key.sort()
    first = np.flatnonzero(_new(key))
    return key[first], np.diff(np.append(first, len(key)))


def _union(keys: Iterable[np.ndarray]) -> np.ndarray:
    """Distinct keys, sorted. What is held grows with these, not with all keys."""
    out, more, n = np.zeros(0, np.int64), [], 0
    for key in keys:
        more.append(key)
        n += len(key)
        if n > max(len(out), UNIT // 8):
            out, more, n = _merged([out, *more]), [], 0
    return _merged([out, *more])


def _merged(keys: list[np.ndarray]) -> np.ndarray:
    key = np.concatenate(keys)
    key.sort()
    return key[_new(key)]


class Forest:
    """The context trees below one-byte contexts, of all contexts of some pairs of nearest bytes, from ``key`` (distinct, in order) and counts.

    Levels are built from the deepest up, and only what the next one needs is held. With ``asked``, ``p`` follows each key upwards: the probability
    of a one at its eight decisions, mixed from depth DEPTH up to 2. A key that was only asked for has a count of 0: it changes no estimate, and a
    node without counts passes on its parent's.
    """

    def __init__(self, key: np.ndarray, n: np.ndarray, asked: bool = False):
        self.p = np.full((8, len(key)), np.nan, np.float32) if asked else None
        at = np.arange(len(key), dtype=np.int32)  # for each key asked for, its place among the keys of this depth
        below: list[tuple[np.ndarray, np.ndarray]] = []
        top = []
        inverse = None
        for depth in range(DEPTH, 0, -1):
            above = []
            for b in range(8):
                # Keys of this depth in order, so the bytes that share a node of a decision lie together.
                first, group = _runs(key >> (8 - b))
                total, one = _sums(n, first), _sums(n * (key >> (7 - b) & 1), first)
                up = None if inverse is None else np.bincount(group[inverse[below[b][0]]], below[b][1], len(first))
                if depth == 1:
                    entry = key[first] >> 8 << 8 | 1 << b | (key[first] & 255) >> (8 - b)
                    top.append((entry, total - one, one, np.zeros(len(first)) if up is None else up))
                    continue
                own = log_kt(total - one, one)
                weighted = own if up is None else np.logaddexp(own, up) - np.log(2)
                if self.p is not None:
                    here = group[at]
                    share = ((one + 0.5) / (total + 1)).astype(np.float32)[here]
                    stop = np.ones(1, np.float32) if up is None else np.exp(own - np.log(2) - weighted).astype(np.float32)[here]
                    p = np.where(np.isnan(self.p[b]), share, stop * share + (1 - stop) * self.p[b])
                    self.p[b] = np.where((total > 0)[here], p, np.nan)
                above.append((first, weighted))
            if depth == 1:
                break
            below = above
            shorter = key >> 16 << 8 | key & 255
            order = np.argsort(shorter, kind="stable")
            first, group = _runs(shorter[order])
            inverse = np.empty(len(key), np.int32)
            inverse[order] = group
            at = inverse[at]
            key, n = shorter[order][first], _sums(n[order], first)
        flat = [np.concatenate(c) for c in zip(*top, strict=True)]
        order = np.argsort(flat[0])
        self.top = tuple(c[order] for c in flat)  #: one-byte contexts, as far as these trees hang below them


class Top:
    """Contexts of one and no byte."""

    def __init__(self, entry: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray):
        self.levels = []
        for depth in (1, 0):
            own = log_kt(n0, n1)
            weighted = np.logaddexp(own, below) - np.log(2)
            self.levels.append((depth, entry, n0, n1, np.exp(own - np.log(2) - weighted)))
            entry, n0, n1, below = _summed(entry & 255, n0, n1, weighted)

    def log10(self, key: np.ndarray, p: np.ndarray) -> np.ndarray:
        """log10 probability of each byte in its context, from ``Forest.p``."""
        byte, total = key & 255, np.zeros(len(key))
        # The nodes are few: each is sought once.
        few, which = np.unique((key >> 8 * DEPTH << 8 | byte).astype(np.int32), return_inverse=True)
        few, last = few.astype(np.int64), few.astype(np.int64) & 255
        for b in range(8):
            q = p[b]
            node = (1 << b) | (last >> (8 - b))
            for depth, entry, n0, n1, stop in self.levels:
                if not len(entry):
                    continue
                at = node | (few >> 8 << 8 if depth else 0)
                i = np.minimum(np.searchsorted(entry, at), len(entry) - 1)
                own, weight = np.where(entry[i] == at, (n1[i] + 0.5) / (n0[i] + n1[i] + 1), np.nan)[which], stop[i][which]
                q = np.where(np.isnan(q), own, weight * own + (1 - weight) * q)
            q = np.where(np.isnan(q), 0.5, q)
            total += np.log10(np.where((byte >> (7 - b)) & 1 == 1, q, 1 - q))
        return total


def _one(columns: dict, types: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, types[k]) for k, v in columns.items()], names=list(columns))


@arrow.lean
def _running(rb: pa.RecordBatch) -> pa.RecordBatch:
    """``doc_id``, ``text``, the running text that is scored, and ``n_bytes`` of the text itself."""
    raw = arrow.utf8(rb["text"])
    texts = [b" ".join([*t.lower().split(), END]) for t in raw]
    return pa.RecordBatch.from_arrays([rb["doc_id"].cast(pa.int64()), pa.array(texts, pa.binary()), pa.array(map(len, raw), pa.int64())], names=["doc_id", "text", "n_bytes"])


def _distinct(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A unit's distinct contexts with bytes, in order, and how often its training rows have them."""
    keys, counts = [], []
    for rb in blocks.opened(blob, STEP):
        held = [held_out(i) for i in rb["doc_id"].to_pylist()]
        for out in (False, True):
            texts = [t for t, h in zip(rb["text"].to_pylist(), held, strict=True) if h == out]
            if texts:
                key, n = _counted(contexts(texts)[0])
                keys.append(key)
                counts.append(None if out else n)
    key = _union(keys)
    total = np.zeros(len(key), np.int64)
    for own, n in zip(keys, counts, strict=True):
        if n is not None:
            total[np.searchsorted(key, own)] += n
    return key, total


def _bucket(key: np.ndarray, n: int) -> np.ndarray:
    return (arrow.mix((key >> 8 * (DEPTH - 1) & 0xFFFF).astype(np.uint64)) % np.uint64(n)).astype(np.int64)


def _words(units: DataFrame, parts: int) -> DataFrame:
    """``part``, ``unit``, ``blob``: each unit's distinct tokens with their training counts, by hash of the token."""
    types = {"part": pa.int64(), "unit": pa.int64(), "blob": pa.binary()}

    @arrow.lean
    def of(row: tuple[int, pa.Scalar]) -> pa.RecordBatch:
        unit, n = row[0], {END: 0}
        for rb in blocks.opened(row[1], STEP):
            train = np.array([not held_out(i) for i in rb["doc_id"].to_pylist()])
            words = arrow.Words(rb["text"].to_pylist())
            here, which = words.distinct()
            n[END] += int(train.sum())
            counts = np.bincount(which, np.repeat(train, np.diff(words.bounds)), len(here)).astype(np.int64)
            for w, k in zip(here, counts.tolist(), strict=True):
                n[w] = n.get(w, 0) + k
        words = list(n)
        counts = np.fromiter(n.values(), np.int64, len(n))
        part = arrow.Words([w if w != END else b"|" for w in words]).hashes() % np.uint64(parts)
        out = {k: [] for k in types}
        order = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[order], np.arange(parts + 1).astype(np.uint64))
        for p in range(parts):
            own = order[cut[p] : cut[p + 1]]
            if len(own):
                out["part"].append(p)
                out["unit"].append(unit)
                out["blob"].append(arrow.pack(pa.table({"w": pa.array([words[i] for i in own.tolist()], pa.binary()), "n": counts[own]})))
        return _one(out, types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            yield from map(of, zip(rb["unit"].to_pylist(), rb["blob"], strict=True))

    return units.mapInArrow(run, "part long, unit long, blob binary")


@arrow.lean
def _counts(t: pa.Table) -> pa.Table:
    """Each unit's tokens of a part with their count in the corpus; the part's totals stand in its first row."""
    index: dict[bytes, int] = {}
    where, counts, tables = [], [], []
    for blob in t["blob"].to_pylist():
        tables.append(arrow.unpack(blob))
        where.append(np.fromiter((index.setdefault(w, len(index)) for w in tables[-1]["w"].to_pylist()), np.int64, tables[-1].num_rows))
        counts.append(tables[-1]["n"].to_numpy())
    n = np.zeros(len(index), np.int64)
    for i, c in zip(where, counts, strict=True):
        n[i] += c
    out = [arrow.pack(pa.table({"w": own["w"], "n": n[i]})) for own, i in zip(tables, where, strict=True)]
    zeros = [0] * (len(out) - 1)
    return pa.table({"unit": t["unit"], "blob": pa.array(out, pa.binary()), "tokens": pa.array([int(n.sum()), *zeros], pa.int64()), "distinct": pa.array([int((n > 0).sum()), *zeros], pa.int64())})


def _asks(units: DataFrame, buckets: int) -> DataFrame:
    """``bucket``, ``unit``, ``size``, ``keys``, ``counts``: what each unit counts, and asks for, in each bucket of contexts."""
    types = {"bucket": pa.int64(), "unit": pa.int64(), "size": pa.int64(), "keys": pa.binary(), "counts": pa.binary()}

    @arrow.lean
    def of(row: tuple[int, pa.Scalar]) -> pa.RecordBatch:
        unit, (key, n) = row[0], _distinct(row[1].as_py())
        order = np.argsort(_bucket(key, buckets), kind="stable")
        key, n = key[order], n[order]
        cut = np.searchsorted(_bucket(key, buckets), np.arange(buckets + 1))
        rows = [(b, unit, y - x, arrow.packed(key[x:y]), arrow.packed(n[x:y])) for b, (x, y) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if y > x]
        return _one(dict(zip(types, map(list, zip(*rows, strict=True)), strict=True)), types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            yield from map(of, zip(rb["unit"].to_pylist(), rb["blob"], strict=True))

    return units.mapInArrow(run, "bucket long, unit long, size long, keys binary, counts binary")


@arrow.lean
def _bucketed(t: pa.Table) -> pa.Table:
    """A bucket in one row: its contexts with bytes, their counts, where each unit's are among them, and the bucket's share of the top."""

    def unpacked(column: str) -> Iterator[np.ndarray]:
        """Each unit's, one at a time."""
        return (arrow.unpacked(k.as_py(), n) for k, n in zip(t[column], t["size"].to_pylist(), strict=True))

    key = _union(unpacked("keys"))
    n = np.zeros(len(key), np.int64)
    where = []
    for own, counts in zip(unpacked("keys"), unpacked("counts"), strict=True):
        at = np.searchsorted(key, own)
        n[at] += counts
        where.append(arrow.packed(at))
    top = arrow.pack(pa.table(dict(zip(("entry", "n0", "n1", "below"), Forest(key, n).top, strict=True))))
    row = {"bucket": [t["bucket"][0].as_py()], "size": [len(key)], "keys": [arrow.packed(key)], "counts": [arrow.packed(n)], "units": [t["unit"].to_pylist()], "sizes": [t["size"].to_pylist()], "places": [where], "top": [top]}
    return pa.table(row, schema=pa.schema([("bucket", pa.int64()), ("size", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("units", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("places", pa.list_(pa.binary())), ("top", pa.binary())]))


def score(docs: DataFrame, depth_docs: int = PART_DOCS) -> DataFrame:
    """Scores of every row of ``docs`` (``doc_id``, ``text``), learnt from those not held out."""
    parts = max(1, -(-docs.count() // depth_docs))
    buckets = BUCKETS * parts
    units = blocks.units(docs, UNIT, change=_running)
    words = blocks.saved(_words(units, parts).groupBy("part").applyInArrow(_counts, "unit long, blob binary, tokens long, distinct long"))
    total = words.agg(F.sum("tokens").alias("n"), F.sum("distinct").alias("v")).first()
    tokens_all, distinct = total["n"] or 0, total["v"] or 0
    forests = blocks.saved(_asks(units, buckets).groupBy("bucket").applyInArrow(_bucketed, "bucket long, size long, keys binary, counts binary, units array<long>, sizes array<long>, places array<binary>, top binary"))

    def unroll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for blob in rb["top"].to_pylist():
                yield from arrow.unpack(blob).to_batches()

    tops = forests.select("top").mapInArrow(unroll, "entry long, n0 long, n1 long, below double").groupBy("entry").agg(F.sum("n0"), F.sum("n1"), F.sum("below")).orderBy("entry").toArrow()
    top = Top(*[c.to_numpy() for c in tops.columns])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The log10 probabilities that each unit asked a bucket for."""
        types = {"unit": pa.int64(), "bucket": pa.int64(), "p": pa.binary()}

        @arrow.lean
        def of(r: dict) -> np.ndarray:
            key, n = arrow.unpacked(r["keys"], r["size"]), arrow.unpacked(r["counts"], r["size"])
            return top.log10(key, Forest(key, n, asked=True).p).astype("<f4")

        for rb in batches:
            for i in range(rb.num_rows):
                r = {c: rb[c][i].as_py() for c in rb.schema.names}
                p = of(r)
                for unit, size, place in zip(r["units"], r["sizes"], r["places"], strict=True):
                    yield _one({"unit": [unit], "bucket": [r["bucket"]], "p": [p[arrow.unpacked(place, size)].tobytes()]}, types)

    answers = forests.drop("top").mapInArrow(answer, "unit long, bucket long, p binary")
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes"]
    target = pa.schema([(c, pa.bool_() if c == "held_out" else pa.float64() if "score" in c else pa.int64()) for c in names])
    # A unit's text, the counts of its words and the probabilities of its contexts, told apart by bucket.
    sent = units.select("unit", F.lit(-2).cast("long").alias("bucket"), F.col("blob").alias("p")).unionByName(words.select("unit", F.lit(-1).cast("long").alias("bucket"), F.col("blob").alias("p"))).unionByName(answers)

    @arrow.lean
    def sums(t: pa.Table) -> pa.Table:
        kind = t["bucket"].to_numpy()
        blob = t["p"][int(np.flatnonzero(kind == -2)[0])].as_py()
        index: dict[bytes, int] = {}
        n = []
        for i in np.flatnonzero(kind == -1).tolist():
            own = arrow.unpack(t["p"][i].as_py())
            index.update(zip(own["w"].to_pylist(), range(len(index), len(index) + own.num_rows), strict=True))
            n.append(own["n"].to_numpy())
        n = np.concatenate(n)
        base = np.log10((n + 0.1) / (tokens_all + 0.1 * (distinct + 1)))
        rows, places, keys, logs = [], [], [], []
        for rb in blocks.opened(blob, STEP):
            ids, texts = rb["doc_id"].to_pylist(), rb["text"].to_pylist()
            words = arrow.Words(texts)
            here, which = words.distinct()
            i = np.fromiter(map(index.__getitem__, here), np.int64, len(here))[which]
            score = np.concatenate([[0.0], np.cumsum(base[i])])[words.bounds]
            known = np.concatenate([[0], np.cumsum(n[i] > 0)])[words.bounds]
            end = index[END]
            for k, (doc, size) in enumerate(zip(ids, rb["n_bytes"].to_pylist(), strict=True)):
                tokens = int(words.bounds[k + 1] - words.bounds[k]) + 1
                rows.append((doc, held_out(doc), tokens, int(known[k + 1] - known[k]) + int(n[end] > 0), tokens_all, float(score[k + 1] - score[k] + base[end]), size))
            at, starts = contexts(texts)
            order = np.argsort(at)
            at = at[order]
            new = _new(at)
            which = np.empty(len(at), np.int32)  # each byte's context among the distinct ones
            which[order] = np.cumsum(new, dtype=np.int32) - 1
            keys.append(at[new])
            places.append((which, starts))
        key = _union(keys)
        p = np.empty(len(key), np.float32)
        replies = sorted((kind[i], i) for i in np.flatnonzero(kind >= 0).tolist())
        p[np.argsort(_bucket(key, buckets), kind="stable")] = np.concatenate([np.frombuffer(t["p"][i].as_py(), "<f4") for _, i in replies])
        for own, (which, starts) in zip(keys, places, strict=True):
            logs += np.add.reduceat(p[np.searchsorted(key, own)][which], starts, dtype=np.float64).tolist()
        rows = [(*r[:-1], log, r[-1]) for r, log in zip(rows, logs, strict=True)]
        return pa.table(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)), schema=target)

    out = sent.groupBy("unit").applyInArrow(sums, SCHEMA)
    # Bits that the model needs for each byte of the text.
    return out.withColumn("bits_per_byte", -F.col("score") / F.log10(F.lit(2.0)) / F.greatest(F.col("n_bytes"), F.lit(1)))
