"""Arrow batches in bounded slices, texts as bytes, and words as numpy arrays."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 4 << 20  #: bytes of text that one step of numpy work takes at once (or one longer text)

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], np.uint64)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches with at most ``size`` bytes of text, or one row."""
    for rb in batches:
        if not rb.num_rows:
            continue
        n = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(rb[text]), 0).to_numpy(zero_copy_only=False))])
        a = 0
        while a < rb.num_rows:
            b = max(a + 1, int(np.searchsorted(n, n[a] + size, "right")) - 1)
            yield rb.slice(a, b - a)
            a = b


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it


def release() -> None:
    """Freed memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def lean(step: Callable) -> Callable:
    """``step``, and then ``release``: a worker that waits for its next task keeps nothing from those that work beside it."""

    @functools.wraps(step)
    def run(given):
        out = step(given)
        release()
        return out

    return run


def copied(rb: pa.RecordBatch) -> pa.RecordBatch:
    return rb.take(pa.array(np.arange(rb.num_rows)))


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as bytes; null is empty."""
    return pc.fill_null(column.cast(pa.binary()), b"").to_pylist()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct value stands first in sorted order, and for each value which one it is."""
    order = np.argsort(h)
    new = np.concatenate([[True], h[order][1:] != h[order][:-1]])[: len(h)]
    which = np.empty(len(h), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which


def gathered(values: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """n[i] values from starts[i] on, for every i in turn."""
    ends = np.cumsum(n)
    return values[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - n), n)]


def taken(values: list[bytes], which: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The values at ``which`` one after the other, and where each one starts (and the last ends)."""
    if not len(which):
        return memoryview(b""), np.zeros(1, np.int64)
    _, offsets, data = pa.array(values, pa.large_binary()).take(pa.array(which)).buffers()
    return memoryview(data) if data is not None else memoryview(b""), np.frombuffer(offsets, np.int64)[: len(which) + 1]


class Spans:
    """Parts of some texts: byte ``starts`` and ``ends`` in ``data`` (which has 8 bytes more), and ``bounds``: text i has spans bounds[i] to bounds[i + 1]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each span, from eight bytes at a time. Another seed gives one that is independent for spans of more than eight."""
        size = self.ends - self.starts
        eight = np.ndarray((len(self.data) - 7,), "<u8", self.data, strides=(1,))
        h = mix(size.astype(np.uint64) * _A + np.uint64(seed))
        live, at = np.arange(len(size)), self.starts
        while len(live):
            rest = size[live]
            v = eight[at] & _MASK[np.minimum(rest, 8)]
            h[live] = mix((h[live] + _A) ^ v)
            on = rest > 8
            live, at = live[on], at[on] + 8
            size = size - 8 if len(live) else size
        return h

    def distinct(self) -> tuple[list[bytes], np.ndarray]:
        """Distinct spans by their hash, and for each span which one it is."""
        first, which = distinct(self.hashes())
        data = self.data.tobytes()
        return [data[a:b] for a, b in zip(self.starts[first].tolist(), self.ends[first].tolist(), strict=True)], which


class Words(Spans):
    """Words ``[^\\x20\\x09-\\x0D]+`` of some texts."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.data = np.frombuffer(b"".join([*texts, b" " * 8]), np.uint8)
        if lower:
            self.data = _LOWER[self.data]
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        n = int(offsets[-1])
        word = ~_SPACE[self.data[:n]]
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        edge = np.concatenate([[True], ~word])[:n] | first[:n]
        self.starts = np.flatnonzero(word & edge)
        edge = np.concatenate([~word, [True]])[1:] | first[1:]
        self.ends = np.flatnonzero(word & edge) + 1
        self.bounds = np.searchsorted(self.starts, offsets)

    def doc_of(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def windows(self, k: int, h: np.ndarray, base: int = 0x9E6D8E1B7A3F4C55) -> tuple[np.ndarray, np.ndarray]:
        """Rabin-Karp hash of the k words that start at each word, and whether all of them lie in its text."""
        n = len(h)
        w = np.zeros(n, np.uint64)
        if n >= k:
            for i in range(k):
                w[: n - k + 1] = w[: n - k + 1] * np.uint64(base) + h[i : n - k + 1 + i]
        last = np.repeat(self.bounds[1:], np.diff(self.bounds))
        return mix(w), np.arange(n) + k <= last


def pack(table: pa.Table | pa.RecordBatch, level: int = 1) -> bytes:
    """A table as one compressed value."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=level))) as out:
        out.write(table)
    return sink.getvalue().to_pybytes()


def unpack(value: bytes) -> pa.Table:
    return pa.ipc.open_stream(value).read_all()


def packed(a: np.ndarray) -> bytes:
    """Whole numbers as differences, all lowest bytes first, compressed."""
    d = np.diff(a.view(np.int64), prepend=np.int64(0))
    return pa.compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def unpacked(blob: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(blob, 8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, n).T).view(np.int64).ravel())
