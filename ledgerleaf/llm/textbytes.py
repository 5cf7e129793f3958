"""Words of many texts at once, as numpy arrays over Arrow's UTF-8 bytes.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Nothing here makes a Python string for each
word: a batch is cut into pieces of about PIECE bytes, and each step is a few array operations.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER_ASCII = np.arange(256, dtype=np.uint8)
LOWER_ASCII[ord("A") : ord("Z") + 1] += 32

try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:  # not glibc
    _libc = None
_STEP = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of an odd multiplier, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 256) - 1, _STEP)]), dtype=np.uint64)
    return _powers


def mixed(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64: every bit of x changes every bit of the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bytes_and_offsets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and its n + 1 offsets into them; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def pieces(column: pa.Array, most: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of runs of rows with about `most` bytes; a longer text is a run of its own."""
    data, off = bytes_and_offsets(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi
    trim()


def trim() -> None:
    """Gives back to the system what this process has freed: workers live on between tasks, and an executor's memory counts them all."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


class Words:
    """Where the words of a piece start and end, and which belong to which text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        inside = ~SEPARATOR[data]
        begin, last = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        first_bytes = offsets[:-1][offsets[:-1] < len(data)]
        begin[first_bytes] = inside[first_bytes]
        last_bytes = offsets[1:][offsets[1:] > 0] - 1
        last[last_bytes] = inside[last_bytes]
        self.data, self.offsets = data, offsets
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.starts, offsets)  # words of text i: first[i] to first[i + 1]
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.starts)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def place(self) -> np.ndarray:
        """Each word's number in its own text."""
        return np.arange(len(self)) - np.repeat(self.first[:-1], self.counts)

    def hashes(self, bytes_: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each word; bytes_: of the same length as data, to hash in its place."""
        return hash_spans(self.data if bytes_ is None else bytes_, self.starts, self.ends)

    def runs(self, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of n words that stay in one text, and the index of each run's first word."""
        if len(h) < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        acc = np.zeros(len(h) - n + 1, np.uint64)
        for j in range(n):
            acc = acc * _STEP + h[j : j + len(acc)]
        left = np.repeat(self.first[1:], self.counts)[: len(acc)] - np.arange(len(acc))
        at = np.flatnonzero(left >= n)
        return mixed(acc[at]), at


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the spans, none empty."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = ends - starts
    to = np.cumsum(n)
    at = to - n
    inside = np.arange(int(to[-1])) - np.repeat(at, n)
    values = (data[inside + np.repeat(starts, n)].astype(np.uint64) + np.uint64(1)) * powers(int(n.max()))[inside]
    return mixed(np.add.reduceat(values, at) + n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def planes(x: np.ndarray) -> bytes:
    """An unsigned array's bytes, those of equal weight together: small numbers then compress to almost nothing."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes()


def unplanes(b: bytes, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(dtype).reshape(-1)
