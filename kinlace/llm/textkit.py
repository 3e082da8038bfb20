"""Vectorised text primitives over Arrow batches, shared by the operators of this subpackage.

A batch of texts is looked at as one byte array with document offsets, so that words, lines and
n-grams of all its documents are found by a few numpy passes and no per-document Python code.
UTF-8 continuation bytes are all >= 0x80, so byte classes below 0x80 give exact word bounds.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa

#: Bytes of text that are looked at together; a single longer text makes a slice of its own.
SLICE_BYTES = 2 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)  # odd
_STEP = _U(0xD1B54A32D192ED03)  # odd

#: Words of class `space`: runs without space and \x09-\x0D.
SPACE_WORDS = np.ones(256, dtype=bool)
SPACE_WORDS[[0x20, *range(0x09, 0x0E)]] = False
#: Words of class `alnum`, after lower-casing: digits, a-z and everything above ASCII.
ALNUM_WORDS = np.zeros(256, dtype=bool)
ALNUM_WORDS[0x30:0x3A] = ALNUM_WORDS[0x61:0x7B] = ALNUM_WORDS[0x80:] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


class Powers:
    """Powers of the hash base, grown on demand."""

    def __init__(self) -> None:
        self.table = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.table) <= n:
            self.table = np.concatenate([self.table, self.table * (self.table[-1:] * _BASE)])
        return self.table


_POWERS = Powers()


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for ascending, disjoint, non-empty spans."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    lens = ends - starts
    total = int(lens.sum())
    first = np.cumsum(lens) - lens
    within = np.arange(total, dtype=np.int64) - np.repeat(first, lens)
    at = within + np.repeat(starts, lens)
    terms = (data[at].astype(np.uint64) + _U(1)) * _POWERS.upto(int(lens.max()))[within]
    return mix(np.add.reduceat(terms, first) + lens.astype(np.uint64) * _STEP)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k word hashes; empty if there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = words[:n].copy()
    for j in range(1, k):
        h = h * _BASE + words[j : j + n]
    return mix(h)


class Slice:
    """Some consecutive rows: `data` is all their text bytes, `off` the rows' offsets (n + 1)."""

    def __init__(self, rows: slice, data: np.ndarray, off: np.ndarray, lower: bool) -> None:
        self.rows, self.off, self.n = rows, off, len(off) - 1
        self.raw = data
        self.data = _LOWER[data] if lower else data

    def text(self, i: int) -> bytes:
        return self.raw[self.off[i] : self.off[i + 1]].tobytes()

    def words(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and row numbers of all words, in order."""
        inside = np.zeros(len(self.data) + 1, dtype=bool)
        inside[:-1] = table[self.data]
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:]
        edges = self.off[1:-1]
        opens[edges] = inside[edges]
        edges = edges[edges > 0]
        closes[edges - 1] = inside[edges - 1]
        starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        return starts, ends, self.row_of(starts)

    def row_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.off, at, side="right") - 1

    def count(self, flags: np.ndarray) -> np.ndarray:
        """How many flagged bytes each row has."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.off[1:]] - total[self.off[:-1]]


def as_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Text bytes and int64 offsets of a string or binary column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not (wide or pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        column, wide = column.cast(pa.string()), False
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(column: pa.Array | pa.ChunkedArray, lower: bool = False, limit: int | None = None) -> Iterator[Slice]:
    """The column's rows in order, some `limit` bytes at a time."""
    data, off = as_bytes(column)
    limit, n, at = limit or SLICE_BYTES, len(off) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
        yield Slice(slice(at, to), data[off[at] : off[to]], off[at : to + 1] - off[at], lower)
        at = to


def keep() -> None:
    """Keep free memory for the arrays to come, until release(): fresh pages cost as much as many a pass over them."""
    with suppress(OSError, AttributeError):
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD: the most there is
        libc.mallopt(-1, 128 << 20)  # M_TRIM_THRESHOLD


def release() -> None:
    """Give free memory back at a task's end: a worker is kept for later tasks, and beside it others wait for theirs."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only in the GNU C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def distinct_counts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether an equal one stands earlier, and how often it occurs."""
    if not len(keys):
        return np.zeros(0, dtype=bool), np.zeros(0, dtype=np.int64)
    _, first, inverse, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    again = np.ones(len(keys), dtype=bool)
    again[first] = False
    return again, counts[inverse]


def by_row(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Keys that differ between rows."""
    return mix(keys + (rows.astype(np.uint64) + _U(1)) * _STEP)


def ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Concatenation of arange(start, start + len)."""
    total = int(lens.sum())
    first = np.cumsum(lens) - lens
    return np.arange(total, dtype=np.int64) + np.repeat(starts - first, lens)


class HashIndex:
    """Numbers 0, 1, ... for 64-bit keys in the order they came; two sorted levels, the smaller of new keys."""

    def __init__(self) -> None:
        self.n = 0
        self.keys = [np.zeros(0, dtype=np.uint64)] * 2
        self.numbers = [np.zeros(0, dtype=np.int64)] * 2

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The keys' numbers; -1 for new ones."""
        out = np.full(len(keys), -1, dtype=np.int64)
        for known, number in zip(self.keys, self.numbers, strict=True):
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[at] == keys
                out[hit] = number[at[hit]]
        return out

    def add(self, keys: np.ndarray) -> np.ndarray:
        """Numbers for distinct keys that are all new."""
        new = self.n + np.arange(len(keys), dtype=np.int64)
        self.n += len(keys)
        key, number = np.concatenate([self.keys[1], keys]), np.concatenate([self.numbers[1], new])
        if len(key) > 20_000 + len(self.keys[0]) // 4:
            key, number = np.concatenate([self.keys[0], key]), np.concatenate([self.numbers[0], number])
            order = np.argsort(key, kind="stable")
            self.keys, self.numbers = [key[order], key[:0]], [number[order], number[:0]]
        else:
            order = np.argsort(key, kind="stable")
            self.keys[1], self.numbers[1] = key[order], number[order]
        return new


class KeyFilter:
    """A bitmap of fixed size over 64-bit keys: never misses a key that was added, and passes few others while it is sparse."""

    BITS = 25
    CHUNK = 1 << 16

    def __init__(self, packed: np.ndarray | None = None) -> None:
        self.packed = np.zeros((1 << self.BITS) // 8, dtype=np.uint8) if packed is None else packed

    @classmethod
    def places(cls, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.view(np.uint64)) >> _U(64 - cls.BITS)).astype(np.int64)

    def add(self, keys: np.ndarray) -> None:
        at = self.places(keys)
        np.bitwise_or.at(self.packed, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = self.places(keys)
        return (self.packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
