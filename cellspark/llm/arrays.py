"""Array kernels over Arrow text columns: words, word hashes and n-gram hashes of many documents at once.

Everything works on the UTF-8 bytes of a slice of documents, so that no Python string is made per word."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
#: Odd multipliers: of bytes in a word's hash, and of words in an n-gram's hash.
BYTE_BASE = np.uint64(0x9E3779B97F4A7C15)
WORD_BASE = np.uint64(0xD6E8FEB86659FD93)

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Words of `[^\x20\x09-\x0D]+`.
NOT_SPACE = ~SPACES
#: Words of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`: digits, a-z and all that is not ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that all bits depend on all bits (the public splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and each row's offset in them; null reads as empty."""
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about limit bytes of text; a longer document comes alone."""
    _, offsets = text_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def released() -> None:
    """Give memory that a task has freed back to the system, as its Python worker lives on. Without glibc only Arrow's part goes."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def releasing(run):
    """The function run of a task's batches, after whose last result the worker's freed memory is released."""

    @functools.wraps(run)
    def then_released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        released()

    return then_released


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of BYTE_BASE and of its inverse, at least n."""
    if len(_POWERS[0]) < n:
        n = max(n, SLICE_BYTES + 1)
        for k, base in enumerate((BYTE_BASE, np.uint64(pow(int(BYTE_BASE), -1, 1 << 64)))):
            powers = np.full(n, base)
            powers[0] = 1
            _POWERS[k] = np.cumprod(powers)
    return _POWERS


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ranges of bytes, none empty; equal ranges have equal ones, in every process."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


class Words:
    """The words of a slice of documents: byte ranges, 64-bit hashes and each document's first word."""

    def __init__(self, column: pa.Array, is_word: np.ndarray, lower: bool = False):
        data, offsets = text_bytes(column)
        self.data = np.take(LOWER, data) if lower else data
        self.offsets, self.docs = offsets, len(offsets) - 1
        inside = is_word[self.data]
        edge = np.empty(len(inside), bool)  # a word begins here
        if len(inside):
            edge[0] = True
            np.logical_not(inside[:-1], out=edge[1:])
            edge[offsets[:-1][offsets[:-1] < len(inside)]] = True
        self.starts = np.flatnonzero(inside & edge)
        if len(inside):
            edge[-1] = True
            np.logical_not(inside[1:], out=edge[:-1])
            edge[offsets[1:][offsets[1:] > 0] - 1] = True
        self.ends = np.flatnonzero(inside & edge) + 1
        #: Where each document's words begin, and at last their number.
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.n = len(self.starts)

    @property
    def doc(self) -> np.ndarray:
        """The document of each word, as a row of the slice."""
        return np.repeat(np.arange(self.docs), self.counts)

    @property
    def place(self) -> np.ndarray:
        """The place of each word in its document."""
        return np.arange(self.n) - np.repeat(self.first[:-1], self.counts)

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the words, the same in every process."""
        return range_hashes(self.data, self.starts, self.ends)


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words; those that cross documents are among them (see within)."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:size].copy()
    for k in range(1, n):
        out *= WORD_BASE
        out += hashes[k : k + size]
    return mix(out)


def within(doc: np.ndarray, n: int) -> np.ndarray:
    """Which runs of n words lie in one document."""
    return doc[: len(doc) - n + 1] == doc[n - 1 :] if len(doc) >= n else np.zeros(0, bool)


def spans_flagged(starts: np.ndarray, length: int, size: int) -> np.ndarray:
    """Which of size places lie in [start, start + length) of any start."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, starts, 1)
    np.subtract.at(change, np.minimum(starts + length, size), 1)
    return np.cumsum(change[:-1]) > 0


def packed(values: list[np.ndarray], dtype) -> pa.Array:
    """A binary column of number arrays."""
    return pa.array([np.ascontiguousarray(v, dtype).tobytes() for v in values], pa.binary())


def unpacked(column, dtype) -> np.ndarray:
    """The numbers of all rows of a binary column, one after the other."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        return np.concatenate([unpacked(c, dtype) for c in column.chunks]) if column.num_chunks else np.zeros(0, dtype)
    return np.frombuffer(text_bytes(column)[0].tobytes(), dtype) if len(column) else np.zeros(0, dtype)


def isin_sorted(values: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each value is in the sorted table, and its place there."""
    if not len(table):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values, at
