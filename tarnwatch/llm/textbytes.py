"""UTF-8 text columns as NumPy byte arrays.

A batch of documents is one ``uint8`` array and ``int64`` offsets.  Kernels work on
blocks of documents of about ``BLOCK`` bytes, so their temporaries are bounded by that
size or by the longest single document.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 19

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: bytes of the words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[65:91] = ALNUM[128:] = True

#: bytes that are not white space ``[\x20\x09-\x0D]``
SOLID = np.ones(256, dtype=bool)
SOLID[[9, 10, 11, 12, 13, 32]] = False


def tidy(generator):
    """For a worker's generator: what its allocators have free goes back to the system when it ends.

    A worker stays for later tasks, and else would keep the largest size that it ever had."""

    @functools.wraps(generator)
    def run(*args, **how):
        try:
            yield from generator(*args, **how)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return run


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Data and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``size`` bytes each, one row at least."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true bytes; no run crosses a document's border."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    border = offsets[:-1][offsets[:-1] < n]
    before[border] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    border = offsets[1:][offsets[1:] > 0] - 1
    after[border] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def same_runs(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether run ``i`` of ``sizes[i]`` bytes is the same in ``a`` and in ``b``; a few MB of temporaries at a time."""
    out = np.ones(len(sizes), bool)
    edge = np.concatenate([[0], np.cumsum(sizes)])
    first = 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(edge, edge[first] + BLOCK, side="right")) - 1)
        n = sizes[first:last]
        step = np.arange(edge[last] - edge[first]) - np.repeat(edge[first:last] - edge[first], n)
        differ = a[np.repeat(a_starts[first:last], n) + step] != b[np.repeat(b_starts[first:last], n) + step]
        if differ.any():
            bad = np.concatenate([[0], np.cumsum(differ)])
            out[first:last] = bad[edge[first + 1 : last + 1] - edge[first]] == bad[edge[first:last] - edge[first]]
        first = last
    return out


def _odd_powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


class RunHasher:
    """64-bit hashes of many byte runs at once, from one running sum over the block.

    ``sum(T[byte] * r**position)`` modulo 2**64 over a run, divided by ``r**start``.  T is a
    fixed random table.  Equal runs have equal hashes, but different runs may too (Thue-Morse words
    do by construction): users confirm hits on the bytes with :func:`same_runs`.
    """

    def __init__(self, seed: int = 1):
        self.table = np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = 0x9E3779B97F4A7C15 | 1
        self.inverse = pow(self.base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(data)
        if len(self.up) < n + 1:
            self.up, self.down = _odd_powers(self.base, n + 1), _odd_powers(self.inverse, n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[:n], out=sums[1:])
        h = (sums[ends] - sums[starts]) * self.down[starts]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        return h
