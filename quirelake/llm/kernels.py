"""Vectorised text kernels on Arrow buffers: words, hashes, shingles.

Words are maximal runs of bytes other than space and \\x09-\\x0D, with A-Z
lower-cased on demand. Work proceeds over slices of whole documents of bounded
size, so memory follows the longest document rather than the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 21

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_rng = np.random.default_rng(20_240_607)  # fixed: hashes must agree between runs and executors
_TABLE = _rng.integers(1, 1 << 63, (64, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TABLE[:, _SPACE] = 0
_STEP = _rng.integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    where = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), where


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes, or of one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


class Words:
    """The words of the rows of one slice.

    start, end: byte positions in ``data``; first: index of each row's first
    word (and one past the last row's); row: the row of each word.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool) -> None:
        base = int(offsets[0])
        self.data = data[base : int(offsets[-1])]
        if lower:
            self.data = _LOWER[self.data]
        self.offsets = offsets - base
        inside = ~_SPACE[self.data]
        before, after = np.zeros_like(inside), np.zeros_like(inside)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edges = self.offsets[(self.offsets > 0) & (self.offsets < len(inside))]
        before[edges] = False
        after[edges - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self) -> np.ndarray:
        """A 64-bit tabulation hash of each word's bytes."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        length = self.end - self.start
        reach = np.diff(np.append(self.start, len(self.data)))
        at = np.arange(int(self.start[0]), len(self.data)) - np.repeat(self.start, reach)
        part = _TABLE[at & 63, self.data[int(self.start[0]) :]]
        if int(length.max()) > 64:
            part = part * (np.uint64(2) * (at >> 6).astype(np.uint64) + np.uint64(1))
        total = np.add.reduceat(part, self.start - self.start[0])
        return mix(total + length.astype(np.uint64))

    def shingles(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the ``size`` words from each word on, and whether they all lie in its row."""
        n = len(hashes)
        out = np.zeros(n, np.uint64)
        for k in range(min(size, n)):
            out[: n - k] += hashes[k:] * _STEP[k]
        whole = np.arange(n) + size <= self.first[1:][self.row]
        return mix(out), whole

    def sets(self, size: int) -> Iterator[np.ndarray]:
        """Each row's distinct shingles, sorted; with fewer words all of them as one; else empty."""
        hashes = self.hashes()
        grams, _ = self.shingles(hashes, size)
        for row, n in enumerate(self.count.tolist()):
            a = int(self.first[row])
            if n >= size:
                yield np.unique(grams[a : a + n - size + 1])
            elif n:
                yield mix((hashes[a : a + n] * _STEP[:n]).sum(dtype=np.uint64, keepdims=True) + np.array([n], np.uint64) * _STEP[15])
            else:
                yield np.zeros(0, np.uint64)
