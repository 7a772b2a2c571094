"""Vectorized 64-bit hashes of the words of texts and of runs of words.

A word's hash is a polynomial over its bytes, a run's a polynomial over its words' hashes, both
modulo 2**64 and mixed at the end. Prefix sums give all of them in a few passes over flat arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Texts are handled in slices of about so many bytes.
SLICE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * _BASE)


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, _BASE), np.full(size, _INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse, n at least."""
    return _powers(1 << max(12, (n - 1).bit_length()))


class Words:
    """The words of some texts: hashes, byte ranges, and for each text the place of its first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        n = len(data)
        space = _SPACE[data]
        starts, ends = ~space, ~space
        starts[1:] &= space[:-1]
        ends[:-1] &= space[1:]
        inner = offsets[(offsets > 0) & (offsets < n)]
        starts[inner] = ~space[inner]
        ends[inner - 1] = ~space[inner - 1]
        self.data, self.starts, self.ends = data, np.flatnonzero(starts), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, offsets)
        up, down = powers(n + 1)
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * up[:n], out=sums[1:])
        raw = (sums[self.ends] - sums[self.starts]) * down[self.starts]
        self.hashes = mixed(raw + (self.ends - self.starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def left(self) -> np.ndarray:
        """For each word, how many words from it to the end of its text."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.starts))


def run_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash for each run of ``length`` hashes, at the place of its first; empty if there are fewer."""
    n = len(hashes)
    if n < length:
        return np.zeros(0, dtype=np.uint64)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(hashes * up[:n], out=sums[1:])
    return mixed((sums[length:] - sums[: n - length + 1]) * down[: n - length + 1] + np.uint64(length))


def text_hashes(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each text's whole sequence of words."""
    n = len(hashes)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(hashes * up[:n], out=sums[1:])
    return mixed((sums[first[1:]] - sums[first[:-1]]) * down[first[:-1]] + np.diff(first).astype(np.uint64) * _BASE)


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """A binary or string column in slices of about ``limit`` bytes: first and last row, bytes, and offsets; nulls are empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    whole = column.buffers()[2]
    data = np.frombuffer(whole, dtype=np.uint8) if whole else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end
