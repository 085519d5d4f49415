"""Vectorised text kernels: words, lines and n-grams of a whole Arrow batch as NumPy arrays of hashes.

A batch's texts lie in one byte buffer. A string's hash is a polynomial over its bytes modulo 2**64, read off
a prefix sum, so all words of a batch are hashed in a handful of array operations. White space is
``[\\x20\\x09-\\x0D]`` and upper case is A-Z, both ASCII, so bytes suffice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are taken in runs of about so many bytes (one longer text makes a run of its own).
RUN_BYTES = 1 << 20

_U = np.uint64
_rng = np.random.default_rng(20260101)
_BYTE = _rng.integers(1, 1 << 63, size=(2, 256), dtype=np.uint64) | _U(1)
_BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Powers:
    """Powers of an odd base and of its inverse, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), RUN_BYTES + 1)
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_POWERS = tuple(_Powers(b) for b in _BASE)
_WORD_POWERS = _Powers(0xD6E8FEB86659FD93)


class Run:
    """Some texts in one byte buffer: ``data`` and the ``bounds`` of each text in it."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray) -> None:
        self.data, self.bounds, self.n = data, bounds, len(bounds) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.bounds[i] : self.bounds[i + 1]].tobytes()

    def spans(self, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal spans without separators, within texts: starts, ends, and each text's bounds among them."""
        inside = ~separator
        first = inside.copy()
        first[1:] &= separator[:-1]
        last = inside.copy()
        last[:-1] &= separator[1:]
        full = self.bounds[:-1] < self.bounds[1:]
        heads, tails = self.bounds[:-1][full], self.bounds[1:][full] - 1
        first[heads] = inside[heads]
        last[tails] = inside[tails]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        return starts, ends, np.searchsorted(starts, self.bounds)

    def hashes(self, starts: np.ndarray, ends: np.ndarray, *, lower: bool, which: int = 0) -> np.ndarray:
        """A hash of the bytes from each start to its end; ``lower`` folds A-Z."""
        table = _BYTE[which][LOWER] if lower else _BYTE[which]
        up, down = _POWERS[which].get(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum(table[self.data] * up[:-1], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))

    def words(self, *, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word starts, ends, each text's bounds among the words, and the words' hashes."""
        starts, ends, bounds = self.spans(IS_SPACE[self.data])
        return starts, ends, bounds, self.hashes(starts, ends, lower=lower)


def runs(texts: pa.Array, limit: int = RUN_BYTES) -> Iterator[tuple[int, Run]]:
    """The texts of an Arrow column in runs, each with the position of its first text; null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, Run(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def windows(bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First positions of all windows of ``size`` items within each text, and the texts' bounds among them."""
    counts = np.maximum(np.diff(bounds) - size + 1, 0)
    out = np.concatenate(([0], np.cumsum(counts)))
    return np.repeat(bounds[:-1] - out[:-1], counts) + np.arange(out[-1]), out


def gram_hashes(items: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Order-sensitive hashes of ``size`` consecutive item hashes from each position."""
    up, down = _WORD_POWERS.get(len(items) + 1)
    sums = np.zeros(len(items) + 1, dtype=np.uint64)
    np.cumsum(items * up[:-1], out=sums[1:])
    return mix((sums[at + size] - sums[at]) * down[at] + _U(size))


def range_hashes(items: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Order-sensitive hashes of the items from each start to its end."""
    up, down = _WORD_POWERS.get(len(items) + 1)
    sums = np.zeros(len(items) + 1, dtype=np.uint64)
    np.cumsum(items * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)


def in_sieve(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether a sieve's bit is set for each unsigned value."""
    place = values & np.uint64(32 * len(table) - 1)
    return ((table[(place >> np.uint64(5)).astype(np.int64)] >> (place & np.uint64(31)).astype(np.uint32)) & np.uint32(1)).astype(bool)
