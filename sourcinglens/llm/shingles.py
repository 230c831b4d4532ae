"""Word and phrase hashes of many texts at a time, in numpy.

A word's hash is a polynomial over its bytes modulo 2^64, taken from running
sums, then mixed; a phrase's is a mixed combination of its words' hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15                      # odd, so it has an inverse modulo 2^64
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_SAME = np.arange(256, dtype=np.uint8)
_LOWER = _SAME.copy()
_LOWER[0x41:0x5B] += 32
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """First ``n`` powers of the base and of its inverse."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of a few texts: byte spans ``start`` / ``end`` in ``data``, their
    hashes, and ``first[i]:first[i + 1]``, the words of text i."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lower: bool):
        self.data, self.bounds = data, bounds
        table = _LOWER if lower else _SAME
        blank = _BLANK[data]
        opens, closes = ~blank, ~blank
        opens[1:] &= blank[:-1]
        closes[:-1] &= blank[1:]
        full = bounds[:-1][np.diff(bounds) > 0]
        opens[full] = ~blank[full]
        last = bounds[1:][np.diff(bounds) > 0] - 1
        closes[last] = ~blank[last]
        self.start, self.end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, bounds)
        up, down = powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((table[data] + np.uint64(1)) * up[:len(data)], out=sums[1:])
        length = (self.end - self.start).astype(np.uint64)
        self.hash = mix((sums[self.end] - sums[self.start]) * down[self.start] + length)

    def phrases(self, k: int, seed: int = 0) -> np.ndarray:
        """Hash of the k words from each word on (the last k - 1 are not used
        by a text; phrases that leave their text are the caller's to skip)."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        up, down = powers(len(self.hash) + 1)
        sums = np.zeros(len(self.hash) + 1, np.uint64)
        np.cumsum(mix(self.hash + np.uint64(seed)) * up[:-1], out=sums[1:])
        return mix((sums[k:] - sums[:-k]) * down[:n] + np.uint64(k))


def groups(texts: pa.Array, lower: bool, size: int = 1 << 20) -> Iterator[tuple[int, Words]]:
    """Words of consecutive texts, about ``size`` bytes at a time, with the
    number of the first text."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        to = min(to, len(texts))
        yield at, Words(data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at], lower)
        at = to
