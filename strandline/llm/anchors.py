"""Anchors: few places of a token sequence, chosen by content, such that every window of a length holds one.

The anchor of a window of ``window`` tokens is its k-gram of least hash, the last one of several. It depends on the window's
tokens alone, so equal windows have equal anchors at equal places. Consecutive windows mostly share an anchor: a *run* is an
anchor with the first and last start of its windows. Equal windows thus lie in runs of equal anchors, and only those need to
be compared. About 2 runs come on window - k + 2 tokens.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

PLACE_BITS = 20
CHUNK = 1 << (PLACE_BITS - 1)  # window starts handled at a time, so that long texts need little memory
_MASK = np.uint64((1 << PLACE_BITS) - 1)
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.ones(size, np.uint64), np.ones(size, np.uint64)
    up[1:], down[1:] = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any runs of a sequence of 64-bit token hashes."""

    def __init__(self, tokens: np.ndarray):
        size = 1 << max(len(tokens), 1).bit_length()
        self.up, self.down = _powers(size)
        self.sums = np.zeros(len(tokens) + 1, np.uint64)
        np.cumsum(tokens * self.up[:len(tokens)], out=self.sums[1:])

    def at(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[first]) * self.down[first])

    def every(self, length: int) -> np.ndarray:
        count = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:count]) * self.down[:count])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return x if span == width else np.minimum(x[:len(x) - (width - span)], x[width - span:])


def runs(tokens: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, first start, last start, hash of the run's tokens and shape) of every run; empty below one window."""
    found = []
    for base in range(0, max(len(tokens) - window + 1, 0), CHUNK):
        part = tokens[base:base + CHUNK + window - 1]
        rolling = Rolling(part)
        hashes = rolling.every(gram)
        packed = (hashes & ~_MASK) | (_MASK - np.arange(len(hashes), dtype=np.uint64))
        place = (_MASK - (sliding_min(packed, window - gram + 1) & _MASK)).astype(np.int64)
        cut = np.flatnonzero(np.diff(place)) + 1
        first = np.concatenate([[0], cut])
        last = np.concatenate([cut, [len(place)]]) - 1
        anchor = place[first]
        shape = mix(((anchor - first).astype(np.uint64) << np.uint64(32)) | (last - first).astype(np.uint64))
        found.append((hashes[anchor], first + base, last + base, rolling.at(first, last + window) ^ shape))
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return tuple(np.concatenate(c) for c in zip(*found))


def marked(size: int, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which of so many tokens lie in a span [first, end)."""
    if not len(spans):
        return np.zeros(size, bool)
    edges = np.zeros(size + 1, np.int64)
    bounds = np.asarray(spans, np.int64)
    np.add.at(edges, bounds[:, 0], 1)
    np.add.at(edges, bounds[:, 1], -1)
    return np.cumsum(edges[:size]) > 0
