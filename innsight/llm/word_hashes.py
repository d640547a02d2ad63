"""Hashes of the words of many texts at once, and of runs of words, in numpy.

A run's hash is a polynomial over its items modulo 2^64, taken from running sums, then mixed; words are
runs of bytes, shingles and windows runs of words. Every step is a few passes over flat arrays.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_AS_IS = np.arange(1, 257, dtype=np.uint64)
_LOWER = _AS_IS.copy()
_LOWER[65:91] += np.uint64(32)

_BASE = {"byte": 0x9E3779B97F4A7C15, "word": 0xD6E8FEB86659FD93}  # odd, so that powers have inverses
_powers: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _power(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of a base and of its inverse modulo 2^64."""
    if kind not in _powers or len(_powers[kind][0]) < n:
        base = _BASE[kind]
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(max(n, 1 << 16), b, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        _powers[kind] = tuple(both)
    return _powers[kind]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Words:
    """Words of a batch of texts: ``hashes`` of all, and ``first``, where each text's words begin (one more at the end)."""

    hashes: np.ndarray
    first: np.ndarray
    sums: np.ndarray

    def runs(self, start: np.ndarray, length) -> np.ndarray:
        """Hash of the ``length`` words from each ``start``; also of the length itself."""
        _, inverse = _power("word", len(self.hashes) + 1)
        length = np.asarray(length)
        return mixed((self.sums[start + length] - self.sums[start]) * inverse[start] + length.astype(np.uint64))


def words(texts: pa.Array, lower: bool = False) -> Words:
    """Hash the words of ``texts`` (no nulls): maximal runs without space and tab to carriage return."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    inside = ~_SPACE[raw]
    before, after = np.r_[False, inside[:-1]][:len(raw)], np.r_[inside[1:], False][:len(raw)]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(raw))]
    before[edges] = False
    after[edges - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    power, inverse = _power("byte", len(raw) + 1)
    values = (_LOWER if lower else _AS_IS)[raw] * power[:len(raw)]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    hashes = mixed((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))
    power, _ = _power("word", len(hashes) + 1)
    return Words(hashes, np.searchsorted(start, offsets), np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * power[:len(hashes)], dtype=np.uint64)]))
