"""Hashes of words and substrings of many texts at once, on arrays.

A substring's hash is the sum of a random 64-bit number per byte times a power of an odd
base, modulo 2^64, brought back to its start: differences of running sums give any substring.
"""

from __future__ import annotations

from functools import cache

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_SPAN = 1 << 20


@cache
def _byte_values() -> np.ndarray:
    return np.random.default_rng(20_240_229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@cache
def _powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.full(length, _BASE, np.uint64), np.full(length, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    size = _SPAN
    while size < length:
        size *= 2
    return _powers(size) if size == _SPAN else _powers.__wrapped__(size)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that lets every bit depend on every other."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Substrings:
    """Hashes of substrings of one byte string."""

    def __init__(self, data: np.ndarray):
        self._up, self._down = powers(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_byte_values()[data] * self._up[: len(data)], out=self._sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[start]) * self._down[start])


def is_blank(data: np.ndarray) -> np.ndarray:
    """White space of the ASCII range, which parts words."""
    return (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of a byte string, A-Z in lower case, and where it starts."""
    hashes, starts, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + _SPAN - 1)
        while end < len(data):  # to the end of a word
            gap = np.flatnonzero(is_blank(data[end : end + 4096]))
            if len(gap):
                end += int(gap[0])
                break
            end = min(len(data), end + 4096)
        part = data[at:end]
        blank = is_blank(part)
        edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).view(np.int8)))
        first, last = edge[::2], edge[1::2]
        part = np.where((part >= 0x41) & (part <= 0x5A), part | 0x20, part)
        hashes.append(Substrings(part).hash(first, last))
        starts.append(first + at)
        at = end
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts)
