"""Words of UTF-8 text as numpy arrays: where they are, and 64-bit hashes of words and of runs of words.

A word is a longest run of bytes other than space and the five ASCII control blanks (0x09 to 0x0D), within one document.
"""

from __future__ import annotations

import numpy as np

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xE9846AF9B1A615D1)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


def _power(base: np.uint64, n: int) -> np.ndarray:
    key = str(base)
    if key not in _powers or len(_powers[key]) < n:
        _powers[key] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 1 << 20), base)]).astype(np.uint64))
    return _powers[key][:n]


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; every other byte as it is."""
    return _LOWER[data]


def spans(data: np.ndarray, bounds: np.ndarray, blank: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each document and the number of words) for documents lying end to end in data."""
    word = ~blank[data]
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(bounds), np.int64)
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    before = np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    before[inner] = False
    after = np.empty_like(word)
    after[-1], after[:-1] = False, word[1:]
    after[inner - 1] = False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(data)), out=total[1:])
    return mix((total[ends] - total[starts]) * _power(_BASE_INVERSE, len(data) + 1)[starts] + (ends - starts).astype(np.uint64) * _STEP)


def runs(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of words[i:i+n] for every i; runs across documents are for the caller to leave out."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    count = len(words) - n + 1
    out, factor = words[:count].copy(), 1
    for k in range(1, n):
        factor = factor * int(_STEP) % (1 << 64)
        out += words[k : k + count] * np.uint64(factor)
    return mix(out)
