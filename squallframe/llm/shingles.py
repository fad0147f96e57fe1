"""Distinct word shingles of a text as sorted 64-bit hashes, computed on whole arrays."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240907)
_BASE = int(_RNG.integers(2**62, 2**63)) * 2 + 1
_INVERSE = pow(_BASE, -1, 2**64)
_BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + _RNG.integers(0, 2, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_GAP = np.zeros(256, dtype=bool)
_GAP[[32, *range(9, 14)]] = True
_POWERS = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64; kept for the next text."""
    if len(_POWERS["up"]) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            _POWERS[name] = np.cumprod(np.r_[np.uint64(1), np.full(2 * n, base, dtype=np.uint64)])
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """One hash for each run of bytes other than space and 0x09 to 0x0D, A-Z lower-cased."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    if not len(raw):
        return np.array([], dtype=np.uint64)
    gap = _GAP[raw]
    starts = np.flatnonzero(~gap & np.r_[True, gap[:-1]])
    ends = np.flatnonzero(~gap & np.r_[gap[1:], True]) + 1
    up, down = powers(len(raw) + 1)
    sums = np.r_[np.uint64(0), np.cumsum(_BYTE[raw] * up[:len(raw)], dtype=np.uint64)]
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_set(text: str, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes; a text of fewer words is one shingle, one without words has none."""
    words = word_hashes(text)
    if not len(words):
        return words
    used = min(width, len(words))
    total = np.full(len(words) - used + 1, used, dtype=np.uint64)
    factor = 0x9E3779B97F4A7C15
    for j in range(used):
        total += words[j:len(words) - used + 1 + j] * np.uint64(factor)
        factor = factor * 0xD1342543DE82EF95 % 2**64
    return np.unique(mix(total))
