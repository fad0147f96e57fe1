"""Positions of a text sampled by content so that equal strings are sampled alike, and names of substrings.

A difference cover samples positions such that any two suffixes have a sampled position at one
common distance. This cover is chosen by content: every string of ``length`` bytes is
represented by the leftmost of its ``gram``-byte substrings with the least hash, so equal strings have their
sample at the same distance wherever they stand, and few positions (about one in 33) are samples.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240923)
_BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = _RNG.integers(0, 2**62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes from each position, joined from hashes of powers of two."""
    part, width, out, done = _BYTE[raw], 1, None, 0
    while width <= gram:
        if gram & width:
            if out is None:
                out, done = part, width
            else:  # the longer part goes first
                n = len(raw) - done - width + 1
                out = part[:n] * _FACTORS[done % 64] + out[width:width + n]
                done += width
        if 2 * width <= gram:
            part = part[:-width] * _FACTORS[32 + width.bit_length()] + part[width:]
        width *= 2
    return mix(out)


def least_in_windows(keys: np.ndarray, window: int) -> np.ndarray:
    """Minimum of each run of ``window`` neighbours."""
    best, width = keys, 1
    while 2 * width <= window:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    return np.minimum(best[:len(keys) - window + 1], best[window - width:]) if window > width else best


def sampled_runs(raw: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of string starts with one sample: first start, last start, sample, hash of its gram."""
    if len(raw) < length:
        none = np.array([], dtype=np.int64)
        return none, none, none, np.array([], dtype=np.uint64)
    hashes = gram_hashes(raw, gram)
    keys = (hashes >> np.uint64(32) << np.uint64(32)) | np.arange(len(hashes), dtype=np.uint64)
    sample = (least_in_windows(keys, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, sample[1:] != sample[:-1]])
    last = np.r_[first[1:], len(sample)] - 1
    return first, last, sample[first], hashes[sample[first]]
