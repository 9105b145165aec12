"""Vectorised 64-bit hashing of byte ranges.

A polynomial over the bytes modulo 2**64 with an odd base: prefix sums give the
hash of any range of a text in one subtraction and one product, and ``mix``
spreads it over all bits.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C55  # odd, so it has an inverse
INVERSE = pow(BASE, -1, 1 << 64)

_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _table(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n; kept for the next text."""
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 2 * len(_powers))
        _powers, _inverses = _table(BASE, size), _table(INVERSE, size)
    return _powers, _inverses


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of (byte + 1) * BASE**i over the first 0, 1, ... bytes."""
    p, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=out[1:])
    return out


def ranges(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], equal for equal bytes."""
    _, inv = powers(len(sums))
    return mix((sums[end] - sums[start]) * inv[start] + (end - start).astype(np.uint64))
