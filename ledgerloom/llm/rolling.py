"""Polynomial hashes of the windows of many texts at once, in numpy.

With prefix sums P[i] = sum of c[j] * B**j modulo 2**64, and B odd, a window's hash is (P[end] - P[start]) * B**-start, so every
window costs two lookups, whatever its length.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
SECOND = 0xC2B2AE3D27D4EB4F
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i for i < n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(size, b, np.uint64)
            a[0] = 1
            both.append(np.multiply.accumulate(a))
        have = _powers[base] = tuple(both)
    return have[0][:n], have[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit over the whole word; the sums' low bits are weak."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def prefix(values: np.ndarray, base: int = BASE) -> np.ndarray:
    p = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values), base)[0], out=p[1:])
    return p


def windows(p: np.ndarray, start: np.ndarray, width: np.ndarray | int, base: int = BASE) -> np.ndarray:
    """Hashes of the windows [start, start + width) under prefix sums p."""
    return mixed((p[start + width] - p[start]) * powers(len(p), base)[1][start])


def code_points(texts: list[str]) -> np.ndarray:
    """The texts' code points, one after the other, each plus one so that none is zero."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
