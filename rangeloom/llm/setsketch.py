"""SetSketch registers: K_i = floor(1 - log_b(h_i)), h_i the least of rate-``a`` exponentials over a set's elements.

Each element owns a Poisson process of rate ``a*m`` whose points fall on random registers, so register ``i`` sees an
independent rate-``a`` process and its first point is the exponential wanted. Points are made in rounds for all
elements of all sets of a batch at once; an element leaves when its process has passed the latest first point of its
set, after which it can't change any register. Registers of a union are the register-wise maxima.
"""

from __future__ import annotations

import numpy as np

from .textkit import U, mix

M = 128
BASE = 1.001
RATE = 20.0
LIMIT = 65534
#: Points made at a time; the schedule is the same for all elements, so sums of times are too.
SINGLE, BLOCK = 6, 16


def sketches(hashes: np.ndarray, owner: np.ndarray, n: int, m: int = M, base: float = BASE, rate: float = RATE) -> np.ndarray:
    """Registers (n, m), unsigned 16-bit, of the sets given as (element hash, set number); 0 where a set is empty."""
    least = np.full(n * m, np.inf)
    h, own, t = hashes, owner.astype(np.int64), np.zeros(len(hashes))
    k = 0
    while len(h):
        width = 1 if k < SINGLE else BLOCK
        u = mix(h[:, None] + (np.arange(k + 1, k + width + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15))[None, :])
        gap = -np.log(((u >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / (rate * m)
        when = t[:, None] + np.cumsum(gap, axis=1)
        register = own[:, None] * m + (mix(u ^ U(0x5851F42D4C957F2D)) % U(m)).astype(np.int64)
        np.minimum.at(least, register.ravel(), when.ravel())
        latest = least.reshape(n, m).max(axis=1)
        t = when[:, -1]
        on = t < latest[own]
        h, own, t = h[on], own[on], t[on]
        k += width
    with np.errstate(divide="ignore"):
        level = np.floor(1.0 - np.log(least) / np.log(base))
    level[np.isinf(least)] = 0
    return np.clip(level, 0, LIMIT).astype(np.uint16).reshape(n, m)


def band_keys(registers: np.ndarray, rows: int = 4) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` registers (4 of 16 bits fill it exactly)."""
    n, m = registers.shape
    bands = m // rows
    key = np.zeros((n, bands), dtype=np.uint64)
    for r in range(rows):
        key = mix(key ^ (registers[:, r : bands * rows : rows].astype(np.uint64) + U(1)) * U(0x9E3779B97F4A7C15))
    return mix(key + np.arange(1, bands + 1, dtype=np.uint64)[None, :] * U(0xD1342543DE82EF95)).view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, base: float = BASE) -> np.ndarray:
    """Jaccard similarities of pairs of sketches of sets of known sizes, by maximum joint likelihood.

    With u, v the shares of the two sizes, a register of the first is the larger with probability p(u - v*J), of the
    second with p(v - u*J), p(x) = -log_b(1 - x*(b-1)/b). The likelihood is concave in J; its top is bracketed by
    ternary search over [0, min(u/v, v/u)].
    """
    m = a.shape[1]
    more = (a > b).sum(axis=1)
    less = (a < b).sum(axis=1)
    same = m - more - less
    total = (size_a + size_b).astype(np.float64)
    u, v = size_a / total, size_b / total

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.maximum(x, 0.0) * (base - 1) / base) / np.log(base)

    def likelihood(j: np.ndarray) -> np.ndarray:
        x, y = p(u - v * j), p(v - u * j)
        return more * np.log(np.maximum(x, 1e-300)) + less * np.log(np.maximum(y, 1e-300)) + same * np.log(np.maximum(1 - x - y, 1e-300))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):
        third = (high - low) / 3
        one, two = low + third, high - third
        up = likelihood(one) < likelihood(two)
        low, high = np.where(up, one, low), np.where(up, high, two)
    return (low + high) / 2
