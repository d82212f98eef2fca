"""SetSketch of sets of 64-bit hashes: truncated minima on an exponentially spaced scale.

Every element draws M exponential values, each for another register; a register keeps
the largest floor(1 - log_B(value)) over all elements, in 0 .. Q + 1. Registers of a union
are the maxima of the registers, and two sets' registers agree with a probability close to
their Jaccard similarity, so they serve both for bands and for a joint estimate.

An element's values come in ascending order (spacings of ordered exponentials, registers in
a random order without repetition), so it is done as soon as its next value cannot raise
the least register of its set. Many sets are sketched at once, round by round.
"""

from __future__ import annotations

import numpy as np

M = 256
B = 1.001
A = 20.0
Q = (1 << 16) - 2

_MIX1, _MIX2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def sketch(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Registers (sets x M, uint16) of sets whose elements stand one after another in ``hashes``."""
    n = len(sizes)
    regs = np.zeros(n * M, dtype=np.int32)
    low = np.zeros(n, dtype=np.int32)
    own = np.repeat(np.arange(n, dtype=np.int64), sizes)
    seed = mix(hashes + _STEP)
    first = (seed & np.uint64(M - 1)).astype(np.int64)
    stride = ((seed >> np.uint64(32)) & np.uint64(M - 1)).astype(np.int64) | 1  # odd: meets every register once
    value = np.zeros(len(hashes))
    scale = 1 / np.log(B)
    for j in range(M):
        if not len(own):
            break
        draw = mix(seed + np.uint64(0x9E3779B97F4A7C15 * (j + 1) & (1 << 64) - 1))
        value += -np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (A * (M - j))
        k = np.clip(np.floor(1 - np.log(value) * scale), 0, Q + 1).astype(np.int32)
        live = k > low[own]
        if not live.all():
            own, seed, first, stride, value, k = own[live], seed[live], first[live], stride[live], value[live], k[live]
        np.maximum.at(regs, own * M + ((first + stride * j) & (M - 1)), k)
        if j % 2 or j > 16:
            low = regs.reshape(n, M).min(axis=1)
    return regs.reshape(n, M).astype(np.uint16)


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (B - 1) / B) / np.log(B)


def similarity(u: np.ndarray, v: np.ndarray, nu: np.ndarray, nv: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs, from registers (pairs x M) and set sizes.

    The likelihood is that of the counts of registers where either set's is larger or both
    agree. It is concave in the similarity; the maximum is found by trisection.
    """
    up, down = (u > v).sum(axis=1), (u < v).sum(axis=1)
    even = M - up - down
    a, b = nu / (nu + nv), nv / (nu + nv)

    def likelihood(j):
        p, q = (np.clip(_p(x), 1e-12, 1 - 1e-12) for x in (a - b * j, b - a * j))
        return up * np.log(p) + down * np.log(q) + even * np.log(np.clip(1 - p - q, 1e-12, 1))

    lo, hi = np.zeros(len(up)), np.minimum(a / b, b / a)
    for _ in range(40):
        x, y = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        left = likelihood(x) > likelihood(y)
        lo, hi = np.where(left, lo, x), np.where(left, y, hi)
    return (lo + hi) / 2


def at_least(least: float, u: np.ndarray, v: np.ndarray, nu: np.ndarray, nv: np.ndarray) -> np.ndarray:
    """Which pairs have ``similarity`` >= least.

    The likelihood is concave, so its maximum lies at ``least`` or above just where it doesn't fall there.
    """
    up, down = (u > v).sum(axis=1), (u < v).sum(axis=1)
    even = M - up - down
    a, b = nu / (nu + nv), nv / (nu + nv)
    x, y = a - b * least, b - a * least
    p, q = _p(np.maximum(x, 1e-12)), _p(np.maximum(y, 1e-12))
    slope = lambda z: (B - 1) / B / (1 - z * (B - 1) / B) / np.log(B)
    dp, dq = -b * slope(x), -a * slope(y)
    return (x > 0) & (y > 0) & (up * dp / p + down * dq / q - even * (dp + dq) / np.clip(1 - p - q, 1e-12, 1) >= 0)
