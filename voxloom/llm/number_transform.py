"""Number-theoretic transforms of the rows of a matrix, exact in 64-bit integers modulo one prime.

The prime is 3 * 2^30 + 1: products of two residues fit into 64 bits, and lengths up to 2^30 have roots of unity."""

from __future__ import annotations

import numpy as np

PRIME = 3 * (1 << 30) + 1
_GENERATOR = 5
_P = np.uint64(PRIME)


def _roots(size: int, inverse: bool) -> np.ndarray:
    """The first ``size // 2`` powers of a root of unity of order ``size``."""
    step = pow(_GENERATOR, (PRIME - 1) // size, PRIME)
    step = pow(step, -1, PRIME) if inverse else step
    out = np.ones(1, np.uint64)
    while len(out) < size // 2:  # doubling: the powers so far, times the next one
        out = np.concatenate((out, out * np.uint64(pow(step, len(out), PRIME)) % _P))
    return out


def transform(rows: np.ndarray, inverse: bool = False) -> np.ndarray:
    """The transform of each row; the length is a power of two. Each step halves the number of interleaved sequences
    (self-sorting order, so nothing is permuted)."""
    m, size = rows.shape
    x, root = rows.astype(np.uint64), _roots(size, inverse)
    half, stride = size // 2, 1
    while half:
        v = x.reshape(m, 2, half, stride)
        a, b = v[:, 0], v[:, 1]
        y = np.empty((m, half, 2, stride), np.uint64)
        y[:, :, 0] = (a + b) % _P
        y[:, :, 1] = (a + (_P - b)) % _P * root[::stride, None] % _P
        x, half, stride = y.reshape(m, size), half // 2, stride * 2
    return x * np.uint64(pow(size, -1, PRIME)) % _P if inverse else x


def correlate(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Sum over i of short[i] * long[d + i] for each row and each shift d that stays inside ``long``, modulo the prime.
    ``long`` is at least as long as ``short``."""
    (m, k), n = short.shape, long.shape[1]
    size = 1 << max(n - 1, 0).bit_length()
    padded = np.zeros((2, m, size), np.uint64)
    padded[0, :, :k], padded[1, :, :n] = short[:, ::-1], long
    # reversed, the correlation at d is the product's coefficient d + k - 1; what wraps around falls below k - 1
    product = transform(padded[0]) * transform(padded[1]) % _P
    return transform(product, inverse=True)[:, k - 1 : n]
