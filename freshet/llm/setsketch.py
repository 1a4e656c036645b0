"""SetSketch registers: exponentially spaced, truncated minima of exponential hashes.

Register i of a set is ``floor(1 - log_b(min h_i))`` over its elements, held between 0 and ``LIMIT + 1``, where h_i
is an exponential hash with rate ``RATE``. Registers of a union are the greater ones of its parts. Sets agree in a register
about as often as they share elements, and from the numbers of greater, lesser and equal registers the similarity
follows by maximum likelihood (O. Ertl, SetSketch: Filling the gap between MinHash and HyperLogLog, 2021).
"""

from __future__ import annotations

import numpy as np

BASE, RATE, LIMIT = 1.001, 20.0, 2**16 - 2
_CHUNK = 1024


class SetSketch:
    """``m`` registers, from hashes that are functions of ``seed`` alone."""

    def __init__(self, m: int, seed: int = 1):
        random = np.random.default_rng(seed)
        self.m = m
        self.factors = random.integers(0, 2**63, m, np.uint64) * np.uint64(2) + np.uint64(1)
        self.shifts = random.integers(0, 2**63, m, np.uint64) * np.uint64(2)

    def registers(self, elements: np.ndarray) -> np.ndarray:
        """Registers of a set of 64-bit hashes."""
        least = np.full(self.m, 2**64 - 1, np.uint64)
        for at in range(0, len(elements), _CHUNK):
            np.minimum(least, (elements[at : at + _CHUNK, None] * self.factors + self.shifts).min(axis=0), out=least)
        if not len(elements):
            return np.zeros(self.m, np.uint16)
        u = (least.astype(np.float64) + 1) / 2.0**64
        h = -np.log1p(-np.minimum(u, 1 - 1e-16)) / RATE
        return np.clip(np.floor(1 - np.log(h) / np.log(BASE)), 0, LIMIT + 1).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def jaccard(greater: np.ndarray, lesser: np.ndarray, equal: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Most likely similarity, given how many registers of a are greater than, less than and equal to those of b."""
    u = size_a / (size_a + size_b)
    v = 1 - u

    def likelihood(j: np.ndarray) -> np.ndarray:
        more, less = _p(np.maximum(u - v * j, 0)), _p(np.maximum(v - u * j, 0))
        tiny = 1e-12
        return greater * np.log(more + tiny) + lesser * np.log(less + tiny) + equal * np.log(np.maximum(1 - more - less, 0) + tiny)

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    ratio = (np.sqrt(5) - 1) / 2
    for _ in range(40):  # golden section; the likelihood has one maximum
        c, d = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        left = likelihood(c) > likelihood(d)
        hi, lo = np.where(left, d, hi), np.where(left, lo, c)
    return (lo + hi) / 2
