"""SetSketch: registers of exponentially spaced, truncated minima.

Register i of a set is ``floor(1 - log_b(x))`` for the least of its elements' exponential values x under
the i-th hash, cut to 0..q+1. The register of a union is the greater of two registers, and two sets
agree in a register with a probability that rises with their similarity: about the Jaccard similarity,
as b is close to 1. So groups of registers serve as bands of a locality-sensitive hash, and for a pair
the numbers of registers that are greater, less or equal give the likelihood of each similarity.
"""

from __future__ import annotations

import numpy as np

REGISTERS = 128
BAND = 4  # registers in a band: together 64 bits, so a band is one number
B, A, Q = 1.001, 20.0, (1 << 16) - 2
_rng = np.random.default_rng(20240229)
_FACTORS = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2)


def sketches(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Registers (uint16) of the sets hashes[first[i]:first[i + 1]], none of which is empty."""
    least = np.empty((REGISTERS, len(first) - 1), np.uint64)
    for i in range(REGISTERS):
        np.minimum.reduceat(hashes * _FACTORS[i] + _SHIFTS[i], first[:-1], out=least[i])
    unit = (least.T.astype(np.float64) + 0.5) / 2.0**64
    spaced = np.floor(1.0 - np.log(-np.log1p(-unit) / A) / np.log(B))
    return np.clip(spaced, 0, Q + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


def bands(registers: np.ndarray) -> np.ndarray:
    """One 64-bit number for each band of each set."""
    return np.ascontiguousarray(registers).view(np.uint64)


def _differs(share: np.ndarray) -> np.ndarray:
    return -np.log1p(-share * (B - 1) / B) / np.log(B)


def similarity(greater: np.ndarray, less: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """Jaccard similarity of greatest likelihood, given how many registers differ either way and both sizes."""
    u = size_a / (size_a + size_b)
    v = 1.0 - u
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    equal = registers - greater - less

    def likelihood(j: np.ndarray) -> np.ndarray:
        up, down = _differs(np.maximum(u - v * j, 1e-12)), _differs(np.maximum(v - u * j, 1e-12))
        return greater * np.log(up) + less * np.log(down) + equal * np.log(np.maximum(1.0 - up - down, 1e-12))

    for _ in range(25):  # one maximum: narrow down by thirds
        a, b = low + (high - low) / 3, high - (high - low) / 3
        left = likelihood(a) < likelihood(b)
        low, high = np.where(left, a, low), np.where(left, high, b)
    return (low + high) / 2
