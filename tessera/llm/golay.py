"""Perfect binary Golay code [23,12,7]: which codewords a damaged 23-bit word may stand for."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

POLY = 0xAE3  # x^11+x^9+x^7+x^6+x^5+x+1, a generator of the code


def _remainder(value: int) -> int:
    for bit in range(22, 10, -1):
        if value >> bit & 1:
            value ^= POLY << (bit - 11)
    return value


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits, and each syndrome's error pattern of three bits at most."""
    low = np.array([_remainder(v) for v in range(1 << 12)], np.int32)
    high = np.array([_remainder(v << 12) for v in range(1 << 11)], np.int32)
    error = np.zeros(1 << 11, np.int32)
    for n in (1, 2, 3):
        for bits in combinations(range(23), n):
            e = sum(1 << b for b in bits)
            error[low[e & 0xFFF] ^ high[e >> 12]] = e
    return low, high, error


def decode(v: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the only codeword within three bits of each 23-bit word."""
    low, high, error = _tables()
    v = v.astype(np.int32)
    return (v ^ error[low[v & 0xFFF] ^ high[v >> 12]]) >> 11


def near_indices(v: np.ndarray, width: int) -> np.ndarray:
    """For each word, the codeword indices of the word and of all words one bit away (of its ``width`` low bits).

    Two words that differ in two bits or fewer have a word between them that is at most one bit from either, so they
    share an index. A row holds its few distinct indices (six at most) and -1 after them.
    """
    v = v.astype(np.int32)
    flips = np.concatenate([[0], 1 << np.arange(width)]).astype(np.int32)
    out = np.sort(decode((v[:, None] ^ flips[None, :]).ravel()).reshape(len(v), -1), axis=1)
    out[:, 1:][out[:, 1:] == out[:, :-1]] = -1
    return -np.sort(-out, axis=1)[:, :6]
