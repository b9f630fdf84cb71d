"""The perfect binary Golay code [23, 12, 7] as a fuzzy hash of 23-bit vectors.

Every vector lies within three bits of exactly one codeword, and a vector at
exactly three bits has five more codewords at four bits.  ``nearby`` lists all
codewords within four bits (one or six), so for two vectors that differ in at
most one bit the nearest codeword of either is among the nearby ones of the
other: distance 3 + 1 at most.  That is the property the SimHash join needs.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

BITS, CHECK = 23, 11
#: Fixed value: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, the generator polynomial.
GENERATOR = 0b101011100011


def _remainder(v: int) -> int:
    for i in range(BITS - 1, CHECK - 1, -1):
        if v >> i & 1:
            v ^= GENERATOR << (i - CHECK)
    return v


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and of the high 11 bits; per syndrome the error patterns, nearest first, padded with -1."""
    one = [_remainder(1 << i) for i in range(BITS)]
    low, high = np.zeros(1 << 12, np.int32), np.zeros(1 << 11, np.int32)
    for i in range(12):
        low[np.arange(1 << 12) >> i & 1 == 1] ^= one[i]
    for i in range(11):
        high[np.arange(1 << 11) >> i & 1 == 1] ^= one[12 + i]
    errors = np.full((1 << CHECK, 6), -1, np.int32)
    filled = [0] * (1 << CHECK)
    for weight in range(5):
        for at in combinations(range(BITS), weight):
            s = e = 0
            for i in at:
                s ^= one[i]
                e |= 1 << i
            errors[s, filled[s]] = e
            filled[s] += 1
    return low, high, errors


def nearby(v: np.ndarray) -> np.ndarray:
    """(n, 6) indices (12 bits) of the codewords within four bits of each of n vectors: the nearest first, -1 where there are fewer."""
    low, high, errors = _tables()
    v = v.astype(np.int32)
    e = errors[low[v & 0xFFF] ^ high[v >> 12]]
    return np.where(e < 0, -1, (v[:, None] ^ e) >> CHECK)


@lru_cache(maxsize=1)
def codewords() -> np.ndarray:
    """(4096, 23) the codewords as +1 and -1, in order of their indices."""
    index = np.arange(1 << 12, dtype=np.int32) << CHECK
    low, high, _ = _tables()
    words = index ^ (low[index & 0xFFF] ^ high[index >> 12])
    return ((words[:, None] >> np.arange(BITS) & 1) * 2 - 1).astype(np.float32)
