"""The binary [23, 12, 7] Golay code: every 23-bit word lies within 3 bits of exactly one codeword."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
GENERATOR = 0b110001110101
LENGTH, DIMENSION = 23, 12


def _remainder(word: int) -> int:
    for i in range(LENGTH - 1, 10, -1):
        if word >> i & 1:
            word ^= GENERATOR << (i - 11)
    return word


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the upper 12 bits, and the error pattern (at most 3 bits) of each of the 2,048 remainders."""
    upper = np.array([_remainder(x << 11) for x in range(1 << DIMENSION)], dtype=np.int32)
    error = np.zeros(1 << 11, dtype=np.int32)
    for weight in (1, 2, 3):
        for bits in combinations(range(LENGTH), weight):
            e = sum(1 << b for b in bits)
            error[_remainder(e)] = e
    return upper, error, np.int32(0x7FF)


def decode(words: np.ndarray) -> np.ndarray:
    """Index (its upper 12 bits, the code is systematic) of the codeword nearest to each word."""
    upper, error, low = tables()
    words = words.astype(np.int32)
    return (words ^ error[upper[words >> 11] ^ (words & low)]) >> 11


def nearby(words: np.ndarray, bits: int = LENGTH) -> np.ndarray:
    """Codeword indices of each word and of its neighbours at one bit, a row each (repeats included).

    Two words at distance 2 or less have a common neighbour (or are neighbours),
    and so an index in common. There are 1 or 6 different ones in a full row.
    """
    flips = np.concatenate([[0], 1 << np.arange(bits)]).astype(np.int32)
    return decode(words.astype(np.int32)[:, None] ^ flips[None, :])
