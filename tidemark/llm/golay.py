"""The perfect binary Golay code of length 23: 12 message bits, minimum distance 7."""

from __future__ import annotations

import functools
from itertools import combinations

import numpy as np

LENGTH, CHECK = 23, 11
GENERATOR = 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1


def _remainder(word: int) -> int:
    for i in range(LENGTH - 1, CHECK - 1, -1):
        if word >> i & 1:
            word ^= GENERATOR << (i - CHECK)
    return word


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits, and the error pattern of each of the 2048 syndromes."""
    low = np.array([_remainder(x) for x in range(1 << 12)], dtype=np.int64)
    high = np.array([_remainder(x << 12) for x in range(1 << 11)], dtype=np.int64)
    error = np.zeros(1 << CHECK, dtype=np.int64)
    for weight in (1, 2, 3):  # each word is within 3 bits of exactly one codeword
        for bits in combinations(range(LENGTH), weight):
            pattern = sum(1 << b for b in bits)
            error[_remainder(pattern)] = pattern
    return low, high, error


def index(words: np.ndarray) -> np.ndarray:
    """The 12 message bits of the codeword nearest to each 23-bit word."""
    low, high, error = _tables()
    return (words ^ error[low[words & 0xFFF] ^ high[words >> 12]]) >> CHECK


def nearby(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codeword indices of all words within one bit of each word: (position in words, index), without repeats.

    That is one index for a word within two bits of a codeword and six for the others. Two words at most two
    bits apart have a word within one bit of both between them, so they have an index in common.
    """
    flips = np.concatenate([[0], 1 << np.arange(LENGTH)])
    found = np.sort(index(words[:, None] ^ flips[None, :]), axis=1)
    first = np.ones(found.shape, dtype=bool)
    first[:, 1:] = found[:, 1:] != found[:, :-1]
    at, _ = np.nonzero(first)
    return at, found[first]
