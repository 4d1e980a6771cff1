"""The binary Golay code (23, 12): every 23-bit word lies within 3 bits of
exactly one codeword, and any two codewords differ in 7 bits or more.

``nearest`` decodes words to the index of that codeword.  ``nearby`` gives the
indices of all codewords within 4 bits: one where the word is within 2 bits of
its codeword, else six.  If x and y differ in one bit, the codeword nearest to x is
within 4 bits of y, so it is among the nearby ones of y.

All tables follow from the generator polynomial.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
GENERATOR = 0b101011100011
BITS, CHECKS = 23, 11


def _remainder(word: int) -> int:
    for bit in range(BITS - 1, CHECKS - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECKS)
    return word


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the low 12 and high 11 bits; for each remainder the error
    pattern, and the index differences of its nearby codewords (-1: none)."""
    low = np.array([_remainder(w) for w in range(1 << 12)], dtype=np.int32)
    high = np.array([_remainder(w << 12) for w in range(1 << 11)], dtype=np.int32)
    codewords = [d << CHECKS | _remainder(d << CHECKS) for d in range(1 << 12)]
    sevens = [c for c in codewords if c.bit_count() == 7]
    errors = np.zeros(1 << CHECKS, dtype=np.int32)
    nearby = np.full((1 << CHECKS, 6), -1, dtype=np.int32)
    nearby[:, 0] = 0
    for weight in (1, 2, 3):
        for places in combinations(range(BITS), weight):
            error = sum(1 << p for p in places)
            remainder = _remainder(error)
            errors[remainder] = error
            if weight == 3:
                nearby[remainder, 1:] = [
                    c >> CHECKS for c in sevens if c & error == error
                ]
    return low, high, errors, nearby


def decode(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``nearest`` index (n) and ``nearby`` indices (n, 6; -1: none)."""
    low, high, errors, offsets = tables()
    words = words.astype(np.int32)
    remainder = low[words & 0xFFF] ^ high[words >> 12]
    nearest = (words ^ errors[remainder]) >> CHECKS
    nearby = offsets[remainder]
    return nearest, np.where(nearby < 0, -1, nearby ^ nearest[:, None])
