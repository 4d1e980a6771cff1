"""Hashed character n-grams of one text at a time, as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Characters hashed in one step; longer texts go in overlapping steps.
STEP = 1 << 20

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def buckets(text: str, sizes: tuple[int, ...], bits: int) -> Iterator[np.ndarray]:
    """The buckets (``bits`` wide) of all n-grams, by size and step.

    n-grams are runs of code points; a repeated one comes up repeatedly.
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    longest = max(sizes)
    for begin in range(0, max(1, len(points)), STEP):
        part = points[begin : begin + STEP + longest - 1].astype(np.uint64)
        grams = np.zeros(len(part), dtype=np.uint64)
        for n in range(1, longest + 1):
            if len(part) < n:
                break
            grams = grams[: len(part) - n + 1] * _FACTOR + part[n - 1 :] + np.uint64(1)
            if n in sizes:
                mixed = (grams[:STEP] ^ (grams[:STEP] >> np.uint64(29))) * _MIX
                yield (mixed >> np.uint64(64 - bits)).astype(np.int64)
