"""Hashed byte grams of whole texts, for the classifiers trained here."""

from __future__ import annotations

import numpy as np

from paperloom.llm import bytetext as bt

#: Lower-cased bytes, with everything in ASCII that is neither letter nor digit as a space.
WORDLIKE = np.where(bt.NON_WORD, 32, bt.LOWERED).astype(np.uint8)
#: The same with digits as spaces too.
LETTERLIKE = WORDLIKE.copy()
LETTERLIKE[48:58] = 32
_STEPS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D], np.uint32)


def gram_buckets(normal: np.ndarray, order: int, bits: int) -> np.ndarray:
    """The bucket of every window of `order` bytes."""
    n = len(normal) - order + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    wide = normal.astype(np.uint32)
    h = np.full(n, order * 0x61C88647 & 0xFFFFFFFF, np.uint32)
    for i in range(order):
        h += wide[i : i + n] * _STEPS[i]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return h >> np.uint32(32 - bits)


def across(offsets: np.ndarray, order: int, n: int) -> np.ndarray:
    """Windows that begin in one row and end in another."""
    at = (offsets[1:-1, None] - np.arange(1, order)[None, :]).ravel()
    return at[(at >= 0) & (at < n)]


def pieces(size: int, order: int):
    """Ranges that together hold every window of a row once."""
    lo = 0
    while True:
        hi = min(size, lo + bt.SEGMENT + order - 1)
        yield lo, hi
        if hi >= size:
            return
        lo = hi - order + 1
