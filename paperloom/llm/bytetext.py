"""Vectorised hashing of words straight from Arrow string buffers.

A word's hash is a polynomial over its bytes modulo 2**64 with an odd base, so
one running sum over a block of text and the inverse powers of the base give
all its words' hashes without touching them one by one. Byte values first go
through a table of random 64-bit numbers. Long texts are handled in segments
that end at separators, so memory follows the segment and not the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20
BASE = 0xD1342543DE82EF95
_INVERSE = pow(BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: A-Z hash like a-z.
LOWERED = np.arange(256)
LOWERED[65:91] += 32
BYTE_HASH = _BYTES[LOWERED]
#: The ASCII white space that ends a word: tab to carriage return, and the space.
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: Everything in ASCII but letters and digits ends a word; bytes of other characters do not.
NON_WORD = np.ones(256, bool)
NON_WORD[48:58] = NON_WORD[65:91] = NON_WORD[97:123] = NON_WORD[128:] = False
#: Odd multipliers by position in a shingle.
PLACES = np.random.default_rng(77).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SEGMENT + 4096)
        for k, base in enumerate((BASE, _INVERSE)):
            steps = np.full(size, base & (2**64 - 1), np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole 64-bit word."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = SEGMENT) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `limit` bytes; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def _segments(raw: np.ndarray, ends_word: np.ndarray) -> Iterator[tuple[int, int]]:
    lo, n = 0, len(raw)
    while lo < n:
        hi = min(n, lo + SEGMENT)
        if hi < n:
            back = np.flatnonzero(ends_word[raw[lo:hi]])
            if len(back):
                hi = lo + int(back[-1]) + 1
            else:  # a word longer than a segment
                at = hi
                while at < n:
                    more = np.flatnonzero(ends_word[raw[at : at + SEGMENT]])
                    if len(more):
                        at += int(more[0]) + 1
                        break
                    at = min(n, at + SEGMENT)
                hi = at
        yield lo, hi
        lo = hi


def words(raw: np.ndarray, offsets: np.ndarray, ends_word: np.ndarray = SPACES, byte_hash: np.ndarray = BYTE_HASH, spans: bool = False):
    """Hashes of all words of the rows in `offsets`, and the first word of each row.

    With spans also the byte positions where words start and end.
    """
    hashes, first, last = [], [], []
    cuts = np.unique(offsets)
    for lo, hi in _segments(raw, ends_word):
        part = raw[lo:hi]
        n = len(part)
        powers, inverses = _table(n)
        gap = ends_word[part]
        inside = ~gap
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= gap[:-1]
        closes[:-1] &= gap[1:]
        here = cuts[np.searchsorted(cuts, lo, "right") : np.searchsorted(cuts, hi, "left")] - lo
        opens[here] = inside[here]
        closes[here - 1] = inside[here - 1]
        start, end = np.flatnonzero(opens), np.flatnonzero(closes)
        sums = byte_hash[part]
        sums *= powers[:n]
        np.cumsum(sums, out=sums)
        before = np.where(start > 0, sums[start - 1], np.uint64(0)) if len(start) else np.zeros(0, np.uint64)
        hashes.append((sums[end] - before) * inverses[start])
        first.append(start + lo)
        if spans:
            last.append(end + lo + 1)
    joined = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    starts = np.concatenate(first) if first else np.zeros(0, np.int64)
    at = np.searchsorted(starts, offsets)
    if spans:
        return joined, at, starts, np.concatenate(last) if last else np.zeros(0, np.int64)
    return joined, at


def shingle_sets(hashes: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingles of each row, as (int64 values, first value of each row).

    A row of fewer than k words has its whole sequence as its only shingle; a row
    without words has none.
    """
    count = np.diff(at)
    made = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    slot = np.concatenate(([0], np.cumsum(made)))
    out = np.zeros(slot[-1], np.uint64)
    n = len(hashes)
    if n >= k:
        rolled = np.zeros(n - k + 1, np.uint64)
        for i in range(k):
            rolled += hashes[i : n - k + 1 + i] * PLACES[i]
        begin = np.repeat(at[:-1] - slot[:-1], made) + np.arange(slot[-1])
        whole = np.repeat(count >= k, made)
        out[whole] = rolled[begin[whole]]
    for size in range(1, k):
        rows = np.flatnonzero(count == size)
        if len(rows):
            value = np.full(len(rows), np.uint64(size) * PLACES[k], np.uint64)
            for i in range(size):
                value += hashes[at[rows] + i] * PLACES[i]
            out[slot[rows]] = value
    out = mix(out).view(np.int64)
    for a, b in zip(slot[:-1].tolist(), slot[1:].tolist()):
        if b - a > 1:
            out[a:b].sort()
    if not len(out):
        return out, slot
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[slot[:-1][made > 0]] = True
    return out[new], np.concatenate(([0], np.cumsum(new)))[slot]


def row_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of the values of each row (0 for a row without values), wrapping for integers."""
    total = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)))
    return total[at[1:]] - total[at[:-1]]


def lists(values: np.ndarray, at: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values))
