"""Many texts as one byte array: word spans and hashes of any span by numpy, a slice of an Arrow batch at a time.

All functions here work inside a Spark task on the bytes of one slice; nothing is kept between slices but
tables of powers. Offsets are byte offsets in the slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
# odd, so that they have inverses modulo 2**64
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BASES = tuple((b, np.uint64(pow(int(b), -1, 1 << 64))) for b in (_P, _Q))
_powers = [[np.ones(1, np.uint64), np.ones(1, np.uint64)] for _ in _BASES]

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
WORD_BYTE = ~_SPACE
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows of about ``limit`` bytes; null counts as empty.

    A row longer than ``limit`` comes alone and whole.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    everything = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, everything[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def powers(n: int, kind: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of a multiplier and of its inverse; there are two kinds, for hashes that do not depend on one another."""
    own = _powers[kind]
    if len(own[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate(_BASES[kind]):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            own[i] = np.cumprod(steps, dtype=np.uint64)
    return own[0][:n], own[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Spans:
    """64-bit hashes of any spans of a sequence of integers, each in constant time."""

    def __init__(self, values: np.ndarray, kind: int = 0):
        n = len(values)
        up, self._down = powers(n + 1, kind)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:n], out=self._sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self._sums[ends] - self._sums[starts]) * self._down[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = WORD_BYTE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): maximal runs of word bytes inside each row; row r has words first[r] to first[r + 1]."""
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = is_word[buf]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    begins[cuts] = inside[cuts]
    stops[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of ``flags`` are set between consecutive ``offsets``."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def row_numbers(first: np.ndarray) -> np.ndarray:
    """The row of each item, given the first item of each row (and the number of items at the end)."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def within_rows(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Hashes that are equal only for equal ``hashes`` in the same row."""
    return mix(hashes ^ mix(rows.astype(np.uint64) + _P))
