"""Array helpers for Arrow text batches: byte views, words, rolling and word hashes (numpy)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19
U64 = np.uint64


def random_table(seed: int, n: int) -> np.ndarray:
    """n fixed 64-bit values (splitmix64 from ``seed``)."""
    with np.errstate(over="ignore"):
        z = U64(seed) + np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)
        return mix(z)


def mix(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (z ^ (z >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> U64(27))) * U64(0x94D049BB133111EB)
        return z ^ (z >> U64(31))


def text_slices(column: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows; null counts as empty text.

    A run holds at most ``max_bytes`` unless a single text is longer, so working arrays stay small
    whatever the batch. offsets has one entry more than rows, from 0.
    """
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + max_bytes, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal True runs that do not cross document offsets, and each document's
    first run number (one more entry than documents)."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    first = np.empty(n, bool)
    first[0] = True
    np.logical_not(inside[:-1], out=first[1:])
    cuts = offsets[:-1][offsets[:-1] < n]
    first[cuts] = True
    last = np.empty(n, bool)
    last[-1] = True
    np.logical_not(inside[1:], out=last[:-1])
    last[cuts[cuts > 0] - 1] = True
    starts = np.flatnonzero(inside & first)
    ends = np.flatnonzero(inside & last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


class PolyHash:
    """64-bit polynomial hashes of array ranges from one prefix sum."""

    def __init__(self, seed: int):
        self.base = int(random_table(seed, 1)[0]) | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self._up = self._down = np.ones(1, U64)

    def _powers(self, n: int) -> None:
        if len(self._up) < n:
            up, down = np.full(n, U64(self.base)), np.full(n, U64(self.inverse))
            up[0] = down[0] = 1
            with np.errstate(over="ignore"):
                self._up, self._down = np.cumprod(up), np.cumprod(down)

    def ranges(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(values)
        self._powers(n + 1)
        total = np.zeros(n + 1, U64)
        with np.errstate(over="ignore"):
            np.cumsum(values * self._up[:n], out=total[1:])
            return mix((total[ends] - total[starts]) * self._down[starts])
