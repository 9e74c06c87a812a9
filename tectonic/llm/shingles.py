"""Word shingles of whole texts as sets of 64-bit hashes, for Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .textnum import U64, PolyHash, mix, random_table, runs, text_slices

WORDS = 5
#: A-Z in lower case; white space, which separates words, is 0x20 and 0x09-0x0D.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
IN_WORD = np.ones(256, bool)
IN_WORD[[0x20, *range(0x09, 0x0E)]] = False
BYTE_HASH = random_table(21, 256)[LOWER]   # by raw byte, so that case makes no difference
PLACE = random_table(22, 64) | U64(1)
_WORD_HASH = PolyHash(23)


def shingle_sets(column: pa.Array, k: int = WORDS) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text.

    Words are runs without white space, A-Z lower-cased; a shingle is ``k`` consecutive words, and a
    text with fewer words has the whole sequence as its one shingle. Null, empty and blank texts have
    the empty set. Two different shingles share a 64-bit hash with probability 2**-64.
    """
    for lo, hi, data, offsets in text_slices(column):
        starts, ends, first = runs(IN_WORD[data], offsets)
        words = _WORD_HASH.ranges(BYTE_HASH[data], starts, ends)
        n = len(words)
        with np.errstate(over="ignore"):
            rolled = np.zeros(max(0, n - k + 1), U64)
            for j in range(k):
                rolled += words[j:j + len(rolled)] * PLACE[j]
            rolled = mix(rolled)
            for i in range(hi - lo):
                a, b = first[i], first[i + 1]
                if b - a >= k:
                    yield lo + i, np.unique(rolled[a:b - k + 1])
                else:
                    whole = (words[a:b] * PLACE[:b - a]).sum(dtype=U64, keepdims=True) if b > a else words[:0]
                    yield lo + i, mix(whole)
