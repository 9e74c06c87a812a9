"""Hierarchical packing of tokenised documents into windows of several context sizes.

Every document is routed to the smallest tier (256, 512, 1024 or 2048 tokens) that holds it; what
exceeds the longest window fills whole windows of its own first. Windows are packed from the longest
pieces down: a piece opens a window of its tier, its gap is filled by the best-fitting pieces of shorter
tiers, and the rest of the gap by cutting the longest of them (or, if there is none, the next piece of
its own tier). Every window thus ends exactly full. Pieces that cannot fill a window wait for the task's
next documents; what is left when a task ends (less than one window) is cut into lengths that are powers
of two, so no sequence is padded at all.

Step groups hold ``group_tokens`` tokens each: the windows are taken from the longest to the shortest,
so that lengths that divide each other fill every group exactly, but for a task's last one.

Packing is local to a task: no shuffle, memory for one slice of texts and one group, the same result
when a task runs again. Window and group numbers carry the task's partition number.

Defined results: null or empty text gives a document of one token (the separator); every token of
every row lies in exactly one piece; equal rows and equal ids are packed as separate documents; other
columns are ignored. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from . import wordbpe
from .common import table
from .textnum import text_slices

TIERS = (256, 512, 1024, 2048)
GROUP_TOKENS = 16 * 2048
SEPARATOR = 1
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long, window long, step_group long")

# A piece: (length, arrival number, start in the document, document)
Piece = tuple[int, int, int, tuple]


class Packer:
    """Packs the pieces of one task; finished windows are lists of pieces that fill them exactly."""

    def __init__(self, tiers: tuple[int, ...]):
        self.tiers = sorted(tiers)
        self.pool: list[Piece] = []   # pieces not yet placed, by length
        self.count = 0

    def _put(self, length: int, start: int, doc: tuple) -> None:
        if length:
            self.count += 1
            insort(self.pool, (length, self.count, start, doc), key=lambda p: p[:2])

    def add(self, doc: tuple, n_tokens: int) -> Iterator[list[Piece]]:
        """Route a document; yields the windows that it fills alone."""
        most, start = self.tiers[-1], 0
        while n_tokens - start > most:
            yield [(most, 0, start, doc)]
            start += most
        self._put(n_tokens - start, start, doc)

    def windows(self) -> Iterator[list[Piece]]:
        """Pack what waits into full windows; what cannot fill one goes on waiting."""
        while self.pool:
            first = self.pool.pop()
            size = next(t for t in self.tiers if t >= first[0])
            window, gap = [first], size - first[0]
            while gap and self.pool:
                fit = bisect_right(self.pool, gap, key=lambda p: p[0]) - 1
                if fit >= 0:
                    piece = self.pool.pop(fit)
                else:
                    shorter = bisect_right(self.pool, size // 2, key=lambda p: p[0]) - 1
                    length, number, start, doc = self.pool.pop(shorter)
                    piece = (gap, number, start, doc)
                    self._put(length - gap, start + gap, doc)
                window.append(piece)
                gap -= piece[0]
            if gap:
                for length, _, start, doc in window:
                    self._put(length, start, doc)
                return
            yield window

    def rest(self) -> Iterator[list[Piece]]:
        """The last pieces, cut to windows whose lengths are powers of two."""
        total = sum(p[0] for p in self.pool)
        for bit in reversed(range(total.bit_length())):
            gap, window = total & (1 << bit), []
            while gap:
                length, number, start, doc = self.pool.pop()
                take = min(gap, length)
                window.append((take, number, start, doc))
                self._put(length - take, start + take, doc)
                gap -= take
            if window:
                yield window


def pack_documents(docs: DataFrame, path: str, tiers: tuple[int, ...] = TIERS, group_tokens: int = GROUP_TOKENS,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document: where it lies in the document and in which window.

    ``tiers`` are powers of two. ``window`` is the length of the sequence, ``step_group`` the group it
    is trained in.
    """
    if any(t & (t - 1) for t in tiers) or group_tokens % max(tiers):
        raise ValueError("tiers must be powers of two and divide group_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(tiers)
        base = TaskContext.get().partitionId() << 40
        made = groups = filled = 0

        def rows(windows: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal made, groups, filled
            out = []
            for window in sorted(windows, key=lambda w: -sum(p[0] for p in w)):
                size, offset = sum(p[0] for p in window), 0
                if filled + size > group_tokens:
                    groups, filled = groups + 1, 0
                filled += size
                for length, _, start, (doc_id, raw, n) in window:
                    out.append((doc_id, start, length, zlib.crc32(raw[4 * start:4 * (start + length)]), n,
                                base + made, offset, size, base + groups))
                    offset += length
                made += 1
            columns = list(zip(*out, strict=True)) or [()] * 9
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        names = [f.split()[0] for f in SCHEMA.split(", ")]
        with wordbpe.loaded(path) as coder:
            for batch in batches:
                for lo, hi, *_ in text_slices(batch.column(1), wordbpe.SLICE_BYTES):
                    part = batch.slice(lo, hi - lo)
                    _, _, ids, first = coder.encode([t or "" for t in part.column(1).to_pylist()])
                    ids = np.insert(ids, first[1:], SEPARATOR).astype("<u4")
                    first = first + np.arange(len(first))
                    done: list[list[Piece]] = []
                    for i, doc_id in enumerate(part.column(0).to_pylist()):
                        n = int(first[i + 1] - first[i])
                        done += packer.add((doc_id, ids[first[i]:first[i + 1]].tobytes(), n), n)
                    done += packer.windows()
                    yield rows(done)
        yield rows(list(packer.rest()))

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), wordbpe.default_path())
