"""Hard negatives: searched with rotated one-bit codes, intervals from their stored alignment, exact scores.

Vectors become integers (``floor(256 x)``), are padded with zeros to a power of two and rotated by random
signs and a Hadamard transform, which is exact on integers. A vector x keeps one bit per rotated
component, the code o (unit vector of the signs), its length along the code and its length off it. For an
anchor q, t = <q, o> comes from popcounts of the code against the bit planes of the rotated anchor, within
the planes' rounding error; then <q, x> = along * t + <rest of x, rest of q>, and by Cauchy-Schwarz the
last term is at most off * sqrt(|q|^2 - t^2) either way. Only rows whose interval can still enter an
anchor's result are scored, by the integer inner product; what they return is exact.

Anchors are a stated query set: they are broadcast in blocks of at most ``BLOCK_ANCHORS`` rows and
``BLOCK_BYTES``, every row of the table is scanned against each block, and each task sends at most a few
rows per anchor. Two scans per block: the anchors' positives, then the negatives within the score windows
that the positives set. Coded rows are written once to the shared folder.

Defined results: rows with a null label, a null vector or a null or non-finite component take no part,
nor do vectors whose squared integer length exceeds 2**60, as their scores may not fit 64 bits; vectors
of different lengths are never compared (an empty one scores 0); equal ids are separate rows, each with
results of its own as an anchor; a null id is no anchor and ranks after all others of its score; a
positive with a score below 0 has no negatives; other columns are ignored. An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, scan_tasks, table
from .textnum import random_table

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95            # percent of the positive's score
PLANES = 8                    # bits per component of a rotated anchor
MOST_SQUARED = 1 << 60
BLOCK_ANCHORS = 8192
BLOCK_BYTES = 32 << 20
PAIRS_AT_ONCE = 1 << 18
FIRST = 64                    # rows of a batch scored before the others are judged
NO_ID = (1 << 63) - 1
CODED = ("uid long, vec_id long, label long, dim int, anchor boolean, vector binary, code binary, along double, off double, size double")


def width(dim: int) -> int:
    """Rotated length: a power of two, whole 64-bit words."""
    return max(64, 1 << max(dim - 1, 0).bit_length())


def rotate(vectors: np.ndarray) -> np.ndarray:
    """Random signs and a Hadamard transform of integer rows, times sqrt(width): exact integers."""
    n, dim = vectors.shape
    size = width(dim)
    out = np.zeros((n, size), np.int64)
    out[:, :dim] = vectors * (1 - 2 * (random_table(21, dim) >> np.uint64(63)).astype(np.int64))
    step = 1
    while step < size:
        pairs = out.reshape(n, size // (2 * step), 2, step)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, size)
        step *= 2
    return out


def code_vectors(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes as 64-bit words, lengths along and off the code, lengths."""
    turned, wide = rotate(vectors), width(vectors.shape[1])
    codes = np.packbits(turned >= 0, axis=1, bitorder="little").view("<u8")
    size = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
    along = np.abs(turned).sum(axis=1, dtype=np.float64) / wide
    return codes, along, np.sqrt(np.maximum(size ** 2 - along ** 2, 0.0)), size


class Planes:
    """A rotated anchor in bit planes, for popcounts against codes."""

    def __init__(self, vector: np.ndarray):
        self.wide = width(len(vector))
        turned = rotate(vector[None])[0] / np.sqrt(self.wide)
        self.size = float(np.sqrt((vector.astype(np.float64) ** 2).sum()))
        self.low = float(turned.min())
        self.step = (float(turned.max()) - self.low) / ((1 << PLANES) - 1) or 1.0
        steps = np.rint((turned - self.low) / self.step).astype(np.uint64)
        self.error = float(np.sqrt(((turned - (self.low + self.step * steps)) ** 2).sum()))
        bits = (steps[None] >> np.arange(PLANES, dtype=np.uint64)[:, None]) & np.uint64(1)
        self.planes = np.packbits(bits.astype(np.uint8), axis=1, bitorder="little").view("<u8")
        self.steps = float(steps.sum())

    def bounds(self, codes: np.ndarray, ones: np.ndarray, along: np.ndarray, off: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest possible scores of coded rows; ``ones`` is the popcount of their codes."""
        hits = np.zeros(len(codes), np.int64)
        for k in range(PLANES):
            hits += np.bitwise_count(codes & self.planes[k]).sum(axis=1, dtype=np.int64) << k
        t = (self.low * (2 * ones - self.wide) + self.step * (2 * hits - self.steps)) / np.sqrt(self.wide)
        rest = off * np.sqrt(np.maximum(self.size ** 2 - np.maximum(np.abs(t) - self.error, 0.0) ** 2, 0.0))
        slack = along * self.error + rest + 1e-9 * size * self.size + 1e-6
        return along * t - slack, along * t + slack


@dataclass
class Best:
    """The k best rows so far: score descending, then id, then row."""

    k: int
    low: int = -(1 << 62)
    high: int = 1 << 62
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    rows: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def least(self) -> int:
        return int(self.scores[-1]) if len(self.scores) == self.k else self.low

    def offer(self, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        use = (scores >= self.least()) & (scores <= self.high)
        if not use.any():
            return
        s, i, r = (np.concatenate(x) for x in ((self.scores, scores[use]), (self.ids, ids[use]), (self.rows, rows[use])))
        top = np.lexsort((r, i, -s))[:self.k]
        self.scores, self.ids, self.rows = s[top], i[top], r[top]


class Part:
    """Rows of one dimension out of a batch, by label."""

    def __init__(self, batch: pa.RecordBatch, dim: int):
        number = {f: i for i, f in enumerate(batch.schema.names)}

        def raw(name: str, kind: str) -> np.ndarray:
            return np.frombuffer(b"".join(batch.column(number[name]).to_pylist()), kind).reshape(batch.num_rows, -1)

        def plain(name: str) -> np.ndarray:
            return batch.column(number[name]).to_numpy(zero_copy_only=False)

        label = plain("label")
        order = np.argsort(label, kind="stable")
        self.label = label[order]
        self.rows, self.along, self.off, self.size = (plain(c)[order] for c in ("uid", "along", "off", "size"))
        self.ids = pc.fill_null(batch.column(number["vec_id"]), NO_ID).to_numpy()[order]
        self.codes = raw("code", "<u8")[order]
        self.vectors = raw("vector", "<i4")[order] if dim else np.zeros((len(order), 0), np.int32)
        self.ones = np.bitwise_count(self.codes).sum(axis=1, dtype=np.int64)
        self.longest = float(self.size.max(initial=0.0))
        self.doubles = self.vectors.astype(np.float64)

    def of_label(self, label: int) -> slice:
        return slice(*np.searchsorted(self.label, [label, label + 1]))

    def bounds(self, anchor: Anchor, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        return anchor.planes.bounds(self.codes[a:b], self.ones[a:b], self.along[a:b], self.off[a:b], self.size[a:b])

    def score(self, anchor: Anchor, at: np.ndarray) -> np.ndarray:
        """Integer inner products; doubles hold them exactly below 2**52."""
        if self.longest * anchor.planes.size < 1 << 52:
            return (self.doubles[at] @ anchor.doubles).astype(np.int64)
        return self.vectors[at].astype(np.int64) @ anchor.vector


class Anchor:
    def __init__(self, uid: int, label: int, vector: np.ndarray, windows: list[tuple[int, int]] | None = None):
        self.uid, self.label, self.vector, self.doubles = uid, label, vector.astype(np.int64), vector.astype(np.float64)
        self.planes = Planes(self.vector)
        self.slots = [Best(NEGATIVES, lo, hi) for lo, hi in windows] if windows is not None else [Best(POSITIVES)]

    def search(self, part: Part, ranges: list[tuple[int, int]]) -> None:
        """Offer the rows of the ranges whose interval meets a slot's window above what the slot holds.

        The rows of the greatest possible scores go first: what they score lifts the slots' floors, and
        most of the others then need no score."""
        for a, b in ((a, min(a + PAIRS_AT_ONCE, end)) for start, end in ranges for a in range(start, end, PAIRS_AT_ONCE)):
            low, high = part.bounds(self, a, b)
            open_ = part.rows[a:b] != self.uid
            first = open_ & self.wanted(low, high)
            if first.sum() > FIRST:
                at = np.flatnonzero(first)
                first[:] = False
                first[at[np.argpartition(high[at], -FIRST)[-FIRST:]]] = True
                self.offer(part, a + np.flatnonzero(first))
                open_ &= ~first
                first = open_ & self.wanted(low, high)
            self.offer(part, a + np.flatnonzero(first))

    def wanted(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        use = np.zeros(len(low), bool)
        for slot in self.slots:
            use |= (high >= slot.least()) & (low <= slot.high)
        return use

    def offer(self, part: Part, at: np.ndarray) -> None:
        if len(at):
            scores = part.score(self, at)
            for slot in self.slots:
                slot.offer(scores, part.ids[at], part.rows[at])


def code_rows(vectors: DataFrame, id_col: str, vector_col: str, label: Column, anchor: Column) -> DataFrame:
    """Coded rows of the vectors that take part, written to the shared folder."""
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), label.cast("long").alias("label"),
                          F.coalesce(anchor, F.lit(False)).alias("anchor"), vectors[vector_col].cast("array<double>").alias("vector"))
    rows = rows.where("label IS NOT NULL AND vector IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            lists = batch.column(3).cast(pa.large_list(pa.float64()))
            sizes = pc.list_value_length(lists).to_numpy()
            for dim in np.unique(sizes):
                here = pa.array(np.flatnonzero(sizes == dim))
                values = lists.take(here).flatten()
                values = pc.fill_null(values, float("nan")).to_numpy(zero_copy_only=False).reshape(len(here), dim)
                whole = np.floor(SCALE * values)
                keep = np.isfinite(values).all(axis=1) & (np.square(np.where(np.isfinite(whole), whole, np.inf)).sum(axis=1) <= MOST_SQUARED)
                whole = whole[keep].astype(np.int64)
                codes, along, off, size = code_vectors(whole)
                kept = batch.take(pa.array(np.asarray(here)[keep]))
                n = len(whole)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(next_uid + np.arange(n)), kept.column(0), kept.column(1), pa.array(np.full(n, dim, np.int32)), kept.column(2),
                     pa.array([v.tobytes() for v in whole.astype("<i4")], pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary()),
                     pa.array(along), pa.array(off), pa.array(size)], [f.split()[0] for f in CODED.split(", ")])
                next_uid += n

    return materialize(rows.mapInArrow(run, CODED), "codes")


def _search(coded: DataFrame, shared, same_label: bool) -> DataFrame:
    """(anchor, slot, score, id, row): per task what each slot of each anchor holds at its end."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_dim: dict[int, list[Anchor]] = {}
        for uid, label, dim, vector, windows in shared.value:
            by_dim.setdefault(dim, []).append(Anchor(uid, label, np.frombuffer(vector, "<i4"), windows))
        for batch in batches:
            dims = batch.column(batch.schema.get_field_index("dim")).to_numpy()
            for dim in np.unique(dims).tolist():
                if dim not in by_dim:
                    continue
                part = Part(batch.filter(pa.array(dims == dim)), dim)
                for anchor in by_dim[dim]:
                    own = part.of_label(anchor.label)
                    anchor.search(part, [(own.start, own.stop)] if same_label else [(0, own.start), (own.stop, len(part.rows))])
        out = [(a.uid, k, *row) for anchors in by_dim.values() for a in anchors for k, slot in enumerate(a.slots)
               for row in zip(slot.scores.tolist(), slot.ids.tolist(), slot.rows.tolist(), strict=True)]
        columns = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["anchor", "slot", "score", "id", "row"])

    needed = coded.select("uid", "vec_id", "label", "dim", "vector", "code", "along", "off", "size")
    return scan_tasks(needed).mapInArrow(run, "anchor long, slot long, score long, id long, row long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _id(column: str) -> Column:
    return F.when(F.col(column) != NO_ID, F.col(column))


def hard_negatives(vectors: DataFrame, label: Column, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that ``anchor`` marks."""
    spark = vectors.sparkSession
    coded = code_rows(vectors, id_col, vector_col, label, anchor)
    anchors = coded.where("anchor").select("uid", "vec_id", "label", "dim", "vector")
    size = anchors.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("vector") + 64), F.lit(0)).alias("bytes")).first()
    n = max(1, -(-size["n"] // BLOCK_ANCHORS), -(-size["bytes"] // BLOCK_BYTES))
    out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    for block in range(n):
        part = anchors.where(F.pmod(F.xxhash64("uid"), F.lit(n)) == block) if n > 1 else anchors
        rows = part.collect()
        if not rows:
            continue
        shared = spark.sparkContext.broadcast([(r["uid"], r["label"], r["dim"], bytes(r["vector"]), None) for r in rows])
        positives: dict[int, list] = {}
        for p in _ranked(_search(coded, shared, same_label=True), POSITIVES).orderBy("anchor", "rank").collect():
            positives.setdefault(p["anchor"], []).append(p)
        windows = [(r["uid"], r["label"], r["dim"], bytes(r["vector"]),
                    [(-(-LOW * p["score"] // 100), HIGH * p["score"] // 100) for p in positives[r["uid"]]]) for r in rows if r["uid"] in positives]
        facts = [(r["uid"], k, r["vec_id"], p["id"], p["score"]) for r in rows for k, p in enumerate(positives.get(r["uid"], ()))]
        shared.unpersist()
        if not facts:
            continue
        slots = spark.createDataFrame(facts, "anchor long, slot long, anchor_id long, positive long, positive_score long")
        found = _ranked(_search(coded, spark.sparkContext.broadcast(windows), same_label=False), NEGATIVES)
        out = out.unionByName(found.join(F.broadcast(slots), ["anchor", "slot"]).select(
            "anchor_id", _id("positive").alias("positive_id"), "rank", _id("id").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score")))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    known = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (known + 1) % 10).otherwise(known)
    return hard_negatives(vectors, label, F.col("vec_id") % 50 == 0)


ORACLE_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
                  [floor(256 * x::DOUBLE) for x in embedding] AS q
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND list_bool_and([x IS NOT NULL AND isfinite(x) for x in embedding])),
s AS (SELECT a.r, a.vec_id AS anchor_id, a.label = b.label AS same, b.r AS other, b.vec_id AS id, list_inner_product(a.q, b.q)::BIGINT AS score
      FROM v a JOIN v b ON a.r <> b.r AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
p AS (SELECT r, anchor_id, id AS positive_id, other, score AS positive_score,
             row_number() OVER (PARTITION BY r ORDER BY score DESC, id, other) AS k FROM s WHERE same QUALIFY k <= 5),
n AS (SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.r, p.k ORDER BY s.score DESC, s.id, s.other)::INTEGER AS rank,
             s.id AS negative_id, p.positive_score, s.score AS negative_score
      FROM p JOIN s ON s.r = p.r AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
SELECT * FROM n WHERE rank <= 3
"""
