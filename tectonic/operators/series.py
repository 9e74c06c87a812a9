"""Statistics as the viewer's time window moves (playback frames).

Frame ``k`` starts at ``start + k * step`` while that is before the last start
``end - duration``; the last frame is clamped to exactly ``end - duration``.
Each frame covers ``[s, s + duration)``.

Plan, built so no event row is copied per frame: events are first reduced by
a partial/final aggregate to micro-buckets of width ``g = gcd(step, duration)``
(count, sums in integer tenths, max) -- the only data-sized step, and skew-proof
because a hot bucket is combined map-side. Each micro-bucket then fans out to
the ``duration / step`` frames that contain it (parameter-sized work) and is
summed per frame. Empty frames come from a ``spark.range`` frame list joined
on the frame number. The clamped last frame is one direct filter-aggregate.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clamp, round_half_even
from .stats import mean_of_tenths, tenths


def frame_count(start_ms: int, end_ms: int, duration_ms: int, step_ms: int) -> int:
    """Number of regular frames (before the clamped last one)."""
    max_start = end_ms - duration_ms
    return max(0, -(-(max_start - start_ms) // step_ms)) if max_start > start_ms else 0


def _partial(df: DataFrame, keys: list):
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(tenths("magnitude")).alias("mag10"),
        F.sum(tenths("depth_km")).alias("dep10"),
        F.max(F.col("magnitude").cast("double")).alias("max_magnitude"),
    )


def _finish(df: DataFrame, start_ms: int, end_ms: int, digits: int) -> DataFrame:
    n = F.coalesce(F.col("n"), F.lit(0).cast("long"))
    avg = lambda c: mean_of_tenths(F.col(c), F.col("n"), digits)
    progress = clamp((F.col("frame_start") - F.lit(start_ms)).cast("double") / F.lit(float(end_ms - start_ms)), 0.0, 1.0)
    return df.select(
        "frame", "frame_start", n.alias("n"),
        F.col("max_magnitude"),
        F.when(n > 0, avg("mag10")).alias("avg_magnitude"),
        F.when(n > 0, avg("dep10")).alias("avg_depth_km"),
        round_half_even(progress, 6).alias("progress"),
    )


def window_series(rows: DataFrame, start_ms: int, end_ms: int, duration_ms: int, step_ms: int, digits: int = 4) -> DataFrame:
    """Per frame: ``frame, frame_start, n, max_magnitude, avg_magnitude, avg_depth_km, progress``.

    ``rows`` are web rows (magnitude and depth in tenths, missing depth 0), as the
    viewer's statistics see them.
    """
    spark = rows.sparkSession
    start_ms, end_ms, duration_ms, step_ms = int(start_ms), int(end_ms), int(duration_ms), int(step_ms)
    max_start = end_ms - duration_ms
    k_count = frame_count(start_ms, end_ms, duration_ms, step_ms)
    g = math.gcd(step_ms, duration_ms)
    a, w = step_ms // g, duration_ms // g

    in_span = (F.col("time") >= F.lit(start_ms)) & (F.col("time") < F.lit(start_ms + max(k_count - 1, 0) * step_ms + duration_ms))
    micro = _partial(
        rows.filter(in_span).select(
            F.expr(f"(time - {start_ms}L) div {g}L").alias("j"), "magnitude", "depth_km"),
        ["j"],
    )
    # frames holding bucket j: k*a <= j < k*a + w
    k_lo = F.greatest(F.lit(0).cast("long"), F.expr(f"floor((j - {w}L) / {a}.0D)").cast("long") + F.lit(1))
    k_hi = F.least(F.lit(k_count - 1).cast("long"), F.expr(f"j div {a}L"))
    ks = F.when(k_lo <= k_hi, F.sequence(k_lo, k_hi)).otherwise(F.array().cast("array<bigint>"))
    fanned = micro.select(F.explode(ks).alias("frame"), "n", "mag10", "dep10", "max_magnitude")
    per_frame = fanned.groupBy("frame").agg(
        F.sum("n").alias("n"), F.sum("mag10").alias("mag10"), F.sum("dep10").alias("dep10"),
        F.max("max_magnitude").alias("max_magnitude"),
    )
    frames = spark.range(k_count).select(
        F.col("id").alias("frame"), (F.lit(start_ms) + F.col("id") * F.lit(step_ms)).alias("frame_start"))
    regular = frames.join(per_frame, "frame", "left")

    last = _partial(
        rows.filter((F.col("time") >= F.lit(max_start)) & (F.col("time") < F.lit(end_ms))).select("magnitude", "depth_km"),
        [],
    ).select(F.lit(k_count).cast("long").alias("frame"), F.lit(max_start).cast("long").alias("frame_start"),
             "n", "mag10", "dep10", "max_magnitude")
    return _finish(regular.unionByName(last), start_ms, end_ms, digits)
