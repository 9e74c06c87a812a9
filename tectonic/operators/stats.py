"""Aggregates: window statistics, yearly counts, timeline ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import year_of
from ..functions.numeric import round_half_even
from ..functions.style import magnitude_hex, tick_height


def tenths(col) -> Column:
    """A value of one decimal as a whole number of tenths."""
    return F.round((F.col(col) if isinstance(col, str) else col).cast("double") * F.lit(10.0)).cast("long")


def mean_of_tenths(total: Column, n: Column, digits: int) -> Column:
    """Mean from a whole sum: the order in which rows meet cannot decide how it rounds."""
    return round_half_even(total.cast("double") / n.cast("double") / F.lit(10.0), digits)


def _mean(col: str, digits: int, in_tenths: bool) -> Column:
    n = F.nullif(F.count(col), F.lit(0).cast("long"))
    if in_tenths:
        return mean_of_tenths(F.sum(tenths(col)), n, digits)
    total = F.sum(F.col(col).cast("double").cast("decimal(28,9)"))
    return round_half_even(total.cast("double") / n.cast("double"), digits)


def stats_columns(digits: int = 4, mag: str = "magnitude", depth: str = "depth_km", in_tenths: bool = False):
    """count, max magnitude, mean magnitude, mean depth (null when there are no rows)."""
    return [
        F.count(F.lit(1)).alias("n"),
        F.max(F.col(mag).cast("double")).alias("max_magnitude"),
        _mean(mag, digits, in_tenths).alias("avg_magnitude"),
        _mean(depth, digits, in_tenths).alias("avg_depth_km"),
    ]


def window_stats(rows: DataFrame, digits: int = 4, mag: str = "magnitude", depth: str = "depth_km", in_tenths: bool = False) -> DataFrame:
    """One-row global aggregate (partial per task, final merge of one row per task).

    Over web rows depth is already 0 for missing values, as the viewer sees it, and values have
    one decimal: with ``in_tenths`` they are summed as whole tenths. Other values, as the regional page's
    raw points (``window_stats(points, mag="mag", depth="depth")``), are summed as decimals of nine
    places. Either way rows in any order give equal results.
    """
    return rows.agg(*stats_columns(digits, mag, depth, in_tenths))


def yearly_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(year_of("time").alias("yr")).agg(F.count(F.lit(1)).alias("n")).orderBy("yr")


def timeline_ticks(df: DataFrame, digits: int = 6) -> DataFrame:
    """Tick per event: position ``(t - t0) / span * 100`` (span 0 counts as 1), height, colour.

    ``t0``/``t1`` come from one scalar subquery (a partial/final aggregate whose
    single row is inlined in the projection) rather than a join or an
    unpartitioned window.
    """
    bounds = df.agg(F.struct(F.min("time").alias("t0"), F.max("time").alias("t1")).alias("b")).scalar()
    t0, t1 = bounds["t0"], bounds["t1"]
    span = F.when((t1 - t0) == 0, F.lit(1)).otherwise(t1 - t0).cast("double")
    pct = (F.col("time") - t0).cast("double") / span * F.lit(100.0)
    cols = ["id", "time"] if "id" in df.columns else df.columns
    return df.select(
        *cols,
        round_half_even(pct, digits).alias("pct"),
        round_half_even(tick_height("magnitude"), digits).alias("height"),
        magnitude_hex("magnitude").alias("color"),
    )
