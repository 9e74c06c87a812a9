"""The viewer's moving window over a stored archive and the live layer; boxes of a stored archive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedupe import with_live
from ..operators.filters import bbox, time_between, view_filter
from ..operators.stats import stats_columns
from ..operators.topk import visible_recent
from ..sources.parquet import read_catalog
from ..sources.web import web_rows

# Web rows carry one decimal: a magnitude rounds up by at most half of that.
ROUNDED_BY = 0.05


def view_rows(events: DataFrame, start_ms: int, duration_ms: int, min_mag: float, max_depth: float) -> DataFrame:
    """Web rows inside the viewer's window.

    The viewer rounds first (its exports are rounded) and filters then. The window
    and a magnitude floor lowered by the rounding are applied to the raw events
    before, so partition pruning and Parquet filters still work; the exact filter
    sees the rounded rows.
    """
    near = time_between(events, start_ms, start_ms + duration_ms)
    near = near.filter(F.col("magnitude") >= F.lit(float(min_mag) - 2 * ROUNDED_BY).cast("float"))
    return view_filter(web_rows(near, min_mag=None), start_ms, duration_ms, min_mag, max_depth)


def moving_view(archive: DataFrame, live: DataFrame, start_ms: int, duration_ms: int, min_mag: float, max_depth: float,
                k: int = 100, **camera) -> DataFrame:
    """The visible recent events of the window over archive and live layer, each with the window's statistics."""
    core = [c for c in live.columns if c in archive.columns]
    rows = with_live(view_rows(archive, start_ms, duration_ms, min_mag, max_depth),
                     view_rows(live.select(*core), start_ms, duration_ms, min_mag, max_depth))
    stats = rows.agg(F.struct(*stats_columns(in_tenths=True)).alias("s")).scalar()
    names = ["n", "max_magnitude", "avg_magnitude", "avg_depth_km"]
    return visible_recent(rows, k=k, **camera).select("*", *[stats[c].alias(f"window_{c}") for c in names])


def box_rows(spark: SparkSession, path: str, min_lat: float, max_lat: float, min_lon: float, max_lon: float,
             years: list[int] | None = None) -> DataFrame:
    """Archive rows in a box. Of an archive in the ``space`` layout only the row groups near the box are read."""
    return bbox(read_catalog(spark, path, years, with_key=True), min_lat, max_lat, min_lon, max_lon).drop("space_key")
