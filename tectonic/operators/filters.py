"""Row filters. All are conjunctive ``filter`` calls that Catalyst pushes into the scan.

Where a frame carries the ``year`` partition column, time filters also add a
``year`` range so the archive scan prunes whole partitions (Catalyst does not
derive ``year`` from ``time`` by itself).
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import box_ranges, cartesian_xyz
from ..functions.geo import facing as facing_expr
from ..functions.labels import year_of
from ..functions.numeric import threshold_for
from ..schema import CA_BOUNDS, DAY_MS, DEFAULT_CAMERA


def utc_year(ms: int | float) -> int:
    return datetime.fromtimestamp(ms / 1000.0, tz=timezone.utc).year


def utc_midnight(ms: int | float) -> int:
    """Start of the UTC day holding ``ms`` (plain arithmetic on a parameter, no clock read)."""
    return int(ms // DAY_MS * DAY_MS)


def with_year(df: DataFrame) -> DataFrame:
    return df if "year" in df.columns else df.withColumn("year", year_of("time"))


def _prune_years(df: DataFrame, start_ms, end_ms_exclusive) -> DataFrame:
    if "year" not in df.columns:
        return df
    lo, hi = utc_year(start_ms), utc_year(end_ms_exclusive - 1)
    return df.filter(F.col("year").between(lo, hi))


def min_magnitude(df: DataFrame, m: float) -> DataFrame:
    return df.filter(F.col("magnitude") >= threshold_for(df, "magnitude", m))


def time_between(df: DataFrame, start_ms, end_ms) -> DataFrame:
    """Half-open ``[start, end)``."""
    return _prune_years(df, start_ms, end_ms).filter(
        (F.col("time") >= F.lit(start_ms)) & (F.col("time") < F.lit(end_ms))
    )


def event_range(df: DataFrame, start_ms: int, end_ms: int, min_mag: float = 2.5) -> DataFrame:
    """A range request: ``[start, end)``, magnitude floor, time ascending (ties by id).

    The global sort range-partitions on ``(time, id)``, so rows sharing one
    millisecond do not all land in one task.
    """
    ordered = ["time", "id"] if "id" in df.columns else ["time"]
    return min_magnitude(time_between(df, start_ms, end_ms), min_mag).orderBy(*ordered)


def view_filter(df: DataFrame, start_ms, duration_ms, min_mag: float, max_depth: float) -> DataFrame:
    """The viewer's window: ``start <= time < start + duration``, magnitude floor, depth ceiling.

    The viewer filters its exported rows, so ``df`` are web rows (rounded); over a
    stored archive see ``plans.view``. Null depth counts as 0, as in the exported rows the viewer filters; written
    as ``depth IS NULL OR depth <= max`` so Parquet can evaluate it.
    """
    end_ms = start_ms + duration_ms
    out = time_between(df, start_ms, end_ms)
    out = min_magnitude(out, min_mag)
    depth = F.col("depth_km")
    within = depth <= F.lit(float(max_depth))
    return out.filter((depth.isNull() | within) if max_depth >= 0 else within)


def bbox(df: DataFrame, min_lat: float, max_lat: float, min_lon: float, max_lon: float) -> DataFrame:
    """Rows in a box, edges included. A frame with a ``space_key`` (see ``plans.view.box_rows``) is first filtered
    by the few key ranges that hold the box, which a scan sorted by the key answers from its statistics."""
    if "space_key" in df.columns:
        near = F.lit(False)
        for first, last in box_ranges(min_lat, max_lat, min_lon, max_lon):
            near = near | F.col("space_key").between(F.lit(first).cast("long"), F.lit(last).cast("long"))
        df = df.filter(near)
    lat, lon = F.col("lat"), F.col("lon")
    return df.filter(
        (lat >= threshold_for(df, "lat", min_lat)) & (lat <= threshold_for(df, "lat", max_lat))
        & (lon >= threshold_for(df, "lon", min_lon)) & (lon <= threshold_for(df, "lon", max_lon)))


def regional_bbox(df: DataFrame) -> DataFrame:
    b = CA_BOUNDS
    return bbox(df, b["min_lat"], b["max_lat"], b["min_lon"], b["max_lon"])


def regional_filter(df: DataFrame, show_micro: bool = False, min_mag: float = 0.0) -> DataFrame:
    """Regional page toggle: drop ``mag < 2`` unless micro events are shown, then the floor.

    A missing magnitude counts as 0, as the page reads it.
    """
    floor = float(min_mag) if show_micro else max(float(min_mag), 2.0)
    mag = F.coalesce(F.col("magnitude"), threshold_for(df, "magnitude", 0.0))
    return df.filter(mag >= threshold_for(df, "magnitude", floor))


def trailing_days(df: DataFrame, now_ms: int, days: int = 30) -> DataFrame:
    """Whole UTC days: from the midnight ``days`` before ``now`` up to today's midnight."""
    end = utc_midnight(now_ms)
    start = utc_midnight(now_ms - days * DAY_MS)
    return time_between(df, start, end)


def today_events(df: DataFrame, now_ms: int) -> DataFrame:
    """Live layer: midnight UTC up to ``now`` (a parameter, never a clock read)."""
    return time_between(df, utc_midnight(now_ms), now_ms)


def unlanded_events(df: DataFrame, landed_days: DataFrame, now_ms: int, since_ms: int | None = None) -> DataFrame:
    """Live layer without the gap: events before ``now`` whose UTC day has not landed yet.

    Between midnight and the nightly sync yesterday is in neither the archive nor
    today's feed; keeping every unlanded day closes that gap. ``landed_days`` has
    one row per landed date (calendar-sized), so it is restricted to the span
    and broadcast; ``since_ms`` bounds how far back the live layer reaches.
    """
    out = df.filter(F.col("time") < F.lit(int(now_ms)))
    if since_ms is not None:
        out = out.filter(F.col("time") >= F.lit(int(since_ms)))
    day = F.to_date(F.timestamp_millis("time"))
    have = landed_days.select(F.col("land_date").alias("_day"))
    last = F.to_date(F.timestamp_millis(F.lit(int(now_ms))))
    span = F.col("_day") <= last
    if since_ms is not None:
        span = span & (F.col("_day") >= F.to_date(F.timestamp_millis(F.lit(int(since_ms)))))
    have = have.filter(span).distinct()   # at most one row per day of the span
    return out.join(F.broadcast(have), day == F.col("_day"), "left_anti")


def facing(df: DataFrame, camera: tuple[float, float, float] = DEFAULT_CAMERA) -> DataFrame:
    """Events on the camera's half of the globe."""
    return df.filter(facing_expr("lat", "lon", camera))


def in_frustum(df: DataFrame, matrix: tuple[float, ...] | list[float]) -> DataFrame:
    """Events whose surface point lies inside the view frustum.

    ``matrix`` is the camera's projection x view matrix, 16 numbers in column
    order: a point is inside if its clip coordinates lie within [-w, w]. All
    zeros (no camera yet) keep every row.
    """
    m = [float(v) for v in matrix]
    if not any(m):
        return df
    point = cartesian_xyz("lat", "lon", None)
    x, y, z, w = (sum((c * F.lit(m[4 * k + row]) for k, c in enumerate(point)), F.lit(m[12 + row])) for row in range(4))
    inside = F.lit(True)
    for axis in (x, y, z):
        inside = inside & (w - axis >= 0) & (w + axis >= 0)
    return df.filter(inside)
