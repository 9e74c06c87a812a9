"""Text labels and calendar helpers (UTC)."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .numeric import _c, to_fixed  # noqa: F401  (to_fixed re-exported)


def year_of(time_ms) -> Column:
    """UTC year of a ms timestamp (session time zone must be UTC)."""
    return F.year(F.timestamp_millis(_c(time_ms)))


def event_label(place, lat, lon) -> Column:
    """Place when not empty, else ``lat°, lon°`` with one decimal."""
    p = _c(place)
    fallback = F.concat(to_fixed(lat, 1), F.lit("°, "), to_fixed(lon, 1), F.lit("°"))
    return F.when(p.isNotNull() & (p != F.lit("")), p).otherwise(fallback)


def coordinate_label(lat, lon) -> Column:
    """``12.345° N, 67.890° W``: latitude keeps its sign, longitude is absolute."""
    la, lo = _c(lat).cast("double"), _c(lon).cast("double")
    ns = F.when(la >= 0, F.lit("N")).otherwise(F.lit("S"))
    ew = F.when(lo >= 0, F.lit("E")).otherwise(F.lit("W"))
    return F.concat(to_fixed(la, 3), F.lit("° "), ns, F.lit(", "), to_fixed(F.abs(lo), 3), F.lit("° "), ew)


def depth_label(depth_km, digits: int = 0) -> Column:
    return F.concat(to_fixed(depth_km, digits), F.lit(" km deep"))


def date_label(time_ms) -> Column:
    """Short date ``MMM d, yyyy`` in UTC (the viewer uses the browser's zone)."""
    return F.date_format(F.timestamp_millis(_c(time_ms)), "MMM d, yyyy")


def time_label(time_ms) -> Column:
    """Time of day ``hh:mm:ss AM UTC`` (two digits each; the viewer uses the browser's zone)."""
    return F.date_format(F.timestamp_millis(_c(time_ms)), "hh:mm:ss a 'UTC'")


def register_sql_functions(spark: SparkSession) -> None:
    """SQL helpers the catalog's ad-hoc queries use, e.g. ``year(epoch_ms(time))``."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION epoch_ms(t BIGINT) RETURNS TIMESTAMP "
        "RETURN timestamp_millis(t)"
    )
