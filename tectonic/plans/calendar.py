"""What still has to be requested: missing years, missing days, and day ranges to ask for.

The calendars here are built from parameters with ``spark.range`` and compared
with what has landed through ``left_anti`` joins. The landed side is first
restricted to the requested span, so its size is bounded by that span (at most
one row per day or year) and it is broadcast on that proven bound.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _as_date(d) -> date:
    return d if isinstance(d, date) else date.fromisoformat(str(d))


def year_calendar(spark: SparkSession, start_year: int, end_year: int) -> DataFrame:
    return spark.range(int(start_year), int(end_year) + 1).select(F.col("id").cast("int").alias("year"))


def day_calendar(spark: SparkSession, start, through) -> DataFrame:
    """Every date in ``[start, through]`` (leap days included, spans New Year)."""
    s, t = _as_date(start), _as_date(through)
    n = max((t - s).days + 1, 0)
    return spark.range(n).select(
        F.date_add(F.lit(s.isoformat()).cast("date"), F.col("id").cast("int")).alias("land_date")
    )


def missing_years(landed: DataFrame, start_year: int, end_year: int, overwrite: bool = False) -> DataFrame:
    """Years in ``[start_year, end_year]`` with no archived rows (all of them when ``overwrite``).

    ``landed`` has a ``year`` column, or ``time`` from which the year is derived.
    """
    spark = landed.sparkSession
    years = year_calendar(spark, start_year, end_year)
    if overwrite:
        return years
    have = landed if "year" in landed.columns else landed.select(F.year(F.timestamp_millis("time")).alias("year"))
    have = have.select(F.col("year").cast("int").alias("year")).filter(F.col("year").between(start_year, end_year))
    return years.join(F.broadcast(have.distinct()), "year", "left_anti")


def landed_days_of(rows: DataFrame) -> DataFrame:
    """Landed-days table (``land_date``, ``n``) from landed rows."""
    return rows.groupBy("land_date").agg(F.count(F.lit(1)).alias("n"))


def missing_days(landed_days: DataFrame, start, through, refresh_days: list | None = None) -> DataFrame:
    """Days in ``[start, through]`` not landed yet. A landed day with ``n = 0`` counts as landed.

    ``refresh_days`` are requested again even if landed.
    """
    spark = landed_days.sparkSession
    s, t = _as_date(start), _as_date(through)
    cal = day_calendar(spark, s, t)
    have = landed_days.select("land_date").filter(F.col("land_date").between(F.lit(s.isoformat()).cast("date"), F.lit(t.isoformat()).cast("date")))
    if refresh_days:
        have = have.filter(~F.col("land_date").isin([_as_date(d).isoformat() for d in refresh_days]))
    return cal.join(F.broadcast(have.distinct()), "land_date", "left_anti")


def plan_requests(landed_days: DataFrame, start, through, refresh_days: list | None = None) -> DataFrame:
    """Merge consecutive missing days into one request each (gaps and islands).

    Output ``start_day``, ``end_day`` (inclusive), ``n_days``, and the half-open
    request bounds ``start_ms`` / ``end_ms`` (midnight to midnight). The first run
    is one bulk range; later runs one range per gap.

    Islands are keyed by ``day - rank`` (consecutive days share it), where the
    rank of a missing day is its position within its year (a window
    partitioned by year) plus the missing days of all earlier years (a prefix
    sum over at most one row per year, broadcast back).
    """
    s, t = _as_date(start), _as_date(through)
    miss = missing_days(landed_days, s, t, refresh_days).withColumn("_year", F.year("land_date"))
    per_year = miss.groupBy("_year").agg(F.count(F.lit(1)).alias("_n"))
    before = per_year.select(
        "_year",
        (F.sum("_n").over(Window.orderBy("_year").rowsBetween(Window.unboundedPreceding, -1))).alias("_before"),
    )
    in_year = F.row_number().over(Window.partitionBy("_year").orderBy("land_date"))
    ranked = miss.select("land_date", "_year", in_year.alias("_k")).join(F.broadcast(before), "_year")
    rank = (F.col("_k") + F.coalesce(F.col("_before"), F.lit(0))).cast("int")
    islands = ranked.select("land_date", F.date_sub("land_date", rank).alias("_island"))
    out = islands.groupBy("_island").agg(
        F.min("land_date").alias("start_day"), F.max("land_date").alias("end_day"),
        F.count(F.lit(1)).alias("n_days"),
    )
    start_ms = F.unix_millis(F.col("start_day").cast("timestamp"))
    end_ms = F.unix_millis(F.date_add("end_day", 1).cast("timestamp"))
    return out.select("start_day", "end_day", "n_days", start_ms.alias("start_ms"), end_ms.alias("end_ms"))
