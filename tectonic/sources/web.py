"""Web rows: the viewer's compact per-year exports, written and read back.

``web_rows`` is the projection (rounding and null rules of the exports);
``write_web_json`` is the sink, one JSON array per line, partitioned by year;
``read_web_json`` parses both that layout and one-array-per-file exports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import year_of
from ..functions.numeric import round_half_even
from ..operators.filters import min_magnitude

WEB5 = ["time", "lat", "lon", "depth_km", "magnitude"]
WEB6 = WEB5 + ["place"]


def web_rows(df: DataFrame, min_mag: float = 2.5, with_place: bool = True, keep_year: bool = False) -> DataFrame:
    """Magnitude floor, then ``time`` and rounded ``lat/lon`` (4), ``depth/magnitude`` (1).

    Null depth becomes 0 and null place ``""``. A null lat/lon/magnitude stays
    null (the reference's ``round`` would raise and stop the whole export).
    """
    out = min_magnitude(df, min_mag) if min_mag is not None else df
    cols = [
        F.col("time"),
        round_half_even("lat", 4).alias("lat"),
        round_half_even("lon", 4).alias("lon"),
        round_half_even(F.coalesce(F.col("depth_km"), F.lit(0.0).cast("float")), 1).alias("depth_km"),
        round_half_even("magnitude", 1).alias("magnitude"),
    ]
    if with_place:
        cols.append(F.coalesce(F.col("place"), F.lit("")).alias("place"))
    if keep_year:
        cols.append(year_of("time").alias("year"))
    return out.select(*cols)


def web_json_lines(rows: DataFrame) -> DataFrame:
    """One compact JSON array per row, e.g. ``[1704067207179,35.1234,-117.5,10.0,4.2,"a"]``."""
    fields = [c for c in WEB6 if c in rows.columns]
    arr = F.to_json(F.array(*[F.expr(f"CAST(`{c}` AS VARIANT)") for c in fields]))
    extra = [c for c in rows.columns if c == "year"]
    return rows.select(arr.alias("value"), *extra)


def write_web_json(rows: DataFrame, path: str) -> None:
    """Per-year text files, time-sorted within each year.

    Range-partitioned on ``(year, time)`` so a dense year spreads over several
    tasks, each writing one contiguous, time-sorted slice of it.
    """
    if "year" not in rows.columns:
        rows = rows.withColumn("year", year_of("time"))
    tie = F.xxhash64(*[F.col(c) for c in rows.columns]).alias("_tie")   # spreads a hot millisecond
    ordered = rows.repartitionByRange("year", "time", tie).sortWithinPartitions("year", "time")
    (web_json_lines(ordered).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("year").text(path))


def parse_web_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON array text per row -> typed web rows; empty place becomes null."""
    a = F.from_json(F.col(column), "array<string>")
    out = lines.select(
        F.element_at(a, 1).cast("long").alias("time"),
        F.element_at(a, 2).cast("double").alias("lat"),
        F.element_at(a, 3).cast("double").alias("lon"),
        F.element_at(a, 4).cast("double").alias("depth_km"),
        F.element_at(a, 5).cast("double").alias("magnitude"),
        F.nullif(F.element_at(a, 6), F.lit("")).alias("place"),
        *[c for c in lines.columns if c == "year"],
    )
    return out


def read_web_json(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """Read web rows. ``whole_files`` reads one-array-of-arrays-per-file exports."""
    if not whole_files:
        return parse_web_lines(spark.read.text(path))
    doc = spark.read.option("wholetext", "true").text(path)
    rows = doc.select(F.explode(F.from_json("value", "array<array<string>>")).alias("r"))
    return parse_web_lines(rows.select(F.to_json("r").alias("value")))
