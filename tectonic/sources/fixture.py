"""The event catalog mapped from the driver's ``events`` table.

The test tables hold no earthquakes, so every registered query runs on this
projection of ``events`` (one narrow, shuffle-free ``select``; column pruning
reaches the Parquet scan). Each id ending in 4 is revised by the row five ids
later; times spread over 40 years; locations repeat per user so grid cells fill.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import YEAR_MS
from ..session import ensure_utc

# The mapping's offsets (100 days; 40 year-slots).
SHIFT_MS = 8_640_000_000
YEAR_SLOTS = 40


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def catalog_from_events(events: DataFrame) -> DataFrame:
    """Core catalog columns plus ``land_date`` and ``row_seq`` (landing order)."""
    eid = F.col("event_id")
    base_ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return events.select(
        F.concat(F.lit("eq"), F.when(eid % 10 == 9, eid - 5).otherwise(eid).cast("string")).alias("id"),
        (base_ms + F.lit(SHIFT_MS) - (F.floor(eid / 10) % YEAR_SLOTS) * F.lit(YEAR_MS)).alias("time"),
        ((F.col("user_id") * 37) % 181 - 90).cast("float").alias("lat"),
        ((F.col("user_id") * 61) % 361 - 180).cast("float").alias("lon"),
        F.when(eid % 50 == 0, F.lit(None).cast("float"))
        .otherwise((((eid * 7) % 7000).cast("double") / F.lit(10.0)).cast("float"))
        .alias("depth_km"),
        (F.lit(4.0) + F.col("value") / F.lit(100.0)).cast("float").alias("magnitude"),
        F.when(eid % 3 == 0, "mw").when(eid % 3 == 1, "mb").otherwise("ml").alias("mag_type"),
        F.when(eid % 20 == 0, F.lit(None).cast("string")).otherwise(F.col("event_type")).alias("place"),
        F.col("ts").cast("date").alias("land_date"),
        eid.alias("row_seq"),
    )


def load_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_utc(spark)
    events = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return catalog_from_events(events)


# DuckDB text of the same mapping, used by the oracle queries.
CATALOG_SQL = """
SELECT concat('eq', CAST(CASE WHEN event_id % 10 = 9 THEN event_id - 5 ELSE event_id END AS VARCHAR)) AS id,
       (epoch_us(ts) // 1000) + 8640000000 - (CAST(floor(event_id / 10.0) AS BIGINT) % 40) * 31557600000 AS time,
       CAST((user_id * 37 % 181) - 90 AS FLOAT) AS lat,
       CAST((user_id * 61 % 361) - 180 AS FLOAT) AS lon,
       CASE WHEN event_id % 50 = 0 THEN NULL
            ELSE CAST(CAST(event_id * 7 % 7000 AS DOUBLE) / 10.0 AS FLOAT) END AS depth_km,
       CAST(4.0 + value / 100.0 AS FLOAT) AS magnitude,
       CASE WHEN event_id % 3 = 0 THEN 'mw' WHEN event_id % 3 = 1 THEN 'mb' ELSE 'ml' END AS mag_type,
       CASE WHEN event_id % 20 = 0 THEN NULL ELSE event_type END AS place,
       CAST(ts AS DATE) AS land_date, event_id AS row_seq
FROM events
"""
