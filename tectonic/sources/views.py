"""Ad-hoc SQL over the catalog: views ``events`` (latest per id) and ``events_all``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.labels import register_sql_functions, year_of
from ..operators.dedupe import latest_by_id
from ..schema import CORE_COLUMNS, CORE_SCHEMA
from ..session import ensure_utc
from . import manifest
from .parquet import read_catalog, read_landing


def _empty_core(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CORE_SCHEMA)


def current_events(archive: DataFrame, landing: DataFrame | None = None) -> DataFrame:
    """Latest version per id of an archive (one row per id already) and a landing area.

    Archive rows whose id has landed again give way to the landing's latest. Without
    landing the archive passes through, so filters and column pruning reach its
    scan; with landing only the ids of the (small) landing area are met. ``year`` is
    a column, so a filter on it prunes partitions.
    """
    if "year" not in archive.columns:
        archive = archive.withColumn("year", year_of("time"))
    archive = archive.select(*CORE_COLUMNS, "year")
    if landing is None:
        return archive
    ids = landing.select("id").distinct().withColumnRenamed("id", "_landed")
    rest = archive.join(ids, archive["id"].eqNullSafe(ids["_landed"]), "left_anti")
    news = latest_by_id(landing).withColumn("year", year_of("time"))
    return rest.unionByName(news.select(*CORE_COLUMNS, "year"))


def register_frames(
    spark: SparkSession,
    archive: DataFrame | None,
    landing: DataFrame | None = None,
    name: str = "events",
) -> None:
    """Register ``name`` (archive + landing, latest version per id) and ``{name}_all`` (plain union).

    ``archive`` holds one row per id, as every merge leaves it. A missing archive is
    an empty frame of the core schema, so the views exist in every state.
    """
    ensure_utc(spark)
    register_sql_functions(spark)
    archive = archive if archive is not None else _empty_core(spark)
    events = current_events(archive, landing)
    union = archive.select(*CORE_COLUMNS)
    if landing is not None:
        union = union.unionByName(landing.select(*CORE_COLUMNS))
    union.createOrReplaceTempView(f"{name}_all")
    events.createOrReplaceTempView(name)


def register_views(spark: SparkSession, path: str, name: str = "events") -> None:
    """Views over the archive and the landing area at ``path``, both of one state of the manifest: a
    merge that ends meanwhile changes nothing in them."""
    state = manifest.load(spark, path)
    landed = any(b["rows"] for b in state.batches)
    landing = read_landing(spark, path, arrival=True, at=state) if landed else None
    register_frames(spark, read_catalog(spark, path, at=state), landing, name)


def query(spark: SparkSession, path: str, sql: str) -> DataFrame:
    """Ad-hoc SQL over the stored catalog (lazy; Catalyst plans it).

    Runs in a session of its own, so the caller's views of the same names stay.
    """
    own = spark.newSession()
    register_views(own, path)
    return own.sql(sql)
