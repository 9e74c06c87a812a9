"""Keep-last merging of revised events.

Spark has no row order, so "last" is an explicit rank: source (archive before
landing), arrival number of the landing batch, landing date, position in the landing (``row_seq``) or, without one,
``time`` (the service returns time ascending), then a hash of the row so the
choice is repeatable. The merge is one ``groupBy(id)`` with ``max_by``, which
Spark aggregates partially on the map side: an id holding a third of all rows
is combined per task before the shuffle, never gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import year_of
from ..schema import CORE_COLUMNS

RANK_COLUMNS = ["_source_rank", "batch", "land_date", "row_seq", "time", "_row_hash"]


def _with_rank(df: DataFrame, source_rank: int) -> DataFrame:
    out = df
    if "_source_rank" not in out.columns:
        out = out.withColumn("_source_rank", F.lit(source_rank))
    if "batch" not in out.columns:
        out = out.withColumn("batch", F.lit(None).cast("long"))
    if "land_date" not in out.columns:
        out = out.withColumn("land_date", F.lit(None).cast("date"))
    if "row_seq" not in out.columns:
        out = out.withColumn("row_seq", F.lit(None).cast("long"))
    if "_row_hash" not in out.columns:
        out = out.withColumn("_row_hash", F.xxhash64(*[F.col(c) for c in CORE_COLUMNS]))
    return out


def latest_by_id(df: DataFrame, order_by: list[str] | None = None, key: str = "id") -> DataFrame:
    """One row per ``key``: the row with the greatest rank. Null keys form one group.

    ``order_by`` defaults to the landing order ``(batch, land_date, row_seq)`` as far as the
    frame has it; the output keeps the input's columns and their order.
    """
    cols = df.columns
    if order_by is None:
        order_by = [c for c in RANK_COLUMNS if c in cols] or ["time"]
    rank = F.struct(*[F.col(c) for c in order_by])
    payload = F.struct(*[F.col(c) for c in cols if c != key])
    merged = df.groupBy(key).agg(F.max_by(payload, rank).alias("_latest"))
    return merged.select(key, "_latest.*").select(*cols)


def compact(archive: DataFrame, landing: DataFrame | None = None) -> DataFrame:
    """Archive + landed rows, latest version per id, with ``year`` derived from ``time``.

    The year comes from the event's own time, so a revision that moves an event
    across New Year leaves exactly one copy, in its new year. Without
    ``landing`` the archive rows alone are merged (a first build).
    """
    keep = CORE_COLUMNS + ["batch", "land_date", "row_seq"]
    union = _with_rank(archive.select(*[c for c in archive.columns if c in keep]), 0)
    if landing is not None:
        news = _with_rank(landing.select(*[c for c in landing.columns if c in keep]), 1)
        union = union.unionByName(news, allowMissingColumns=True)
    ranked = union.select(*CORE_COLUMNS, *[c for c in RANK_COLUMNS if c not in CORE_COLUMNS])
    latest = latest_by_id(ranked, order_by=RANK_COLUMNS)
    return latest.select(*CORE_COLUMNS).withColumn("year", year_of("time"))


def with_live(archive: DataFrame, live: DataFrame, dedupe: bool = False) -> DataFrame:
    """Archive rows plus the live layer; plain concatenation as the viewer does, or merged."""
    if dedupe:
        return compact(archive, live)
    return archive.unionByName(live, allowMissingColumns=True)
