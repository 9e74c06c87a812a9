"""Incremental sync: land missing days, merge whatever has landed, export web rows.

The driver only plans (calendar-sized lists of days and years); rows stay on
executors. Every step writes files of its own and publishes them with one commit
of the manifest, so a run that ends anywhere leaves a whole catalog, and a re-run
resumes from what has been published:

1. land the raw rows of the days not landed yet (``land_daily``), recording empty days too, in ranges of bounded
   size that the request ledger keeps; only the raw files of those days' ranges are opened;
2. merge the landing batches listed now, whoever landed them: only the years an incoming id
   touches (its old year and its new one) are written anew, and one commit switches them and retires just
   those batches. What lands meanwhile waits for the next merge;
3. export web rows of those years, of years that an interrupted run left pending
   and of stored years that have no export yet;
4. optionally refit the hazard grid, from the changed years' rows and the other years' sums;
5. delete files that an earlier merge has retired.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import year_of
from ..operators.dedupe import compact, latest_by_id
from ..operators.filters import min_magnitude
from ..session import ensure_utc
from ..sources import manifest
from ..sources import parquet as pq
from ..sources.csv import apply_null_markers, normalize, read_event_csv
from ..sources.hazard_io import write_hazard
from ..sources.web import web_rows, write_web_json
from . import ledger
from .calendar import missing_days
from .refit import refit_hazard


def _years(df: DataFrame) -> list[int | None]:
    """Distinct years of a frame (one per calendar year), a null year last."""
    return sorted((r[0] for r in df.select("year").distinct().collect()), key=lambda y: (y is None, y or 0))


def _folder(year: int | None) -> str:
    return pq.NO_VALUE if year is None else str(year)


#: Bytes that a raw row counts for where rows come without files.
RAW_ROW_BYTES = 200

#: Least number of buckets of a new id index; it has as many as the session has shuffle partitions, which are
#: sized to the data, so that a day's ids touch few of them in a large archive.
ID_BUCKETS = 16


def indexed_years(spark: SparkSession, path: str, ids: DataFrame, state: manifest.Manifest) -> DataFrame:
    """(id, year) of the archive rows with one of ``ids`` (a distinct column ``id``), from the id index alone:
    only the buckets that these ids fall in are read, and no file of the archive."""
    touched = [r[0] for r in ids.select(pq.id_bucket(state.id_buckets)).distinct().collect()]   # at most one per bucket
    known, wanted = pq.read_ids(spark, path, touched, at=state), ids.withColumnRenamed("id", "_id")
    return known.join(wanted, known["id"].eqNullSafe(wanted["_id"]), "left_semi").select("id", "year")


def upsert(spark: SparkSession, path: str, incoming: DataFrame, claims: list[str] = (), at: manifest.Manifest | None = None,
           id_buckets: int | None = None) -> list[int]:
    """Merge rows into the archive; returns the years rewritten.

    Years touched = years of the incoming rows plus the years where their ids
    live now (a revision may move an event across New Year, however far). An id index beside the archive,
    bucketed by hash and sorted, knows the year of every id: only the buckets of the incoming ids are read and
    written anew. An archive without one (a first merge, or years replaced by ``write_catalog``) gets it
    with this merge, in ``id_buckets`` buckets (as many as shuffle partitions). The touched years are
    merged keep-last and written as a new generation beside the old one; one commit makes it
    the archive, notes the years as pending and retires the landing batches ``claims``. A touched year
    left without rows is removed. Another merge that published any of these years or batches first is a
    ``manifest.Conflict``, and nothing changes.
    """
    ensure_utc(spark)
    state = at or manifest.load(spark, path)
    archive = pq.read_catalog(spark, path, at=state)
    inc = incoming.withColumn("year", year_of("time"))
    ids = inc.select("id").distinct()
    if state.id_buckets:
        old_years = indexed_years(spark, path, ids, state).select("year")
    else:
        wanted = ids.withColumnRenamed("id", "_id")
        old_years = archive.join(wanted, archive["id"].eqNullSafe(wanted["_id"]), "left_semi").select("year")
    touched = _years(inc.select("year").unionByName(old_years))
    token, got, id_token, buckets, n_buckets = "", set(), "", set(), state.id_buckets or int(id_buckets or 0)
    if not n_buckets:
        n_buckets = max(ID_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if touched:
        known = [y for y in touched if y is not None]
        here = F.col("year").isin(known) | F.col("year").isNull() if None in touched else F.col("year").isin(known)
        token, got = pq.write_years(compact(archive.filter(here), inc.drop("year")), path)
        id_token, buckets = pq.write_ids(_index_rows(spark, path, archive, inc, state, n_buckets), path, n_buckets)
    folders = {_folder(y) for y in touched}

    def publish(now: manifest.Manifest) -> bool | None:
        unmerged = {b["token"] for b in now.batches}
        moved = any(now.years.get(y) != state.years.get(y) for y in folders) or any(now.ids.get(b) != state.ids.get(b) for b in buckets)
        if not set(claims) <= unmerged or moved or now.id_buckets != state.id_buckets:
            raise manifest.Conflict(f"{path}: another merge has published these years or batches")
        if not touched and not claims:
            return False
        now.put_years(token, got, folders - got)
        if touched:
            now.put_ids(id_token, buckets, n_buckets)
        for batch in claims:
            now.retire(f"landing/token={batch}")
        now.batches = [b for b in now.batches if b["token"] not in claims]
        now.pending = sorted({*now.pending, *(y for y in touched if y is not None)})
        return None

    manifest.commit(spark, path, publish)
    return [y for y in touched if y is not None]


def _index_rows(spark, path, archive: DataFrame, inc: DataFrame, state: manifest.Manifest, n_buckets: int) -> DataFrame:
    """(id, year) as the index holds them after a merge of ``inc``: of the touched buckets, or of all ids
    where there is no index yet."""
    news = latest_by_id(inc.select(*[c for c in inc.columns if c in ("id", "batch", "land_date", "row_seq", "time", "year")]))
    news = news.select(F.col("id").alias("_id"), F.col("year").alias("_year"))
    if state.id_buckets:
        touched = [r[0] for r in inc.select(pq.id_bucket(n_buckets)).distinct().collect()]
        known = pq.read_ids(spark, path, touched, at=state).select("id", "year")
    else:
        known = archive.select("id", "year")
    kept = known.join(news, known["id"].eqNullSafe(news["_id"]), "left_anti")
    return kept.unionByName(news.select(F.col("_id").alias("id"), F.col("_year").alias("year")))


def land_raw_days(spark: SparkSession, raw: DataFrame, path: str, days: DataFrame, min_mag: float, also=None) -> None:
    """Normalize the raw rows of the given days (column ``land_date``) and land them in the service's order.

    The least and greatest day are a literal range on ``land_date``, so raw files of other days are not
    opened; the join picks the days between. The service returns rows time ascending, so ``row_seq`` is the event time:
    it does not depend on how files are split into tasks, so a retried task
    ranks its rows the same way (ties fall to the row hash in ``compact``).
    """
    first, last = days.agg(F.min("land_date"), F.max("land_date")).first()
    rows = raw.withColumn("land_date", F.col("land_date").cast("date"))
    if first is not None:
        rows = rows.where(F.col("land_date").between(F.lit(first), F.lit(last)))
    rows = rows.join(days.select("land_date").distinct(), "land_date", "left_semi")
    core = normalize(rows, keep=["land_date"]).withColumn("row_seq", F.col("time"))
    core = min_magnitude(core, min_mag)
    pq.land_daily(core, path, days, also)


def _backfill(spark: SparkSession, raw: DataFrame, path: str, days: list[str], min_mag: float, sizes: DataFrame, batch_bytes: int) -> None:
    """Land the missing days range by range as the request ledger has them."""
    todo = ledger.open_ranges(spark, path, sizes, days, batch_bytes)
    while todo:
        one = todo.pop(0)
        if one["first"] != one["last"]:
            size = ledger.size_of(sizes, one) if one["bytes"] is None else one["bytes"]
            if size >= batch_bytes:
                todo = ledger.halve(spark, path, one) + todo
                continue
        here = [d for d in days if one["first"] <= d <= one["last"]]
        frame = spark.createDataFrame([(date.fromisoformat(d),) for d in here], "land_date date")
        land_raw_days(spark, raw, path, frame, min_mag, also=lambda state, one=one: ledger.mark_done(state, one))


def append_day(spark: SparkSession, raw: DataFrame, path: str, day, min_mag: float = 2.5,
               overwrite: bool = False) -> bool:
    """Land one day of raw rows; skip a day already landed unless ``overwrite``. Returns whether it ran."""
    d = day if isinstance(day, date) else date.fromisoformat(str(day))
    if not overwrite:
        landed = pq.read_landed_days(spark, path).filter(F.col("land_date") == F.lit(d.isoformat()).cast("date"))
        if landed.take(1):
            return False
    land_raw_days(spark, raw, path, spark.createDataFrame([(d,)], "land_date date"), min_mag)
    return True


def merge_landing(spark: SparkSession, path: str) -> list[int]:
    """Merge the batches landed by now into the archive; returns the years rewritten (none without landed
    rows). Batches that land during the merge stay for the next one."""
    state = manifest.load(spark, path)
    if not state.batches:
        return []
    return upsert(spark, path, pq.read_landing(spark, path, arrival=True, at=state), [b["token"] for b in state.batches], state)


def export_web(spark: SparkSession, path: str, web_path: str, touched: list[int], export_mag: float) -> list[int]:
    """Export the touched and pending years and the stored years without an export; returns them."""
    state = manifest.load(spark, path)
    archive = pq.read_catalog(spark, path, at=state)
    stored = {int(y) for y in state.years if y.lstrip("-").isdigit()}
    exported = {int(y) for y in pq._partition_values(spark, web_path, "year") if y.lstrip("-").isdigit()}
    stale = set(touched) | set(state.pending)
    years = sorted((stale & stored) | (stored - exported))
    if years:
        write_web_json(web_rows(archive.filter(F.col("year").isin(years)), export_mag, with_place=True, keep_year=True), web_path)
    # a year that lost its last row, or has none above the floor, keeps no export
    left = pq._partition_values(spark, web_path, "year")
    have = {r[0] for r in min_magnitude(archive.filter(F.col("year").isin(sorted(stale))), export_mag).select("year").distinct().collect()} if stale else set()
    for y in stale - have:
        if str(y) in left:
            pq._delete(spark, f"{web_path.rstrip('/')}/year={y}")
    return years


def sync(
    spark: SparkSession,
    raw_path: str,
    path: str,
    start=None,
    through=None,
    min_mag: float = 2.5,
    export_mag: float = 2.5,
    web_path: str | None = None,
    drop_landing: bool = True,
    hazard_path: str | None = None,
    as_of_year: int | None = None,
    batch_bytes: int = ledger.BATCH_BYTES,
) -> dict:
    """Land every missing day in ``[start, through]`` from landed CSV, merge, export.

    ``raw_path`` holds the service's CSV files under ``land_date=YYYY-MM-DD``
    folders; without ``start`` and ``through`` the span is that of its folders. Missing days are landed in ranges
    of less than ``batch_bytes`` of raw files, each with a commit of its own (``ledger``): an interrupted run repeats none. With
    ``hazard_path`` (and ``as_of_year``) the hazard grid is refitted in the same job, from the years that changed. ``drop_landing`` deletes the files that the merge before this one
    retired. Returns a small summary (days landed, years rewritten
    and exported).
    """
    ensure_utc(spark)
    if hazard_path and as_of_year is None:
        raise ValueError("as_of_year is required with hazard_path (no clock reads)")
    stored = raw_path if isinstance(raw_path, str) else None
    raw = None if stored else apply_null_markers(raw_path)
    if start is None or through is None:
        days = sorted(pq._partition_values(spark, stored, "land_date")) if stored else []
        if not days:
            raw = raw if raw is not None else read_event_csv(spark, stored)
            span = raw.agg(F.min("land_date").cast("string"), F.max("land_date").cast("string")).first()
            days = [d for d in span if d is not None]
        start, through = start or (days[0] if days else None), through or (days[-1] if days else None)
    landed_now: list[str] = []
    if start is not None and through is not None:
        todo = missing_days(pq.read_landed_days(spark, path), start, through)
        landed_now = [r[0].isoformat() for r in todo.orderBy("land_date").collect()]
        if landed_now:
            if raw is None:
                raw = read_event_csv(spark, stored, days=(landed_now[0], landed_now[-1]))
            if stored:
                sizes = ledger.raw_sizes(spark, stored)
            else:     # rows without files: their number times a usual length
                sizes = raw.select(F.col("land_date").cast("date").alias("land_date"), F.lit(RAW_ROW_BYTES).alias("bytes"))
            _backfill(spark, raw, path, landed_now, min_mag, sizes, batch_bytes)
    touched = merge_landing(spark, path)
    exported, stale = [], pq.pending_years(spark, path)
    if web_path:
        exported = export_web(spark, path, web_path, touched, export_mag)
    if hazard_path and touched:
        write_hazard(refit_hazard(spark, path, as_of_year), hazard_path)
    if web_path:
        pq.clear_pending(spark, path, stale)
    if drop_landing:
        manifest.vacuum(spark, path)
    return {"days": landed_now, "years": touched, "exported": exported}
