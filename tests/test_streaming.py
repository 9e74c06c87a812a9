from pyspark.sql import functions as F

from conftest import SF0001, rows
from tectonic.operators import dedupe
from tectonic.plans import sync as sync_plan
from tectonic.schema import CORE_COLUMNS
from tectonic.sources import csv as csv_src
from tectonic.sources import parquet as pq
from tectonic.sources.fixture import load_catalog
from tectonic.streaming import live


def _raw_files(spark, tmp_path, catalog):
    raw = str(tmp_path / "incoming")
    csv_src.write_event_csv(csv_src.raw_text_from_catalog(catalog).coalesce(1), raw, by_day=False)
    return raw


def test_stream_upsert_equals_batch_compact(spark, tmp_path):
    c = load_catalog(spark, SF0001)
    raw = str(tmp_path / "incoming")
    text = csv_src.raw_text_from_catalog(c).persist()
    days = sorted(r[0] for r in c.select("land_date").distinct().collect())
    for d in days:   # files arrive day by day; each micro-batch takes one file, later batches win
        (text.filter(F.col("land_date") == F.lit(d)).drop("land_date").coalesce(1)
         .write.mode("append").option("header", "true").csv(raw))
    path = str(tmp_path / "cat")
    stream = live.live_stream(spark, raw, max_files_per_trigger=1)
    live.start_stream_upsert(stream, path, str(tmp_path / "ck"), available_now=True).awaitTermination()
    assert pq.read_catalog(spark, path).count() == 0 and pq.read_landing(spark, path).count() == c.count()
    sync_plan.merge_landing(spark, path)
    expect = dedupe.latest_by_id(c).select(*CORE_COLUMNS)
    assert rows(pq.read_catalog(spark, path).select(*CORE_COLUMNS)) == rows(expect)


def test_stream_upsert_replay_is_idempotent(spark, tmp_path):
    c = load_catalog(spark, SF0001)
    raw = _raw_files(spark, tmp_path, c)
    path = str(tmp_path / "cat")
    for ck in ("ck1", "ck2"):   # a second run from scratch replays every batch
        live.start_stream_upsert(live.live_stream(spark, raw), path, str(tmp_path / ck),
                                 available_now=True).awaitTermination()
    sync_plan.merge_landing(spark, path)
    assert pq.read_catalog(spark, path).count() == 900


def test_live_snapshot_keeps_today(spark, tmp_path):
    c = load_catalog(spark, SF0001)
    raw = _raw_files(spark, tmp_path, c)
    now = c.agg(F.max("time")).collect()[0][0] + 1
    out = str(tmp_path / "live")
    live.start_live_snapshot(live.live_stream(spark, raw, keep_poll=True), out, str(tmp_path / "ck"), lambda: now,
                             available_now=True).awaitTermination()
    got = spark.read.parquet(out)
    midnight = now // 86_400_000 * 86_400_000
    expect = c.filter((F.col("time") >= midnight) & (F.col("time") < now)).count()
    assert got.count() == expect and expect > 0


def test_window_stats_stream_emits_closed_windows(spark, tmp_path):
    c = load_catalog(spark, SF0001)
    raw = _raw_files(spark, tmp_path, c)
    out = str(tmp_path / "w")
    s = live.stream_window_stats(live.live_stream(spark, raw), "30 days", "10 days", "1 day")
    live.start_window_stats(s, out, str(tmp_path / "ck"), available_now=True).awaitTermination()
    got = spark.read.parquet(out)
    wm = c.agg(F.max("time")).collect()[0][0] - 86_400_000
    assert got.count() > 0 and got.filter(F.col("window_end") > wm).count() == 0
    total = got.filter(F.col("window_start") % (3 * 864_000_000) == 0).agg(F.sum("n")).collect()[0][0]
    assert total <= c.count()


def test_interval_text_for_viewer_windows():
    from tectonic.schema import WINDOW_STEPS_MS
    got = {k: live.interval_text(v) for k, v in WINDOW_STEPS_MS.items()}
    assert got == {
        "1 MO": "30 days 10 hours 30 minutes", "3 MO": "91 days 7 hours 30 minutes",
        "6 MO": "182 days 15 hours", "1 YR": "365 days 6 hours",
        "5 YR": "1826 days 6 hours", "10 YR": "3652 days 12 hours",
    }
    assert live.interval_text("1 day") == "1 day"


def test_window_stats_drop_rows_behind_the_watermark(spark, tmp_path):
    from conftest import core_df

    day = 86_400_000
    raw = str(tmp_path / "in")
    batches = [
        [("a", 100 * day, 1.0, 1.0, 1.0, 5.0), ("b", 130 * day, 1.0, 1.0, 1.0, 5.0)],
        [("b2", 131 * day, 1.0, 1.0, 1.0, 5.0)],              # watermark is now 129 days
        [("late", 101 * day, 1.0, 1.0, 1.0, 9.0)],            # behind it, and its window already closed
        [("c", 200 * day, 1.0, 1.0, 1.0, 5.0)],
    ]
    for rows_ in batches:
        text = csv_src.raw_text_from_catalog(core_df(spark, rows_))
        text.coalesce(1).write.mode("append").option("header", "true").csv(raw)
    out = str(tmp_path / "w")
    s = live.stream_window_stats(live.live_stream(spark, raw, max_files_per_trigger=1), "10 days", "10 days", "1 day")
    live.start_window_stats(s, out, str(tmp_path / "ck"), available_now=True).awaitTermination()
    got = {r["window_start"] // day: (r["n"], r["max_magnitude"]) for r in spark.read.parquet(out).collect()}
    assert got[100] == (1, 5.0)          # the late 9.0 never entered its window
    assert got[130] == (2, 5.0) and 200 not in got   # the last window is still open


def test_point_stream_matches_batch_parse(spark, tmp_path):
    from tectonic.sources import geojson

    c = load_catalog(spark, SF0001)
    src = str(tmp_path / "features")
    geojson.write_geojson(c, src)
    out = str(tmp_path / "points")
    q = (live.point_stream(spark, src).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert rows(spark.read.parquet(out)) == rows(geojson.parse_geojson_points(geojson.geojson_lines(c)))


def test_live_snapshot_keeps_all_files_of_the_newest_poll(spark, tmp_path):
    import os

    from tectonic.sources import csv as csv_src

    c = load_catalog(spark, SF0001)
    now = c.agg(F.max("time")).collect()[0][0] + 1
    today = c.withColumn("time", F.lit(now - 1))
    for poll, rows_ in (("old", today.limit(50)), ("new", today.where("row_seq >= 100").repartition(4))):
        csv_src.write_event_csv(csv_src.raw_text_from_catalog(rows_), str(tmp_path / "polls" / poll), by_day=False)
    files = sorted((tmp_path / "polls").rglob("*.csv"), key=lambda f: f.parent.name, reverse=True)   # old, then new
    assert len(files) >= 5
    for i, f in enumerate(files):
        os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    out = str(tmp_path / "live")
    live.start_live_snapshot(live.live_stream(spark, str(tmp_path / "polls" / "*"), keep_poll=True), out, str(tmp_path / "ck"),
                             lambda: now, available_now=True).awaitTermination()
    assert spark.read.parquet(out).count() == today.where("row_seq >= 100").count()
