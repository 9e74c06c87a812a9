import os
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF0001, core_df, rows
from tectonic.operators import series
from tectonic.schema import WINDOW_STEPS_MS
from tectonic.sources import csv as csv_src
from tectonic.sources.fixture import load_catalog
from tectonic.sources.web import web_rows
from tectonic.streaming import changes, live

DAY = 86_400_000
POLL = 1_700_000_040_000


def write_poll(spark, folder, events, ms, parts=1):
    df = core_df(spark, events).repartition(parts, "id")
    csv_src.write_event_csv(csv_src.raw_text_from_catalog(df), str(folder), by_day=False)
    files = sorted(f for f in folder.iterdir() if f.name.endswith(".csv"))
    for k, f in enumerate(files):
        os.utime(f, ns=((ms + k) * 1_000_000,) * 2)
    return files


def run_feed(spark, tmp_path, name, per_batch=None, gone="90 seconds"):
    stream = live.live_stream(spark, str(tmp_path / "in" / "*"), keep_poll=True, max_files_per_trigger=per_batch)
    out = str(tmp_path / name)
    changes.start_change_feed(changes.poll_changes(stream, gone, "1 second"), out, str(tmp_path / f"ck-{name}"), available_now=True).awaitTermination()
    return [(r.id, r.magnitude, r.change, (r.at_ms - POLL) // 1000) for r in spark.read.parquet(out).orderBy("at_ms", "id").collect()]


A, B, C = ("a", 1000, 1.0, 2.0, 3.0, 4.0, "ml", "p"), ("b", 2000, 1.0, 2.0, None, 4.0, None, None), (None, 3000, 1.0, 2.0, 3.0, 4.0)


@pytest.mark.parametrize("per_batch", [None, 1])
def test_new_revised_and_vanished_events(spark, tmp_path, per_batch):
    """Whatever way the files are dealt to micro-batches; a poll may have several."""
    later = (*A[:5], 4.5, *A[6:])
    polls = [[A], [A, B, C], [A, B, C], [later, B, C], [B, C], [B, C], [B, C, A], [B, C, A]]
    for k, events in enumerate(polls):
        write_poll(spark, tmp_path / "in" / f"p{k}", events, POLL + 60_000 * k, parts=2)
    got = run_feed(spark, tmp_path, "out", per_batch)
    assert got == [("a", 4.0, "new", 0), (None, 4.0, "new", 60), ("b", 4.0, "new", 60), ("a", 4.5, "revised", 180),
                   ("a", 4.5, "vanished", 270), ("a", 4.0, "new", 360)]


def test_equal_polls_emit_nothing_and_state_ends(spark, tmp_path):
    for k in range(3):
        write_poll(spark, tmp_path / "in" / f"p{k}", [A, B], POLL + 60_000 * k)
    assert [g[2] for g in run_feed(spark, tmp_path, "out", 1)] == ["new", "new"]
    write_poll(spark, tmp_path / "in" / "p9", [B], POLL + 600_000)
    # one stream goes on from its checkpoint: a has vanished, b was away for longer than gone_after too
    got = run_feed(spark, tmp_path, "out", 1)
    assert [(g[0], g[2], g[3]) for g in got[2:]] == [("a", "vanished", 210), ("b", "vanished", 210), ("b", "new", 600)]


def test_a_poll_in_two_micro_batches_stays_whole(spark, tmp_path):
    now = POLL + DAY
    today = now // DAY * DAY
    events = [(f"e{k}", today + k, 1.0, 2.0, 3.0, 4.0) for k in range(40)]
    old = write_poll(spark, tmp_path / "in" / "old", events[:5], POLL)
    new = write_poll(spark, tmp_path / "in" / "new", events[5:], POLL + 60_000, parts=4)
    assert len(old) == 1 and len(new) == 4
    out, ck = str(tmp_path / "snap"), str(tmp_path / "ck")
    stream = live.live_stream(spark, str(tmp_path / "in" / "*"), keep_poll=True, max_files_per_trigger=1)
    live.start_live_snapshot(stream, out, ck, lambda: now, available_now=True).awaitTermination()
    assert rows(live.read_live_snapshot(spark, out), "id") == sorted((e[0],) for e in events[5:])
    assert spark.read.parquet(out).count() == 35            # nothing else is left beside it
    # the next day the same snapshot holds nothing of today once a poll comes
    write_poll(spark, tmp_path / "in" / "next", events[:2], POLL + 120_000)
    live.start_live_snapshot(stream, out, ck, lambda: now + DAY, available_now=True).awaitTermination()
    assert live.read_live_snapshot(spark, out).count() == 0


def test_a_file_of_an_older_poll_changes_nothing(spark, tmp_path):
    now = POLL + DAY
    out, ck = str(tmp_path / "snap"), str(tmp_path / "ck")
    stream = live.live_stream(spark, str(tmp_path / "in" / "*"), keep_poll=True)
    write_poll(spark, tmp_path / "in" / "b", [("new", now - 1, 1.0, 2.0, 3.0, 4.0)], POLL + 60_000)
    live.start_live_snapshot(stream, out, ck, lambda: now, available_now=True).awaitTermination()
    write_poll(spark, tmp_path / "in" / "a", [("old", now - 1, 1.0, 2.0, 3.0, 4.0)], POLL)
    live.start_live_snapshot(stream, out, ck, lambda: now, available_now=True).awaitTermination()
    assert rows(live.read_live_snapshot(spark, out), "id") == [("new",)]
    with pytest.raises(FileNotFoundError):
        live.read_live_snapshot(spark, str(tmp_path / "none"))


def test_a_failed_snapshot_keeps_the_one_before(spark, tmp_path):
    now = POLL + DAY
    out, ck = str(tmp_path / "snap"), str(tmp_path / "ck")
    stream = live.live_stream(spark, str(tmp_path / "in" / "*"), keep_poll=True)
    write_poll(spark, tmp_path / "in" / "a", [("one", now - 1, 1.0, 2.0, 3.0, 4.0)], POLL)
    live.start_live_snapshot(stream, out, ck, lambda: now, available_now=True).awaitTermination()
    write_poll(spark, tmp_path / "in" / "b", [("two", now - 1, 1.0, 2.0, 3.0, 4.0)], POLL + 60_000)

    def broken():
        raise RuntimeError("no clock")

    with pytest.raises(Exception, match="no clock"):
        live.start_live_snapshot(stream, out, ck, broken, available_now=True).awaitTermination()
    assert rows(live.read_live_snapshot(spark, out), "id") == [("one",)]
    live.start_live_snapshot(stream, out, ck, lambda: now, available_now=True).awaitTermination()
    assert rows(live.read_live_snapshot(spark, out), "id") == [("two",)]


def test_streamed_windows_equal_the_batch_series(spark, tmp_path):
    """Ten years moved by a month: every closed frame with events has the values of window_series."""
    c = load_catalog(spark, SF0001)
    raw, out = str(tmp_path / "raw"), str(tmp_path / "w")
    csv_src.write_event_csv(csv_src.raw_text_from_catalog(c), raw, by_day=False)
    low, high = c.agg(F.min("time"), F.max("time")).first()
    duration, step = WINDOW_STEPS_MS["10 YR"], WINDOW_STEPS_MS["1 MO"]
    start = low - duration + 12_345
    stats = live.stream_window_stats(web_rows(live.live_stream(spark, raw), None), duration, step, "1 day", start_ms=start)
    live.start_window_stats(stats, out, str(tmp_path / "ck"), available_now=True).awaitTermination()
    names = ["n", "max_magnitude", "avg_magnitude", "avg_depth_km"]
    got = rows(spark.read.parquet(out), "window_start", *names)
    frames = series.window_series(web_rows(c, None), start, high + duration, duration, step)
    want = rows(frames.where((F.col("n") > 0) & (F.col("frame_start") + duration <= high - DAY)), "frame_start", *names)
    assert got == want and len(got) > 400


def test_means_do_not_depend_on_the_order_of_rows(spark):
    from tectonic.operators import stats

    values = [(float(k % 97) / 10, float(k % 89) / 10) for k in range(2000)] + [(0.1, 0.2)] * 7
    frame = spark.createDataFrame(values, "magnitude double, depth_km double")
    seen = {rows(stats.window_stats(frame.orderBy(F.rand(s)).repartition(7), 12, in_tenths=t))[0] for s in range(4) for t in (True,)}
    assert len(seen) == 1
    raw = spark.createDataFrame([(0.1234567 * k, 1e6 / (k + 1)) for k in range(2000)], "magnitude double, depth_km double")
    assert len({rows(stats.window_stats(raw.orderBy(F.rand(s)).repartition(7), 12))[0] for s in range(4)}) == 1


def test_spans():
    assert live.span_ms("2 days 3 hours 1 millisecond") == 2 * DAY + 3 * 3_600_000 + 1 and live.span_ms(5) == 5
    assert live.span_ms("1 week") == 7 * DAY and live.span_ms(live.interval_text(987_654_321)) == 987_654_321
    with pytest.raises(ValueError, match="month"):
        live.span_ms("1 month")


def plain_feed(polls, gone):
    """The changes of polls (time, {id: row}) event by event, with all that vanish by the last watermark."""
    known, out = {}, []
    for at, events in polls:
        for key, row in events.items():
            if key in known and at > known[key][1] + gone:
                out.append((key, known[key][0], "vanished", known[key][1] + gone))
                del known[key]
            if key not in known or known[key][0] != row:
                out.append((key, row, "revised" if key in known else "new", at))
            known[key] = (row, at)
    return out + [(k, row, "vanished", at + gone) for k, (row, at) in known.items() if at + gone <= polls[-1][0] - 1000]


@pytest.mark.parametrize("buckets", [1, 7, changes.BUCKETS])
def test_buckets_of_events_equal_a_plain_feed(spark, tmp_path, buckets):
    rng = random.Random(buckets)
    polls = []
    for k in range(6):
        ids = [i for i in [*(f"e{n}" for n in range(60)), None] if rng.random() < 0.7]
        polls.append((POLL + 60_000 * k, {i: (rng.choice([None, 1, 2]), rng.choice([1.5, 2.5, None]), rng.choice(["p", None])) for i in ids}))
        write_poll(spark, tmp_path / "in" / f"p{k}", [(i, t, 1.0, 2.0, 3.0, m, "ml", p) for i, (t, m, p) in polls[-1][1].items()], polls[-1][0])
    stream = live.live_stream(spark, str(tmp_path / "in" / "*"), keep_poll=True)
    out = str(tmp_path / "out")
    feed = changes.poll_changes(stream, "90 seconds", "1 second", buckets=buckets)
    changes.start_change_feed(feed, out, str(tmp_path / "ck"), available_now=True).awaitTermination()
    got = [(r.id, (r.time, r.magnitude, r.place), r.change, r.at_ms) for r in spark.read.parquet(out).collect()]
    assert sorted(got, key=repr) == sorted(plain_feed(polls, 90_000), key=repr)


def test_state_is_kept_by_bucket_not_by_event(spark, tmp_path):
    """A call per event and batch, each with its own trips to the state store, took minutes for 100,000 events."""
    write_poll(spark, tmp_path / "in" / "a", [(f"e{k}", k, 1.0, 2.0, 3.0, 4.0) for k in range(3000)], POLL)
    stream = live.live_stream(spark, str(tmp_path / "in" / "*"), keep_poll=True)
    out = str(tmp_path / "out")
    query = changes.start_change_feed(changes.poll_changes(stream, "90 seconds"), out, str(tmp_path / "ck"), available_now=True)
    query.awaitTermination()
    assert spark.read.parquet(out).where("change = 'new'").count() == 3000
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 4 * changes.BUCKETS
