import datetime as dt
import time
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SF0001, core_df, rows
from tectonic.operators import dedupe
from tectonic.plans import sync as sync_plan
from tectonic.schema import CORE_COLUMNS
from tectonic.sources import csv as csv_src
from tectonic.sources import manifest, views
from tectonic.sources import parquet as pq
from tectonic.sources.fixture import load_catalog

DAY = 86_400_000
NY = 1_704_067_200_000   # 2024-01-01T00:00Z


def event(spark, id_, time, magnitude, place):
    return core_df(spark, [(id_, time, 1.0, 2.0, 3.0, magnitude, "ml", place)])


def landed(spark, id_, time, magnitude, place, day):
    return event(spark, id_, time, magnitude, place).withColumn("land_date", F.lit(day).cast("date")).withColumn("row_seq", F.lit(1).cast("long"))


def places(spark, path):
    return rows(pq.read_catalog(spark, path), "id", "place")


def test_a_later_stream_batch_wins_over_a_landed_day(spark, tmp_path):
    path = str(tmp_path / "cat")
    pq.land_daily(landed(spark, "x", NY, 4.0, "old", "2024-01-05"), path)
    assert pq.land_stream_batch(event(spark, "x", NY, 4.1, "new"), path, "q", 0)
    assert rows(views.query(spark, path, "SELECT id, place FROM events")) == [("x", "new")]
    assert sync_plan.merge_landing(spark, path) == [2024]
    assert places(spark, path) == [("x", "new")]
    # and a day landed after the stream wins over it
    assert pq.land_stream_batch(event(spark, "x", NY, 4.2, "newer"), path, "q", 1)
    pq.land_daily(landed(spark, "x", NY, 4.3, "newest", "2024-01-04"), path)
    sync_plan.merge_landing(spark, path)
    assert places(spark, path) == [("x", "newest")]


def test_a_stream_batch_of_any_number_touches_no_day(spark, tmp_path):
    path = str(tmp_path / "cat")
    pq.land_daily(landed(spark, "x", NY, 4.0, "day", "2024-01-05"), path)
    assert dt.date(1970, 1, 1) + dt.timedelta(days=19_727) == dt.date(2024, 1, 5)
    assert pq.land_stream_batch(event(spark, "y", NY, 4.1, "stream"), path, "q", 19_727)
    assert rows(pq.read_landing(spark, path), "id", "place") == [("x", "day"), ("y", "stream")]
    assert rows(pq.read_landing(spark, path, year=2024), "id") == [("x",)]
    assert [r["n"] for r in pq.read_landed_days(spark, path).collect()] == [1]


def test_a_replayed_batch_changes_nothing_even_after_its_merge(spark, tmp_path):
    path = str(tmp_path / "cat")
    first = event(spark, "x", NY, 4.0, "first")
    assert pq.land_stream_batch(first, path, "q", 3)
    assert not pq.land_stream_batch(first, path, "q", 3)
    assert pq.land_stream_batch(event(spark, "x", NY, 4.0, "second"), path, "other", 0)
    sync_plan.merge_landing(spark, path)
    assert not pq.land_stream_batch(first, path, "q", 3)
    assert sync_plan.merge_landing(spark, path) == [] and places(spark, path) == [("x", "second")]
    assert pq.land_stream_batch(first.limit(0), path, "q", 4) and manifest.load(spark, path).batches == []


def test_rows_that_land_during_a_merge_survive_it(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "cat")
    pq.land_daily(landed(spark, "x", NY, 4.0, "old", "2024-01-05"), path)
    commit = manifest.commit

    def late(*args):
        monkeypatch.setattr(manifest, "commit", commit)
        pq.land_stream_batch(event(spark, "x", NY, 4.0, "meanwhile"), path, "q", 0)
        pq.land_daily(landed(spark, "z", NY, 4.0, "next day", "2024-01-06"), path)
        return commit(*args)

    monkeypatch.setattr(manifest, "commit", late)
    sync_plan.merge_landing(spark, path)
    assert places(spark, path) == [("x", "old")]
    assert rows(pq.read_landing(spark, path), "id", "place") == [("x", "meanwhile"), ("z", "next day")]
    sync_plan.merge_landing(spark, path)
    assert places(spark, path) == [("x", "meanwhile"), ("z", "next day")]


def test_of_two_merges_the_later_one_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "cat")
    pq.land_daily(landed(spark, "x", NY, 4.0, "one", "2024-01-05"), path)
    commit = manifest.commit

    def late(*args):
        monkeypatch.setattr(manifest, "commit", commit)
        sync_plan.merge_landing(spark, path)
        return commit(*args)

    monkeypatch.setattr(manifest, "commit", late)
    with pytest.raises(manifest.Conflict):
        sync_plan.merge_landing(spark, path)
    state = manifest.load(spark, path)
    assert state.generation == 1 and places(spark, path) == [("x", "one")]


def test_relanding_a_day_replaces_it_and_a_crash_before_the_commit_does_not(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "cat")
    pq.land_daily(landed(spark, "x", NY, 4.0, "a", "2024-01-05").union(landed(spark, "y", NY, 4.0, "b", "2024-01-06")), path)

    def crash(*args):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(manifest, "commit", crash)
        with pytest.raises(RuntimeError):
            pq.land_daily(landed(spark, "w", NY, 4.0, "c", "2024-01-05"), path)
    assert rows(pq.read_landing(spark, path), "id") == [("x",), ("y",)]
    pq.land_daily(landed(spark, "w", NY, 4.0, "c", "2024-01-05"), path)
    assert rows(pq.read_landing(spark, path), "id") == [("w",), ("y",)]
    pq.drop_landing(spark, path, ["2024-01-06"])
    assert rows(pq.read_landing(spark, path), "id") == [("w",)]
    pq.drop_landing(spark, path)
    assert pq.read_landing(spark, path).count() == 0 and pq.read_landed_days(spark, path).count() == 2


@pytest.mark.parametrize("step", range(1, 5))
def test_a_sync_killed_at_any_commit_is_resumed(spark, tmp_path, monkeypatch, step):
    """Commits of a sync: landing, merge, exports done, files deleted."""
    c = load_catalog(spark, SF0001).where("land_date <= DATE'2024-01-04'")
    raw, path, web = str(tmp_path / "raw"), str(tmp_path / "cat"), str(tmp_path / "web")
    csv_src.write_event_csv(csv_src.raw_text_from_catalog(c), raw)
    pq.write_catalog(dedupe.compact(c.where("land_date <= DATE'2024-01-02'")), path)
    commit, calls = manifest.commit, []

    def crash(*args):
        calls.append(1)
        if len(calls) == step:
            raise RuntimeError("killed")
        return commit(*args)

    with monkeypatch.context() as m:
        m.setattr(manifest, "commit", crash)
        with pytest.raises(RuntimeError, match="killed"):
            sync_plan.sync(spark, raw, path, "2024-01-02", "2024-01-04", web_path=web)
    got = rows(views.query(spark, path, "SELECT id, count(*) AS n FROM events GROUP BY id"))
    assert all(n == 1 for _, n in got)            # between the runs each event is there once
    sync_plan.sync(spark, raw, path, "2024-01-02", "2024-01-04", web_path=web)
    want = rows(dedupe.latest_by_id(c).select(*CORE_COLUMNS))
    assert rows(pq.read_catalog(spark, path).select(*CORE_COLUMNS)) == want
    assert spark.read.text(web).count() == len(want) and pq.pending_years(spark, path) == set()
    assert pq.read_landing(spark, path).count() == 0 and pq.read_landed_days(spark, path).count() == 3


def test_a_reader_keeps_the_generation_it_began_with(spark, tmp_path):
    path = str(tmp_path / "cat")

    def version(place):
        pq.land_daily(landed(spark, "x", NY, 4.0, place, "2024-01-05"), path)
        sync_plan.merge_landing(spark, path)

    version("one")
    reader = pq.read_catalog(spark, path)
    reader.explain()                               # planned: its files are listed
    version("two")
    manifest.vacuum(spark, path)
    assert rows(reader, "place") == [("one",)] and rows(pq.read_catalog(spark, path), "place") == [("two",)]
    first = set(manifest.Files(spark, path).names(f"{path}/archive"))
    version("three")
    assert len(manifest.vacuum(spark, path)) >= 2
    left = {n for n in first if manifest.Files(spark, path).names(f"{path}/archive/{n}")}
    state = manifest.load(spark, path)
    assert f"token={state.years['2024']}" not in first
    assert sum(bool(manifest.Files(spark, path).names(f"{path}/archive/{n}/year=2024")) for n in left) == 1   # "two" waits for one more merge


def test_files_of_jobs_that_never_committed_go_when_old(spark, tmp_path):
    path = str(tmp_path / "cat")
    pq.land_daily(landed(spark, "x", NY, 4.0, "a", "2024-01-05"), path)
    pq.write_years(event(spark, "y", NY, 4.0, "b"), path)
    sync_plan.merge_landing(spark, path)
    now = int(time.time() * 1000)
    assert not [f for f in manifest.vacuum(spark, path, orphans_before_ms=now - DAY) if f.startswith("archive")]
    assert len([f for f in manifest.vacuum(spark, path, orphans_before_ms=now + DAY) if f.startswith("archive")]) == 1
    assert places(spark, path) == [("x", "a")]


def test_commits_of_several_writers_all_count(spark, tmp_path):
    path = str(tmp_path / "cat")

    def add(k):
        manifest.commit(spark, path, lambda state: state.streams.__setitem__(f"q{k}", k))

    with ThreadPoolExecutor(6) as pool:
        list(pool.map(add, range(30)))
    state = manifest.load(spark, path)
    assert state.streams == {f"q{k}": k for k in range(30)} and state.version == 30
    assert len(manifest.Files(spark, path).names(f"{path}/manifest")) == manifest.KEPT_VERSIONS


def test_events_without_a_time_are_kept_and_revised(spark, tmp_path):
    path = str(tmp_path / "cat")
    sync_plan.upsert(spark, path, landed(spark, "a", None, 4.0, "one", "2024-01-05").union(landed(spark, "b", NY, 4.0, "two", "2024-01-05")))
    sync_plan.upsert(spark, path, landed(spark, "c", None, 4.0, "three", "2024-01-06"))
    assert rows(pq.read_catalog(spark, path), "id", "year") == [("a", None), ("b", 2024), ("c", None)]
    assert sync_plan.upsert(spark, path, landed(spark, "a", NY, 4.0, "timed", "2024-01-07")) == [2024]
    assert rows(pq.read_catalog(spark, path), "id", "year") == [("a", 2024), ("b", 2024), ("c", None)]


def test_many_landed_day_tables_become_one(spark, tmp_path):
    path = str(tmp_path / "cat")
    for k in range(4):
        pq.land_daily(landed(spark, "x", NY, 4.0, "a", f"2024-01-0{5 + k % 2}"), path)
    pq.compact_landed_days(spark, path, most=2)
    state = manifest.load(spark, path)
    assert len(state.landed) == 1 and rows(pq.read_landed_days(spark, path), "n") == [(1,), (1,)]
    pq.land_daily(landed(spark, "x", NY, 4.0, "a", "2024-01-05").limit(0), path, spark.createDataFrame([(dt.date(2024, 1, 5),)], "land_date date"))
    assert rows(pq.read_landed_days(spark, path), "n") == [(0,), (1,)]


def test_a_one_day_sync_opens_no_other_raw_file(spark, tmp_path):
    c = load_catalog(spark, SF0001).where("land_date <= DATE'2024-01-03'")
    raw, path = str(tmp_path / "raw"), str(tmp_path / "cat")
    csv_src.write_event_csv(csv_src.raw_text_from_catalog(c), raw)
    for folder in ("2024-01-01", "2024-01-02"):     # not a catalog file: an error as soon as it is read
        (tmp_path / "raw" / f"land_date={folder}" / "x.csv").write_text("what,is,this\n1,2,3\n")
    done = sync_plan.sync(spark, raw, path, "2024-01-03", "2024-01-03")
    assert done["days"] == ["2024-01-03"]
    assert pq.read_catalog(spark, path).count() == dedupe.latest_by_id(c.where("land_date = DATE'2024-01-03'")).count()
    frame = csv_src.read_event_csv(spark, raw, days=("2024-01-03", "2024-01-03"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(land_date" in plan and "2024-01-03" in plan
    with pytest.raises(Exception, match="what|header"):
        csv_src.read_event_csv(spark, raw).collect()


def test_a_path_of_one_header_is_read_once(spark, tmp_path, monkeypatch):
    """Beside the scan itself only first lines are read."""
    c = load_catalog(spark, SF0001)
    raw = str(tmp_path / "raw")
    csv_src.write_event_csv(csv_src.raw_text_from_catalog(c).repartition(3), raw, by_day=False)
    headers = csv_src._headers(spark, raw, None)
    assert len(headers) == 1 and len(next(iter(headers.values()))) == 3
    monkeypatch.setattr(csv_src, "HEADS_ON_DRIVER", 0)                 # the same from tasks
    names = [{h: sorted(x.rsplit("/", 1)[1] for x in f) for h, f in found.items()} for found in (headers, csv_src._headers(spark, raw, None))]
    assert names[0] == names[1]
    batches = iter([pa.RecordBatch.from_arrays([pa.array(v), pa.array(["f"] * len(v))], ["value", "file"])
                    for v in ([""], [" ", "id,time", "x,y"], ["z,z"])])
    assert [b.to_pylist() for b in csv_src._first_line(batches)] == [[{"value": "id,time", "file": "f"}]]
    assert next(batches).num_rows == 1          # the rest was not asked for


def test_an_archive_without_a_manifest_is_read_but_not_written(spark, tmp_path):
    path = str(tmp_path / "cat")
    old = event(spark, "x", NY, 4.0, "a").withColumn("year", F.lit(2024))
    old.write.partitionBy("year").parquet(f"{path}/archive")
    assert places(spark, path) == [("x", "a")]
    with pytest.raises(ValueError, match="without a manifest"):
        pq.write_catalog(old, path)


def index_is_right(spark, path):
    state = manifest.load(spark, path)
    assert rows(pq.read_ids(spark, path), "id", "year") == rows(pq.read_catalog(spark, path), "id", "year")
    assert all(r["bucket"] == r["want"] for r in pq.read_ids(spark, path).select("bucket", pq.id_bucket(state.id_buckets).alias("want")).collect())


def test_the_id_index_follows_every_merge(spark, tmp_path):
    path, year = str(tmp_path / "cat"), 31_557_600_000
    first = [(f"e{k}", NY - (k % 7) * year, 0.0, 0.0, 1.0, 4.0) for k in range(60)] + [(None, NY - 3 * year, 0.0, 0.0, 1.0, 4.0)]
    sync_plan.upsert(spark, path, core_df(spark, first), id_buckets=8)
    index_is_right(spark, path)
    # revisions that change the year, one of them to no time at all, a new event, and the event without an id
    later = [("e1", NY + 366 * DAY, 0.0, 0.0, 1.0, 5.0), ("e2", None, 0.0, 0.0, 1.0, 5.0), ("new", NY, 0.0, 0.0, 1.0, 5.0), (None, NY, 0.0, 0.0, 1.0, 5.0)]
    assert {2024, 2025} <= set(sync_plan.upsert(spark, path, core_df(spark, later)))
    index_is_right(spark, path)
    assert manifest.load(spark, path).id_buckets == 8
    got = {r["id"]: r["year"] for r in pq.read_catalog(spark, path).collect()}
    assert len(got) == 62 and got["e1"] == 2025 and got["e2"] is None and got[None] == 2024 and got["new"] == 2024
    # years replaced by other means: the index starts anew
    pq.write_catalog(core_df(spark, [("x", NY, 0.0, 0.0, 1.0, 4.0)]), path)
    assert manifest.load(spark, path).id_buckets == 0
    sync_plan.upsert(spark, path, core_df(spark, [("x", NY + year, 0.0, 0.0, 1.0, 4.0)]))
    index_is_right(spark, path)


def test_old_years_come_from_few_buckets_and_no_archive_file(spark, tmp_path):
    path = str(tmp_path / "cat")
    sync_plan.upsert(spark, path, core_df(spark, [(f"e{k}", NY - k * 31_557_600_000, 0.0, 0.0, 1.0, 4.0) for k in range(40)]), id_buckets=32)
    state = manifest.load(spark, path)
    ids = spark.createDataFrame([("e5",), ("e6",), ("absent",)], "id string")
    frame = sync_plan.indexed_years(spark, path, ids, state)
    assert rows(frame) == rows(pq.read_catalog(spark, path).where("id IN ('e5', 'e6')"), "id", "year") and frame.count() == 2
    files = frame.inputFiles()
    assert files and all("/ids/token=" in f for f in files)
    assert len({f.split("bucket=")[1].split("/")[0] for f in files}) <= 3 < len(state.ids)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "/archive" not in plan
