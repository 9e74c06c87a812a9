import random

import pytest
from pyspark.sql import functions as F

from conftest import SF0001, core_df, rows
from tectonic.operators import dedupe, hazard
from tectonic.plans import ledger, refit
from tectonic.plans import sync as sync_plan
from tectonic.schema import CORE_COLUMNS
from tectonic.sources import csv as csv_src
from tectonic.sources import manifest
from tectonic.sources import parquet as pq
from tectonic.sources.fixture import load_catalog

YEAR = 31_557_600_000
NY = 1_704_067_200_000   # 2024-01-01T00:00Z


def events(seed, n=600, years=5):
    rng = random.Random(seed)
    return [(f"e{k}", NY - rng.randrange(years) * YEAR - rng.randrange(10**9), rng.choice([10.0, 11.5, -3.0]), rng.choice([20.0, 77.0]), 5.0,
             round(rng.uniform(4.0, 7.0), 2)) for k in range(n)]


def same_as_full_fit(spark, path):
    full = hazard.hazard_cells(pq.read_catalog(spark, path), 2026)
    got = refit.refit_hazard(spark, path, 2026)
    assert rows(got) == rows(full) and got.columns == full.columns
    return rows(got)


def test_a_refit_reads_the_changed_years_only(spark, tmp_path):
    path = str(tmp_path / "cat")
    first = events(1)
    sync_plan.upsert(spark, path, core_df(spark, first))
    assert len(same_as_full_fit(spark, path)) > 3
    assert refit.refresh_sums(spark, path) == []
    # a merge into one year; another that moves an event from one year to another
    moved = next(e for e in first if 2019 <= 1970 + e[1] / YEAR < 2020)
    touched = sync_plan.upsert(spark, path, core_df(spark, [("new", NY - 10**9, 10.0, 20.0, 5.0, 6.5)]))
    assert len(touched) == 1
    assert refit.refresh_sums(spark, path) == touched
    same_as_full_fit(spark, path)
    touched = sync_plan.upsert(spark, path, core_df(spark, [(moved[0], NY + 10**9, *moved[2:])]))
    assert len(touched) == 2 and refit.refresh_sums(spark, path) == sorted(touched)
    same_as_full_fit(spark, path)


def test_a_year_that_ends_empty_and_other_parameters(spark, tmp_path):
    path = str(tmp_path / "cat")
    sync_plan.upsert(spark, path, core_df(spark, events(2) + [("only", NY - 20 * YEAR, 10.0, 20.0, 5.0, 6.0), ("old", NY - 60 * YEAR, 10.0, 20.0, 5.0, 6.0)]))
    same_as_full_fit(spark, path)
    sync_plan.upsert(spark, path, core_df(spark, [("only", NY - YEAR, 10.0, 20.0, 5.0, 6.0)]))
    same_as_full_fit(spark, path)
    state = manifest.load(spark, path)
    assert set(state.hazard["years"]) == {y for y in state.years if int(y) >= 1990}
    one = refit.refit_hazard(spark, path, 2026, mc=5.0, min_events=3)
    assert rows(one) == rows(hazard.hazard_cells(pq.read_catalog(spark, path), 2026, mc=5.0, min_events=3))
    manifest.vacuum(spark, path)
    same_as_full_fit(spark, path)


def test_an_empty_archive_has_no_cells(spark, tmp_path):
    assert refit.refit_hazard(spark, str(tmp_path / "cat"), 2026).collect() == []


def raw_files(spark, tmp_path, through="2024-01-08"):
    c = load_catalog(spark, SF0001).where(F.col("land_date") <= F.lit(through).cast("date"))
    raw = str(tmp_path / "raw")
    csv_src.write_event_csv(csv_src.raw_text_from_catalog(c), raw)
    return c, raw


def day_bytes(tmp_path):
    out = {}
    for f in (tmp_path / "raw").rglob("*.csv"):
        day = f.parent.name.split("=")[1]
        out[day] = out.get(day, 0) + f.stat().st_size
    return out


def test_ranges_cover_the_days_below_the_limit(spark, tmp_path):
    _, raw = raw_files(spark, tmp_path)
    sizes, per_day = ledger.raw_sizes(spark, raw), day_bytes(tmp_path)
    day = max(per_day.values())
    for limit in (day // 2, day * 2, day * 5, 10**12):
        got = ledger.plan_ranges(sizes, "2024-01-01", "2024-01-10", limit)
        days = [d for r in got for d in sorted(per_day) if r["first"] <= d <= r["last"]]
        assert days == sorted(per_day) and got[0]["first"] == "2024-01-01" and got[-1]["last"] == "2024-01-10"
        for r in got:
            n = sum(n for d, n in per_day.items() if r["first"] <= d <= r["last"])
            assert r["bytes"] == n and (n < limit or r["first"] == r["last"])
    assert len(ledger.plan_ranges(sizes, "2024-01-01", "2024-01-10", 10**12)) == 1


def test_an_interrupted_backfill_repeats_no_finished_range(spark, tmp_path, monkeypatch):
    c, raw = raw_files(spark, tmp_path)
    path, limit = str(tmp_path / "cat"), 2 * max(day_bytes(tmp_path).values())
    commit, calls = manifest.commit, []

    def crash(*args):
        calls.append(1)
        if len(calls) == 4:            # the plan, two ranges, then
            raise RuntimeError("killed")
        return commit(*args)

    with monkeypatch.context() as m:
        m.setattr(manifest, "commit", crash)
        with pytest.raises(RuntimeError, match="killed"):
            sync_plan.sync(spark, raw, path, batch_bytes=limit)
    state = manifest.load(spark, path)
    done, left = ([r for r in state.requests if r["done"] is flag] for flag in (True, False))
    assert len(done) == 2 and len(left) >= 2 and len(state.batches) == 2
    assert pq.read_landing(spark, path).count() == c.where(F.col("land_date") <= F.lit(done[-1]["last"]).cast("date")).count()
    for r in done:                      # files of finished ranges would fail if they were read
        (tmp_path / "raw" / f"land_date={r['first']}" / "x.csv").write_text("what,is,this\n1,2,3\n")
    sync_plan.sync(spark, raw, path, batch_bytes=limit)
    assert all(r["done"] for r in manifest.load(spark, path).requests)
    assert rows(pq.read_catalog(spark, path).select(*CORE_COLUMNS)) == rows(dedupe.latest_by_id(c).select(*CORE_COLUMNS))


def test_a_range_that_has_grown_is_halved(spark, tmp_path):
    c, raw = raw_files(spark, tmp_path, "2024-01-04")
    path, limit = str(tmp_path / "cat"), 2 * max(day_bytes(tmp_path).values())
    sizes, days = ledger.raw_sizes(spark, raw), ["2024-01-01", "2024-01-02", "2024-01-03", "2024-01-04"]
    assert len(ledger.open_ranges(spark, path, sizes, days, 10**12)) == 1
    sync_plan._backfill(spark, csv_src.read_event_csv(spark, raw), path, days, 2.5, sizes, limit)      # the limit is lower now
    state = manifest.load(spark, path)
    assert len(state.requests) >= 2 and all(r["done"] for r in state.requests) and len(state.batches) == len(state.requests)
    assert pq.read_landing(spark, path).count() == c.count() and pq.read_landed_days(spark, path).count() == 4


def test_rows_without_files_are_planned_too(spark, tmp_path):
    c, raw = raw_files(spark, tmp_path, "2024-01-04")
    frame = csv_src.read_event_csv(spark, raw)
    sync_plan.sync(spark, frame, str(tmp_path / "cat"), batch_bytes=70 * sync_plan.RAW_ROW_BYTES)
    assert rows(pq.read_catalog(spark, str(tmp_path / "cat")).select(*CORE_COLUMNS)) == rows(dedupe.latest_by_id(c).select(*CORE_COLUMNS))
    assert len(manifest.load(spark, str(tmp_path / "cat")).requests) >= 2
