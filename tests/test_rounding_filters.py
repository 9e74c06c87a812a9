from pyspark.sql import functions as F

from conftest import core_df
from tectonic.functions.numeric import round_half_even, to_fixed
from tectonic.operators import filters
from tectonic.sources.web import web_rows


def test_half_even_on_float32(spark):
    df = spark.createDataFrame([(4.25,), (4.35,), (35.12345,)], "m float")
    got = [r[0] for r in df.select(round_half_even("m", 1)).collect()]
    assert got[:2] == [4.2, 4.3]
    assert df.select(round_half_even("m", 4)).collect()[2][0] == round(float(__import__("numpy").float32(35.12345)), 4)


def test_web_rows_null_rules(spark):
    df = core_df(spark, [("a", 1, 35.12345, -117.5, None, 4.25, "ml", None)])
    r = web_rows(df, min_mag=None).collect()[0]
    assert (r["depth_km"], r["magnitude"], r["place"]) == (0.0, 4.2, "")
    assert r["lat"] == 35.1234 or r["lat"] == 35.1235


def test_threshold_is_float(spark):
    df = core_df(spark, [("a", 1, 0.0, 0.0, 1.0, 4.6), ("b", 1, 0.0, 0.0, 1.0, 4.59)])
    assert [r["id"] for r in filters.min_magnitude(df, 4.6).collect()] == ["a"]


def test_view_filter_boundaries(spark):
    start, dur = 1_000, 500
    df = core_df(spark, [
        ("in_start", 1_000, 0.0, 0.0, 700.0, 5.0),
        ("out_end", 1_500, 0.0, 0.0, 10.0, 5.0),
        ("depth_max", 1_200, 0.0, 0.0, 700.0, 5.0),
        ("too_deep", 1_200, 0.0, 0.0, 700.5, 5.0),
        ("null_depth", 1_200, 0.0, 0.0, None, 5.0),
    ])
    got = sorted(r["id"] for r in filters.view_filter(df, start, dur, 2.5, 700).collect())
    assert got == ["depth_max", "in_start", "null_depth"]


def test_view_filter_over_new_year_prunes_years(spark):
    ny = 1_704_067_200_000   # 2024-01-01
    df = filters.with_year(core_df(spark, [("a", ny - 10, 0.0, 0.0, 1.0, 5.0), ("b", ny + 10, 0.0, 0.0, 1.0, 5.0)]))
    out = filters.view_filter(df, ny - 100, 200, 2.5, 700)
    assert sorted(r["id"] for r in out.collect()) == ["a", "b"]


def test_today_and_trailing(spark):
    day = 86_400_000
    now = 19_000 * day + 5 * 3_600_000
    df = core_df(spark, [
        ("today", 19_000 * day + 1, 0.0, 0.0, 1.0, 5.0),
        ("future", now + 1, 0.0, 0.0, 1.0, 5.0),
        ("yday", 19_000 * day - 1, 0.0, 0.0, 1.0, 5.0),
        ("old", 18_970 * day - 1, 0.0, 0.0, 1.0, 5.0),
    ])
    assert [r["id"] for r in filters.today_events(df, now).collect()] == ["today"]
    assert [r["id"] for r in filters.trailing_days(df, now, 30).collect()] == ["yday"]


def test_regional_filter_micro_toggle(spark):
    df = core_df(spark, [("micro", 1, 0.0, 0.0, 1.0, 1.5), ("none", 1, 0.0, 0.0, 1.0, None), ("big", 1, 0.0, 0.0, 1.0, 3.0)])
    assert sorted(r["id"] for r in filters.regional_filter(df, False, 0.0).collect()) == ["big"]
    assert sorted(r["id"] for r in filters.regional_filter(df, True, 0.0).collect()) == ["big", "micro", "none"]


def test_to_fixed_ties_away_from_zero(spark):
    df = spark.createDataFrame([(12.5,), (-1.25,), (0.04,), (None,)], "x double")
    got = [r[0] for r in df.select(to_fixed("x", 0), to_fixed("x", 1)).collect()]
    assert got == ["13", "-1", "0", None]
    got1 = [r[1] for r in df.select(to_fixed("x", 0), to_fixed("x", 1)).collect()]
    assert got1 == ["12.5", "-1.3", "0.0", None]


def test_unlanded_events_close_the_midnight_gap(spark):
    import datetime as dt

    day = 86_400_000
    now = 19_001 * day + 30 * 60_000          # 00:30, the nightly sync has not run yet
    df = core_df(spark, [
        ("landed", 18_999 * day + 5, 0.0, 0.0, 1.0, 5.0),
        ("yesterday", 19_000 * day + 5, 0.0, 0.0, 1.0, 5.0),
        ("today", 19_001 * day + 5, 0.0, 0.0, 1.0, 5.0),
        ("future", now + 5, 0.0, 0.0, 1.0, 5.0),
    ])
    landed = spark.createDataFrame([(dt.date(1970, 1, 1) + dt.timedelta(days=18_999), 1)], "land_date date, n long")
    got = sorted(r["id"] for r in filters.unlanded_events(df, landed, now).collect())
    assert got == ["today", "yesterday"]
    assert [r["id"] for r in filters.today_events(df, now).collect()] == ["today"]
