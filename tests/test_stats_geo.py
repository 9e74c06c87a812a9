import math

from pyspark.sql import functions as F

from conftest import core_df, rows
from tectonic.functions import labels, style
from tectonic.operators import nearest, series, stats, topk
from tectonic.sources import geojson
from tectonic.sources.web import web_rows


def test_window_stats_empty(spark):
    r = stats.window_stats(web_rows(core_df(spark, []), None)).collect()[0]
    assert (r["n"], r["max_magnitude"], r["avg_magnitude"], r["avg_depth_km"]) == (0, None, None, None)


def _brute_series(events, start, end, dur, step):
    max_start = end - dur
    starts, s = [], start
    while s < max_start:
        starts.append(s)
        s += step
    starts.append(max_start)
    out = []
    for k, s in enumerate(starts):
        inside = [e for e in events if s <= e[0] < s + dur]
        n = len(inside)
        out.append((k, s, n, max((e[1] for e in inside), default=None),
                    round(sum(round(e[1] * 10) for e in inside) / n / 10, 4) if n else None))
    return out


def test_window_series_matches_brute_force(spark):
    events = [(t, 4.0 + (t % 7) / 10) for t in range(0, 1000, 13)]
    df = spark.createDataFrame([(f"e{t}", t, 0.0, 0.0, 10.0, m) for t, m in events],
                               "id string, time long, lat double, lon double, depth_km double, magnitude double")
    for dur, step in [(100, 25), (100, 30), (60, 100)]:
        got = [(r["frame"], r["frame_start"], r["n"], r["max_magnitude"], r["avg_magnitude"])
               for r in series.window_series(df, 0, 990, dur, step).orderBy("frame").collect()]
        assert got == _brute_series(events, 0, 990, dur, step), (dur, step)


def test_window_series_empty_and_clamped_frames(spark):
    df = spark.createDataFrame([("a", 5, 0.0, 0.0, 0.0, 5.0)],
                               "id string, time long, lat double, lon double, depth_km double, magnitude double")
    got = series.window_series(df, 0, 100, 30, 40).orderBy("frame").collect()
    assert [(r["frame_start"], r["n"]) for r in got] == [(0, 1), (40, 0), (70, 0)]
    assert got[1]["avg_magnitude"] is None


def test_depth_rgb_points(spark):
    df = spark.createDataFrame([(d,) for d in [0.0, 70.0, 300.0, 700.0, 900.0, -5.0, None]], "d double")
    got = [tuple(round(x, 6) for x in r[0]) for r in df.select(style.depth_rgb("d")).collect()]
    assert got[0] == (1.0, 0.25, 0.05) and got[5] == got[0] and got[6] == got[0]
    assert got[1] == (1.0, 0.6, 0.05) and got[2] == (0.35, 0.45, 0.35)
    assert got[3] == (0.1, 0.3, 1.0) and got[4] == got[3]


def test_magnitude_band_edges(spark):
    df = spark.createDataFrame([(m,) for m in [1.99, 2.0, 4.0, 5.0, 6.0, 7.0]], "m double")
    got = [r[0] for r in df.select(style.magnitude_band("m")).collect()]
    assert got == ["Micro", "Minor", "Light", "Moderate", "Strong", "Major"]
    css = df.select(style.rgb_css(style.magnitude_rgb("m"))).collect()[0][0]
    assert css == "rgb(79,194,247)"


def test_heat_threshold(spark):
    df = spark.createDataFrame([(0.01,), (0.02,), (1.0,)], "p double")
    got = df.select(style.heat_rgb("p"), style.heat_alpha("p")).collect()
    assert got[0][0] is None and got[1][0] is not None
    assert tuple(round(x, 6) for x in got[2][0]) == (0.9, 0.1, 0.05) and got[2][1] == 0.72


def test_timeline_single_event(spark):
    df = core_df(spark, [("a", 1000, 0.0, 0.0, 1.0, 3.0)])
    r = stats.timeline_ticks(df).collect()[0]
    assert r["pct"] == 0.0 and r["height"] == round(1.8 * 2 ** 2 * 2, 6)


def test_labels(spark):
    df = spark.createDataFrame([("", -12.34, -70.05, 12.5, 1_704_067_200_000)], "place string, lat double, lon double, d double, t long")
    r = df.select(labels.event_label("place", "lat", "lon"), labels.coordinate_label("lat", "lon"),
                  labels.depth_label("d", 0), labels.date_label("t")).collect()[0]
    assert r[0] == "-12.3°, -70.1°" or r[0] == "-12.3°, -70.0°"
    assert r[1] == "-12.340° S, 70.050° W"
    assert r[2] == "13 km deep" and r[3] == "Jan 1, 2024"


def test_line_segments_by_type(spark):
    df = spark.createDataFrame([
        (1, "LineString", "[[0,0],[1,1],[2,2]]"),
        (2, "MultiLineString", "[[[0,0],[1,0]],[[5,5],[6,6],[7,7]]]"),
        (3, "Point", "[0,0]"),
        (4, "LineString", "[[9,9]]"),
    ], "feature int, type string, coordinates string")
    got = rows(geojson.line_segments(df, keys=["feature"]), "feature", "line_idx", "seg_idx", "lon1", "lat2")
    assert got == [(1, 0, 0, 0.0, 1.0), (1, 0, 1, 1.0, 2.0), (2, 0, 0, 0.0, 0.0), (2, 1, 0, 5.0, 6.0), (2, 1, 1, 6.0, 7.0)]
    assert geojson.polyline_segments(geojson.fault_lines(spark)).count() == 6 + 2 + 2 + 2 + 3


def test_geojson_points_defaults(spark, tmp_path):
    p = tmp_path / "fc.json"
    p.write_text('{"type":"FeatureCollection","features":['
                 '{"geometry":{"coordinates":[-117,35,5]},"properties":{"mag":null,"time":2,"place":null}},'
                 '{"geometry":{"coordinates":[-118,36,7]},"properties":{"mag":3.5,"time":1,"place":"x"}}]}')
    got = [tuple(r) for r in geojson.read_geojson_points(spark, str(p)).collect()]
    assert got == [(-118.0, 36.0, 7.0, 3.5, 1, "x"), (-117.0, 35.0, 5.0, 0.0, 2, "Unknown")]


def test_nearest_event_rules(spark):
    bounds = {"min_lat": 0.0, "max_lat": 100.0, "min_lon": 0.0, "max_lon": 100.0}
    ev = core_df(spark, [("late", 20, 50.0, 25.0, 1.0, 5.0), ("early", 10, 50.0, 75.0, 1.0, 5.0),
                         ("far", 5, 90.0, 90.0, 1.0, 1.0)])
    probes = spark.createDataFrame([(50.0, 50.0), (5.0, 5.0)], "px double, py double")
    got = {(r["px"], r["py"]): r["id"] for r in nearest.nearest_event(probes, ev, bounds, 100, 100).collect()}
    assert got == {(50.0, 50.0): "early", (5.0, 5.0): None}


def test_freshness_cutoff(spark):
    df = core_df(spark, [(f"e{i:03d}", i, 0.0, 0.0, 1.0, 3.0) for i in range(60)])
    f = {r["id"]: r["freshness"] for r in topk.freshness(df).collect()}
    assert f["e059"] == 0.975 and abs(f["e021"] - 0.025) < 1e-12 and f["e020"] == 0.0
    assert len(f) == 60


def test_significant_ties_keep_time_order(spark):
    df = core_df(spark, [("b", 2, 0.0, 0.0, 1.0, 5.0), ("a", 1, 0.0, 0.0, 1.0, 5.0), ("c", 3, 0.0, 0.0, 1.0, 6.0),
                         ("d", 0, 0.0, 0.0, 1.0, 2.9)])
    assert [r["id"] for r in topk.significant(df, 3.0, 12).collect()] == ["c", "a", "b"]


def test_regional_stats_over_raw_points(spark, tmp_path):
    p = tmp_path / "fc.json"
    p.write_text('{"features":[{"geometry":{"coordinates":[-117,35,5]},"properties":{"mag":null,"time":2}},'
                 '{"geometry":{"coordinates":[-118,36,7]},"properties":{"mag":3.0,"time":1}}]}')
    r = stats.window_stats(geojson.read_geojson_points(spark, str(p)), mag="mag", depth="depth").collect()[0]
    assert (r["n"], r["max_magnitude"], r["avg_magnitude"], r["avg_depth_km"]) == (2, 3.0, 1.5, 6.0)


def test_view_progress(spark):
    start, length = style.view_bounds("recent", 10 * 31_557_600_000)
    df = spark.createDataFrame([(start - 5,), (start + length // 2,), (start + 2 * length,)], "w long")
    assert [r[0] for r in df.select(style.view_progress("w", start, length)).collect()] == [0.0, 0.5, 1.0]


def test_append_day_skips_landed(spark, tmp_path):
    from tectonic.plans import sync as sync_plan
    from tectonic.sources import csv as csv_src
    from tectonic.sources import parquet as pq
    from tectonic.sources.fixture import load_catalog
    from conftest import SF0001

    raw_path = str(tmp_path / "raw")
    csv_src.write_event_csv(csv_src.raw_text_from_catalog(load_catalog(spark, SF0001)), raw_path)
    raw = csv_src.read_event_csv(spark, raw_path)
    path = str(tmp_path / "cat")
    assert sync_plan.append_day(spark, raw, path, "2024-01-05") is True
    n = pq.read_landing(spark, path).count()
    assert n > 0 and sync_plan.append_day(spark, raw, path, "2024-01-05") is False
    assert sync_plan.append_day(spark, raw, path, "2024-01-05", overwrite=True) is True
    assert pq.read_landing(spark, path).count() == n


def test_polyline_query_joins_all_rows_of_a_block(spark):
    from conftest import SF0001
    from tectonic.sources.fixture import load_catalog
    from tectonic.suite import QUERIES

    lines = {}
    for seq, lon, lat in sorted(tuple(r) for r in load_catalog(spark, SF0001).select("row_seq", "lon", "lat").collect()):
        lines.setdefault(seq // 8, []).append((lon, lat))
    want = [(line, i, *a, *b) for line, p in lines.items() for i, (a, b) in enumerate(zip(p, p[1:], strict=False))]
    assert rows(QUERIES["polyline_segments"](spark, SF0001), "line_id", "seg_idx", "lon1", "lat1", "lon2", "lat2") == sorted(want)
