"""Rules that whole-degree fixtures do not show: exact decimals, thresholds, positions, grids, frontiers."""

import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from conftest import SF0001, core_df, rows
from tectonic.functions.labels import time_label
from tectonic.functions.numeric import to_fixed
from tectonic.operators import filters, hazard, nearest, stats, topk
from tectonic.sources import csv as csv_src
from tectonic.sources import geojson
from tectonic.sources.fixture import load_catalog

T0 = 1_704_067_200_000


def test_to_fixed_rounds_the_exact_decimal_value(spark):
    rng = random.Random(1)
    values = [round(rng.uniform(-180, 180), 4) for _ in range(20_000)] + [0.5, -0.5, 0.25, 0.125, 0.0625, 1e9 + 0.5, -0.0001, 38.0145, 1.005]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (0, 1, 3):
        for r in df.select("x", to_fixed("x", digits).alias("t")).collect():
            exact = Decimal(abs(r.x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)
            assert r.t == ("-" if r.x < 0 else "") + f"{exact:f}", (r.x, digits)


def test_thresholds_are_compared_in_the_columns_type(spark):
    df = core_df(spark, [("a", T0, 32.5, -114.1, 1.0, 4.6), ("b", T0, 42.0, -124.5, 1.0, 3.1), ("c", T0, 40.0, -114.0, 1.0, 4.5)])
    assert rows(filters.regional_filter(df, min_mag=4.6), "id") == [("a",)]
    assert rows(topk.significant(df, 3.1), "id") == [("a",), ("b",), ("c",)]
    assert rows(filters.regional_bbox(df), "id") == [("a",), ("b",)]


def test_freshness_counts_positions(spark):
    df = core_df(spark, [("x", T0, 0.0, 0.0, 1.0, 4.0)] * 3 + [("w", T0 - 1, 0.0, 0.0, 1.0, 4.0)])
    assert [r[2] for r in rows(topk.freshness(df))] == pytest.approx([0.9, 0.925, 0.95, 0.975])
    crowd = core_df(spark, [("x", T0, 0.0, 0.0, 1.0, 4.0)] * 60 + [("w", T0 - 1, 0.0, 0.0, 1.0, 4.0)])
    got = [r["freshness"] for r in topk.freshness(crowd).collect()]
    assert len(got) == 61 and sum(f > 0 for f in got) == 39 and sum(got) == pytest.approx(19.5)
    assert topk.freshness(df.limit(0)).count() == 0


def test_raster_has_the_cells_of_any_grid(spark):
    c = load_catalog(spark, SF0001)
    for grid, n in ((2, 16_200), (0.5, 259_200), (5, 2_592)):
        cells = hazard.hazard_cells(c, 2026, grid_deg=grid, min_events=2)
        raster = hazard.hazard_raster(hazard.hazard_surface(cells, [(6.5, 30)]), [(6.5, 30)], grid_deg=grid)
        assert raster.count() == n and raster.filter("p > 0").count() == cells.count()


def test_catalog_years_follow_the_span(spark):
    c = load_catalog(spark, SF0001)
    cells = hazard.hazard_cells(c, 2026, start_ms=946_684_800_000, end_ms=1_262_304_000_000, min_events=1)
    assert {r["catalog_years"] for r in cells.collect()} <= {10}


def test_frustum_and_time_label(spark):
    df = core_df(spark, [("front", T0, 0.0, 90.0, 0.0, 4.0), ("edge", T0, 60.0, 90.0, 0.0, 4.0), ("back", T0, 0.0, -90.0, 0.0, 4.0)])
    narrow = (10.0, 0, 0, 0, 0, 10.0, 0, 0, 0, 0, -1.002, -1.0, 0, 0, 2.8, 3.0)   # camera at z = 3, about 11 degrees wide
    at = {r["id"]: (round(r["x"], 6), round(r["y"], 6), round(r["z"], 6)) for r in
          df.select("id", F.inline(F.array(__import__("tectonic.functions.geo", fromlist=["x"]).to_cartesian("lat", "lon")))).collect()}
    front = max(at, key=lambda k: at[k][2])
    assert rows(filters.in_frustum(filters.facing(df, (0.0, 0.0, 3.0)), narrow), "id") == [(front,)]
    assert filters.in_frustum(df, (0.0,) * 16).count() == 3
    assert df.limit(1).select(time_label(F.lit(T0 + 47_109_000))).first()[0] == "01:05:09 PM UTC"
    assert df.limit(1).select(time_label(F.lit(T0))).first()[0] == "12:00:00 AM UTC"


def test_one_place_with_many_events_gives_few_pairs(spark):
    many = spark.range(100_000).select(
        F.concat(F.lit("e"), F.col("id")).alias("id"), (F.lit(T0) + F.xxhash64("id") % 10**9).alias("time"),
        F.lit(10.0).cast("float").alias("lat"), F.lit(20.0).cast("float").alias("lon"),
        (F.lit(4.0) + F.pmod(F.xxhash64("id", F.lit(1)), F.lit(10**6)) / 2e5).cast("float").alias("magnitude"))
    world = {"min_lat": -90.0, "max_lat": 90.0, "min_lon": -180.0, "max_lon": 180.0}
    left = nearest.frontier(nearest.event_pixels(many, world, 3600, 1800))
    assert left.count() < 60
    x, y = 2000.0, 800.0
    probes = spark.createDataFrame([(x + d, y) for d in (0.0, 3.0, 15.0, 60.0, 400.0)], "px double, py double")
    got = {r["px"]: r["id"] for r in nearest.nearest_event(probes, many, world, 3600, 1800).collect()}
    reach = {r["id"]: (r["reach"], r["time"]) for r in nearest.event_pixels(many, world, 3600, 1800).select("event.*", "reach").collect()}
    for px, found in got.items():
        inside = [(t, i) for i, (far, t) in reach.items() if abs(px - x) < far]
        assert found == (min(inside)[1] if inside else None)


def test_regional_operators_take_regional_points(spark, tmp_path):
    path = str(tmp_path / "points")
    geojson.write_geojson(load_catalog(spark, SF0001), path)
    points = geojson.read_geojson_lines(spark, path)
    events = filters.regional_filter(geojson.regional_events(points), min_mag=4.6)
    assert stats.timeline_ticks(events).count() == topk.freshness(events).count() == events.count() > 0
    assert topk.significant(events, 3.0).count() == 12
    box = {"min_lat": -90.0, "max_lat": 90.0, "min_lon": -180.0, "max_lon": 180.0}
    near = nearest.nearest_event(spark.createDataFrame([(10.0, 10.0)], "px double, py double"), events, box, 720, 360)
    assert near.count() == 1 and "place" in near.columns


def test_csv_by_name_with_doubled_quotes(spark, tmp_path):
    path = tmp_path / "in"
    path.mkdir()
    (path / "a.csv").write_text('time,latitude,longitude,depth,mag,magType,id,place\n'
                                '2024-01-01T00:00:00.000Z,38.1,-122.2,1,2.5,md,x,"7 km NW of ""The Geysers"", CA"\n')
    (path / "b.csv").write_text('id,longitude,latitude,time,mag,depth,magType,place\ny,-122.3,38.2,2024-01-01T00:00:01.000Z,2.6,null,md,\n')
    got = rows(csv_src.normalize(csv_src.read_event_csv(spark, str(path))), "id", "lat", "lon", "place", "depth_km")
    assert [(r[0], round(r[1], 3), round(r[2], 3), r[3], r[4]) for r in got] == [
        ("x", 38.1, -122.2, '7 km NW of "The Geysers", CA', 1.0), ("y", 38.2, -122.3, None, None)]


def test_csv_file_with_an_unknown_header_is_an_error(spark, tmp_path):
    texts = ("time,id,latitude\n2024-01-01T00:00:00.000Z,a,1\n", "id,time,latitude\nb,2024-01-01T00:00:00.000Z,2\n", "", "\n")
    for i, text in enumerate(texts):
        (tmp_path / f"{i}.csv").write_text(text)
    assert rows(csv_src.read_event_csv(spark, str(tmp_path)), "id") == [("a",), ("b",)]
    (tmp_path / "9.csv").write_text("id, time,latitude\nc,2024-01-01T00:00:00.000Z,3\n")
    with pytest.raises(ValueError, match="9.csv"):
        csv_src.read_event_csv(spark, str(tmp_path))
