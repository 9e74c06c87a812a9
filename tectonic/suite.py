"""The registered catalog queries: each takes ``(spark, sf_dir)`` and returns a DataFrame.

Every query reads the driver's ``events`` table through the catalog mapping
(``sources.fixture``), so its work grows with the table. Parameters that the
reference takes from the clock (now, the current year) are fixed here.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geo as geo_fn
from .functions import labels as label_fn
from .functions import style as style_fn
from .functions.numeric import round_half_even as rnd
from .operators import dedupe, filters, hazard, nearest, series, stats, topk
from .plans import calendar, splits
from .plans import sync as sync_plan
from .plans import view
from .schema import DAY_MS, WINDOW_STEPS_MS, YEAR_MS
from .session import scratch_path
from .sources import csv as csv_src
from .sources import geojson, hazard_io, views, web
from .sources import parquet as pq
from .sources.manifest import Files
from .sources.fixture import load_catalog
from .streaming import changes, live

# Fixed query parameters (the reference reads these from the clock or the UI).
AS_OF_YEAR = 2026
NOW_MS = 1_714_586_400_000          # 2024-05-01T18:00:00Z
VIEW_START_MS = 1_709_251_200_000   # 2024-03-01T00:00:00Z
VIEW_DURATION_MS = 7_889_400_000    # 3 MO = YEAR_MS / 4
VIEW_MIN_MAG = 4.5
VIEW_MAX_DEPTH = 300.0

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def dates_as_text(df: DataFrame) -> DataFrame:
    """Registered outputs carry dates as ISO text, so any client compares them the same way."""
    dates = {f.name for f in df.schema.fields if f.dataType.typeName() == "date"}
    if not dates:
        return df
    return df.select(*[F.col(c).cast("string").alias(c) if c in dates else F.col(c) for c in df.columns])


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: dates_as_text(fn(spark, sf_dir))
        return fn
    return deco


# ---- phase 1: schema and hazard -------------------------------------------------

@register("normalize")
def q_normalize(spark, sf_dir):
    raw = csv_src.apply_null_markers(csv_src.raw_text_from_catalog(load_catalog(spark, sf_dir)))
    return csv_src.normalize(raw)


def _cells(spark, sf_dir):
    return hazard.hazard_cells(load_catalog(spark, sf_dir), as_of_year=AS_OF_YEAR)


@register("hazard_cells")
def q_hazard_cells(spark, sf_dir):
    return _cells(spark, sf_dir)


@register("hazard_surface")
def q_hazard_surface(spark, sf_dir):
    return hazard.hazard_surface(_cells(spark, sf_dir))


@register("hazard_raster")
def q_hazard_raster(spark, sf_dir):
    surface = hazard.hazard_surface(_cells(spark, sf_dir), [hazard.DEFAULT_SCENARIO])
    return hazard.hazard_raster(surface, [hazard.DEFAULT_SCENARIO])


# ---- phase 2: filters, stats, top-k, SQL ------------------------------------------


SPLIT_LAND_DATE = "2024-01-15"   # rows landed before it form the archive, the rest the landing area


VIEW = (VIEW_START_MS, VIEW_DURATION_MS, VIEW_MIN_MAG, VIEW_MAX_DEPTH)


def _view_rows(spark, sf_dir):
    return view.view_rows(load_catalog(spark, sf_dir), *VIEW)


@register("min_magnitude")
def q_min_magnitude(spark, sf_dir):
    return filters.min_magnitude(load_catalog(spark, sf_dir), 4.6)


@register("view_filter")
def q_view_filter(spark, sf_dir):
    return _view_rows(spark, sf_dir)


@register("bbox")
def q_bbox(spark, sf_dir):
    return filters.bbox(load_catalog(spark, sf_dir), -30.0, 45.0, -90.0, 90.0)


@register("event_range")
def q_event_range(spark, sf_dir):
    # 2000-01-01 .. 2010-01-01
    return filters.event_range(load_catalog(spark, sf_dir), 946_684_800_000, 1_262_304_000_000, 4.5)


@register("regional_filter")
def q_regional_filter(spark, sf_dir):
    return filters.regional_filter(load_catalog(spark, sf_dir), show_micro=False, min_mag=4.6)


@register("trailing_days")
def q_trailing_days(spark, sf_dir):
    return filters.trailing_days(load_catalog(spark, sf_dir), NOW_MS, 30)


@register("today_events")
def q_today_events(spark, sf_dir):
    return filters.today_events(load_catalog(spark, sf_dir), NOW_MS)


@register("facing")
def q_facing(spark, sf_dir):
    return filters.facing(load_catalog(spark, sf_dir))


@register("window_stats")
def q_window_stats(spark, sf_dir):
    return stats.window_stats(_view_rows(spark, sf_dir), in_tenths=True)


@register("yearly_counts")
def q_yearly_counts(spark, sf_dir):
    return stats.yearly_counts(load_catalog(spark, sf_dir))


@register("visible_recent")
def q_visible_recent(spark, sf_dir):
    return topk.visible_recent(_view_rows(spark, sf_dir))


# Fixed value: a projection x view matrix (16 numbers, column order) of a 50-degree camera at (0, 0, 3),
# near plane 0.1 and far plane 100.
CAMERA_MATRIX = (2.144506920509559, 0.0, 0.0, 0.0, 0.0, 2.144506920509559, 0.0, 0.0,
                 0.0, 0.0, -1.002002002002002, -1.0, 0.0, 0.0, 2.8058058058058056, 3.0)
FRUSTUM_CAMERA = (0.0, 0.0, 3.0)


@register("visible_frustum")
def q_visible_frustum(spark, sf_dir):
    rows = web.web_rows(load_catalog(spark, sf_dir), min_mag=4.5)
    zoomed = tuple(v * (2.5 if i in (0, 5) else 1.0) for i, v in enumerate(CAMERA_MATRIX))
    return filters.in_frustum(filters.facing(rows, FRUSTUM_CAMERA), zoomed)


@register("significant")
def q_significant(spark, sf_dir):
    return topk.significant(load_catalog(spark, sf_dir), 3.1, 12)


@register("playhead")
def q_playhead(spark, sf_dir):
    return topk.playhead(load_catalog(spark, sf_dir), 50)


@register("freshness")
def q_freshness(spark, sf_dir):
    return topk.freshness(load_catalog(spark, sf_dir))


@register("timeline_ticks")
def q_timeline_ticks(spark, sf_dir):
    return stats.timeline_ticks(load_catalog(spark, sf_dir))


def _stored(spark, sf_dir):
    """A stored catalog: rows landed early merged into the archive, later ones in the landing area."""
    path = _scratch(spark, "stored")
    c = load_catalog(spark, sf_dir)
    early = F.col("land_date") < F.lit(SPLIT_LAND_DATE).cast("date")
    pq.write_catalog(dedupe.compact(c.filter(early)), path)
    pq.land_daily(c.filter(~early), path)
    return path


def _sql(text):
    def run(spark, sf_dir):
        return views.query(spark, _stored(spark, sf_dir), text)
    return run


# The documented ad-hoc queries (ties broken by time and id where it limits).
SQL_TEXT = {
    "sql_count": "SELECT COUNT(*) AS n FROM events",
    "sql_top_magnitude": "SELECT * FROM events WHERE magnitude >= 8.0 ORDER BY magnitude DESC, time, id LIMIT 20",
    "sql_yearly": "SELECT year(epoch_ms(time)) yr, COUNT(*) n FROM events GROUP BY yr ORDER BY yr",
    "sql_region": "SELECT * FROM events WHERE magnitude >= 5.0 AND lat BETWEEN 32 AND 49 "
                  "AND lon BETWEEN -125 AND -114 ORDER BY time, id LIMIT 20",
    "sql_count_all": "SELECT COUNT(*) AS n FROM events_all",
    # pruned by the year partition and a pushed magnitude
    "sql_stored_archive": "SELECT * FROM events WHERE year BETWEEN 1995 AND 2004 AND magnitude >= 4.75",
}
for _k, _t in SQL_TEXT.items():
    QUERIES[_k] = _sql(_t)


# ---- phase 3: dedupe and request planning ----------------------------------------


PLAN_START, PLAN_THROUGH = "2023-12-25", "2024-02-05"
LANDED_UNTIL_MS = 1_714_003_200_000   # 2024-04-25T00:00:00Z
CORE = ["id", "time", "lat", "lon", "depth_km", "magnitude", "mag_type", "place"]
SPLIT_START_MS, SPLIT_END_MS = 473_385_600_000, 1_735_689_600_000   # 1985-01-01 .. 2025-01-01
SPLIT_MAX_ROWS = 1000


@register("moving_view")
def q_moving_view(spark, sf_dir):
    path = _scratch(spark, "moving")
    c = load_catalog(spark, sf_dir)
    midnight = filters.utc_midnight(NOW_MS)
    pq.write_catalog(c.filter(F.col("time") < midnight), path)
    live_rows = filters.today_events(c, NOW_MS).select(*CORE)
    return view.moving_view(pq.read_catalog(spark, path), live_rows, *VIEW)


@register("year_pruning")
def q_year_pruning(spark, sf_dir):
    path = _scratch(spark, "pruned")
    pq.write_catalog(load_catalog(spark, sf_dir), path)
    return filters.event_range(pq.read_catalog(spark, path), 946_684_800_000, 978_307_200_000, 4.5)   # 2000


@register("view_progress")
def q_view_progress(spark, sf_dir):
    rows = load_catalog(spark, sf_dir)
    at = style_fn.view_progress("time", SPLIT_START_MS, SPLIT_END_MS - SPLIT_START_MS)
    return rows.select("id", "time", rnd(at, 9).alias("progress"))


def _archive_and_landing(spark, sf_dir):
    c = load_catalog(spark, sf_dir)
    early = F.col("land_date") < F.lit(SPLIT_LAND_DATE).cast("date")
    return dedupe.compact(c.filter(early)), c.filter(~early)


@register("latest_by_id")
def q_latest_by_id(spark, sf_dir):
    return dedupe.latest_by_id(load_catalog(spark, sf_dir))


@register("compact")
def q_compact(spark, sf_dir):
    archive, landing = _archive_and_landing(spark, sf_dir)
    return dedupe.compact(archive, landing)


@register("with_live")
def q_with_live(spark, sf_dir):
    c = load_catalog(spark, sf_dir)
    midnight = filters.utc_midnight(NOW_MS)
    archive = web.web_rows(filters.time_between(c, 1_704_067_200_000, midnight), min_mag=2.5)  # 2024 so far
    live = web.web_rows(filters.today_events(c, NOW_MS), min_mag=2.5)
    return dedupe.with_live(archive, live)


@register("unlanded_events")
def q_unlanded_events(spark, sf_dir):
    # the archive holds every UTC day with an event before 2024-04-25; live is the rest up to now
    c = load_catalog(spark, sf_dir)
    landed = c.filter(F.col("time") < F.lit(LANDED_UNTIL_MS)).select(
        F.to_date(F.timestamp_millis("time")).alias("land_date")).distinct()
    return filters.unlanded_events(c, landed, NOW_MS, since_ms=1_704_067_200_000).select(*CORE)


@register("missing_years")
def q_missing_years(spark, sf_dir):
    return calendar.missing_years(load_catalog(spark, sf_dir), 1900, AS_OF_YEAR - 1)


@register("missing_days")
def q_missing_days(spark, sf_dir):
    landed = calendar.landed_days_of(load_catalog(spark, sf_dir))
    return calendar.missing_days(landed, PLAN_START, PLAN_THROUGH)


@register("plan_requests")
def q_plan_requests(spark, sf_dir):
    landed = calendar.landed_days_of(load_catalog(spark, sf_dir))
    return calendar.plan_requests(landed, PLAN_START, PLAN_THROUGH)


@register("size_bounded_splits")
def q_size_bounded_splits(spark, sf_dir):
    return splits.size_bounded_splits(load_catalog(spark, sf_dir), SPLIT_START_MS, SPLIT_END_MS, SPLIT_MAX_ROWS)


# ---- phase 4: exports, geometry, display scalars ---------------------------------


CANVAS_HEIGHT = 800.0


@register("web_rows")
def q_web_rows(spark, sf_dir):
    return web.web_rows(load_catalog(spark, sf_dir), min_mag=4.0, with_place=True)


@register("web_rows_5")
def q_web_rows_5(spark, sf_dir):
    return web.web_rows(load_catalog(spark, sf_dir), min_mag=4.0, with_place=False)


@register("read_web_json")
def q_read_web_json(spark, sf_dir):
    path = _scratch(spark, "web")
    web.write_web_json(web.web_rows(load_catalog(spark, sf_dir), min_mag=4.0, keep_year=True), path)
    return web.read_web_json(spark, path)


@register("geojson_features")
def q_geojson_features(spark, sf_dir):
    f = geojson.geojson_features(load_catalog(spark, sf_dir)).select("feature")
    return f.select(
        F.col("feature.properties.id").alias("id"), F.col("feature.properties.time").alias("time"),
        F.col("feature.type").alias("feature_type"), F.col("feature.geometry.type").alias("geometry_type"),
        F.element_at("feature.geometry.coordinates", 1).alias("coord_lon"),
        F.element_at("feature.geometry.coordinates", 2).alias("coord_lat"),
        F.element_at("feature.geometry.coordinates", 3).alias("coord_z"),
        F.col("feature.properties.magnitude").alias("magnitude"),
        F.col("feature.properties.mag_type").alias("mag_type"),
        F.col("feature.properties.depth_km").alias("depth_km"),
        F.col("feature.properties.place").alias("place"),
    )


@register("geojson_points")
def q_geojson_points(spark, sf_dir):
    path = _scratch(spark, "points")
    geojson.write_geojson(load_catalog(spark, sf_dir), path)
    return geojson.read_geojson_lines(spark, path)


@register("regional_chain")
def q_regional_chain(spark, sf_dir):
    """The regional page: file, points, toggle, then each event's tick and freshness with the nearest and the page's statistics."""
    path = _scratch(spark, "regional")
    geojson.write_geojson(load_catalog(spark, sf_dir), path)
    points = geojson.read_geojson_lines(spark, path)
    whole = stats.window_stats(points, mag="mag", depth="depth").agg(F.struct(F.first("n").alias("n"), F.first("max_magnitude").alias("m")).alias("s")).scalar()
    rows = filters.regional_filter(geojson.regional_events(points), min_mag=4.6)
    ticks = stats.timeline_ticks(rows).select("time", "magnitude", "pct", "height", "color")
    top = topk.significant(rows, 4.6, 12).select("time", "lat", "lon")
    px, py = geo_fn.project_box("lat", "lon", WORLD, WORLD_W, WORLD_H)
    hover = nearest.nearest_event(top.select((px + 3.0).alias("px"), (py - 2.0).alias("py")).distinct(), rows, WORLD, WORLD_W, WORLD_H)
    fresh = topk.freshness(rows).where("freshness > 0")
    kinds = [
        ticks.agg(F.lit("ticks").alias("part"), F.count(F.lit(1)).alias("n"), rnd(F.sum("pct"), 3).alias("a"), rnd(F.sum("height"), 3).alias("b")),
        top.agg(F.lit("significant").alias("part"), F.count(F.lit(1)).alias("n"), F.sum("lat").alias("a"), F.sum("lon").alias("b")),
        hover.agg(F.lit("nearest").alias("part"), F.count("time").alias("n"), rnd(F.sum("dist"), 3).alias("a"), rnd(F.max("dist"), 3).alias("b")),
        fresh.agg(F.lit("fresh").alias("part"), F.count(F.lit(1)).alias("n"), rnd(F.sum("freshness"), 6).alias("a"), F.max("freshness").alias("b")),
        rows.agg(F.lit("rows").alias("part"), F.count(F.lit(1)).alias("n"), whole["n"].cast("double").alias("a"), whole["m"].alias("b")),
    ]
    out = kinds[0]
    for k in kinds[1:]:
        out = out.unionByName(k)
    return out


@register("line_segments")
def q_line_segments(spark, sf_dir):
    # one feature per line, as large sets are written
    path = _scratch(spark, "lines")
    geojson.event_geometry_text(load_catalog(spark, sf_dir)).write.json(path)
    geoms = spark.read.schema("feature long, type string, coordinates string").json(path)
    return geojson.line_segments(geoms, keys=["feature"])


@register("polyline_segments")
def q_polyline_segments(spark, sf_dir):
    """Tracks of eight consecutive rows in arrival order (blocks of ``row_seq``), as polylines."""
    c = load_catalog(spark, sf_dir)
    track = c.groupBy(F.expr("row_seq div 8").alias("line_id")).agg(F.sort_array(F.collect_list(
        F.struct("row_seq", F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat")))).alias("p"))
    return geojson.polyline_segments(track.select("line_id", F.transform("p", lambda p: F.struct(p["lon"], p["lat"])).alias("points")))


@register("to_cartesian")
def q_to_cartesian(spark, sf_dir):
    c = load_catalog(spark, sf_dir)
    x, y, z = geo_fn.cartesian_xyz("lat", "lon", F.coalesce(F.col("depth_km"), F.lit(0.0)))
    return c.select("id", "time", rnd(x, 9).alias("x"), rnd(y, 9).alias("y"), rnd(z, 9).alias("z"))


@register("depth_line")
def q_depth_line(spark, sf_dir):
    rows = web.web_rows(load_catalog(spark, sf_dir), min_mag=None)
    sx, sy, sz = geo_fn.cartesian_xyz("lat", "lon", None)
    hx, hy, hz = geo_fn.cartesian_xyz("lat", "lon", geo_fn.visual_depth_km("depth_km"))
    rgb = style_fn.depth_rgb("depth_km")
    return rows.select(
        "time",
        *[rnd(v, 9).alias(n) for v, n in ((sx, "sx"), (sy, "sy"), (sz, "sz"), (hx, "hx"), (hy, "hy"), (hz, "hz"))],
        *[rnd(rgb[ch] * F.lit(0.3), 9).alias(f"surface_{ch}") for ch in "rgb"],
        *[rnd(rgb[ch], 9).alias(f"hypo_{ch}") for ch in "rgb"],
    )


@register("magnitude_band")
def q_magnitude_band(spark, sf_dir):
    rows = web.web_rows(load_catalog(spark, sf_dir), min_mag=None)
    rgb = style_fn.magnitude_rgb("magnitude")
    return rows.select(
        "time", "magnitude", style_fn.magnitude_band("magnitude").alias("band"),
        rgb["r"].alias("r"), rgb["g"].alias("g"), rgb["b"].alias("b"),
        style_fn.magnitude_hex("magnitude").alias("hex"),
        style_fn.rgb_css(rgb).alias("css"),
    )


@register("depth_rgb")
def q_depth_rgb(spark, sf_dir):
    c = load_catalog(spark, sf_dir)
    rgb = style_fn.depth_rgb("depth_km")
    return c.select("id", "depth_km", *[rnd(rgb[ch], 9).alias(ch) for ch in "rgb"], style_fn.rgb_css(rgb).alias("css"))


@register("depth_band")
def q_depth_band(spark, sf_dir):
    return load_catalog(spark, sf_dir).select("id", "depth_km", style_fn.depth_band("depth_km").alias("band"))


@register("point_size")
def q_point_size(spark, sf_dir):
    return load_catalog(spark, sf_dir).select(
        "id", "magnitude",
        rnd(style_fn.point_size("magnitude"), 9).alias("size"),
        rnd(style_fn.mag_radius("magnitude"), 9).alias("radius"),
    )


@register("window_age")
def q_window_age(spark, sf_dir):
    rows = _view_rows(spark, sf_dir)
    age = style_fn.window_age("time", VIEW_START_MS, VIEW_START_MS + VIEW_DURATION_MS)
    return rows.select("time", "magnitude", rnd(age, 9).alias("age"), rnd(style_fn.age_fade(age), 9).alias("fade"))


@register("heat_rgb")
def q_heat_rgb(spark, sf_dir):
    s = hazard.hazard_surface(_cells(spark, sf_dir))
    rgb = style_fn.heat_rgb("p")
    return s.select(
        "lat", "lon", "threshold", "horizon", "p",
        *[rnd(rgb[ch], 9).alias(ch) for ch in "rgb"],
        rnd(style_fn.heat_alpha("p"), 9).alias("alpha"),
    )


@register("depth_bar")
def q_depth_bar(spark, sf_dir):
    return load_catalog(spark, sf_dir).select("id", "depth_km", rnd(style_fn.depth_bar("depth_km", CANVAS_HEIGHT), 9).alias("bar"))


@register("event_label")
def q_event_label(spark, sf_dir):
    rows = web.web_rows(load_catalog(spark, sf_dir), min_mag=None)
    return rows.select(
        "time",
        label_fn.event_label("place", "lat", "lon").alias("label"),
        label_fn.coordinate_label("lat", "lon").alias("coordinates"),
        label_fn.depth_label("depth_km", 0).alias("depth_list"),
        label_fn.depth_label("depth_km", 1).alias("depth_detail"),
        F.concat(F.lit("M"), label_fn.to_fixed("magnitude", 1)).alias("mag_label"),
    )


@register("time_label")
def q_time_label(spark, sf_dir):
    return load_catalog(spark, sf_dir).select("id", "time", label_fn.time_label("time").alias("clock"))


@register("exact_label")
def q_exact_label(spark, sf_dir):
    """Coordinates with four decimals, as real rows have them: three-decimal labels meet halves."""
    c = load_catalog(spark, sf_dir).select("row_seq", (F.col("lat").cast("double") + (F.col("row_seq") % 9973) / F.lit(10000.0)).alias("lat"))
    return c.select("row_seq", "lat", label_fn.to_fixed("lat", 3).alias("three"), label_fn.to_fixed("lat", 1).alias("one"),
                    label_fn.to_fixed("lat", 0).alias("zero"))


@register("date_label")
def q_date_label(spark, sf_dir):
    return load_catalog(spark, sf_dir).select("id", "time", label_fn.date_label("time").alias("date"))


# ---- phase 5: moving windows and nearest lookup ------------------------------------


SERIES_START_MS = 631_152_000_000        # 1990-01-01
SERIES_END_MS = 1_717_200_000_000        # 2024-06-01 (data end)
WORLD = {"min_lat": -90.0, "max_lat": 90.0, "min_lon": -180.0, "max_lon": 180.0}
WORLD_W, WORLD_H = 7200.0, 3600.0


@register("window_series")
def q_window_series(spark, sf_dir):
    rows = web.web_rows(load_catalog(spark, sf_dir), min_mag=4.4).where("magnitude >= 4.5")   # rounded, then filtered
    return series.window_series(rows, SERIES_START_MS, SERIES_END_MS, YEAR_MS, YEAR_MS // 4)


def probe_points(catalog):
    """One probe per distinct epicentre, offset by 0.5 + 0.4*(lat mod 3) degrees east and 0.6 south."""
    locs = catalog.select("lat", "lon").distinct()
    plat = F.col("lat").cast("double") - F.lit(0.6)
    plon = F.col("lon").cast("double") + F.lit(0.5) + F.pmod(F.col("lat").cast("double"), F.lit(3.0)) * F.lit(0.4)
    px, py = geo_fn.project_box(plat, plon, WORLD, WORLD_W, WORLD_H)
    return locs.select(px.alias("px"), py.alias("py"))


@register("nearest_event")
def q_nearest_event(spark, sf_dir):
    c = load_catalog(spark, sf_dir)
    return nearest.nearest_event(probe_points(c), c, WORLD, WORLD_W, WORLD_H)


# ---- phase 6: storage round trips, sync, streams -----------------------------------
# These write to a fresh folder under the shared checkpoint location and return
# what Spark reads back, so the check covers the sink and the scan together.



SNAPSHOT_NOW_MS = 1_714_564_800_000     # 2024-05-01T12:00:00Z
GONE_BEFORE_MS = 946_684_800_000          # 2000-01-01T00:00Z
PLAYBACK_START_MS = 473_428_800_000      # 1985-01-01T12:00Z
STREAM_WINDOW = ("30 days", "10 days", "1 day")


def _scratch(spark, name):
    return scratch_path(spark, f"tectonic-{name}-{uuid.uuid4().hex}")


def _documents(features, column, path):
    """FeatureCollection files of up to 1000 features each, on one line, with a member object before them."""
    doc = F.concat(F.lit('{"type":"FeatureCollection","metadata":{"title":"}{\\""},"features":['),
                   F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row_seq", column))), lambda f: f[column]), ","), F.lit("]}"))
    docs = features.groupBy(F.expr("row_seq div 1000").alias("doc")).agg(doc.alias("value"))
    docs.write.partitionBy("doc").option("maxRecordsPerFile", 1).text(path)


@register("read_borders")
def q_read_borders(spark, sf_dir):
    """Line documents written and read back in pieces."""
    path = _scratch(spark, "borders")
    lines = geojson.event_geometry_text(load_catalog(spark, sf_dir)).withColumnRenamed("feature", "row_seq")
    text = F.concat(F.lit('{"type":"Feature","geometry":{"type":"'), "type", F.lit('","coordinates":'), "coordinates", F.lit("}}"))
    _documents(lines.select("row_seq", text.alias("feature")), "feature", path)
    return geojson.read_line_segments(spark, path).drop("file")


@register("read_points")
def q_read_points(spark, sf_dir):
    """Point documents written and read back in pieces."""
    path = _scratch(spark, "points")
    c = load_catalog(spark, sf_dir)
    lines = geojson.geojson_lines(c.withColumn("place", F.concat(F.coalesce("place", F.lit("")), F.lit(' }{ "x" \\ ]'))))
    _documents(lines.withColumn("row_seq", F.monotonically_increasing_id()).withColumnRenamed("value", "feature"), "feature", path)
    return geojson.read_geojson_points(spark, path)


@register("bbox_stored")
def q_bbox_stored(spark, sf_dir):
    """A box of an archive sorted along a space-filling curve."""
    path = _scratch(spark, "space")
    pq.write_catalog(load_catalog(spark, sf_dir), path, layout="space")
    return view.box_rows(spark, path, -30.0, 45.0, -90.0, 90.0)


@register("playhead_half")
def q_playhead_half(spark, sf_dir):
    """The first half of all events: too many for a top-k in one task."""
    c = load_catalog(spark, sf_dir).select(*CORE)
    return topk.playhead(c, c.count() // 2, take_most=100)


@register("write_catalog")
def q_write_catalog(spark, sf_dir):
    path = _scratch(spark, "catalog")
    archive, landing = _archive_and_landing(spark, sf_dir)
    pq.write_catalog(dedupe.compact(archive, landing), path)
    return pq.read_catalog(spark, path)


@register("land_daily")
def q_land_daily(spark, sf_dir):
    path = _scratch(spark, "landing")
    c = load_catalog(spark, sf_dir)
    pq.land_daily(c, path, calendar.day_calendar(spark, PLAN_START, PLAN_THROUGH))
    return pq.read_landed_days(spark, path)


@register("read_landing")
def q_read_landing(spark, sf_dir):
    path = _scratch(spark, "landing")
    pq.land_daily(load_catalog(spark, sf_dir), path)
    return pq.read_landing(spark, path)


@register("read_hazard")
def q_read_hazard(spark, sf_dir):
    path = _scratch(spark, "hazard")
    hazard_io.write_hazard(_cells(spark, sf_dir), path)
    return hazard_io.read_hazard(spark, path)


@register("hazard_document")
def q_hazard_document(spark, sf_dir):
    path = _scratch(spark, "hazard-doc")
    hazard_io.write_hazard_document(_cells(spark, sf_dir), path)
    return hazard_io.read_hazard_document(spark, path)


def _raw_csv(spark, sf_dir, by_day=True):
    """The landed CSV input rendered from ``events`` (the catalog service's files)."""
    path = _scratch(spark, "raw")
    csv_src.write_event_csv(csv_src.raw_text_from_catalog(load_catalog(spark, sf_dir)), path, by_day=by_day)
    return path


@register("read_csv")
def q_read_csv(spark, sf_dir):
    """Files of two column orders and quoted places, read by name."""
    path = _scratch(spark, "two-headers")
    raw = csv_src.raw_text_from_catalog(load_catalog(spark, sf_dir)).withColumn(
        "place", F.when(F.col("place") == "null", F.col("place")).otherwise(F.concat(F.lit('7 km NW of "'), F.col("place"), F.lit('", CA'))))
    cols = [c for c in raw.columns if c not in ("land_date", "row_seq")]
    for k, order in enumerate((cols, cols[::-1])):
        (raw.where(F.col("row_seq") % 2 == k).select(*order).write.option("header", "true").option("emptyValue", "")
         .option("escape", '"').csv(f"{path}/{k}"))
    return csv_src.normalize(csv_src.read_event_csv(spark, [f"{path}/0", f"{path}/1"]))


@register("sync")
def q_sync(spark, sf_dir):
    raw = _raw_csv(spark, sf_dir)
    path = _scratch(spark, "sync")
    sync_plan.sync(spark, raw, path, min_mag=2.5, export_mag=4.0, web_path=path + "/web")
    return pq.read_catalog(spark, path)


@register("append_then_sync")
def q_append_then_sync(spark, sf_dir):
    """Every day landed by itself; a sync with nothing missing merges and exports all of it."""
    raw_path = _raw_csv(spark, sf_dir)
    path = _scratch(spark, "appended")
    raw = csv_src.read_event_csv(spark, raw_path)
    for day in sorted(pq._partition_values(spark, raw_path, "land_date"))[:3]:
        sync_plan.append_day(spark, raw, path, day)
    rest = calendar.day_calendar(spark, *_day_span(spark, raw_path)).join(pq.read_landed_days(spark, path), "land_date", "left_anti")
    sync_plan.land_raw_days(spark, raw, path, rest, 2.5)
    sync_plan.sync(spark, raw_path, path, export_mag=4.0, web_path=path + "/web")
    return web.read_web_json(spark, path + "/web")


def _day_span(spark, raw_path):
    days = sorted(pq._partition_values(spark, raw_path, "land_date"))
    return days[0], days[-1]


@register("reland_empty_day")
def q_reland_empty_day(spark, sf_dir):
    """All days landed, then the first one again without rows: its rows and count go."""
    path = _scratch(spark, "reland")
    c = load_catalog(spark, sf_dir)
    pq.land_daily(c, path)
    first = c.agg(F.min("land_date").alias("land_date"))
    pq.land_daily(c.limit(0), path, first)
    counts = pq.read_landing(spark, path).groupBy("land_date").agg(F.count(F.lit(1)).alias("rows"))
    return pq.read_landed_days(spark, path).join(counts, "land_date", "left").select(
        "land_date", "n", F.coalesce("rows", F.lit(0).cast("long")).alias("rows"))


@register("live_stream")
def q_live_stream(spark, sf_dir):
    raw = _raw_csv(spark, sf_dir, by_day=False)
    out, ck = _scratch(spark, "live"), _scratch(spark, "ck")
    q = (live.live_stream(spark, raw).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", ck).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out)


@register("stream_upsert")
def q_stream_upsert(spark, sf_dir):
    raw = _raw_csv(spark, sf_dir, by_day=False)
    path, ck = _scratch(spark, "archive"), _scratch(spark, "ck")
    live.start_stream_upsert(live.live_stream(spark, raw), path, ck, available_now=True).awaitTermination()
    sync_plan.merge_landing(spark, path)
    return pq.read_catalog(spark, path)


@register("stream_revises_landed")
def q_stream_revises_landed(spark, sf_dir):
    """All days landed, then a stream of revisions of the early ones; the merge keeps what came last."""
    c = load_catalog(spark, sf_dir)
    path, ck, raw = _scratch(spark, "revised"), _scratch(spark, "ck"), _scratch(spark, "raw")
    pq.land_daily(c, path)
    early = c.where(F.col("land_date") < F.lit(SPLIT_LAND_DATE).cast("date"))
    revised = early.withColumn("magnitude", F.col("magnitude") + F.lit(1.0).cast("float")).withColumn("place", F.lit("revised"))
    csv_src.write_event_csv(csv_src.raw_text_from_catalog(revised), raw, by_day=False)
    live.start_stream_upsert(live.live_stream(spark, raw), path, ck, available_now=True).awaitTermination()
    sync_plan.merge_landing(spark, path)
    return pq.read_catalog(spark, path)


def _set_poll_time(spark, folder, ms):
    """Give the files of a written poll the time of its poll."""
    files = Files(spark, folder)
    for name in files.names(folder):
        if name.startswith("part-"):
            files.fs.setTimes(files.path(f"{folder}/{name}"), ms, -1)


@register("poll_changes")
def q_poll_changes(spark, sf_dir):
    """Five polls a minute apart: early versions, all of them, the same again, then without the events before 2000."""
    c = load_catalog(spark, sf_dir)
    first = dedupe.latest_by_id(c.where(F.col("land_date") < F.lit(SPLIT_LAND_DATE).cast("date")))
    every = dedupe.latest_by_id(c)
    rest = every.where(F.col("time") >= GONE_BEFORE_MS)
    polls, out, ck = _scratch(spark, "polls"), _scratch(spark, "changes"), _scratch(spark, "ck")
    for k, poll in enumerate((first, every, every, rest, rest)):
        csv_src.write_event_csv(csv_src.raw_text_from_catalog(poll), f"{polls}/poll-{k}", by_day=False)
        _set_poll_time(spark, f"{polls}/poll-{k}", SNAPSHOT_NOW_MS + k * 60_000)
    stream = live.live_stream(spark, f"{polls}/*", keep_poll=True)
    changes.start_change_feed(changes.poll_changes(stream, "90 seconds", "1 second"), out, ck, available_now=True).awaitTermination()
    return spark.read.parquet(out)


@register("live_snapshot")
def q_live_snapshot(spark, sf_dir):
    """Three polls: an early one, a later one with newer events, one without any of today."""
    day = filters.utc_midnight(SNAPSHOT_NOW_MS)
    c = load_catalog(spark, sf_dir).withColumn("time", F.lit(day) + F.pmod(F.col("time"), F.lit(DAY_MS)))
    polls, path, ck = _scratch(spark, "polls"), _scratch(spark, "snapshot"), _scratch(spark, "ck")
    results = []
    for k, now in enumerate((SNAPSHOT_NOW_MS, SNAPSHOT_NOW_MS + 6 * 3_600_000, SNAPSHOT_NOW_MS + 7 * 3_600_000)):
        poll = c.where(F.col("time") < now) if k < 2 else c.withColumn("time", F.col("time") - DAY_MS)
        csv_src.write_event_csv(csv_src.raw_text_from_catalog(poll), f"{polls}/poll-{k}", by_day=False)
        stream = live.live_stream(spark, f"{polls}/*", keep_poll=True)
        live.start_live_snapshot(stream, path, ck, lambda now=now: now, available_now=True).awaitTermination()
        kept = _scratch(spark, f"poll-{k}")
        live.read_live_snapshot(spark, path).select("id", "time").write.parquet(kept)
        results.append(spark.read.parquet(kept).withColumn("poll", F.lit(k)))
    return results[0].unionByName(results[1]).unionByName(results[2])


@register("stream_playback")
def q_stream_playback(spark, sf_dir):
    """The viewer's longest window, ten years, moved by a month at a time over the stream."""
    raw = _raw_csv(spark, sf_dir, by_day=False)
    out, ck = _scratch(spark, "playback"), _scratch(spark, "ck")
    rows = web.web_rows(live.live_stream(spark, raw), min_mag=None)
    stats_df = live.stream_window_stats(rows, WINDOW_STEPS_MS["10 YR"], WINDOW_STEPS_MS["1 MO"], "1 day", start_ms=PLAYBACK_START_MS)
    live.start_window_stats(stats_df, out, ck, available_now=True).awaitTermination()
    return spark.read.parquet(out)


@register("stream_window_stats")
def q_stream_window_stats(spark, sf_dir):
    raw = _raw_csv(spark, sf_dir, by_day=False)
    out, ck = _scratch(spark, "windows"), _scratch(spark, "ck")
    rows = web.web_rows(live.live_stream(spark, raw), min_mag=None)
    stats_df = live.stream_window_stats(rows, *STREAM_WINDOW)
    live.start_window_stats(stats_df, out, ck, available_now=True).awaitTermination()
    return spark.read.parquet(out)
