"""GeoJSON: point features out, point and line features in.

Lines differ in nesting per feature (``LineString`` is an array of points,
``MultiLineString`` an array of those), so ``coordinates`` is kept as text and
parsed by ``type``; parsing with the wrong nesting does not give null but
``[[null, null]]``, hence the branch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .json_blocks import read_features

# Fault traces of the regional page, [lon, lat] pairs.
FAULTS = [
    ("San Andreas", [(-124.1, 40.5), (-122.5, 38.0), (-121.5, 36.9), (-120.5, 35.8), (-119.5, 34.5), (-117.8, 33.9), (-116.5, 33.2)]),
    ("Hayward", [(-122.3, 37.8), (-122.0, 37.5), (-121.8, 37.2)]),
    ("Calaveras", [(-121.8, 37.5), (-121.5, 37.0), (-121.3, 36.7)]),
    ("Elsinore", [(-117.8, 33.7), (-117.2, 33.2), (-116.5, 32.7)]),
    ("Garlock", [(-119.5, 35.3), (-118.5, 35.0), (-117.8, 34.8), (-117.0, 34.8)]),
]

POINT_PROPERTIES = T.StructType([
    T.StructField("mag", T.DoubleType()),
    T.StructField("magnitude", T.DoubleType()),
    T.StructField("time", T.LongType()),
    T.StructField("place", T.StringType()),
])
POINT_FEATURE = T.StructType([
    T.StructField("geometry", T.StructType([T.StructField("coordinates", T.ArrayType(T.DoubleType()))])),
    T.StructField("properties", POINT_PROPERTIES),
])

LINE_FEATURE = T.StructType([
    T.StructField("geometry", T.StructType([
        T.StructField("type", T.StringType()),
        T.StructField("coordinates", T.StringType()),
    ])),
])


def _surface_offset(depth) -> Column:
    """``-(depth or 0)``: zero or missing depth gives 0 (never -0.0)."""
    d = F.col(depth).cast("double") if isinstance(depth, str) else depth
    return F.when(F.coalesce(d, F.lit(0.0)) == 0, F.lit(0.0)).otherwise(-d)


def geojson_features(df: DataFrame) -> DataFrame:
    """One ``feature`` struct per event: Point ``[lon, lat, -(depth or 0)]`` and six properties.

    Floats are widened to double, as the exported JSON carries them.
    """
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(
            F.lit("Point").alias("type"),
            F.array(F.col("lon").cast("double"), F.col("lat").cast("double"), _surface_offset("depth_km")).alias("coordinates"),
        ).alias("geometry"),
        F.struct(
            F.col("id"), F.col("time"),
            F.col("magnitude").cast("double").alias("magnitude"),
            F.col("mag_type"),
            F.col("depth_km").cast("double").alias("depth_km"),
            F.col("place"),
        ).alias("properties"),
    )
    return df.select(feature.alias("feature"))


def geojson_lines(df: DataFrame) -> DataFrame:
    """Newline-delimited feature text (``value``), ready for ``write.text``."""
    return geojson_features(df).select(F.to_json("feature").alias("value"))


def write_geojson(df: DataFrame, path: str) -> None:
    geojson_lines(df).write.mode("overwrite").text(path)


# time ascending; the other columns only break ties (and spread a hot millisecond)
POINT_ORDER = ["time", "lon", "lat", "depth", "mag", "place"]


def _points(features: Column) -> list[Column]:
    coords = features["geometry"]["coordinates"]
    props = features["properties"]
    mag = F.coalesce(props["mag"], props["magnitude"])
    place = props["place"]
    return [
        F.element_at(coords, 1).alias("lon"),
        F.element_at(coords, 2).alias("lat"),
        F.element_at(coords, 3).alias("depth"),
        F.when(mag.isNull() | F.isnan(mag) | (mag == 0), F.lit(0.0)).otherwise(mag).alias("mag"),
        props["time"].alias("time"),
        F.when(place.isNull() | (place == ""), F.lit("Unknown")).otherwise(place).alias("place"),
    ]


def geojson_point_rows(lines: DataFrame, column: str = "value") -> DataFrame:
    """Feature-per-line text -> regional points (no ordering; usable on a stream)."""
    return lines.select(*_points(F.from_json(F.col(column), POINT_FEATURE)))


def parse_geojson_points(lines: DataFrame, column: str = "value") -> DataFrame:
    """Feature-per-line text -> regional points, time ascending."""
    return geojson_point_rows(lines, column).orderBy(*POINT_ORDER)


def read_geojson_points(spark: SparkSession, path: str) -> DataFrame:
    """FeatureCollection documents -> points (``lon, lat, depth, mag, time, place``), time ascending.

    A document is read by several tasks, whatever its size and line breaks (``json_blocks``).
    Missing magnitude reads as 0 and missing place as ``Unknown``, as the regional page does.
    """
    return parse_geojson_points(read_features(spark, path))


def regional_events(points: DataFrame) -> DataFrame:
    """Regional points under the catalog's names, as the regional operators read them (no ``id``)."""
    return points.select("time", "lat", "lon", F.col("depth").alias("depth_km"), F.col("mag").alias("magnitude"), "place")


def read_geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    """Feature-per-line files -> regional points, time ascending: files are split over tasks at any size."""
    return parse_geojson_points(spark.read.text(path))


def line_segments(df: DataFrame, type_col: str = "type", coords_col: str = "coordinates",
                  keys: list[str] | None = None, multi_fallback: bool = False) -> DataFrame:
    """Consecutive point pairs of every line.

    ``LineString`` gives its pairs, ``MultiLineString`` the pairs of each part; any
    other type gives none, or (``multi_fallback``, the coastline reader) is read
    as multi. Output: keys, ``line_idx``, ``seg_idx``, ``lon1, lat1, lon2, lat2``.
    """
    keys = keys or []
    t, c = F.col(type_col), F.col(coords_col)
    single = F.array(F.from_json(c, "array<array<double>>"))
    multi = F.from_json(c, "array<array<array<double>>>")
    other = multi if multi_fallback else F.array().cast("array<array<array<double>>>")
    lines = F.when(t == "LineString", single).when(t == "MultiLineString", multi).otherwise(other)
    exploded = df.select(*keys, F.posexplode(F.coalesce(lines, F.array().cast("array<array<array<double>>>"))).alias("line_idx", "line"))
    n = F.size("line")
    pairs = F.when(n >= 2, F.arrays_zip(F.slice("line", 1, n - 1).alias("a"), F.slice("line", 2, n - 1).alias("b")))
    segs = exploded.select(*keys, "line_idx", F.posexplode(F.coalesce(pairs, F.array().cast("array<struct<a:array<double>,b:array<double>>>"))).alias("seg_idx", "p"))
    return segs.select(
        *keys, "line_idx", "seg_idx",
        F.element_at("p.a", 1).alias("lon1"), F.element_at("p.a", 2).alias("lat1"),
        F.element_at("p.b", 1).alias("lon2"), F.element_at("p.b", 2).alias("lat2"),
    )


def read_line_segments(spark: SparkSession, path: str, multi_fallback: bool = False) -> DataFrame:
    """Border / coastline FeatureCollection files -> segments (file and feature position as keys), a document
    read by several tasks."""
    feats = read_features(spark, path).select(
        F.element_at(F.split("file", "/"), -1).alias("file"), "feature", F.from_json("value", LINE_FEATURE).alias("f")).select(
        "file", "feature", F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("coordinates"))
    return line_segments(feats, keys=["file", "feature"], multi_fallback=multi_fallback)


def polyline_segments(df: DataFrame, key: str = "line_id", points: str = "points") -> DataFrame:
    """Consecutive point pairs of ``(key, array<struct<lon, lat>>)`` polylines, ``line_idx`` 0."""
    p = F.col(points)
    n = F.coalesce(F.size(p), F.lit(0))
    pairs = F.when(n >= 2, F.arrays_zip(F.slice(p, 1, n - 1).alias("a"), F.slice(p, 2, n - 1).alias("b")))
    segs = df.select(key, F.posexplode(pairs).alias("seg_idx", "p"))
    ends = [F.col(f"p.{s}.{c}").cast("double").alias(f"{c}{i}") for i, s in ((1, "a"), (2, "b")) for c in ("lon", "lat")]
    return segs.select(key, F.lit(0).alias("line_idx"), "seg_idx", *ends)


def fault_lines(spark: SparkSession) -> DataFrame:
    rows = [(i, name, [{"lon": lo, "lat": la} for lo, la in pts]) for i, (name, pts) in enumerate(FAULTS)]
    schema = "line_id int, name string, points array<struct<lon:double,lat:double>>"
    return spark.createDataFrame(rows, schema)


def event_geometry_text(df: DataFrame) -> DataFrame:
    """A line feature per event, derived from its own epicentre (used to exercise the line reader).

    ``mb`` events: a LineString of 3 points; ``mw``: a MultiLineString of 2 parts
    (2 and 3 points); others: a Point (no segments).
    """
    lon, lat = F.col("lon").cast("double"), F.col("lat").cast("double")

    def pt(x, y):
        return F.array(x, y)

    ls = F.to_json(F.array(pt(lon, lat), pt(lon + 1.0, lat), pt(lon + 1.0, lat + 1.0)))
    mls = F.to_json(F.array(
        F.array(pt(lon, lat), pt(lon, lat + 1.0)),
        F.array(pt(lon - 1.0, lat), pt(lon - 1.0, lat - 1.0), pt(lon - 2.0, lat - 1.0)),
    ))
    p = F.to_json(pt(lon, lat))
    mt = F.col("mag_type")
    return df.select(
        F.col("row_seq").alias("feature"),
        F.when(mt == "mb", "LineString").when(mt == "mw", "MultiLineString").otherwise("Point").alias("type"),
        F.when(mt == "mb", ls).when(mt == "mw", mls).otherwise(p).alias("coordinates"),
    )
