import json

from pyspark.sql import functions as F

from conftest import SF0001, core_df, rows
from tectonic.operators import dedupe
from tectonic.schema import CORE_COLUMNS
from tectonic.sources import geojson, hazard_io, views
from tectonic.sources import parquet as pq
from tectonic.sources import web
from tectonic.sources.fixture import load_catalog
from tectonic.operators import hazard

NY = 1_704_067_200_000


def test_web_json_sink_and_both_scans(spark, tmp_path):
    df = core_df(spark, [("a", NY - 10, 35.12345, -117.5, None, 4.25, "ml", None),
                         ("b", NY + 10, 1.0, 2.0, 3.0, 5.0, "ml", "x")])
    out = str(tmp_path / "web")
    web.write_web_json(web.web_rows(df, 2.5), out)
    back = web.read_web_json(spark, out)
    assert rows(back, "time", "depth_km", "magnitude", "place", "year") == [
        (NY - 10, 0.0, 4.2, None, 2023), (NY + 10, 3.0, 5.0, "x", 2024)]
    # the reference's layout: one JSON array of arrays per file
    f = tmp_path / "2024.json"
    f.write_text(json.dumps([[NY + 10, 1.0, 2.0, 3.0, 5.0, "x"], [NY + 20, 1.5, 2.5, 0, 4.5, ""]], separators=(",", ":")))
    got = rows(web.read_web_json(spark, str(f), whole_files=True), "time", "lat", "place")
    assert got == [(NY + 10, 1.0, "x"), (NY + 20, 1.5, None)]


def test_web_json_line_format(spark):
    df = core_df(spark, [("a", 1704067207179, 35.1234, -117.5, 10.0, 4.2, "ml", "a")])
    line = web.web_json_lines(web.web_rows(df, None)).collect()[0][0]
    assert json.loads(line) == [1704067207179, 35.1234, -117.5, 10.0, 4.2, "a"]


def test_coastline_reader_treats_other_types_as_multi(spark, tmp_path):
    f = tmp_path / "coast.json"
    f.write_text(json.dumps({"type": "FeatureCollection", "features": [
        {"geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}},
        {"geometry": {"type": "Polygonish", "coordinates": [[[5, 5], [6, 6]]]}},
    ]}))
    assert geojson.read_line_segments(spark, str(f)).count() == 1
    both = geojson.read_line_segments(spark, str(f), multi_fallback=True)
    assert rows(both, "feature", "lon1", "lon2") == [(0, 0.0, 1.0), (1, 5.0, 6.0)]


def test_geojson_feature_text(spark):
    df = core_df(spark, [("a", 5, 35.0, -117.0, 0.0, 4.5, "ml", "p"), ("b", 6, 1.0, 2.0, 7.5, 4.5, "mb", None)])
    feats = [json.loads(r[0]) for r in geojson.geojson_lines(df).orderBy("value").collect()]
    coords = sorted(f["geometry"]["coordinates"] for f in feats)
    assert coords == [[-117.0, 35.0, 0.0], [2.0, 1.0, -7.5]]
    assert feats[0]["type"] == "Feature" and set(feats[0]["properties"]) == {
        "id", "time", "magnitude", "mag_type", "depth_km", "place"}


def test_hazard_round_trip(spark, tmp_path):
    cells = hazard.hazard_cells(load_catalog(spark, SF0001), 2026)
    hazard_io.write_hazard(cells, str(tmp_path / "hz"))
    assert rows(hazard_io.read_hazard(spark, str(tmp_path / "hz"))) == rows(cells)


def test_query_over_stored_catalog(spark, tmp_path):
    path = str(tmp_path / "cat")
    c = load_catalog(spark, SF0001)
    pq.write_catalog(dedupe.compact(c.filter(F.col("land_date") < "2024-01-15")), path)
    pq.land_daily(c.filter(F.col("land_date") >= "2024-01-15"), path)
    n = views.query(spark, path, "SELECT COUNT(*) AS n FROM events").collect()[0]["n"]
    assert n == 900
    yearly = views.query(spark, path, "SELECT year(epoch_ms(time)) yr, COUNT(*) n FROM events GROUP BY yr ORDER BY yr")
    assert sum(r["n"] for r in yearly.collect()) == 900
    assert views.query(spark, path, "SELECT COUNT(*) FROM events_all").collect()[0][0] > 900


def test_views_without_landing(spark, tmp_path):
    path = str(tmp_path / "cat")
    pq.write_catalog(core_df(spark, [("a", NY, 1.0, 1.0, 1.0, 8.5)]), path)
    got = views.query(spark, path, "SELECT * FROM events WHERE magnitude >= 8.0 ORDER BY magnitude DESC LIMIT 20")
    assert got.columns == [*CORE_COLUMNS, "year"] and got.count() == 1


def test_hazard_document_round_trip(spark, tmp_path):
    cells = hazard.hazard_cells(load_catalog(spark, SF0001), 2026)
    doc = hazard_io.hazard_document(cells).collect()[0][0]
    parsed = json.loads(doc)
    assert parsed["mc"] == 4.5 and parsed["catalog_years"] == 36
    assert len(parsed["cells"]) == cells.count() and all(len(c) == 5 and isinstance(c[4], int) for c in parsed["cells"])
    hazard_io.write_hazard_document(cells, str(tmp_path / "hz"))
    back = hazard_io.read_hazard_document(spark, str(tmp_path / "hz"))
    assert rows(back) == rows(cells)
