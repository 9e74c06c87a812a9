import json
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tectonic.sources import geojson
from tectonic.sources.json_blocks import read_features

ODD = ['{', '}', '"', '\\', '}{', '"}', '\\"', '{"features":[{', ']}', 'é漢', '\n', ',', '\\\\', "a{b}c", ""]


def feature(rng, k):
    text = "".join(rng.choice(ODD) for _ in range(rng.randint(0, 6)))
    return {"type": "Feature", "properties": {"mag": k / 10, "time": k, "place": text, "deep": {"er": [{"x": text}, {}]}},
            "geometry": {"type": "Point", "coordinates": [k % 360 - 180, k % 180 - 90, 1.5]}, text or "k": [text]}


def documents(seed):
    rng = random.Random(seed)
    some = [feature(rng, k) for k in range(40)]
    return {
        "plain.json": {"type": "FeatureCollection", "features": some},
        "around.json": {"metadata": {"title": "}{\"", "n": {"a": 1}}, "other": [{"x": 1}, {"y": "]"}], "features": some[:7], "crs": {"a": {}},
                        "more": [{"features": [{"z": 1}]}, {"w": 2}], "bbox": [1, 2]},
        "last.json": {"note": "\"features\":[{", "crs": {}, "features": some[7:9]},
        "one.json": {"features": [some[0]]},
        "empty.json": {"metadata": {"a": 1}, "features": []},
        "none.json": {"metadata": {"a": 1}},
        "bare.json": {},
        "inner.json": {"properties": {"features": [some[0], some[1]]}},
        "with-null.json": {"features": [None, some[3], None, some[4]]},
    }


@pytest.fixture
def small_blocks(spark):
    names = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "0"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


@pytest.mark.parametrize("indent", [None, 1])
def test_features_of_split_documents_equal_a_json_parser(spark, tmp_path, small_blocks, indent):
    docs = documents(1)
    for name, doc in docs.items():
        (tmp_path / name).write_text(json.dumps(doc, indent=indent, ensure_ascii=False))
    got = {}
    for r in read_features(spark, str(tmp_path)).collect():
        got.setdefault(r.file.rsplit("/", 1)[1], {})[r.feature] = json.loads(r.value)
    for name, doc in docs.items():
        want = [f for f in doc.get("features") or [] if f is not None]
        assert got.get(name, {}) == dict(enumerate(want)), name


def test_one_document_is_read_by_several_tasks(spark, tmp_path, small_blocks):
    rng = random.Random(2)
    (tmp_path / "big.json").write_text(json.dumps({"type": "FeatureCollection", "features": [feature(rng, k) for k in range(300)]}, separators=(",", ":")))
    assert (tmp_path / "big.json").read_text().count("\n") == 0
    assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 50
    points = geojson.read_geojson_points(spark, str(tmp_path))
    assert points.count() == 300 and rows(points, "time") == [(k,) for k in range(300)]
    whole = spark.read.option("multiLine", "true").json(str(tmp_path)).select(F.explode("features").alias("f"))
    assert rows(points, "place") == rows(whole.select(F.when(F.col("f.properties.place") == "", "Unknown").otherwise(F.col("f.properties.place"))))


def test_line_segments_of_a_split_document(spark, tmp_path, small_blocks):
    lines = [{"type": "Feature", "properties": {"name": "}{"}, "geometry": {"type": "LineString", "coordinates": [[k, 0], [k, 1], [k, 2]]}} for k in range(30)]
    lines.insert(4, {"type": "Feature", "properties": {}, "geometry": {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 1]], [[5, 5], [6, 6], [7, 7]]]}})
    (tmp_path / "borders.json").write_text(json.dumps({"features": lines}))
    got = rows(geojson.read_line_segments(spark, str(tmp_path)), "file", "feature", "line_idx", "seg_idx", "lon1", "lat2")
    assert len(got) == 63 and {g[0] for g in got} == {"borders.json"}
    assert [g[1:] for g in got if g[1] == 4] == [(4, 0, 0, 0.0, 1.0), (4, 1, 0, 5.0, 6.0), (4, 1, 1, 6.0, 7.0)]
    assert [g[1:] for g in got if g[1] == 9] == [(9, 0, 0, 8.0, 1.0), (9, 0, 1, 8.0, 2.0)]


def test_no_files_and_empty_files(spark, tmp_path):
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "blank.json").write_text("\n \n")
    assert read_features(spark, str(tmp_path)).count() == 0


def test_objects_are_put_together_once(spark, tmp_path):
    """Marks and result read stored objects; each used to gather and parse all pieces again."""
    (tmp_path / "one.json").write_text(json.dumps({"metadata": {"a": 1}, "features": [feature(random.Random(1), k) for k in range(5)]}))
    found = read_features(spark, str(tmp_path))
    assert found.count() == 5
    assert "collect_list" not in found._jdf.queryExecution().executedPlan().toString()
