import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tectonic.schema import CORE_COLUMNS
from tectonic.sources import csv as csv_src

RAW = "time string, latitude string, longitude string, depth string, mag string, magType string, id string, place string, extra string"


def _raw(spark, data):
    return csv_src.apply_null_markers(spark.createDataFrame(data, RAW))


def test_time_parsing_and_null_markers(spark):
    data = [
        ("1906-04-18T13:12:21.123Z", "37.75", "-122.55", "8", "7.9", "mw", "a", "San Francisco", "x"),
        ("2024-01-01T00:00:00Z", "1", "2", "", "null", "ml", "b", "null", "x"),
        ("2024-01-01T00:00:00.5Z", "1", "2", "3", "4", "ml", "c", "", "x"),
        ("2024-01-01T00:00:00.123456Z", "1", "2", "3", "4", "ml", "d", "p", "x"),
        ("junk", "1", "2", "3", "abc", "ml", "e", "p", "x"),
    ]
    out = {r["id"]: r for r in csv_src.normalize(_raw(spark, data)).collect()}
    assert out["a"]["time"] == -2010394058877
    assert out["b"]["time"] == 1704067200000
    assert out["b"]["depth_km"] is None and out["b"]["magnitude"] is None and out["b"]["place"] is None
    assert out["c"]["time"] == 1704067200500 and out["c"]["place"] is None
    assert out["d"]["time"] == 1704067200123
    assert out["e"]["time"] is None and out["e"]["magnitude"] is None   # bad number -> null
    assert abs(out["a"]["magnitude"] - 7.9) < 1e-6


def test_schema_and_extra_columns_dropped(spark):
    df = csv_src.normalize(_raw(spark, [("2024-01-01T00:00:00Z", "1", "2", "3", "4", "ml", "a", "p", "x")]))
    assert df.columns == CORE_COLUMNS
    assert [f.dataType.simpleString() for f in df.schema.fields] == [
        "string", "bigint", "float", "float", "float", "float", "string", "string"]


def test_missing_core_column_fails(spark):
    raw = _raw(spark, [("2024-01-01T00:00:00Z", "1", "2", "3", "4", "ml", "a", "p", "x")]).drop("place")
    with pytest.raises(AnalysisException):
        csv_src.normalize(raw).collect()


def test_empty_input_keeps_schema(spark):
    df = csv_src.normalize(_raw(spark, []))
    assert df.count() == 0 and df.columns == CORE_COLUMNS


def test_first_z_only_is_removed(spark):
    df = spark.createDataFrame([("2024-01-01T00:00:00ZZ",), ("2024-01-01T00:00:00Z",)], "t string")
    got = [r[0] for r in df.select(csv_src.parse_event_time(F.col("t"))).collect()]
    assert got == [None, 1704067200000]


def test_csv_round_trip(spark, tmp_path):
    from tectonic.sources.fixture import load_catalog
    from conftest import SF0001, rows

    c = load_catalog(spark, SF0001)
    path = str(tmp_path / "raw")
    csv_src.write_event_csv(csv_src.raw_text_from_catalog(c), path)
    back = csv_src.normalize(csv_src.read_event_csv(spark, path))
    assert rows(back) == rows(c.select(*CORE_COLUMNS))
