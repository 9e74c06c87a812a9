import random

import pytest
from pyspark.sql import functions as F

from conftest import SF0001, core_df, rows
from tectonic.functions import geo
from tectonic.operators import filters, topk
from tectonic.plans import sync as sync_plan
from tectonic.plans import view
from tectonic.schema import CORE_COLUMNS
from tectonic.sources import manifest, views
from tectonic.sources import parquet as pq
from tectonic.sources.fixture import load_catalog


def plain_key(lat, lon):
    x, y = geo._steps(lon, -180.0, 360.0), geo._steps(lat, -90.0, 180.0)
    return sum((x >> b & 1) << 2 * b | (y >> b & 1) << 2 * b + 1 for b in range(geo.SPACE_BITS))


def test_space_key_interleaves_the_bits(spark):
    points = [(-90.0, -180.0), (90.0, 180.0), (0.0, 0.0), (37.77, -122.42), (-33.9, 151.2), (1e-9, -1e-9), (95.0, 400.0)]
    df = spark.createDataFrame([*points, (None, 1.0), (float("nan"), 1.0), (1.0, float("inf"))], "lat double, lon double")
    got = [r[0] for r in df.select(geo.space_key("lat", "lon")).collect()]
    assert got == [plain_key(*p) for p in points] + [None, None, None]


@pytest.mark.parametrize("box", [(-30.0, 45.0, -90.0, 90.0), (32.0, 49.0, -125.0, -114.0), (-90.0, 90.0, -180.0, 180.0), (10.0, 10.0, 20.0, 20.0)])
def test_box_ranges_hold_the_box_and_little_else(box):
    ranges = geo.box_ranges(*box)
    assert 1 <= len(ranges) <= 40 and all(a <= b for a, b in ranges) and all(b + 1 < c for (_, b), (c, _) in zip(ranges, ranges[1:], strict=False))
    rng = random.Random(1)
    for _ in range(3000):
        lat, lon = rng.uniform(box[0], box[1]), rng.uniform(box[2], box[3])
        assert any(a <= plain_key(lat, lon) <= b for a, b in ranges)
    share = sum(b - a + 1 for a, b in ranges) / 2 ** (2 * geo.SPACE_BITS)
    area = (box[1] - box[0]) / 180 * (box[3] - box[2]) / 360
    assert share <= 3 * area + 0.001
    assert geo.box_ranges(10.0, 5.0, 0.0, 1.0) == []


def scanned(df):
    """Rows that the scans of an executed query gave: those of row groups that statistics did not rule out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves, out = [plan], 0
    while leaves:
        node = leaves.pop()
        kids = node.children()
        if "AdaptiveSparkPlan" in node.nodeName():
            leaves.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            leaves.append(node.plan())
        leaves += [kids.apply(i) for i in range(kids.size())]
        if "Scan parquet" in node.nodeName():
            out += node.metrics().apply("numOutputRows").value()
    return out


def test_a_box_of_a_stored_archive_reads_few_row_groups(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    events = [(f"e{k}", 1_704_067_200_000 + k, rng.uniform(-89, 89), rng.uniform(-179, 179), 1.0, 5.0) for k in range(20_000)]
    events += [("edge", 1_704_067_200_000, 49.0, -114.0, 1.0, 5.0), ("none", 1_704_067_200_000, None, None, 1.0, 5.0)]
    df = core_df(spark, events)
    box = (32.0, 49.0, -125.0, -114.0)
    want = rows(filters.bbox(df, *box), "id")
    monkeypatch.setattr(pq, "SPACE_ROW_GROUP", 16 << 10)
    read = {}
    for layout in ("time", "space"):
        path = str(tmp_path / layout)
        pq.write_catalog(df, path, partitions=16, layout=layout)
        frame = view.box_rows(spark, path, *box)
        assert rows(frame, "id") == want and frame.columns == [*CORE_COLUMNS, "year"]
        read[layout] = scanned(frame)
    plan = view.box_rows(spark, str(tmp_path / "space"), *box)._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    plan = view.box_rows(spark, str(tmp_path / "space"), *box)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(space_key," in plan
    assert read["time"] == 20_002 and read["space"] < 4_000
    # plain SQL on lat and lon profits from the layout too
    sql = views.query(spark, str(tmp_path / "space"), "SELECT * FROM events WHERE lat BETWEEN 32 AND 49 AND lon BETWEEN -125 AND -114")
    assert rows(sql, "id") == want and scanned(sql) < 8_000


def test_the_layout_stays_through_merges_and_cannot_change_by_halves(spark, tmp_path):
    path, ny = str(tmp_path / "cat"), 1_704_067_200_000
    pq.write_catalog(core_df(spark, [("a", ny, 1.0, 2.0, 3.0, 4.0), ("b", ny - 10, 1.0, 2.0, 3.0, 4.0)]), path, layout="space")
    sync_plan.upsert(spark, path, core_df(spark, [("a", ny + 1, 5.0, 6.0, 3.0, 4.0)]))
    assert manifest.load(spark, path).layout == "space"
    assert rows(view.box_rows(spark, path, 0.0, 9.0, 0.0, 9.0), "id") == [("a",), ("b",)]
    assert rows(pq.read_catalog(spark, path, with_key=True).where("space_key IS NOT NULL"), "id") == [("a",), ("b",)]
    with pytest.raises(ValueError, match="layout"):
        pq.write_catalog(core_df(spark, [("c", ny, 1.0, 2.0, 3.0, 4.0)]), path, layout="time")
    assert "space_key" not in pq.read_catalog(spark, path).columns


def first_by_hand(data, k):
    return sorted(data, key=lambda r: (r[1] is not None, r[1] or 0, r[0] is not None, r[0] or ""))[:k]


@pytest.mark.parametrize("k", [1, 2, 5, 60, 150, 299, 300, 301, 1000])
def test_selection_equals_a_sort(spark, k):
    rng = random.Random(3)
    data = [(f"id{rng.randint(0, 99):02d}x{i}", rng.choice([None, -5, 0, 7, 7, 7, 7, 10**12, 2**62, -(2**62)]), 0.0, 0.0, 1.0, 1.0) for i in range(290)]
    data += [(None, 7, 0.0, 0.0, 1.0, 1.0)] * 4 + [("same", 7, 0.0, 0.0, 1.0, 1.0)] * 6
    got = [(r["id"], r["time"]) for r in topk.playhead(core_df(spark, data).repartition(5), k, take_most=0).collect()]
    assert got == [(r[0], r[1]) for r in first_by_hand(data, k)]
    few = [(r["id"], r["time"]) for r in topk.playhead(core_df(spark, data), k, take_most=3).collect()]
    assert few == got


def test_a_large_playhead_has_no_single_task_stage(spark):
    c = load_catalog(spark, SF0001)
    plan = topk.playhead(c, 500, take_most=10)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "TakeOrdered" not in plan and "rangepartitioning(time" in plan
    assert "TakeOrdered" in topk.playhead(c, 500)._jdf.queryExecution().executedPlan().toString()
