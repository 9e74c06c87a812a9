"""Plan properties of the registered queries, and the driver contract."""

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF0001
from tectonic.operators import filters
from tectonic.sources import parquet as pq
from tectonic.suite import QUERIES

def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert set(df.columns) == {"lat", "lon", "threshold", "horizon", "p"}


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(E.oracle_sql()) and set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_udf_and_no_cartesian(spark, name):
    plan = _plan(QUERIES[name](spark, SF0001))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan, (name, bad)


def test_filters_reach_the_scan(spark):
    # the mapped catalog computes its columns, so only the columns are pruned there
    plan = _plan(QUERIES["hazard_cells"](spark, SF0001))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,value:double>" in plan


@pytest.mark.parametrize("name", ["bbox", "min_magnitude", "view_filter"])
def test_filters_do_not_shuffle(spark, name):
    assert "Exchange" not in _plan(QUERIES[name](spark, SF0001))


def test_sql_over_a_stored_archive_prunes_and_pushes(spark, tmp_path):
    from conftest import core_df
    from tectonic.sources import views
    path = str(tmp_path / "cat")
    ny = 1_704_067_200_000
    pq.write_catalog(core_df(spark, [("a", ny - 10, 0.0, 0.0, 1.0, 8.5), ("b", ny + 10, 0.0, 0.0, 1.0, 8.5)]), path)
    spark.createDataFrame([(1,)], "mine int").createOrReplaceTempView("events")
    df = views.query(spark, path, "SELECT * FROM events WHERE year = 2024 AND magnitude >= 8.0")
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = _plan(views.query(spark, path, "SELECT * FROM events WHERE year = 2024 AND magnitude >= 8.0"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = _plan(df) if "2024" not in plan else plan
    assert "(year#" in plan and "= 2024)" in plan and "GreaterThanOrEqual(magnitude,8.0)" in plan
    assert "Exchange" not in plan and [r["id"] for r in df.collect()] == ["b"]
    assert "Exchange hashpartitioning" not in _plan(views.query(spark, path, "SELECT count(*) FROM events"))
    assert spark.table("events").columns == ["mine"]     # the caller's view stays


def test_year_pruning(spark, tmp_path):
    from conftest import core_df
    path = str(tmp_path / "cat")
    ny = 1_704_067_200_000
    pq.write_catalog(core_df(spark, [("a", ny - 10, 0.0, 0.0, 1.0, 4.0), ("b", ny + 10, 0.0, 0.0, 1.0, 4.0)]), path)
    df = filters.view_filter(pq.read_catalog(spark, path), ny, 1000, 2.5, 700)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")   # print the scan's filters in full
    plan = _plan(df)
    assert "PartitionFilters: [isnotnull(year" in plan and "(year#" in plan
    for pushed in ("GreaterThanOrEqual(time,", "LessThan(time,", "GreaterThanOrEqual(magnitude,", "Or(IsNull(depth_km)"):
        assert pushed in plan, pushed
    assert [r["id"] for r in df.collect()] == ["b"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_duckdb_at_sf0001(spark, name):
    sdf = QUERIES[name](spark, SF0001)
    s_rows = sdf.collect()
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{SF0001}/events.parquet')")
    cur = con.execute(E.oracle_sql()[name])
    d_rows = cur.fetchall()
    d_cols = [c[0] for c in cur.description]
    assert sorted(sdf.columns) == sorted(d_cols)
    order = sorted(d_cols)

    def norm(rows, cols):
        idx = [cols.index(c) for c in order]
        return sorted(repr(tuple(None if r[i] is None else (float(r[i]) if isinstance(r[i], float) else r[i]) for i in idx))
                      for r in rows)

    assert norm([tuple(r) for r in s_rows], sdf.columns) == norm(d_rows, d_cols)


def test_landing_year_filter_prunes_partitions(spark, tmp_path):
    import datetime as dt

    from pyspark.sql import functions as F

    from conftest import core_df
    path = str(tmp_path / "cat")
    rows_ = core_df(spark, [("a", 1_703_980_800_000, 0.0, 0.0, 1.0, 4.0), ("b", 1_704_067_200_000, 0.0, 0.0, 1.0, 4.0)])
    days = spark.createDataFrame([("a", dt.date(2023, 12, 31)), ("b", dt.date(2024, 1, 1))], "id string, land_date date")
    pq.land_daily(rows_.join(days, "id").withColumn("row_seq", F.col("time")), path)
    df = pq.read_landing(spark, path, year=2024)
    assert [r["id"] for r in df.collect()] == ["b"]
    assert "PartitionFilters: [isnotnull(land_date" in _plan(df)
