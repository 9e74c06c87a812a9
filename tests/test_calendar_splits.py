import datetime as dt
import random

from pyspark.sql import functions as F

from tectonic.plans import calendar, splits


def _landed(spark, days):
    return spark.createDataFrame([(dt.date.fromisoformat(d), n) for d, n in days], "land_date date, n long")


def test_missing_days_over_new_year_and_leap_day(spark):
    landed = _landed(spark, [("2023-12-31", 5), ("2024-02-29", 0)])
    got = [r[0].isoformat() for r in calendar.missing_days(landed, "2023-12-30", "2024-03-01").orderBy("land_date").collect()]
    assert got[0] == "2023-12-30" and "2023-12-31" not in got and "2024-02-29" not in got
    assert "2024-01-01" in got and got[-1] == "2024-03-01" and len(got) == 63 - 2


def test_nothing_landed_is_one_request(spark):
    landed = _landed(spark, [])
    plan = calendar.plan_requests(landed, "2024-01-01", "2024-01-31").collect()
    assert len(plan) == 1 and plan[0]["n_days"] == 31
    assert plan[0]["start_ms"] == 1_704_067_200_000 and plan[0]["end_ms"] == 1_704_067_200_000 + 31 * 86_400_000


def test_islands(spark):
    landed = _landed(spark, [("2024-01-03", 1), ("2024-01-04", 0), ("2024-01-08", 2)])
    plan = sorted((r["start_day"].isoformat(), r["end_day"].isoformat(), r["n_days"])
                  for r in calendar.plan_requests(landed, "2024-01-01", "2024-01-10").collect())
    assert plan == [("2024-01-01", "2024-01-02", 2), ("2024-01-05", "2024-01-07", 3), ("2024-01-09", "2024-01-10", 2)]


def test_refresh_days_are_requested_again(spark):
    landed = _landed(spark, [("2024-01-01", 1), ("2024-01-02", 1)])
    got = calendar.missing_days(landed, "2024-01-01", "2024-01-02", refresh_days=["2024-01-02"]).collect()
    assert [r[0].isoformat() for r in got] == ["2024-01-02"]


def test_missing_years(spark):
    landed = spark.createDataFrame([(1990,), (1992,)], "year int")
    assert [r[0] for r in calendar.missing_years(landed, 1990, 1993).orderBy("year").collect()] == [1991, 1993]
    assert calendar.missing_years(landed, 1990, 1993, overwrite=True).count() == 4


def _recursive(times, start, end, max_rows, max_depth, level=0, i=0):
    """Plain model of the halving search: fetch a node, split it while it holds max_rows or more."""
    span = end - start
    lo, hi = start + i * span // 2 ** level, start + (i + 1) * span // 2 ** level
    n = sum(1 for t in times if lo <= t < hi)
    if n < max_rows:
        return [(lo, hi, n, False)]
    if level == max_depth:
        return [(lo, hi, n, True)]
    return (_recursive(times, start, end, max_rows, max_depth, level + 1, 2 * i)
            + _recursive(times, start, end, max_rows, max_depth, level + 1, 2 * i + 1))


def _spark_leaves(spark, times, start, end, max_rows, max_depth):
    df = spark.createDataFrame([(t,) for t in times], "time long")
    out = splits.size_bounded_splits(df, start, end, max_rows, max_depth).collect()
    return sorted((r["start_ms"], r["end_ms"], r["n"], r["too_dense"]) for r in out)


def test_splits_match_recursion(spark):
    rng = random.Random(7)
    for _ in range(6):
        start = rng.randrange(0, 10_000)
        end = start + rng.randrange(50, 5_000)
        times = [rng.randrange(start - 20, end + 20) for _ in range(rng.randrange(0, 300))]
        if rng.random() < 0.5:
            times += [start + 3] * rng.randrange(0, 40)
        max_rows, depth = rng.randrange(5, 40), rng.randrange(2, 8)
        expect = sorted(_recursive(times, start, end, max_rows, depth))
        assert _spark_leaves(spark, times, start, end, max_rows, depth) == expect


def test_split_edges(spark):
    # max_rows - 1 rows: one leaf; exactly max_rows: split; end excluded; one ms: too dense
    assert _spark_leaves(spark, [0, 1, 2], 0, 8, 4, 3) == [(0, 8, 3, False)]
    assert _spark_leaves(spark, [0, 1, 2, 7, 8], 0, 8, 4, 3) == [(0, 4, 3, False), (4, 8, 1, False)]
    dense = _spark_leaves(spark, [5] * 10, 0, 8, 4, 2)
    assert (4, 6, 10, True) in dense and (0, 4, 0, False) in dense


def test_splits_tile_the_range(spark):
    times = list(range(0, 1000, 3))
    leaves = _spark_leaves(spark, times, 0, 1000, 50, 10)
    assert leaves[0][0] == 0 and leaves[-1][1] == 1000
    assert all(a[1] == b[0] for a, b in zip(leaves, leaves[1:]))
    assert sum(x[2] for x in leaves) == len(times) and all(x[2] < 50 for x in leaves)


def test_islands_across_years(spark):
    landed = _landed(spark, [("2023-12-20", 3), ("2024-01-10", 0)])
    plan = sorted((r["start_day"].isoformat(), r["end_day"].isoformat(), r["n_days"])
                  for r in calendar.plan_requests(landed, "2023-12-15", "2024-01-15").collect())
    assert plan == [("2023-12-15", "2023-12-19", 5), ("2023-12-21", "2024-01-09", 20), ("2024-01-11", "2024-01-15", 5)]
    long_gap = calendar.plan_requests(_landed(spark, [("2021-06-01", 1)]), "2020-01-01", "2023-12-31").collect()
    assert sorted((r["start_day"].isoformat(), r["end_day"].isoformat()) for r in long_gap) == [
        ("2020-01-01", "2021-05-31"), ("2021-06-02", "2023-12-31")]
