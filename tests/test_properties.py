"""Property tests against plain-Python models (hypothesis draws the inputs)."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tectonic.operators import dedupe, series

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])

rows_strategy = st.lists(
    st.tuples(st.sampled_from(["a", "b", "c", None]), st.integers(0, 50), st.integers(0, 3), st.integers(0, 5)),
    min_size=0, max_size=25,
)


@SETTINGS
@given(rows_strategy)
def test_latest_by_id_matches_model(spark, data):
    # (id, time, day, seq): keep the row with the greatest (day, seq, time) per id
    uniq = {}
    for i, (k, t, d, s) in enumerate(data):
        uniq[(k, d, s, t)] = (k, t, d, s * 100 + i)   # make the rank total
    rows = list(uniq.values())
    df = spark.createDataFrame(rows, "id string, time long, day int, seq long")
    got = sorted(((r["id"] or ""), r["time"], r["day"], r["seq"]) for r in
                 dedupe.latest_by_id(df, order_by=["day", "seq", "time"]).collect())
    best = {}
    for k, t, d, s in rows:
        if k not in best or (d, s, t) > best[k][1:]:
            best[k] = (t, d, s, t)
    expect = sorted(((k or ""), v[0], v[1], v[2]) for k, v in best.items())
    assert got == expect


@SETTINGS
@given(
    st.lists(st.integers(0, 300), max_size=40),
    st.integers(1, 60), st.integers(1, 50), st.integers(100, 300),
)
def test_window_series_counts_match_model(spark, times, duration, step, end):
    df = spark.createDataFrame([(t, 4.5, 1.0) for t in times], "time long, magnitude double, depth_km double")
    got = [(r["frame_start"], r["n"]) for r in series.window_series(df, 0, end, duration, step).orderBy("frame").collect()]
    max_start = end - duration
    starts, s = [], 0
    while s < max_start:
        starts.append(s)
        s += step
    starts.append(max_start)
    assert got == [(s, sum(1 for t in times if s <= t < s + duration)) for s in starts]
