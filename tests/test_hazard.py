import math

from pyspark.sql import functions as F

from conftest import core_df
from tectonic.operators import hazard

T0 = 700_000_000_000   # after 1990


def _cell_rows(spark, lat, lon, mags):
    return [("e", T0, lat, lon, 10.0, m) for m in mags]


def test_fit_by_hand(spark):
    mags = [4.5, 5.0, 5.5, 6.0, 4.5, 5.0, 5.5, 6.0, 4.5, 5.0]
    df = core_df(spark, _cell_rows(spark, 35.5, -117.5, mags))
    r = hazard.hazard_cells(df, as_of_year=2026).collect()[0]
    mean = sum(mags) / len(mags)
    b = math.log10(math.e) / (mean - 4.5)
    a = math.log10(10) + b * 4.5
    assert (r["lat"], r["lon"], r["n"], r["catalog_years"]) == (35.0, -117.0, 10, 36)
    assert r["b"] == round(b, 4) and r["a"] == round(a, 4)


def test_cell_rules(spark):
    data = (_cell_rows(spark, 10.0, 10.0, [5.0] * 9)            # n = 9: dropped
            + _cell_rows(spark, 20.0, 20.0, [4.5] * 12)          # mean == mc: dropped
            + _cell_rows(spark, 90.0, 0.0, [5.0] * 12)           # centre 91: dropped
            + _cell_rows(spark, 0.0, 180.0, [5.0] * 12)          # centre 181: dropped
            + _cell_rows(spark, -0.5, -0.5, [5.0] * 12)          # cell -1 -> centre -1
            + [("old", 1000, -0.5, -0.5, 1.0, 9.0)])             # before 1990: ignored
    got = [(r["lat"], r["lon"], r["n"]) for r in hazard.hazard_cells(core_df(spark, data), 2026).collect()]
    assert got == [(-1.0, -1.0, 12)]


def test_empty_input(spark):
    assert hazard.hazard_cells(core_df(spark, []), 2026).count() == 0


def test_surface_monotone_and_raster_dense(spark):
    df = core_df(spark, _cell_rows(spark, 35.5, -117.5, [4.6, 5.1, 4.9, 6.2, 4.7, 5.5, 4.8, 5.0, 5.3, 4.6, 7.0]))
    cells = hazard.hazard_cells(df, 2026)
    surf = {(r["threshold"], r["horizon"]): r["p"] for r in hazard.hazard_surface(cells).collect()}
    assert len(surf) == 70
    for (m, t), p in surf.items():
        if (m + 0.5, t) in surf:
            assert surf[(m + 0.5, t)] <= p
        if (m, t + 10) in surf:
            assert surf[(m, t + 10)] >= p
    r = cells.collect()[0]
    rate = 10 ** (r["a"] - r["b"] * 6.5) / 36
    assert abs(surf[(6.5, 30)] - (1 - math.exp(-rate * 30))) < 1e-8
    raster = hazard.hazard_raster(hazard.hazard_surface(cells, [(6.5, 30)]), [(6.5, 30)])
    assert raster.count() == 16200
    hot = raster.filter(F.col("p") > 0).collect()
    assert [(x["row"], x["col"]) for x in hot] == [(62, 31)]


def test_zero_catalog_years_gives_null(spark):
    df = core_df(spark, _cell_rows(spark, 35.5, -117.5, [5.0, 5.5] * 6))
    s = hazard.hazard_surface(hazard.hazard_cells(df, 1990), [(6.0, 10)]).collect()
    assert s[0]["p"] is None
