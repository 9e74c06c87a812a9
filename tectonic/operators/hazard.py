"""Gutenberg-Richter hazard grid and Poisson exceedance probabilities.

Plan: scan (two pushed predicates, three columns) -> partial/final hash
aggregate on the grid cell -> per-cell fit. The cell key bounds the result to
at most 90 x 180 rows (at 2 degrees) whatever the catalog size, and a hot cell is absorbed by
the map-side partial aggregate.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import cell_center, grid_bin
from ..functions.numeric import round_half_even, threshold_for
from ..schema import (
    CATALOG_START_MS,
    HAZARD_GRID_DEG,
    HAZARD_MC,
    HAZARD_MIN_EVENTS,
)
from .filters import utc_year

LOG10_E = math.log10(math.e)

# The viewer's slider positions (magnitude 5.0-8.0 by 0.5, horizon 10-100 by 10).
SCENARIO_MAGNITUDES = [5.0, 5.5, 6.0, 6.5, 7.0, 7.5, 8.0]
SCENARIO_YEARS = [10, 20, 30, 40, 50, 60, 70, 80, 90, 100]
DEFAULT_SCENARIO = (6.5, 30)


def all_scenarios() -> list[tuple[float, int]]:
    return [(m, y) for m in SCENARIO_MAGNITUDES for y in SCENARIO_YEARS]


#: Magnitudes are summed as whole multiples of 2**-23: exact for stored magnitudes from 1 on, and in any order.
MAGNITUDE_UNIT = 1 << 23


def cell_sums(df: DataFrame, mc: float = HAZARD_MC, start_ms: int = CATALOG_START_MS, end_ms: int | None = None,
              grid_deg: float = HAZARD_GRID_DEG, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, lat_bin, lon_bin, n, mag_units) of events ``>= mc`` since ``start_ms``: what the fit needs of a
    cell, and what adds up over parts of a catalog."""
    cond = (F.col("time") >= F.lit(start_ms)) & (F.col("magnitude") >= threshold_for(df, "magnitude", mc))
    if end_ms is not None:
        cond = cond & (F.col("time") < F.lit(end_ms))
    units = F.round(F.col("magnitude").cast("double") * F.lit(float(MAGNITUDE_UNIT))).cast("long")
    return df.filter(cond).groupBy(*keys, grid_bin("lat", grid_deg).alias("lat_bin"), grid_bin("lon", grid_deg).alias("lon_bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(units).alias("mag_units"))


def fit_cells(sums: DataFrame, years: int, mc: float = HAZARD_MC, grid_deg: float = HAZARD_GRID_DEG, min_events: int = HAZARD_MIN_EVENTS) -> DataFrame:
    """The fit of every cell from its sums (see ``hazard_cells``)."""
    mean = F.col("mag_units").cast("double") / F.lit(float(MAGNITUDE_UNIT)) / F.col("n").cast("double")
    diff = mean - F.lit(float(mc))
    b_raw = F.lit(LOG10_E) / diff
    a_raw = F.log10(F.col("n").cast("double")) + b_raw * F.lit(float(mc))
    lat_c, lon_c = cell_center("lat_bin", grid_deg), cell_center("lon_bin", grid_deg)
    return (
        sums.filter((F.col("n") >= min_events) & (diff > 0))
        .select(
            lat_c.alias("lat"), lon_c.alias("lon"),
            round_half_even(a_raw, 4).alias("a"), round_half_even(b_raw, 4).alias("b"),
            F.col("n"),
            F.lit(float(mc)).alias("mc"),
            F.lit(int(years)).alias("catalog_years"),
        )
        .filter(F.col("lat").between(-90.0, 90.0) & F.col("lon").between(-180.0, 180.0))
    )


def hazard_cells(
    df: DataFrame,
    as_of_year: int,
    mc: float = HAZARD_MC,
    start_ms: int = CATALOG_START_MS,
    end_ms: int | None = None,
    grid_deg: float = HAZARD_GRID_DEG,
    min_events: int = HAZARD_MIN_EVENTS,
) -> DataFrame:
    """Fit ``a`` and ``b`` per grid cell from events ``>= mc`` since ``start_ms``.

    ``b = log10(e) / (mean - mc)`` (Aki), ``a = log10(n) + b * mc``; cells need
    ``n >= min_events`` and ``mean > mc``; centres outside [-90, 90] x [-180, 180]
    (lat 90 / lon 180 land in a cell centred at 91 / 181) are dropped; a and b
    are rounded to 4 decimals. ``catalog_years`` are those of the fitted span: up
    to ``as_of_year``, or to the year of ``end_ms``, from the year of ``start_ms``.
    """
    until = as_of_year if end_ms is None else min(as_of_year, utc_year(end_ms))
    return fit_cells(cell_sums(df, mc, start_ms, end_ms, grid_deg), until - utc_year(start_ms), mc, grid_deg, min_events)


def exceedance_probability(a, b, catalog_years, magnitude, horizon_years):
    """``rate = 10^(a - b*M) / years``, ``P = 1 - exp(-rate * T)``; null when years is 0."""
    rate = F.try_divide(F.pow(F.lit(10.0), a - b * magnitude), catalog_years.cast("double"))
    return F.lit(1.0) - F.exp(-rate * horizon_years)


def hazard_surface(cells: DataFrame, scenarios: list[tuple[float, int]] | None = None, digits: int = 8) -> DataFrame:
    """Probability per cell and scenario ``(magnitude threshold, horizon years)``.

    Scenarios are a literal array exploded on each cell (a generator, no join);
    the default is every slider position (70). ``p`` is rounded to ``digits``.
    """
    scenarios = scenarios or all_scenarios()
    arr = F.array(*[
        F.struct(F.lit(float(m)).alias("threshold"), F.lit(int(t)).alias("horizon"))
        for m, t in scenarios
    ])
    s = cells.select("lat", "lon", "a", "b", "catalog_years", F.inline(arr))
    p = exceedance_probability(F.col("a"), F.col("b"), F.col("catalog_years"), F.col("threshold"), F.col("horizon"))
    return s.select("lat", "lon", "threshold", "horizon", round_half_even(p, digits).alias("p"))


def raster_size(grid_deg: float = HAZARD_GRID_DEG) -> tuple[int, int]:
    """Rows and columns of the globe's grid."""
    return round(180.0 / grid_deg), round(360.0 / grid_deg)


def raster_index(lat_col, lon_col, grid_deg: float = HAZARD_GRID_DEG):
    """Texture position of a cell centre: ``row = floor((lat+90)/grid)``, ``col = floor((lon+180)/grid)``."""
    col = F.floor((F.col(lon_col) + F.lit(180.0)) / F.lit(float(grid_deg)))
    row = F.floor((F.col(lat_col) + F.lit(90.0)) / F.lit(float(grid_deg)))
    return row, col


def hazard_raster(surface: DataFrame, scenarios: list[tuple[float, int]] | None = None,
                  grid_deg: float = HAZARD_GRID_DEG) -> DataFrame:
    """Dense grid per scenario (180 x 90 at 2 degrees); cells without a fit are 0.

    ``grid_deg`` is the one the cells were fitted with. The grid is
    ``spark.range`` (parameter-sized); the join side is left to Spark's statistics.
    """
    spark = surface.sparkSession
    scenarios = scenarios or [DEFAULT_SCENARIO]
    height, width = raster_size(grid_deg)
    arr = F.array(*[
        F.struct(F.lit(float(m)).alias("threshold"), F.lit(int(t)).alias("horizon"))
        for m, t in scenarios
    ])
    grid = spark.range(width * height).select(
        F.expr(f"id div {width}").alias("row"),
        (F.col("id") % width).alias("col"),
        F.inline(arr),
    )
    row, col = raster_index("lat", "lon", grid_deg)
    wanted = F.struct(F.col("threshold"), F.col("horizon")).isin(*[
        F.struct(F.lit(float(m)).alias("threshold"), F.lit(int(t)).alias("horizon")) for m, t in scenarios
    ])
    cells = (
        surface.filter(wanted)
        .select(row.alias("row"), col.alias("col"), "threshold", "horizon", "p")
        .filter(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1))
    )
    out = grid.join(cells, ["row", "col", "threshold", "horizon"], "left")
    return out.select("row", "col", "threshold", "horizon", F.coalesce(F.col("p"), F.lit(0.0)).alias("p"))
