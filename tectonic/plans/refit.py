"""The hazard grid kept up to date: a refit reads only the years that a merge has changed.

Sums per (year, cell) are stored beside the archive, each year's with the token of the archive files they were
taken from. A year whose token has changed since is taken again as a whole, which also takes back what the
year no longer holds; the other years' sums are read, a few thousand rows each. The fit adds the years up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.filters import utc_year
from ..operators.hazard import cell_sums, fit_cells
from ..schema import CATALOG_START_MS, HAZARD_GRID_DEG, HAZARD_MC, HAZARD_MIN_EVENTS
from ..session import ensure_utc
from ..sources import manifest
from ..sources import parquet as pq

SUMS_SCHEMA = T.StructType([T.StructField(c, T.LongType(), True) for c in ("lat_bin", "lon_bin", "n", "mag_units")]
                           + [T.StructField("year", T.IntegerType(), True)])


def _stale(state: manifest.Manifest, params: dict, first_year: int) -> tuple[dict, list[int]]:
    """The stored sums of these parameters, and the years of the archive that they lack or have from other files."""
    stored = state.hazard.get("years", {}) if state.hazard.get("params") == params else {}
    years = [y for y in state.years if y.lstrip("-").isdigit() and int(y) >= first_year]
    return stored, sorted(int(y) for y in years if stored.get(y, [None, None])[1] != state.years[y])


def refresh_sums(spark: SparkSession, path: str, mc: float = HAZARD_MC, start_ms: int = CATALOG_START_MS,
                 grid_deg: float = HAZARD_GRID_DEG) -> list[int]:
    """Bring the stored sums up to date with the archive; returns the years read."""
    ensure_utc(spark)
    params = {"mc": mc, "start_ms": start_ms, "grid_deg": grid_deg}
    state = manifest.load(spark, path)
    stored, stale = _stale(state, params, utc_year(start_ms))
    gone = [y for y in stored if y not in state.years]
    if not stale and not gone and state.hazard.get("params") == params:
        return []
    token = manifest.new_token()
    folder = manifest.join(path, "hazard_sums", f"token={token}")
    if stale:
        sums = cell_sums(pq.read_catalog(spark, path, stale, at=state), mc, start_ms, grid_deg=grid_deg, keys=("year",))
        sums.repartition("year").write.partitionBy("year").parquet(folder)
    written = pq._partition_values(spark, folder, "year")

    def change(now: manifest.Manifest) -> None:
        kept, _ = _stale(now, params, utc_year(start_ms))
        years = {y: v for y, v in kept.items() if y in now.years and int(y) not in stale}
        for y in stale:
            # sums are of the files that were read, also where a merge has replaced them meanwhile
            years[str(y)] = [token if str(y) in written else "", state.years[str(y)]]
        for y, (old, _) in now.hazard.get("years", {}).items():
            if old and years.get(y, [None])[0] != old:
                now.retire(f"hazard_sums/token={old}/year={y}")
        now.hazard = {"params": params, "years": years}

    manifest.commit(spark, path, change)
    return stale


def refit_hazard(spark: SparkSession, path: str, as_of_year: int, mc: float = HAZARD_MC, start_ms: int = CATALOG_START_MS,
                 grid_deg: float = HAZARD_GRID_DEG, min_events: int = HAZARD_MIN_EVENTS) -> DataFrame:
    """As ``hazard_cells`` over the whole archive, from stored sums."""
    refresh_sums(spark, path, mc, start_ms, grid_deg)
    years = manifest.load(spark, path).hazard["years"]
    folders = [f"token={token}/year={y}" for y, (token, _) in sorted(years.items()) if token]
    sums = pq._scan(spark, manifest.join(path, "hazard_sums"), folders, SUMS_SCHEMA) if folders else spark.createDataFrame([], SUMS_SCHEMA)
    total = sums.groupBy("lat_bin", "lon_bin").agg(F.sum("n").alias("n"), F.sum("mag_units").alias("mag_units"))
    return fit_cells(total, as_of_year - utc_year(start_ms), mc, grid_deg, min_events)
