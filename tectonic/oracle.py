"""DuckDB text of every registered query, over the driver's pre-registered tables.

Each statement starts from the same catalog mapping as ``sources.fixture`` and
aliases every computed column with the Spark query's name.
"""

from __future__ import annotations

from .sources.fixture import CATALOG_SQL

# Fixed values, stated here apart from the engine's: magnitude classes (upper bound, label, rgb, hex).
MAGNITUDE_CLASSES = [
    (2.0, "Micro", (0.31, 0.76, 0.97), "#4fc3f7"),
    (4.0, "Minor", (0.51, 0.78, 0.52), "#81c784"),
    (5.0, "Light", (1.00, 0.95, 0.46), "#fff176"),
    (6.0, "Moderate", (1.00, 0.72, 0.30), "#ffb74d"),
    (7.0, "Strong", (1.00, 0.44, 0.26), "#ff7043"),
    (None, "Major", (0.90, 0.22, 0.21), "#e53935"),
]
# Heat ramp stops.
HEAT_STOPS = [(0.10, 0.20, 0.80), (0.10, 0.75, 0.80), (0.95, 0.90, 0.10), (0.95, 0.50, 0.05), (0.90, 0.10, 0.05)]

CTE = f"WITH catalog AS ({CATALOG_SQL})"

CELLS = """
cells AS (
  SELECT lat_bin * 2.0 + 1.0 AS lat, lon_bin * 2.0 + 1.0 AS lon,
         round_even(log10(n) + b_raw * 4.5, 4) AS a, round_even(b_raw, 4) AS b, n,
         CAST(4.5 AS DOUBLE) AS mc, 36 AS catalog_years
  FROM (
    SELECT lat_bin, lon_bin, n, 0.4342944819032518::DOUBLE / (mean_mag - 4.5) AS b_raw
    FROM (
      SELECT floor(CAST(lat AS DOUBLE) / 2.0) AS lat_bin, floor(CAST(lon AS DOUBLE) / 2.0) AS lon_bin,
             count(*) AS n, avg(CAST(magnitude AS DOUBLE)) AS mean_mag
      FROM catalog WHERE time >= 631152000000 AND magnitude >= CAST(4.5 AS FLOAT)
      GROUP BY 1, 2)
    WHERE n >= 10 AND mean_mag - 4.5 > 0)
  WHERE lat_bin * 2.0 + 1.0 BETWEEN -90 AND 90 AND lon_bin * 2.0 + 1.0 BETWEEN -180 AND 180)
"""

SCENARIOS = "scen AS (SELECT CAST(m AS DOUBLE) AS threshold, CAST(t AS INTEGER) AS horizon " \
            "FROM (SELECT unnest([5.0, 5.5, 6.0, 6.5, 7.0, 7.5, 8.0]) AS m), " \
            "(SELECT unnest([10, 20, 30, 40, 50, 60, 70, 80, 90, 100]) AS t))"

SURFACE = """
surface AS (
  SELECT lat, lon, threshold, horizon,
         round_even(1.0 - exp(-(pow(10.0, a - b * threshold) / CAST(catalog_years AS DOUBLE)) * horizon), 8) AS p
  FROM cells, scen)
"""

ORACLE: dict[str, str] = {}

ORACLE["normalize"] = f"""{CTE}
SELECT id, time, lat, lon, depth_km, magnitude, mag_type, place FROM catalog"""

ORACLE["hazard_cells"] = f"""{CTE}, {CELLS} SELECT * FROM cells"""

ORACLE["hazard_surface"] = f"""{CTE}, {CELLS}, {SCENARIOS}, {SURFACE} SELECT * FROM surface"""

ORACLE["hazard_raster"] = f"""{CTE}, {CELLS}, {SCENARIOS}, {SURFACE},
grid AS (SELECT CAST(range // 180 AS BIGINT) AS row, CAST(range % 180 AS BIGINT) AS col FROM range(16200)),
placed AS (SELECT CAST(floor((lat + 90.0) / 2.0) AS BIGINT) AS row, CAST(floor((lon + 180.0) / 2.0) AS BIGINT) AS col, p
           FROM surface WHERE threshold = 6.5 AND horizon = 30)
SELECT g.row, g.col, CAST(6.5 AS DOUBLE) AS threshold, 30 AS horizon, coalesce(p.p, 0.0) AS p
FROM grid g LEFT JOIN placed p ON g.row = p.row AND g.col = p.col"""

# ---- phase 2 ----------------------------------------------------------------------

WEB6 = """SELECT time, round_even(CAST(lat AS DOUBLE), 4) AS lat, round_even(CAST(lon AS DOUBLE), 4) AS lon,
       round_even(CAST(coalesce(depth_km, CAST(0.0 AS FLOAT)) AS DOUBLE), 1) AS depth_km,
       round_even(CAST(magnitude AS DOUBLE), 1) AS magnitude, coalesce(place, '') AS place"""

# The viewer filters its exported (rounded) rows.
VIEW = f"(SELECT * FROM ({WEB6} FROM catalog) WHERE time >= 1709251200000 AND time < 1709251200000 + 7889400000 " \
       "AND magnitude >= 4.5 AND depth_km <= 300.0)"

# Camera unit vector of the default viewpoint and the facing test on the unit sphere.
_CAM = (-0.197, 1.108, 1.405)
_N = sum(c * c for c in _CAM) ** 0.5
UX, UY, UZ = (repr(c / _N) for c in _CAM)
FACING = f"""(((-1.0 * sin(radians(90.0 - CAST(lat AS DOUBLE)))) * cos(radians(CAST(lon AS DOUBLE) + 180.0))) * {UX}
  + (1.0 * cos(radians(90.0 - CAST(lat AS DOUBLE)))) * {UY}
  + ((1.0 * sin(radians(90.0 - CAST(lat AS DOUBLE)))) * sin(radians(CAST(lon AS DOUBLE) + 180.0))) * {UZ}) > 0.0"""

TIES = "lat NULLS FIRST, lon NULLS FIRST, depth_km NULLS FIRST, magnitude NULLS FIRST, place NULLS FIRST"

ORACLE["min_magnitude"] = f"{CTE} SELECT * FROM catalog WHERE magnitude >= CAST(4.6 AS FLOAT)"
ORACLE["view_filter"] = f"{CTE} SELECT * FROM {VIEW}"
ORACLE["bbox"] = f"{CTE} SELECT * FROM catalog WHERE lat BETWEEN -30.0 AND 45.0 AND lon BETWEEN -90.0 AND 90.0"
ORACLE["event_range"] = f"""{CTE} SELECT * FROM catalog WHERE time >= 946684800000 AND time < 1262304000000
  AND magnitude >= CAST(4.5 AS FLOAT) ORDER BY time"""
ORACLE["regional_filter"] = f"""{CTE} SELECT * FROM catalog
  WHERE coalesce(magnitude, CAST(0 AS FLOAT)) >= CAST(4.6 AS FLOAT) AND coalesce(magnitude, CAST(0 AS FLOAT)) >= 2"""
# now = 2024-05-01T18:00Z: trailing 30 whole days = [2024-04-01, 2024-05-01)
ORACLE["trailing_days"] = f"{CTE} SELECT * FROM catalog WHERE time >= 1711929600000 AND time < 1714521600000"
ORACLE["today_events"] = f"{CTE} SELECT * FROM catalog WHERE time >= 1714521600000 AND time < 1714586400000"
ORACLE["facing"] = f"{CTE} SELECT * FROM catalog WHERE {FACING}"
def _mean_of_tenths(column: str) -> str:
    """Mean of one-decimal values from their whole sum: avg() of doubles depends on the rows' order."""
    return (f"round_even(CAST(sum(CAST(round({column} * 10.0) AS BIGINT)) AS DOUBLE) "
            f"/ CAST(nullif(count({column}), 0) AS DOUBLE) / 10.0, 4)")


ORACLE["window_stats"] = f"""{CTE}
SELECT count(*) AS n, max(magnitude) AS max_magnitude, {_mean_of_tenths('magnitude')} AS avg_magnitude,
       {_mean_of_tenths('depth_km')} AS avg_depth_km FROM {VIEW}"""
ORACLE["yearly_counts"] = f"""{CTE} SELECT CAST(year(make_timestamp(time * 1000)) AS INTEGER) AS yr, count(*) AS n
  FROM catalog GROUP BY 1 ORDER BY 1"""
ORACLE["visible_recent"] = f"{CTE} SELECT * FROM {VIEW} WHERE {FACING} ORDER BY time DESC, {TIES} LIMIT 100"
ORACLE["significant"] = f"""{CTE} SELECT * FROM catalog WHERE coalesce(magnitude, CAST(0 AS FLOAT)) >= CAST(3.1 AS FLOAT)
  ORDER BY magnitude DESC, time, id NULLS FIRST LIMIT 12"""
ORACLE["playhead"] = f"{CTE} SELECT * FROM catalog ORDER BY time, id LIMIT 50"
ORACLE["freshness"] = f"""{CTE} SELECT id, time,
  CASE WHEN rn <= 39 THEN 1.0 - CAST(rn AS DOUBLE) / 40.0 ELSE 0.0 END AS freshness
  FROM (SELECT id, time, row_number() OVER (ORDER BY time DESC, id DESC) AS rn FROM catalog)"""
ORACLE["timeline_ticks"] = f"""{CTE}, b AS (SELECT min(time) AS t0, max(time) AS t1 FROM catalog)
SELECT id, time,
  round_even(CAST(time - t0 AS DOUBLE) / CAST(CASE WHEN t1 - t0 = 0 THEN 1 ELSE t1 - t0 END AS DOUBLE) * 100.0, 6) AS pct,
  round_even(greatest(4.0, least(38.0, greatest(2.0, 1.8 * pow(2.0, CAST(magnitude AS DOUBLE) - 1.0)) * 2.0)), 6) AS height,
  CASE WHEN magnitude IS NULL THEN NULL WHEN magnitude < 2 THEN '#4fc3f7' WHEN magnitude < 4 THEN '#81c784'
       WHEN magnitude < 5 THEN '#fff176' WHEN magnitude < 6 THEN '#ffb74d' WHEN magnitude < 7 THEN '#ff7043'
       ELSE '#e53935' END AS color
FROM catalog, b"""

LATEST = """latest AS (SELECT id, time, lat, lon, depth_km, magnitude, mag_type, place FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY land_date DESC, row_seq DESC) AS rn FROM catalog) WHERE rn = 1)"""
YEAR = "CAST(year(make_timestamp(time * 1000)) AS INTEGER)"

ORACLE["sql_count"] = f"{CTE}, {LATEST} SELECT count(*) AS n FROM latest"
ORACLE["sql_top_magnitude"] = f"""{CTE}, {LATEST} SELECT *, {YEAR} AS year FROM latest WHERE magnitude >= 8.0
  ORDER BY magnitude DESC, time, id LIMIT 20"""
ORACLE["sql_yearly"] = f"""{CTE}, {LATEST} SELECT CAST(year(make_timestamp(time * 1000)) AS INTEGER) AS yr, count(*) AS n
  FROM latest GROUP BY 1 ORDER BY 1"""
ORACLE["sql_region"] = f"""{CTE}, {LATEST} SELECT *, {YEAR} AS year FROM latest WHERE magnitude >= 5.0 AND lat BETWEEN 32 AND 49
  AND lon BETWEEN -125 AND -114 ORDER BY time, id LIMIT 20"""
ORACLE["sql_stored_archive"] = f"""{CTE}, {LATEST} SELECT *, {YEAR} AS year FROM latest
  WHERE {YEAR} BETWEEN 1995 AND 2004 AND magnitude >= 4.75"""
# events_all = compacted archive (rows landed before 2024-01-15) + the later landing rows
ORACLE["sql_count_all"] = f"""{CTE} SELECT
  (SELECT count(*) FROM (SELECT DISTINCT id FROM catalog WHERE land_date < DATE '2024-01-15'))
  + (SELECT count(*) FROM catalog WHERE land_date >= DATE '2024-01-15') AS n"""

# ---- phase 3 ----------------------------------------------------------------------

ORACLE["latest_by_id"] = f"""{CTE} SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY land_date DESC, row_seq DESC) AS rn FROM catalog) WHERE rn = 1"""
ORACLE["compact"] = f"""{CTE}, {LATEST} SELECT *, CAST(year(make_timestamp(time * 1000)) AS INTEGER) AS year FROM latest"""
ORACLE["with_live"] = f"""{CTE}
{WEB6} FROM catalog WHERE time >= 1704067200000 AND time < 1714521600000 AND magnitude >= CAST(2.5 AS FLOAT)
UNION ALL
{WEB6} FROM catalog WHERE time >= 1714521600000 AND time < 1714586400000 AND magnitude >= CAST(2.5 AS FLOAT)"""
ORACLE["unlanded_events"] = f"""{CTE},
landed AS (SELECT DISTINCT CAST(make_timestamp(time * 1000) AS DATE) AS d FROM catalog WHERE time < 1714003200000)
SELECT id, time, lat, lon, depth_km, magnitude, mag_type, place FROM catalog
WHERE time < 1714586400000 AND time >= 1704067200000
  AND CAST(make_timestamp(time * 1000) AS DATE) NOT IN (SELECT d FROM landed)"""
ORACLE["missing_years"] = f"""{CTE} SELECT CAST(range AS INTEGER) AS year FROM range(1900, 2026)
  WHERE range NOT IN (SELECT DISTINCT year(make_timestamp(time * 1000)) FROM catalog WHERE time IS NOT NULL)"""
_DAYS = """days AS (SELECT CAST(d AS DATE) AS land_date FROM generate_series(DATE '2023-12-25', DATE '2024-02-05', INTERVAL 1 DAY) t(d)),
miss AS (SELECT land_date FROM days WHERE land_date NOT IN (SELECT DISTINCT land_date FROM catalog WHERE land_date IS NOT NULL))"""
ORACLE["missing_days"] = f"{CTE}, {_DAYS} SELECT * FROM miss"
ORACLE["plan_requests"] = f"""{CTE}, {_DAYS},
isl AS (SELECT land_date, land_date - CAST(row_number() OVER (ORDER BY land_date) AS INTEGER) AS k FROM miss)
SELECT min(land_date) AS start_day, max(land_date) AS end_day, count(*) AS n_days,
       epoch_ms(CAST(min(land_date) AS TIMESTAMP)) AS start_ms, epoch_ms(CAST(max(land_date) + 1 AS TIMESTAMP)) AS end_ms
FROM isl GROUP BY k"""
_S, _E, _SPAN = 473385600000, 1735689600000, 1735689600000 - 473385600000
ORACLE["size_bounded_splits"] = f"""{CTE},
b AS (SELECT ((time - {_S} + 1) * 16384 - 1) // {_SPAN} AS d, count(*) AS n FROM catalog
      WHERE time >= {_S} AND time < {_E} GROUP BY 1),
nodes AS (SELECT l AS level, d >> (14 - l) AS idx, CAST(sum(n) AS BIGINT) AS n FROM b, range(0, 15) r(l) GROUP BY 1, 2),
split AS (SELECT * FROM nodes WHERE n >= 1000),
children AS (SELECT level + 1 AS level, idx * 2 + c AS idx FROM split, (VALUES (0), (1)) v(c) WHERE level < 14),
root AS (SELECT coalesce((SELECT n FROM nodes WHERE level = 0 AND idx = 0), 0) AS n),
leaves AS (
  SELECT c.level, c.idx, coalesce(nd.n, 0) AS n, false AS too_dense
  FROM children c LEFT JOIN nodes nd ON c.level = nd.level AND c.idx = nd.idx WHERE coalesce(nd.n, 0) < 1000
  UNION ALL SELECT 0, 0, n, false FROM root WHERE n < 1000
  UNION ALL SELECT level, idx, n, true FROM split WHERE level = 14)
SELECT CAST(level AS INTEGER) AS level, CAST(idx AS BIGINT) AS idx,
       {_S} + idx * {_SPAN} // (CAST(1 AS BIGINT) << CAST(level AS INTEGER)) AS start_ms,
       {_S} + (idx + 1) * {_SPAN} // (CAST(1 AS BIGINT) << CAST(level AS INTEGER)) AS end_ms,
       CAST(n AS BIGINT) AS n, too_dense FROM leaves"""

# ---- phase 4 ----------------------------------------------------------------------



def _d(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def _fixed(x: str, k: int) -> str:
    """Fixed-decimal text of the exact value, halves away from zero.

    A double is a half at k decimals only if it is an odd multiple of 2^-(k+1); then its product with 10^k is
    exact. All others are printed, which rounds the exact value.
    """
    v = f"abs(CAST({x} AS DOUBLE))"
    sign = f"(CASE WHEN CAST({x} AS DOUBLE) < 0 THEN '-' ELSE '' END)"
    half = f"(({v} * {2 ** (k + 1)}.0) % 2.0 = 1.0)"
    up = f"CAST(floor({v} * {10 ** k}.0 + 0.5) AS BIGINT)"
    whole = f"CAST({up} // {10 ** k} AS VARCHAR)"
    exact = whole if k == 0 else f"{whole} || '.' || lpad(CAST({up} % {10 ** k} AS VARCHAR), {k}, '0')"
    return f"(CASE WHEN {x} IS NULL THEN NULL WHEN {half} THEN {sign} || {exact} ELSE {sign} || format('{{:.{k}f}}', {v}) END)"


def _mag_case(col: str, pick) -> str:
    parts = [f"CASE WHEN {col} IS NULL THEN NULL"]
    for bound, label, rgb, hexv in MAGNITUDE_CLASSES:
        val = pick(label, rgb, hexv)
        parts.append(f" ELSE {val}" if bound is None else f" WHEN {col} < {_d(bound)} THEN {val}")
    return "".join(parts) + " END"


def _depth_rgb(d: str) -> tuple[str, str, str]:
    dd = f"greatest(0.0, least(700.0, coalesce(CAST({d} AS DOUBLE), 0.0)))"
    t1, t2, t3 = f"({dd} / 70.0)", f"(({dd} - 70.0) / 230.0)", f"(({dd} - 300.0) / 400.0)"

    def piece(a, b, c):
        return f"(CASE WHEN {dd} < 70 THEN {a} WHEN {dd} < 300 THEN {b} ELSE {c} END)"

    r = piece("1.0", f"(1.0 - {t2} * {_d(0.65)})", f"({_d(0.35)} - {t3} * {_d(0.25)})")
    g = piece(f"({_d(0.25)} + {t1} * {_d(0.35)})", f"({_d(0.60)} - {t2} * {_d(0.15)})", f"({_d(0.45)} - {t3} * {_d(0.15)})")
    b = piece(_d(0.05), f"({_d(0.05)} + {t2} * {_d(0.30)})", f"({_d(0.35)} + {t3} * {_d(0.65)})")
    return r, g, b


def _css(r: str, g: str, b: str) -> str:
    def ch(x):
        return f"CAST(CAST(floor(({x}) * 255.0 + 0.5) AS BIGINT) AS VARCHAR)"
    return f"'rgb(' || {ch(r)} || ',' || {ch(g)} || ',' || {ch(b)} || ')'"


def _xyz(lat: str, lon: str, depth: str | None) -> tuple[str, str, str]:
    r = "1.0" if depth is None else f"((6371.0 - ({depth})) / 6371.0)"
    if depth is None:
        r = "((6371.0 - 0.0) / 6371.0)"
    phi = f"radians(90.0 - CAST({lat} AS DOUBLE))"
    th = f"radians(CAST({lon} AS DOUBLE) + 180.0)"
    return (f"((-{r}) * sin({phi})) * cos({th})", f"{r} * cos({phi})", f"({r} * sin({phi})) * sin({th})")


def _r9(x: str) -> str:
    # "+ 0.0" turns a rounded -0.0 into 0.0, as Spark's bround gives
    return f"(round_even({x}, 9) + 0.0)"


ORACLE["web_rows"] = f"{CTE} {WEB6} FROM catalog WHERE magnitude >= CAST(4.0 AS FLOAT)"
ORACLE["web_rows_5"] = f"""{CTE} SELECT time, round_even(CAST(lat AS DOUBLE), 4) AS lat, round_even(CAST(lon AS DOUBLE), 4) AS lon,
  round_even(CAST(coalesce(depth_km, CAST(0.0 AS FLOAT)) AS DOUBLE), 1) AS depth_km,
  round_even(CAST(magnitude AS DOUBLE), 1) AS magnitude FROM catalog WHERE magnitude >= CAST(4.0 AS FLOAT)"""
ORACLE["read_web_json"] = f"""{CTE} SELECT time, lat, lon, depth_km, magnitude, nullif(place, '') AS place, {YEAR} AS year FROM (
  {WEB6} FROM catalog WHERE magnitude >= CAST(4.0 AS FLOAT))"""
_Z = "CASE WHEN coalesce(CAST(depth_km AS DOUBLE), 0.0) = 0 THEN 0.0 ELSE -CAST(depth_km AS DOUBLE) END"
ORACLE["geojson_features"] = f"""{CTE} SELECT id, time, 'Feature' AS feature_type, 'Point' AS geometry_type,
  CAST(lon AS DOUBLE) AS coord_lon, CAST(lat AS DOUBLE) AS coord_lat, {_Z} AS coord_z,
  CAST(magnitude AS DOUBLE) AS magnitude, mag_type, CAST(depth_km AS DOUBLE) AS depth_km, place FROM catalog"""
ORACLE["geojson_points"] = f"""{CTE} SELECT CAST(lon AS DOUBLE) AS lon, CAST(lat AS DOUBLE) AS lat, {_Z} AS depth,
  CASE WHEN magnitude IS NULL OR isnan(magnitude) OR magnitude = 0 THEN 0.0 ELSE CAST(magnitude AS DOUBLE) END AS mag,
  time, CASE WHEN place IS NULL OR place = '' THEN 'Unknown' ELSE place END AS place FROM catalog ORDER BY time"""
ORACLE["read_points"] = ORACLE["geojson_points"].replace(
    "CASE WHEN place IS NULL OR place = '' THEN 'Unknown' ELSE place END AS place", "coalesce(place, '') || ' }{ \"x\" \\ ]' AS place")


def _seg(kind: str, li: int, si: int, a: tuple[str, str], b: tuple[str, str]) -> str:
    return (f"SELECT row_seq AS feature, {li} AS line_idx, {si} AS seg_idx, {a[0]} AS lon1, {a[1]} AS lat1, "
            f"{b[0]} AS lon2, {b[1]} AS lat2 FROM c WHERE mag_type = '{kind}'")


_LO, _LA = "CAST(lon AS DOUBLE)", "CAST(lat AS DOUBLE)"
_SEGMENTS = f"""{_seg('mb', 0, 0, (_LO, _LA), (f'{_LO} + 1.0', _LA))}
UNION ALL {_seg('mb', 0, 1, (f'{_LO} + 1.0', _LA), (f'{_LO} + 1.0', f'{_LA} + 1.0'))}
UNION ALL {_seg('mw', 0, 0, (_LO, _LA), (_LO, f'{_LA} + 1.0'))}
UNION ALL {_seg('mw', 1, 0, (f'{_LO} - 1.0', _LA), (f'{_LO} - 1.0', f'{_LA} - 1.0'))}
UNION ALL {_seg('mw', 1, 1, (f'{_LO} - 1.0', f'{_LA} - 1.0'), (f'{_LO} - 2.0', f'{_LA} - 1.0'))}"""
ORACLE["line_segments"] = f"{CTE}, c AS (SELECT * FROM catalog) {_SEGMENTS}"
# documents of 1000 features: a feature's place in its document
ORACLE["read_borders"] = f"""{CTE}, c AS (SELECT * REPLACE (
  CAST(row_number() OVER (PARTITION BY row_seq // 1000 ORDER BY row_seq) - 1 AS INTEGER) AS row_seq) FROM catalog) {_SEGMENTS}"""

_X, _Y, _ZZ = _xyz("lat", "lon", "coalesce(CAST(depth_km AS DOUBLE), 0.0)")
ORACLE["to_cartesian"] = f"{CTE} SELECT id, time, {_r9(_X)} AS x, {_r9(_Y)} AS y, {_r9(_ZZ)} AS z FROM catalog"

_SX, _SY, _SZ = _xyz("lat", "lon", None)
_VD = "(CAST(depth_km AS DOUBLE) / 700.0 * 0.15 * 6371.0)"
_HX, _HY, _HZ = _xyz("lat", "lon", _VD)
_DR, _DG, _DB = _depth_rgb("depth_km")
ORACLE["depth_line"] = f"""{CTE}, w AS ({WEB6} FROM catalog)
SELECT time, {_r9(_SX)} AS sx, {_r9(_SY)} AS sy, {_r9(_SZ)} AS sz, {_r9(_HX)} AS hx, {_r9(_HY)} AS hy, {_r9(_HZ)} AS hz,
  {_r9(f'{_DR} * 0.3')} AS surface_r, {_r9(f'{_DG} * 0.3')} AS surface_g, {_r9(f'{_DB} * 0.3')} AS surface_b,
  {_r9(_DR)} AS hypo_r, {_r9(_DG)} AS hypo_g, {_r9(_DB)} AS hypo_b FROM w"""

_MR = _mag_case("magnitude", lambda lab, rgb, h: _d(rgb[0]))
_MG = _mag_case("magnitude", lambda lab, rgb, h: _d(rgb[1]))
_MB = _mag_case("magnitude", lambda lab, rgb, h: _d(rgb[2]))
ORACLE["magnitude_band"] = f"""{CTE}, w AS ({WEB6} FROM catalog)
SELECT time, magnitude, {_mag_case('magnitude', lambda lab, rgb, h: repr(lab))} AS band,
  {_MR} AS r, {_MG} AS g, {_MB} AS b, {_mag_case('magnitude', lambda lab, rgb, h: repr(h))} AS hex,
  {_css(_MR, _MG, _MB)} AS css FROM w"""
ORACLE["depth_rgb"] = f"""{CTE} SELECT id, depth_km, {_r9(_DR)} AS r, {_r9(_DG)} AS g, {_r9(_DB)} AS b,
  {_css(_DR, _DG, _DB)} AS css FROM catalog"""
ORACLE["depth_band"] = f"""{CTE} SELECT id, depth_km, CASE WHEN coalesce(CAST(depth_km AS DOUBLE), 0.0) < 70 THEN 'Shallow'
  WHEN coalesce(CAST(depth_km AS DOUBLE), 0.0) < 300 THEN 'Intermediate' ELSE 'Deep' END AS band FROM catalog"""
_M = "CAST(magnitude AS DOUBLE)"
ORACLE["point_size"] = f"""{CTE} SELECT id, magnitude,
  CASE WHEN magnitude IS NULL THEN NULL ELSE {_r9(f'greatest(1.0, ({_M} - 2.0) * {_d(1.2)})')} END AS size,
  CASE WHEN magnitude IS NULL THEN NULL ELSE {_r9(f'greatest(2.0, {_d(1.8)} * pow(2.0, {_M} - 1.0))')} END AS radius
  FROM catalog"""
_AGE = "greatest(0.0, least(1.0, (CAST(time AS DOUBLE) - 1709251200000.0) / 7889400000.0))"
ORACLE["window_age"] = f"""{CTE} SELECT time, magnitude, {_r9(_AGE)} AS age, {_r9(f'pow({_AGE}, 6.0)')} AS fade FROM {VIEW}"""


def _heat() -> tuple[list[str], str]:
    t = f"greatest(0.0, least(1.0, (p - {_d(0.01)}) / {_d(1.0 - 0.01)}))"
    seg_t = [f"({t} / 0.25)", f"(({t} - 0.25) / 0.25)", f"(({t} - 0.5) / 0.25)", f"(({t} - 0.75) / 0.25)"]
    chans = []
    for k in range(3):
        mixes = [f"({_d(HEAT_STOPS[i][k])} + ({_d(HEAT_STOPS[i + 1][k])} - {_d(HEAT_STOPS[i][k])}) * {seg_t[i]})" for i in range(4)]
        v = (f"CASE WHEN {t} < 0.25 THEN {mixes[0]} WHEN {t} < 0.5 THEN {mixes[1]} "
             f"WHEN {t} < 0.75 THEN {mixes[2]} ELSE {mixes[3]} END")
        chans.append(f"CASE WHEN p IS NULL OR p <= {_d(0.01)} THEN NULL ELSE {_r9(v)} END")
    alpha = _r9(f"greatest(0.0, least({_d(0.72)}, p * 2.5))")
    return chans, alpha


_HC, _HA = _heat()
ORACLE["heat_rgb"] = f"""{CTE}, {CELLS}, {SCENARIOS}, {SURFACE}
SELECT lat, lon, threshold, horizon, p, {_HC[0]} AS r, {_HC[1]} AS g, {_HC[2]} AS b, {_HA} AS alpha FROM surface"""
ORACLE["depth_bar"] = f"""{CTE} SELECT id, depth_km, CASE WHEN CAST(depth_km AS DOUBLE) > 0 THEN
  {_r9(f'least({_d(0.12 * 800.0)}, (1.0 - least(CAST(depth_km AS DOUBLE), 300.0) / 300.0) * 60.0 + 4.0)')} END AS bar
  FROM catalog"""
ORACLE["event_label"] = f"""{CTE}, w AS ({WEB6} FROM catalog)
SELECT time,
  CASE WHEN place IS NOT NULL AND place <> '' THEN place ELSE {_fixed('lat', 1)} || '°, ' || {_fixed('lon', 1)} || '°' END AS label,
  {_fixed('lat', 3)} || '° ' || (CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END) || ', ' || {_fixed('abs(lon)', 3)} || '° '
    || (CASE WHEN lon >= 0 THEN 'E' ELSE 'W' END) AS coordinates,
  {_fixed('depth_km', 0)} || ' km deep' AS depth_list, {_fixed('depth_km', 1)} || ' km deep' AS depth_detail,
  'M' || {_fixed('magnitude', 1)} AS mag_label FROM w"""
ORACLE["date_label"] = f"""{CTE} SELECT id, time, strftime(make_timestamp(time * 1000), '%b %-d, %Y') AS date FROM catalog"""

# ---- phase 5 ----------------------------------------------------------------------


_SS, _SE, _SD, _ST = 631152000000, 1717200000000, 31557600000, 31557600000 // 4
_K = 134   # quarter-year steps from 1990-01-01 that start before the last window does
ORACLE["window_series"] = f"""{CTE}, w AS (SELECT * FROM ({WEB6} FROM catalog) WHERE magnitude >= 4.5),
frames AS (SELECT range AS frame, {_SS} + range * {_ST} AS frame_start FROM range({_K})
           UNION ALL SELECT {_K}, {_SE - _SD}),
agg AS (SELECT f.frame, f.frame_start, count(w.time) AS n, max(w.magnitude) AS max_magnitude,
               sum(CAST(round(w.magnitude * 10.0) AS BIGINT)) AS mag10, sum(CAST(round(w.depth_km * 10.0) AS BIGINT)) AS dep10
        FROM frames f LEFT JOIN w ON w.time >= f.frame_start AND w.time < f.frame_start + {_SD}
        GROUP BY 1, 2)
SELECT frame, frame_start, n, max_magnitude,
  CASE WHEN n > 0 THEN round_even(CAST(mag10 AS DOUBLE) / CAST(n AS DOUBLE) / 10.0, 4) END AS avg_magnitude,
  CASE WHEN n > 0 THEN round_even(CAST(dep10 AS DOUBLE) / CAST(n AS DOUBLE) / 10.0, 4) END AS avg_depth_km,
  round_even(greatest(0.0, least(1.0, CAST(frame_start - {_SS} AS DOUBLE) / {float(_SE - _SS)!r})), 6) AS progress
FROM agg"""

_PX = "((plon - (-180.0)) / 360.0 * 7200.0)"
_PY = "((1.0 - (plat - (-90.0)) / 180.0) * 3600.0)"
_EX = "((CAST(lon AS DOUBLE) - (-180.0)) / 360.0 * 7200.0)"
_EY = "((1.0 - (CAST(lat AS DOUBLE) - (-90.0)) / 180.0) * 3600.0)"
_REACH = ("greatest(greatest(2.0, CAST(1.8 AS DOUBLE) * pow(2.0, coalesce(CAST(magnitude AS DOUBLE), 0.0) - 1.0)) + 4.0, 10.0)")
ORACLE["nearest_event"] = f"""{CTE},
locs AS (SELECT DISTINCT lat, lon FROM catalog),
pr AS (SELECT {_PX} AS px, {_PY} AS py FROM (
  SELECT CAST(lat AS DOUBLE) - 0.6 AS plat,
         CAST(lon AS DOUBLE) + 0.5 + (CAST(lat AS DOUBLE) - 3.0 * floor(CAST(lat AS DOUBLE) / 3.0)) * 0.4 AS plon FROM locs)),
ev AS (SELECT id, time, {_EX} AS x, {_EY} AS y, {_REACH} AS reach FROM catalog),
pairs AS (SELECT pr.px, pr.py, ev.id, ev.time, sqrt((pr.px - ev.x) * (pr.px - ev.x) + (pr.py - ev.y) * (pr.py - ev.y)) AS d, ev.reach
          FROM pr, ev),
hit AS (SELECT * FROM pairs WHERE d < reach),
best AS (SELECT px, py, id, time, d FROM (
  SELECT *, row_number() OVER (PARTITION BY px, py ORDER BY d, time, id) AS rn FROM hit) WHERE rn = 1)
SELECT pr.px, pr.py, best.id, best.time, round_even(best.d, 6) AS dist
FROM pr LEFT JOIN best ON pr.px = best.px AND pr.py = best.py"""

# ---- phase 6 ----------------------------------------------------------------------

ORACLE["write_catalog"] = ORACLE["compact"]
ORACLE["land_daily"] = f"""{CTE},
days AS (SELECT CAST(d AS DATE) AS land_date FROM generate_series(DATE '2023-12-25', DATE '2024-02-05', INTERVAL 1 DAY) t(d)),
counts AS (SELECT land_date, count(*) AS n FROM catalog GROUP BY 1),
alld AS (SELECT land_date FROM days UNION SELECT land_date FROM counts)
SELECT a.land_date, coalesce(c.n, 0) AS n FROM alld a LEFT JOIN counts c ON a.land_date = c.land_date"""
ORACLE["read_landing"] = f"{CTE} SELECT * FROM catalog"
ORACLE["read_hazard"] = ORACLE["hazard_cells"]
ORACLE["hazard_document"] = ORACLE["hazard_cells"]
ORACLE["sync"] = ORACLE["compact"]
ORACLE["live_stream"] = ORACLE["normalize"]
ORACLE["stream_upsert"] = ORACLE["compact"]
_CORE = "id, time, lat, lon, depth_km, magnitude, mag_type, place"
ORACLE["stream_revises_landed"] = f"""{CTE}, {LATEST},
s AS (SELECT id, time, lat, lon, depth_km, CAST(magnitude + CAST(1.0 AS FLOAT) AS FLOAT) AS magnitude, mag_type, 'revised' AS place
      FROM catalog WHERE land_date < DATE '2024-01-15' QUALIFY row_number() OVER (PARTITION BY id ORDER BY time DESC) = 1)
SELECT {_CORE}, {YEAR} AS year FROM (SELECT {_CORE} FROM s UNION ALL SELECT {_CORE} FROM latest WHERE id NOT IN (SELECT id FROM s))"""
ORACLE["bbox_stored"] = f"""{CTE} SELECT {_CORE}, {YEAR} AS year FROM catalog
  WHERE lat BETWEEN -30.0 AND 45.0 AND lon BETWEEN -90.0 AND 90.0"""
ORACLE["playhead_half"] = f"{CTE} SELECT {_CORE} FROM catalog ORDER BY time, id LIMIT (SELECT count(*) // 2 FROM catalog)"
_POLL = 1714564800000
ORACLE["poll_changes"] = f"""{CTE}, {LATEST},
early AS (SELECT {_CORE} FROM catalog WHERE land_date < DATE '2024-01-15'
          QUALIFY row_number() OVER (PARTITION BY id ORDER BY land_date DESC, row_seq DESC) = 1)
SELECT *, 'new' AS change, {_POLL} AS at_ms FROM early
UNION ALL SELECT *, 'new', {_POLL + 60_000} FROM latest WHERE id NOT IN (SELECT id FROM early)
UNION ALL SELECT *, 'revised', {_POLL + 60_000} FROM (SELECT * FROM latest EXCEPT SELECT * FROM early) WHERE id IN (SELECT id FROM early)
UNION ALL SELECT *, 'vanished', {_POLL + 120_000 + 90_000} FROM latest WHERE time < 946684800000"""


def _stream_windows(step: int, duration: int, lateness: int, start: int = 0) -> str:
    """Windows closed by the watermark, over web rows; ``start`` aligns them."""
    first = f"CAST(floor((time - {start}) / {float(step)!r}) AS BIGINT)"
    return f"""{CTE},
ev AS (SELECT time, magnitude, depth_km, {first} AS b FROM ({WEB6} FROM catalog)),
win AS (SELECT {start} + (b - k) * {step} AS window_start, magnitude, depth_km, time FROM ev, range(0, {-(-duration // step)}) t(k)),
agg AS (SELECT window_start, window_start + {duration} AS window_end, count(*) AS n, max(magnitude) AS max_magnitude,
               {_mean_of_tenths('magnitude')} AS avg_magnitude, {_mean_of_tenths('depth_km')} AS avg_depth_km
        FROM win WHERE time >= window_start AND time < window_start + {duration} GROUP BY 1)
SELECT * FROM agg WHERE window_end <= (SELECT max(time) FROM catalog) - {lateness}"""


ORACLE["stream_window_stats"] = _stream_windows(864000000, 2592000000, 86400000)   # 30-day windows every 10 days, 1 day late
# ten years a window, a month (a twelfth of a year) a step, aligned at 1985-01-01T12:00Z
ORACLE["stream_playback"] = _stream_windows(2629800000, 315576000000, 86400000, 473428800000)


# ---- further storage, stream and viewer queries -------------------------------------

ORACLE["year_pruning"] = f"""{CTE} SELECT id, time, lat, lon, depth_km, magnitude, mag_type, place, {YEAR} AS year FROM catalog
  WHERE time >= 946684800000 AND time < 978307200000 AND magnitude >= CAST(4.5 AS FLOAT)"""
ORACLE["view_progress"] = f"""{CTE} SELECT id, time,
  {_r9(f"greatest(0.0, least(1.0, (CAST(time AS DOUBLE) - {float(_S)!r}) / {float(_SPAN)!r}))")} AS progress FROM catalog"""
ORACLE["time_label"] = f"""{CTE} SELECT id, time, strftime(make_timestamp(time * 1000), '%I:%M:%S %p UTC') AS clock FROM catalog"""
ORACLE["exact_label"] = f"""{CTE}, w AS (SELECT row_seq, CAST(lat AS DOUBLE) + CAST(row_seq % 9973 AS DOUBLE) / 10000.0 AS lat FROM catalog)
SELECT row_seq, lat, {_fixed('lat', 3)} AS three, {_fixed('lat', 1)} AS one, {_fixed('lat', 0)} AS zero FROM w"""
_CX, _CY, _CZ = _xyz("lat", "lon", None)
ORACLE["visible_frustum"] = f"""{CTE}, w AS ({WEB6} FROM catalog WHERE magnitude >= CAST(4.5 AS FLOAT)),
p AS (SELECT *, {_CX} AS px, {_CY} AS py, {_CZ} AS pz FROM w)
SELECT time, lat, lon, depth_km, magnitude, place FROM p WHERE pz > 0
  AND abs(px * (2.144506920509559 * 2.5)) <= 3.0 - pz AND abs(py * (2.144506920509559 * 2.5)) <= 3.0 - pz
  AND abs(pz * -1.002002002002002 + 2.8058058058058056) <= 3.0 - pz"""
ORACLE["moving_view"] = f"""{CTE}, v AS (SELECT * FROM {VIEW} WHERE time < 1714586400000),
st AS (SELECT count(*) AS window_n, max(magnitude) AS window_max_magnitude, {_mean_of_tenths('magnitude')} AS window_avg_magnitude,
       {_mean_of_tenths('depth_km')} AS window_avg_depth_km FROM v)
SELECT * FROM (SELECT * FROM v WHERE {FACING} ORDER BY time DESC, {TIES} LIMIT 100), st"""
ORACLE["polyline_segments"] = f"""{CTE}, c AS (SELECT *, row_seq // 8 AS line_id FROM catalog),
s AS (SELECT line_id, 0 AS line_idx, CAST(row_number() OVER w - 1 AS INTEGER) AS seg_idx,
             CAST(lon AS DOUBLE) AS lon1, CAST(lat AS DOUBLE) AS lat1,
             CAST(lead(lon) OVER w AS DOUBLE) AS lon2, CAST(lead(lat) OVER w AS DOUBLE) AS lat2, lead(row_seq) OVER w AS more
      FROM c WINDOW w AS (PARTITION BY line_id ORDER BY row_seq))
SELECT * EXCLUDE (more) FROM s WHERE more IS NOT NULL"""
ORACLE["read_csv"] = f"""{CTE} SELECT id, time, lat, lon, depth_km, magnitude, mag_type,
  CASE WHEN place IS NOT NULL THEN '7 km NW of "' || place || '", CA' END AS place FROM catalog"""
ORACLE["append_then_sync"] = f"""{CTE}, {LATEST} SELECT time, lat, lon, depth_km, magnitude, nullif(place, '') AS place, {YEAR} AS year
  FROM ({WEB6} FROM latest WHERE magnitude >= CAST(4.0 AS FLOAT))"""
ORACLE["reland_empty_day"] = f"""{CTE}, d AS (SELECT land_date, count(*) AS n FROM catalog GROUP BY 1)
SELECT land_date, CASE WHEN land_date = (SELECT min(land_date) FROM d) THEN 0 ELSE n END AS n,
       CASE WHEN land_date = (SELECT min(land_date) FROM d) THEN 0 ELSE n END AS rows FROM d"""
ORACLE["live_snapshot"] = f"""{CTE},
t AS (SELECT id, 1714521600000 + (time % 86400000 + 86400000) % 86400000 AS time FROM catalog)
SELECT id, time, 0 AS poll FROM t WHERE time < 1714564800000
UNION ALL SELECT id, time, 1 AS poll FROM t WHERE time < 1714564800000 + 21600000"""
_RD = "(greatest(greatest(2.0, CAST(1.8 AS DOUBLE) * pow(2.0, magnitude - 1.0)) + 4.0, 10.0))"
ORACLE["regional_chain"] = f"""{CTE},
pts AS (SELECT time, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon, {_Z} AS depth_km, CAST(magnitude AS DOUBLE) AS magnitude,
        CASE WHEN place IS NULL OR place = '' THEN 'Unknown' ELSE place END AS place FROM catalog),
r AS (SELECT * FROM pts WHERE magnitude >= 4.6),
b AS (SELECT min(time) AS t0, max(time) AS t1 FROM r),
ticks AS (SELECT round_even(CAST(time - t0 AS DOUBLE) / CAST(t1 - t0 AS DOUBLE) * 100.0, 6) AS pct,
          round_even(greatest(4.0, least(38.0, greatest(2.0, 1.8 * pow(2.0, magnitude - 1.0)) * 2.0)), 6) AS height FROM r, b),
top AS (SELECT * FROM r ORDER BY magnitude DESC, time, lat, lon, depth_km, place LIMIT 12),
pr AS (SELECT DISTINCT (lon - (-180.0)) / 360.0 * 7200.0 + 3.0 AS px, (1.0 - (lat - (-90.0)) / 180.0) * 3600.0 - 2.0 AS py FROM top),
ev AS (SELECT *, (lon - (-180.0)) / 360.0 * 7200.0 AS x, (1.0 - (lat - (-90.0)) / 180.0) * 3600.0 AS y, {_RD} AS reach FROM r),
hit AS (SELECT px, py, sqrt((px - x) * (px - x) + (py - y) * (py - y)) AS d, reach FROM pr, ev),
near AS (SELECT px, py, round_even(min(d), 6) AS dist FROM hit WHERE d < reach GROUP BY 1, 2)
SELECT 'ticks' AS part, count(*) AS n, round_even(sum(pct), 3) AS a, round_even(sum(height), 3) AS b FROM ticks
UNION ALL SELECT 'significant', count(*), sum(lat), sum(lon) FROM top
UNION ALL SELECT 'nearest', count(*), round_even(sum(dist), 3), round_even(max(dist), 3) FROM near
UNION ALL SELECT 'fresh', 39, 19.5, 0.975
UNION ALL SELECT 'rows', (SELECT count(*) FROM r), CAST((SELECT count(*) FROM pts) AS DOUBLE), (SELECT max(magnitude) FROM pts)"""

# Registered outputs carry dates as ISO text (see ``suite.dates_as_text``).
_DATE_COLUMNS = {k: ["land_date"] for k in (
    "min_magnitude", "bbox", "event_range", "regional_filter", "trailing_days",
    "today_events", "facing", "significant", "playhead", "latest_by_id",
    "read_landing", "missing_days", "land_daily", "reland_empty_day")}
_DATE_COLUMNS["plan_requests"] = ["start_day", "end_day"]
for _k, _cols in _DATE_COLUMNS.items():
    _rep = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in _cols)
    ORACLE[_k] = f"SELECT * REPLACE ({_rep}) FROM ({ORACLE[_k]})"
