"""Fixed schemas and constants of the event catalog."""

from __future__ import annotations

from pyspark.sql import types as T

# The catalog's column order and the raw-to-core renames.
CORE_COLUMNS = ["id", "time", "lat", "lon", "depth_km", "magnitude", "mag_type", "place"]

RAW_RENAMES = {
    "latitude": "lat",
    "longitude": "lon",
    "depth": "depth_km",
    "mag": "magnitude",
    "magType": "mag_type",
}

# Raw CSV columns read as double (all others stay text).
RAW_DOUBLE_COLUMNS = [
    "latitude", "longitude", "depth", "mag", "nst", "gap", "dmin", "rms",
    "horizontalError", "depthError", "magError", "magNst",
]

# Column order of the catalog service's CSV format.
RAW_CSV_COLUMNS = [
    "time", "latitude", "longitude", "depth", "mag", "magType", "nst", "gap", "dmin", "rms",
    "net", "id", "updated", "place", "type", "horizontalError", "depthError", "magError",
    "magNst", "status", "locationSource", "magSource",
]

# Raw CSV null markers.
RAW_NULL_MARKERS = ["", "null"]

CORE_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), True),
    T.StructField("time", T.LongType(), True),        # Unix ms, UTC
    T.StructField("lat", T.FloatType(), True),
    T.StructField("lon", T.FloatType(), True),
    T.StructField("depth_km", T.FloatType(), True),
    T.StructField("magnitude", T.FloatType(), True),
    T.StructField("mag_type", T.StringType(), True),
    T.StructField("place", T.StringType(), True),
])

LANDING_SCHEMA = T.StructType(
    CORE_SCHEMA.fields
    + [T.StructField("land_date", T.DateType(), True), T.StructField("row_seq", T.LongType(), True)]
)

LANDED_DAYS_SCHEMA = T.StructType([
    T.StructField("land_date", T.DateType(), False),
    T.StructField("n", T.LongType(), False),
])

WEB_COLUMNS = ["time", "lat", "lon", "depth_km", "magnitude", "place"]

# Time constants (ms).
DAY_MS = 86_400_000
YEAR_MS = 31_557_600_000            # 365.25 days
CATALOG_START_MS = 631_152_000_000  # 1990-01-01T00:00:00Z
DATA_START_MS = -2_208_988_800_000  # 1900-01-01T00:00:00Z

# Window lengths offered by the viewer (fractions of YEAR_MS).
WINDOW_STEPS_MS = {
    "1 MO": YEAR_MS // 12,
    "3 MO": YEAR_MS // 4,
    "6 MO": YEAR_MS // 2,
    "1 YR": YEAR_MS,
    "5 YR": YEAR_MS * 5,
    "10 YR": YEAR_MS * 10,
}

# Hazard model.
HAZARD_MC = 4.5
HAZARD_GRID_DEG = 2
HAZARD_MIN_EVENTS = 10

# Request splitting.
MAX_EVENTS_PER_REQUEST = 20_000
MAX_SPLIT_DEPTH = 14

# Earth radius and depth scale used by the globe.
EARTH_RADIUS_KM = 6371.0
MAX_DEPTH_KM = 700.0
MAX_VISUAL_DEPTH = 0.15

# Default viewer camera position.
DEFAULT_CAMERA = (-0.197, 1.108, 1.405)

# Regional page bounds.
CA_BOUNDS = {"min_lat": 32.5, "max_lat": 42.0, "min_lon": -124.5, "max_lon": -114.1}
