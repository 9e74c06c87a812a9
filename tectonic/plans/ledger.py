"""A backfill's request ledger: ranges of days, each below a size limit, with a state of its own.

The missing days are halved until a range's raw files are smaller than the limit (``size_bounded_splits``,
weighed by file size, so nothing is read for the plan); the
ranges are kept in the catalog's manifest. Each is landed by itself, and the commit that makes its rows visible
marks it done, so an interrupted backfill goes on with the next range and repeats none. A range that has grown
beyond the limit since is halved again; one day is never divided.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import DAY_MS
from ..sources import manifest
from .splits import size_bounded_splits

#: Raw bytes of one landing: some minutes of work to repeat.
BATCH_BYTES = 4 << 30
_EPOCH = date(1970, 1, 1)


def _ms(day: str) -> int:
    return (date.fromisoformat(day) - _EPOCH).days * DAY_MS


def _day(ms: int) -> str:
    return (_EPOCH + timedelta(days=-(-ms // DAY_MS))).isoformat()


def raw_sizes(spark: SparkSession, raw_path: str) -> DataFrame:
    """(land_date, bytes) of every raw file: the listing alone, no file is opened."""
    files = spark.read.format("binaryFile").load(raw_path)
    if "land_date" not in files.columns:
        return spark.createDataFrame([], "land_date date, bytes long")
    return files.select(F.col("land_date").cast("date").alias("land_date"), F.col("length").alias("bytes"))


def _between(sizes: DataFrame, first: str, last: str) -> DataFrame:
    return sizes.where(F.col("land_date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def size_of(sizes: DataFrame, one: dict) -> int:
    return _between(sizes, one["first"], one["last"]).agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]


def plan_ranges(sizes: DataFrame, first: str, last: str, max_bytes: int = BATCH_BYTES) -> list[dict]:
    """Ranges of days (first and last, both included) that cover the span, each smaller than ``max_bytes`` or a
    single day."""
    total = size_of(sizes, {"first": first, "last": last})
    if total < max_bytes:
        return [{"first": first, "last": last, "bytes": total, "done": False}]
    span = _between(sizes, first, last).select(F.unix_millis(F.col("land_date").cast("timestamp")).alias("time"), "bytes")
    days = (date.fromisoformat(last) - date.fromisoformat(first)).days + 1
    # deep enough that a leaf is a day at least
    leaves = size_bounded_splits(span, _ms(first), _ms(last) + DAY_MS, max_bytes, max(1, min(14, days.bit_length())), weight="bytes")
    out: list[dict] = []
    for leaf in leaves.orderBy("start_ms").collect():       # as many as there are ranges
        a, b = _day(leaf["start_ms"]), _day(leaf["end_ms"])      # the first midnights from the bounds on
        if a < b:
            out.append({"first": a, "last": (date.fromisoformat(b) - timedelta(days=1)).isoformat(), "bytes": leaf["n"], "done": False})
    return out


def open_ranges(spark: SparkSession, path: str, sizes: DataFrame, days: list[str], max_bytes: int = BATCH_BYTES) -> list[dict]:
    """The ranges still to be landed for the missing ``days``: those of an interrupted backfill, and a plan for the rest."""
    known = [r for r in manifest.load(spark, path).requests if not r["done"]]
    left = [d for d in days if not any(r["first"] <= d <= r["last"] for r in known)]
    fresh = [r for a, b in manifest.day_ranges(set(left)) for r in plan_ranges(sizes, a, b, max_bytes)]
    if fresh:
        def change(state: manifest.Manifest) -> None:
            state.requests = [r for r in state.requests if not r["done"]] + fresh

        manifest.commit(spark, path, change)
    again = [{**r, "bytes": None} for r in known if any(r["first"] <= d <= r["last"] for d in days)]     # may have grown
    return sorted(again + fresh, key=lambda r: r["first"])


def halve(spark: SparkSession, path: str, one: dict) -> list[dict]:
    """Replace a range by its halves."""
    a, b = date.fromisoformat(one["first"]), date.fromisoformat(one["last"])
    middle = a + (b - a) // 2
    halves = [{"first": x.isoformat(), "last": y.isoformat(), "bytes": None, "done": False} for x, y in ((a, middle), (middle + timedelta(days=1), b))]

    def change(state: manifest.Manifest) -> None:
        state.requests = [r for r in state.requests if (r["first"], r["last"]) != (one["first"], one["last"])] + halves

    manifest.commit(spark, path, change)
    return halves


def mark_done(state: manifest.Manifest, one: dict) -> None:
    """For the commit that lands the range."""
    for r in state.requests:
        if (r["first"], r["last"]) == (one["first"], one["last"]):
            r["done"] = True
