"""Ordered reports: visible recent events, significant events, playhead, freshness.

Top-k uses ``orderBy(...).limit(k)``, which Spark plans as TakeOrderedAndProject:
each task keeps its own k best, one small merge at the end; a k that is not small is selected without one. Ties get a final
key (``id``) so results repeat run to run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import threshold_for
from ..schema import DEFAULT_CAMERA
from .filters import facing, in_frustum

FRESHNESS_SPAN = 40


def _tie_keys(df: DataFrame, skip: tuple[str, ...]) -> list:
    if "id" in df.columns:
        return [F.col("id").asc_nulls_first()]
    return [F.col(c).asc_nulls_first() for c in df.columns if c not in skip]


def visible_recent(rows: DataFrame, camera=DEFAULT_CAMERA, k: int = 100, matrix=()) -> DataFrame:
    """Events on the camera's side of the globe and, given its matrix, inside its view: newest first, ``k`` of them."""
    return in_frustum(facing(rows, camera), matrix).orderBy(F.col("time").desc(), *_tie_keys(rows, ("time",))).limit(k)


def significant(df: DataFrame, min_mag: float = 3.0, k: int = 12) -> DataFrame:
    """Largest first; equal magnitudes keep time order (the page sorts a time-ordered list)."""
    mag = F.coalesce(F.col("magnitude"), threshold_for(df, "magnitude", 0.0))
    return (
        df.filter(mag >= threshold_for(df, "magnitude", min_mag))
        .orderBy(mag.desc(), F.col("time").asc(), *_tie_keys(df, ("magnitude", "time")))
        .limit(k)
    )


#: Up to so many rows a top-k merges in one task; more are selected by refining histograms.
TAKE_MOST = 100_000
HISTOGRAM = 4096


def playhead(df: DataFrame, k: int, take_most: int = TAKE_MOST) -> DataFrame:
    """The first ``k`` events in time order (what the regional page has drawn so far).

    A large ``k`` is not merged in one task: histograms of the times find the time of the k-th event (each
    refines one bucket of the last, a few scans in all), among its ties the id, and the rows up to there
    are filtered and sorted by ranges.
    """
    keys = [F.col("time").asc(), *_tie_keys(df, ("time",))]
    if k <= take_most:
        return df.orderBy(*keys).limit(k)
    kept, ties, need = _split_at(df, F.col("time"), k)
    if ties is not None and need > take_most and "id" in df.columns:
        more, ties, need = _first_ids(ties, need)
        kept = kept.unionByName(more)
    if ties is not None:
        every = [F.col(c) for c in df.columns]
        if need > take_most:
            more, ties, need = _split_at(ties, F.xxhash64(*every), need)
            kept = kept.unionByName(more)
            if ties is not None:     # equal rows: any of them, as often as needed
                ties = ties.limit(1).withColumn("_", F.explode(F.sequence(F.lit(1), F.lit(need)))).drop("_")
        else:
            ties = ties.orderBy(*keys).limit(need)
    return (kept if ties is None else kept.unionByName(ties)).orderBy(*keys)


def _split_at(df: DataFrame, value: Column, k: int) -> tuple[DataFrame, DataFrame | None, int]:
    """The rows below the k-th least whole number ``value`` (null first), the rows that tie with it (None if all are wanted,
    and then among the first), and how many of these are wanted."""
    size = df.agg(F.count(F.lit(1)).alias("n"), F.count(value).alias("known"), F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    if k >= size["n"]:
        return df, None, 0
    nulls = size["n"] - size["known"]
    if k <= nulls:
        none = df.where(value.isNull())
        return (none, None, 0) if k == nulls else (df.limit(0), none, k)
    need, lo, hi, here = k - nulls, size["lo"], size["hi"], size["known"]
    while lo < hi and need < here:
        width = (hi - lo) // HISTOGRAM + 1
        inside = df.where((value >= F.lit(lo)) & (value <= F.lit(hi)))
        # decimals: the span of all 64-bit numbers is no 64-bit number
        bucket = F.floor((value.cast("decimal(20,0)") - F.lit(lo).cast("decimal(20,0)")) / F.lit(width).cast("decimal(20,0)"))
        counts = sorted((int(r[0]), r[1]) for r in inside.groupBy(bucket).count().collect())    # at most HISTOGRAM rows
        for at, here in counts:
            if need <= here:
                break
            need -= here
        lo, hi = lo + at * width, min(hi, lo + (at + 1) * width - 1)
    first = value.isNull() | (value < F.lit(lo))
    if need == here:
        return df.where(first | (value <= F.lit(hi))), None, 0
    return df.where(first), df.where(value == F.lit(lo)), need


def _first_ids(ties: DataFrame, need: int) -> tuple[DataFrame, DataFrame | None, int]:
    """As ``_split_at`` for the ids of rows of one time, by their bytes: null, then byte by byte."""
    spelled = F.hex(F.col("id").cast("binary"))
    nulls = ties.where("id IS NULL").count()
    if need <= nulls:
        none = ties.where("id IS NULL")
        return (none, None, 0) if need == nulls else (ties.limit(0), none, need)
    need, prefix, below = need - nulls, "", F.col("id").isNull()
    while True:
        inside = ties.where(F.startswith(spelled, F.lit(prefix)))
        byte = F.substring(spelled, len(prefix) + 1, 2)                # empty where the id ends
        counts = sorted((r[0], r[1]) for r in inside.groupBy(byte).count().collect())           # at most 257 rows
        for at, here in counts:
            if need <= here:
                break
            need -= here
        below = below | (F.startswith(spelled, F.lit(prefix)) & (byte < F.lit(at)))
        chosen = F.startswith(spelled, F.lit(prefix)) & (byte == F.lit(at))
        if need == here:
            return ties.where(below | chosen), None, 0
        if not at:
            return ties.where(below), ties.where(chosen), need
        prefix += at


def freshness(df: DataFrame, span: int = FRESHNESS_SPAN) -> DataFrame:
    """``max(0, 1 - age/span)`` with age 1 for the newest event, 2 for the next...

    Ages are positions, so rows with equal keys have different ages. Without an
    ``id`` the other columns order equal times. Only the newest ``span - 1`` rows
    are non-zero: one top-k of that size numbers them. Every other row lies below
    the oldest of them, or repeats its key; such repeats are counted and emitted
    as zeros. No join and no window over the table.
    """
    keys = ["time", "id"] if "id" in df.columns else ["time", *[c for c in df.columns if c != "time"]]
    out = ["id", "time"] if "id" in df.columns else keys
    key = F.struct(*keys)
    newest = df.select(key.alias("k")).orderBy(F.col("k").desc()).limit(span - 1)
    ranked = newest.agg(F.sort_array(F.collect_list("k"), asc=False).alias("ks")).select(F.posexplode("ks").alias("p", "k"))
    fresh = F.lit(1.0) - (F.col("p") + 1).cast("double") / F.lit(float(span))
    top = ranked.select("k.*", fresh.alias("freshness"))
    oldest = newest.agg(F.struct(F.min("k").alias("k")).alias("s")).scalar()["k"]
    older = df.where(key < oldest).select(*keys, F.lit(0.0).alias("freshness"))
    kept = newest.groupBy("k").agg(F.count(F.lit(1)).alias("kept")).orderBy("k").limit(1)
    tied = df.select(key.alias("k")).where(F.col("k") == oldest).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    spare = F.col("n") - kept.select("kept").scalar()
    repeats = tied.select("k", F.explode(F.sequence(F.lit(1).cast("long"), F.when(spare > 0, spare))).alias("_"))
    return top.unionByName(older).unionByName(repeats.select("k.*", F.lit(0.0).alias("freshness"))).select(*out, "freshness")
