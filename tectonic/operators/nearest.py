"""Nearest drawn event to a probe point on the regional map (the hover lookup).

An event at pixel ``(x, y)`` with radius ``r`` is in reach of a probe when the
distance is below ``max(r + 4, 10)``; the nearest wins and, at equal distance,
the earliest (then the least by the remaining columns).

Plan: at one place only an event that is earlier than every event of larger
reach can win, so the events of a place are reduced to that frontier (about the
logarithm of their number when magnitudes vary), first within salts of the
place, so a place with a third of all events is shared by many tasks, then over
the survivors. Reaches fall into classes that double. A
candidate is entered in the grid of its class, whose cells are as wide as the
class's largest reach, so it covers at most nine cells; a probe looks up one
cell per class. Cells are salted on the candidate side, the probes repeated
per salt, so a crowded cell is shared by several tasks. ``min`` of
``(distance, time, ...)`` per probe, partially aggregated, picks the winner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import project_box
from ..functions.numeric import round_half_even
from ..functions.style import mag_radius

REACH_PAD_PX = 4.0
MIN_REACH_PX = 10.0


#: Salts per grid cell: a crowded cell's candidates are shared by so many tasks.
SALTS = 4
#: Salts per place in the first reduction to its frontier.
PLACE_SALTS = 32


def event_pixels(events: DataFrame, bounds: dict, width: float, height: float) -> DataFrame:
    """Pixel position, reach and tie columns: ``time``, then ``id`` or, without one, the other columns."""
    x, y = project_box("lat", "lon", bounds, width, height)
    mag = F.coalesce(F.col("magnitude").cast("double"), F.lit(0.0))
    reach = F.greatest(mag_radius(mag) + F.lit(REACH_PAD_PX), F.lit(MIN_REACH_PX))
    return events.select(F.struct(*tie_columns(events)).alias("event"), x.alias("x"), y.alias("y"), reach.alias("reach"))


def tie_columns(events: DataFrame) -> list[str]:
    return ["time", "id"] if "id" in events.columns else ["time", *[c for c in events.columns if c != "time"]]


def frontier(pixels: DataFrame) -> DataFrame:
    """The events that can win a probe: per place, those earlier than every event that reaches farther.

    ``level`` is the reach class: its largest reach is ``MIN_REACH_PX * 2**level``.
    """
    def undone(rows: DataFrame, *place: str) -> DataFrame:
        wider = Window.partitionBy(*place).orderBy(F.col("reach").desc(), "event").rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn("_best", F.min("event").over(wider)).where(F.col("_best").isNull() | (F.col("event") < F.col("_best"))).drop("_best")

    per_reach = pixels.groupBy("x", "y", "reach").agg(F.min("event").alias("event"))
    salted = per_reach.withColumn("salt", F.pmod(F.xxhash64("event"), F.lit(PLACE_SALTS)))
    left = undone(undone(salted, "x", "y", "salt").drop("salt"), "x", "y")
    level = F.greatest(F.ceil(F.log2(F.col("reach") / F.lit(MIN_REACH_PX))), F.lit(0)).cast("int")
    return left.withColumn("level", level)


def nearest_event(
    probes: DataFrame,
    events: DataFrame,
    bounds: dict,
    width: float,
    height: float,
    probe_keys: list[str] | None = None,
    digits: int = 6,
) -> DataFrame:
    """For each distinct probe key (pixel columns ``px``, ``py``): the nearest event's tie columns and ``dist``, or nulls."""
    keys = probe_keys or ["px", "py"]
    shown = ["id", "time"] if "id" in events.columns else tie_columns(events)
    cands = frontier(event_pixels(events, bounds, width, height))
    most = pixel_levels(events)
    side = F.lit(MIN_REACH_PX) * F.pow(F.lit(2.0), F.col("level").cast("double"))

    def cells(centre: str) -> Column:
        at = F.floor(F.col(centre) / side)
        return F.sequence(at - 1, at + 1)

    salted = cands.withColumn("salt", F.pmod(F.xxhash64("event"), F.lit(SALTS)).cast("int"))
    entered = salted.select("x", "y", "reach", "event", "level", "salt", F.explode(cells("x")).alias("cx"), cells("y").alias("cys"))
    entered = entered.select("x", "y", "reach", "event", "level", "salt", "cx", F.explode("cys").alias("cy"))
    asked = probes.select(*keys, F.col("px").alias("_px"), F.col("py").alias("_py")).withColumn(
        "level", F.explode(F.sequence(F.lit(0), most))).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    asked = asked.select(*keys, "_px", "_py", "level", "salt", F.floor(F.col("_px") / side).alias("cx"), F.floor(F.col("_py") / side).alias("cy"))
    dist = F.sqrt((F.col("_px") - F.col("x")) * (F.col("_px") - F.col("x")) + (F.col("_py") - F.col("y")) * (F.col("_py") - F.col("y")))
    pairs = (
        asked.join(entered, ["level", "salt", "cx", "cy"])
        .select(*keys, dist.alias("d"), "reach", "event")
        .filter(F.col("d") < F.col("reach"))
        .select(*keys, F.struct("d", "event").alias("c"))
    )
    # every probe also enters the aggregate with a null candidate, so a probe
    # with nothing in reach keeps its row (min skips nulls) without a join
    none = probes.select(*keys, F.lit(None).cast(pairs.schema["c"].dataType).alias("c"))
    best = pairs.unionByName(none).groupBy(*keys).agg(F.min("c").alias("b"))
    return best.select(*keys, *[F.col(f"b.event.{c}").alias(c) for c in shown], round_half_even("b.d", digits).alias("dist"))


def pixel_levels(events: DataFrame) -> Column:
    """The largest reach class present (a scalar subquery over the magnitudes)."""
    mag = F.coalesce(F.col("magnitude").cast("double"), F.lit(0.0))
    reach = F.greatest(mag_radius(mag) + F.lit(REACH_PAD_PX), F.lit(MIN_REACH_PX))
    top = events.agg(F.max(reach).alias("reach")).scalar()
    return F.greatest(F.coalesce(F.ceil(F.log2(top / F.lit(MIN_REACH_PX))), F.lit(0)), F.lit(0)).cast("int")
