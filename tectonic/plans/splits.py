"""Size-bounded request ranges: the halving search of the range fetch, done in one pass.

A range ``[start, end)`` is halved until each part holds fewer than
``max_rows`` events, at most ``max_depth`` levels deep. With ``t' = time - start``
and ``span = end - start``, node ``i`` of level ``l`` covers
``[start + floor(i * span / 2^l), start + floor((i + 1) * span / 2^l))``; an
event's deepest node is ``d = ((t' + 1) * 2^D - 1) div span`` and its node at
level ``l`` is ``d >> (D - l)``.

Plan: one partial/final aggregate to at most ``2^D`` counts (the data-sized
step), then parameter-sized work: every count goes to its ancestors and is
summed per parent into left and right child. A node is split when its count
reaches ``max_rows`` (counts only shrink downwards, so every ancestor of a
split node is split); leaves are the children of split nodes that are not
split themselves, or the root when it is small. A split node at the deepest
level cannot be split further: it is returned with ``too_dense = true`` for
the caller to raise on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import MAX_EVENTS_PER_REQUEST, MAX_SPLIT_DEPTH


def size_bounded_splits(
    df: DataFrame,
    start_ms: int,
    end_ms: int,
    max_rows: int = MAX_EVENTS_PER_REQUEST,
    max_depth: int = MAX_SPLIT_DEPTH,
    weight: str | None = None,
) -> DataFrame:
    """Leaves of the halving tree: ``level, idx, start_ms, end_ms, n, too_dense``.

    Two aggregates, no join: events -> counts per deepest bucket (data-sized,
    partial/final); then every bucket count goes to its ancestors at levels
    ``1..D`` and is summed per *parent* into its left and right child. A parent
    is split when ``left + right >= max_rows``; its two children (an absent one
    has 0 rows) are leaves when below ``max_rows``, too dense when not and at
    the deepest level, and split further otherwise. The root is the parent of
    level 1; a zero-count bucket keeps it present when nothing is in range. With a column
    ``weight`` its sum takes the place of the number of rows.
    """
    spark = df.sparkSession
    span = int(end_ms) - int(start_ms)
    if span <= 0:
        raise ValueError("empty range")
    depth = int(max_depth)
    if depth < 1:
        raise ValueError("max_depth must be at least 1")
    limit = F.lit(int(max_rows))
    in_range = (F.col("time") >= F.lit(int(start_ms))) & (F.col("time") < F.lit(int(end_ms)))
    # integer division: these values pass 2^53 for spans of decades
    deepest = F.expr(f"((time - {int(start_ms)}L + 1L) * {1 << depth}L - 1L) div {span}L")
    buckets = (
        df.filter(in_range).groupBy(deepest.alias("d")).agg((F.sum(weight).cast("long") if weight else F.count(F.lit(1))).alias("n"))
        .unionByName(spark.range(1).select(F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("n")))
    )
    nodes = buckets.select("n", "d", F.explode(F.sequence(F.lit(1), F.lit(depth))).alias("level")).select(
        "level", "n", F.expr(f"shiftright(d, {depth} - level)").alias("idx"))
    parents = nodes.groupBy("level", F.shiftright("idx", 1).alias("parent")).agg(
        F.sum(F.when(F.col("idx") % 2 == 0, F.col("n")).otherwise(0)).alias("left"),
        F.sum(F.when(F.col("idx") % 2 == 1, F.col("n")).otherwise(0)).alias("right"),
    )
    total = F.col("left") + F.col("right")
    kids = parents.filter(total >= limit).select(
        "level",
        F.inline(F.array(
            F.struct((F.col("parent") * 2).alias("idx"), F.col("left").alias("n")),
            F.struct((F.col("parent") * 2 + 1).alias("idx"), F.col("right").alias("n")),
        )),
    )
    child_rows = kids.filter((F.col("n") < limit) | (F.col("level") == depth)).select(
        "level", "idx", "n", (F.col("n") >= limit).alias("too_dense"))
    root_row = parents.filter((F.col("level") == 1) & (total < limit)).select(
        F.lit(0).alias("level"), F.lit(0).cast("long").alias("idx"), total.alias("n"), F.lit(False).alias("too_dense"))
    leaves = child_rows.unionByName(root_row)

    def bound(i: str):
        return F.expr(f"{int(start_ms)}L + ({i}) * {span}L div shiftleft(1L, level)")

    return leaves.select(
        F.col("level").cast("int").alias("level"), F.col("idx").cast("long").alias("idx"),
        bound("idx").alias("start_ms"), bound("idx + 1").alias("end_ms"),
        F.col("n").cast("long").alias("n"), "too_dense",
    )
