"""Structured Streaming: live snapshot, streaming upsert, moving-window statistics.

The reference polls the catalog service every 60 s and replaces its snapshot;
here landed CSV files are a file source, normalized as they arrive. The
streaming upsert only appends each micro-batch to the landing area; readers see
it through the SQL view, and a scheduled ``merge_landing`` rewrites the archive.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import today_events
from ..operators.stats import mean_of_tenths, tenths
from ..session import ensure_utc
from ..sources.csv import CSV_OPTIONS, RAW_TEXT_SCHEMA, apply_null_markers, normalize
from ..sources.geojson import geojson_point_rows
from ..sources.manifest import Files, join
from ..sources.parquet import land_stream_batch

DEFAULT_TRIGGER = "60 seconds"


def interval_text(ms: int | str) -> str:
    """A span in ms as a Spark interval string, e.g. a quarter of ``YEAR_MS`` ->
    ``91 days 7 hours 30 minutes`` (strings pass through unchanged)."""
    if isinstance(ms, str):
        return ms
    rest, parts = int(ms), []
    for unit, size in (("days", 86_400_000), ("hours", 3_600_000), ("minutes", 60_000),
                       ("seconds", 1_000), ("milliseconds", 1)):
        q, rest = divmod(rest, size)
        if q:
            parts.append(f"{q} {unit}")
    return " ".join(parts) or "0 seconds"


#: The job id in the name of a file that Spark wrote.
WRITE_JOB = r"/part-\d+-([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})[^/]*$"


def live_stream(spark: SparkSession, landing_csv: str, max_files_per_trigger: int | None = None,
                keep_poll: bool = False) -> DataFrame:
    """Streaming frame of normalized events from CSV files dropped into ``landing_csv``.

    A stream has one schema: a file whose header names other columns, or another
    order, fails the query instead of filling the wrong columns. ``poll_ms`` is
    the time a row's file was written and ``poll`` its poll: the files of one Spark
    write (whose names share its job id) are a poll, any other file is one of its own.
    """
    ensure_utc(spark)
    reader = spark.readStream.schema(RAW_TEXT_SCHEMA).options(**CSV_OPTIONS)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    raw = reader.csv(landing_csv)
    path = F.col("_metadata.file_path")
    job = F.regexp_extract(path, WRITE_JOB, 1)
    raw = raw.select("*", F.unix_millis(F.col("_metadata.file_modification_time")).alias("poll_ms"),
                     F.when(job != "", job).otherwise(path).alias("poll"))
    return normalize(apply_null_markers(raw), keep=["poll_ms", "poll"] if keep_poll else [])


def point_stream(spark: SparkSession, landing_geojson: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming regional points from newline-delimited GeoJSON features dropped into a folder."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    return geojson_point_rows(reader.load(landing_geojson))


def _trigger(writer, available_now: bool, interval: str):
    return writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)


def _query_id(spark: SparkSession, checkpoint: str) -> str:
    """The streaming query's own id, which Spark keeps in its checkpoint."""
    return json.loads(Files(spark, checkpoint).read(join(checkpoint, "metadata")))["id"]


def _last_snapshot(files: Files, path: str) -> dict | None:
    names = sorted(n for n in files.names(join(path, "_state")) if n.endswith(".json"))
    return json.loads(files.read(join(path, "_state", names[-1]))) if names else None


def read_live_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Today's events as the newest poll had them; an error before the first one."""
    last = _last_snapshot(Files(spark, path), path)
    if last is None:
        raise FileNotFoundError(f"no snapshot at {path}")
    return spark.read.parquet(join(path, f"snapshot={last['n']}"))


def start_live_snapshot(stream: DataFrame, path: str, checkpoint: str, now_ms: Callable[[], int],
                        available_now: bool = False, interval: str = DEFAULT_TRIGGER):
    """Keep ``path`` holding today's events as the latest poll has them.

    ``stream`` is ``live_stream(keep_poll=True)``; of several polls in a batch the one
    with the newest file counts, with all of its files. Files of that poll that come in a later batch are added to
    it; files of an older poll change nothing. ``now_ms`` is asked once per batch, so later events and the
    next midnight are seen. A poll without events of today empties the snapshot; a
    failed or replayed batch leaves it as it is: each snapshot is a folder of its own, which a small file published
    last names (``read_live_snapshot``), and the one before goes after that.
    """
    def replace(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        files, query = Files(spark, path), _query_id(spark, checkpoint)
        last = _last_snapshot(files, path)
        if last and last["query"] == query and last["batch"] >= batch_id:
            return
        newest = batch.agg(F.max(F.struct("poll_ms", "poll")).alias("at")).first()["at"]
        if newest is None or last and newest["poll"] != last["poll"] and newest["poll_ms"] < last["poll_ms"]:
            return
        now, n = now_ms(), last["n"] + 1 if last else 0
        today = today_events(batch.where(F.col("poll") == newest["poll"]).drop("poll_ms", "poll"), now)
        if last and last["poll"] == newest["poll"]:
            today = today.unionByName(today_events(read_live_snapshot(spark, path), now))
        today.write.mode("overwrite").parquet(join(path, f"snapshot={n}"))
        state = {"n": n, "poll": newest["poll"], "poll_ms": max(newest["poll_ms"], last["poll_ms"] if last and last["poll"] == newest["poll"] else 0),
                 "query": query, "batch": int(batch_id)}
        draft = join(path, "_state", f"draft-{query}")
        files.delete(draft)
        files.write(draft, json.dumps(state))
        if not files.claim(draft, join(path, "_state", f"{n:012d}.json")):
            raise RuntimeError(f"two streams write the snapshot {path}")
        for name in files.names(path):
            if name.startswith("snapshot=") and name != f"snapshot={n}":
                files.delete(join(path, name))
        for name in files.names(join(path, "_state")):
            if name.endswith(".json") and int(name[:-5]) < n - 1:
                files.delete(join(path, "_state", name))

    w = stream.writeStream.foreachBatch(replace).option("checkpointLocation", checkpoint)
    return _trigger(w, available_now, interval).start()


def start_stream_upsert(stream: DataFrame, path: str, checkpoint: str,
                        available_now: bool = False, interval: str = DEFAULT_TRIGGER):
    """Land every micro-batch at ``path`` as a batch of its own (later batches, landed days included, win
    when merged).

    A batch is known by the query's id and its number, so a replay changes nothing, also when the batch has been
    merged since; neither the archive nor other batches are read or replaced. The SQL
    view serves the rows at once, ``plans.sync.merge_landing`` moves them into the
    archive.
    """
    def land(batch: DataFrame, batch_id: int) -> None:
        land_stream_batch(batch, path, _query_id(batch.sparkSession, checkpoint), int(batch_id))

    w = stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
    return _trigger(w, available_now, interval).start()


def span_ms(span: int | str) -> int:
    """A span in ms, given so or as a Spark interval string of units of fixed length."""
    if not isinstance(span, str):
        return int(span)
    sizes = {"week": 604_800_000, "day": 86_400_000, "hour": 3_600_000, "minute": 60_000, "second": 1_000, "millisecond": 1}
    words = span.removeprefix("INTERVAL ").split()
    try:
        return sum(int(n) * sizes[unit.lower().rstrip("s")] for n, unit in zip(words[::2], words[1::2], strict=True))
    except (KeyError, ValueError):
        raise ValueError(f"no span of weeks, days, hours, minutes, seconds and milliseconds: {span!r}") from None


def stream_window_stats(stream: DataFrame, duration, step, lateness, digits: int = 4, start_ms: int = 0) -> DataFrame:
    """Sliding-window statistics of streamed web rows with a watermark: late rows beyond ``lateness`` leave the running
    statistics (the batch ``window_series`` over the merged archive stays the reference).

    Two chained stateful aggregates. Rows are first reduced to panes of ``gcd(step, duration)``; a pane that the
    watermark has closed goes into the ``duration / step`` windows that hold it. A row thus meets one
    aggregate whatever the spans, and state holds the open panes and windows: ten years of panes and windows at
    steps of a month, not ten years of rows times 120. Values of one decimal are summed as whole tenths, so rows in any order
    give equal results. Windows start at ``start_ms`` plus a multiple of ``step``, as the frames of ``window_series`` do.

    A late row is dropped once the watermark of an earlier batch has passed its pane;
    within the batch that moves the watermark Spark may still count it (its
    late-row filter uses the previous batch's watermark).

    Spans are interval strings or ms (e.g. ``WINDOW_STEPS_MS["3 MO"]``).
    """
    long, hop = span_ms(duration), span_ms(step)
    pane = math.gcd(long, hop)
    offset = interval_text(int(start_ms) % hop)
    depth = F.coalesce(F.col("depth_km").cast("double"), F.lit(0.0))
    panes = (
        stream.withColumn("ts", F.timestamp_millis("time"))
        .withWatermark("ts", interval_text(lateness))
        .groupBy(F.window("ts", interval_text(pane), interval_text(pane), interval_text(int(start_ms) % pane)).alias("pane"))
        .agg(F.count(F.lit(1)).alias("n"), F.count("magnitude").alias("n_mag"), F.max(F.col("magnitude").cast("double")).alias("max_magnitude"),
             F.sum(tenths("magnitude")).alias("mag10"), F.sum(tenths(depth)).alias("dep10"))
    )
    windows = panes.groupBy(F.window(F.window_time("pane"), interval_text(long), interval_text(hop), offset).alias("w")).agg(
        F.sum("n").alias("n"), F.sum("n_mag").alias("n_mag"), F.max("max_magnitude").alias("max_magnitude"),
        F.sum("mag10").alias("mag10"), F.sum("dep10").alias("dep10"))
    return windows.select(
        F.unix_millis(F.col("w.start")).alias("window_start"),
        F.unix_millis(F.col("w.end")).alias("window_end"),
        "n", "max_magnitude",
        mean_of_tenths(F.col("mag10"), F.nullif(F.col("n_mag"), F.lit(0).cast("long")), digits).alias("avg_magnitude"),
        mean_of_tenths(F.col("dep10"), F.col("n"), digits).alias("avg_depth_km"),
    )


def start_window_stats(stats: DataFrame, path: str, checkpoint: str,
                       available_now: bool = False, interval: str = DEFAULT_TRIGGER):
    """Append closed windows to a Parquet table (a window is final once the watermark passes it)."""
    w = (stats.writeStream.outputMode("append").format("parquet")
         .option("path", path).option("checkpointLocation", checkpoint))
    return _trigger(w, available_now, interval).start()
