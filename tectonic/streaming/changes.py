"""Change feed of polls: what each poll of the catalog service adds, revises and no longer has.

Every poll repeats the events it still knows, so the feed keeps state per event: its last row and the time
of the last poll that had it. A row that differs from the state is a change, an equal one only renews
it. An event that no poll has had for ``gone_after`` of poll time has vanished; a timer on the polls' watermark finds
that, emits the event once more and drops its state, so state holds the events of the last polls only. Nothing
depends on how a poll's files are dealt to micro-batches.

Events are dealt by the hash of their id to a fixed number of buckets. A bucket is one group: its events are one
table in the state, compared with a micro-batch's rows as whole columns, with one timer at the
first of their ends. A poll renews nearly all of the state, so a bucket's table is written anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..schema import CORE_COLUMNS, CORE_SCHEMA
from .live import DEFAULT_TRIGGER, _trigger, interval_text, span_ms

NEW, REVISED, VANISHED = "new", "revised", "vanished"
CHANGE_SCHEMA = T.StructType([*CORE_SCHEMA.fields, T.StructField("change", T.StringType()), T.StructField("at_ms", T.LongType())])
#: A known event: its last row and the time of the last poll that had it. Null times are a flag, so that times stay whole numbers.
_KNOWN = pa.schema([("id", pa.string()), ("time", pa.int64()), ("timeless", pa.bool_()),
                    *[(c, pa.float32()) for c in ("lat", "lon", "depth_km", "magnitude")],
                    ("mag_type", pa.string()), ("place", pa.string()), ("row_hash", pa.int64()), ("seen_ms", pa.int64())])
#: Groups of the feed. Part of a query's state, so fixed for its life; a task holds one bucket's rows at a time.
BUCKETS = 256
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class _Changes(StatefulProcessor):
    def __init__(self, gone_after_ms: int):
        self.gone_after = gone_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "timer long, events binary")

    def _load(self) -> tuple[int | None, pd.DataFrame]:
        """The bucket's timer and known events."""
        found = self.known.get()
        if found is None:
            return None, _KNOWN.empty_table().to_pandas()
        timer, raw = found
        return timer, pa.ipc.open_stream(raw).read_all().to_pandas()

    def _store(self, timer: int | None, events: pd.DataFrame) -> None:
        """Keep the events, with the timer at the first time that one of them may have vanished."""
        ends = int(events["seen_ms"].min()) + self.gone_after if len(events) else None
        if ends != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if ends is not None:
                self.handle.registerTimer(ends)
        if ends is None:
            self.known.clear()
            return
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _KNOWN) as out:
            out.write_table(pa.Table.from_pandas(events, _KNOWN, preserve_index=False))
        self.known.update((ends, sink.getvalue().to_pybytes()))

    def _frame(self, found: list[tuple[pd.DataFrame, str, np.ndarray]]) -> Iterator[pd.DataFrame]:
        found = [f for f in found if len(f[0])]
        if found:
            frame = pd.concat([events.assign(change=change, at_ms=at) for events, change, at in found], ignore_index=True)
            frame["time"] = frame["time"].astype("Int64").mask(frame["timeless"].astype(bool))
            yield frame[CHANGE_SCHEMA.names]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        timer, known = self._load()
        found = pd.concat(rows, ignore_index=True).rename(columns={"poll_ms": "seen_ms"})[_KNOWN.names]
        both = pd.concat([known, found], ignore_index=True) if len(known) else found
        old = np.arange(len(both)) < len(known)
        event = pd.factorize(both["id"], use_na_sentinel=False)[0]
        seen = both["seen_ms"].to_numpy()
        before = np.full(event.max() + 1, np.iinfo(np.int64).min)          # the poll that had the event last
        before[event[old]] = seen[old]
        # an event's rows, the known one first, then by poll
        order = np.lexsort([both["row_hash"], both["time"], both["timeless"], seen, ~old, event])
        both, old, event, seen = both.iloc[order], old[order], event[order], seen[order]
        again = np.zeros(len(both), bool)                                  # an id listed twice in a poll: its later version
        again[:-1] = ~old[:-1] & (event[:-1] == event[1:]) & (seen[:-1] == seen[1:])
        late = ~old & (seen < before[event])                               # a file of an older poll
        keep = ~again & ~late
        both, old, event, seen = both[keep], old[keep], event[keep], seen[keep]
        follows = np.zeros(len(both), bool)
        follows[1:] = event[1:] == event[:-1]
        gone, differs = np.zeros(len(both), bool), np.zeros(len(both), bool)
        gone[1:] = follows[1:] & (seen[1:] > seen[:-1] + self.gone_after)
        hashes = both["row_hash"].to_numpy()
        differs[1:] = follows[1:] & ~gone[1:] & (hashes[1:] != hashes[:-1])
        new, last = gone | (~follows & ~old), np.append(gone[1:], False)   # the last row of an event that was gone for a while
        # the newest row of every event, the known one if no later poll has it
        newest = pd.Series(np.arange(len(both))[old | (seen > before[event])]).groupby(event[old | (seen > before[event])]).last()
        self._store(timer, both.iloc[newest.to_numpy()])
        yield from self._frame([(both[last], VANISHED, seen[last] + self.gone_after), (both[new], NEW, seen[new]), (both[differs], REVISED, seen[differs])])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        timer, known = self._load()
        ends = known["seen_ms"].to_numpy() + self.gone_after
        gone = ends <= timerValues.getCurrentWatermarkInMs()
        self._store(timer, known[~gone])
        yield from self._frame([(known[gone], VANISHED, ends[gone])])

    def close(self) -> None:
        pass


def poll_changes(stream: DataFrame, gone_after: int | str, lateness: int | str = "30 seconds", buckets: int = BUCKETS) -> DataFrame:
    """(core columns, ``change``, ``at_ms``) of a ``live_stream(keep_poll=True)``.

    ``change`` is ``new``, ``revised`` (any core column differs; the row is the new one) or ``vanished`` (the last
    row known). ``at_ms`` is the poll's time, for a vanished event the end of ``gone_after`` (ms or an interval
    string; longer than the time between two polls) since the last poll that had it. ``lateness`` is how far the files of a poll may
    come behind newer ones (rows beyond are dropped by the watermark). Equal polls give nothing. Events with a null id are one event, as
    in the merge. ``buckets`` groups hold the events (a restarted query needs the same number). Needs the RocksDB state store, which ``start_change_feed`` sets for its query.
    """
    values = [F.col(c) for c in CORE_COLUMNS if c != "id"]
    rows = stream.select(F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int").alias("bucket"), *[c for c in CORE_COLUMNS if c != "time"],
                         F.coalesce("time", F.lit(0).cast("long")).alias("time"), F.col("time").isNull().alias("timeless"),
                         "poll_ms", F.xxhash64(*values).alias("row_hash"), F.timestamp_millis("poll_ms").alias("poll_ts"))
    return (rows.withWatermark("poll_ts", interval_text(max(span_ms(lateness), 1))).groupBy("bucket")
            .transformWithStateInPandas(_Changes(span_ms(gone_after)), CHANGE_SCHEMA, "append", "eventTime"))


def start_change_feed(changes: DataFrame, path: str, checkpoint: str, available_now: bool = False, interval: str = DEFAULT_TRIGGER):
    """Append the changes to a Parquet table."""
    conf = changes.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKSDB)
    try:
        w = changes.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        return _trigger(w, available_now, interval).start()
    finally:
        conf.set(PROVIDER, before) if before else conf.unset(PROVIDER)
