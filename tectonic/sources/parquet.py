"""Parquet storage: year-partitioned archive, landing batches, landed days.

The manifest (``manifest.py``) says which folders are the catalog; every function here writes folders of
its own and then commits them at once, so a crash between leaves the state before. A reader passes
one state (``at``) to several functions to see archive and landing of the same moment.

A landing batch replaces what earlier batches landed for the days it covers; of several versions of an
event the one of the later batch counts, within a batch that of the later day, then ``row_seq``.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geo import space_key
from ..functions.labels import year_of
from ..schema import CORE_COLUMNS, CORE_SCHEMA, LANDED_DAYS_SCHEMA, LANDING_SCHEMA
from . import manifest
from .manifest import Manifest

ARCHIVE_SCHEMA = T.StructType(CORE_SCHEMA.fields + [T.StructField("year", T.IntegerType(), True)])

ID_SCHEMA = T.StructType([T.StructField("id", T.StringType(), True), T.StructField("year", T.IntegerType(), True),
                          T.StructField("bucket", T.IntegerType(), True)])

SPACE_KEY = T.StructField("space_key", T.LongType(), True)

TOKEN = T.StructField("token", T.StringType(), True)

# Rows per output file when the archive is written (bounded files at any scale).
MAX_RECORDS_PER_FILE = 5_000_000


# Row groups of the space layout: a box meets some of them only.
SPACE_ROW_GROUP = 16 << 20

_join = manifest.join


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    if fs.exists(p):
        fs.delete(p, True)


def _has_data(spark: SparkSession, path: str) -> bool:
    if not _exists(spark, path):
        return False
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return len(p.getFileSystem(conf).listStatus(p)) > 0


def _writer(df: DataFrame):
    return df.write.option("compression", "zstd").option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)


def _scan(spark: SparkSession, base: str, folders: list[str], schema: T.StructType) -> DataFrame:
    """The given folders under ``base``; their ``name=value`` parts are columns that prune."""
    return spark.read.schema(T.StructType([*schema.fields, TOKEN])).option("basePath", base).parquet(*[_join(base, f) for f in folders])


def read_catalog(spark: SparkSession, path: str, years: list[int] | None = None, at: Manifest | None = None,
                 with_key: bool = False) -> DataFrame:
    """Archive rows (core columns + ``year``); empty with the schema when absent.

    ``with_key`` adds the ``space_key`` where the archive has that layout. A folder of ``year=`` folders that was written without a manifest is read as it is.
    """
    state, base = at or manifest.load(spark, path), _join(path, "archive")
    folders = [f"token={token}/year={year}" for year, token in sorted(state.years.items())]
    if folders:
        key = [SPACE_KEY] if with_key and state.layout == "space" else []
        schema = T.StructType([*ARCHIVE_SCHEMA.fields, *key])
        df = _scan(spark, base, folders, schema).select(*CORE_COLUMNS, "year", *[f.name for f in key])
    elif state.version == 0 and _has_data(spark, base):
        df = spark.read.schema(ARCHIVE_SCHEMA).parquet(base)
    else:
        df = spark.createDataFrame([], CORE_SCHEMA).withColumn("year", F.lit(None).cast("int"))
    if years is not None:
        df = df.filter(F.col("year").isin(list(years)))
    return df


def write_years(df: DataFrame, path: str, partitions: int | None = None, layout: str | None = None) -> tuple[str, set[str]]:
    """Write rows as archive years that nothing reads yet; their token and year folders.

    Range-partitioned on ``(year, time)``: a year holding a third of all rows is
    spread over many tasks, each writing a time-sorted file (tight row-group
    statistics for time filters), instead of one task per year; ``id`` breaks
    ties so a single hot millisecond spreads too. Without an explicit
    ``partitions`` the session's shuffle partition count applies, and files are
    split at ``MAX_RECORDS_PER_FILE``. In the ``space`` layout (that of the archive unless given) rows are
    dealt and sorted by ``(year, space_key, time)`` and the key is stored, in row groups of ``SPACE_ROW_GROUP`` bytes: filters
    on the key, or on lat and lon, then skip most row groups.
    """
    spark, token = df.sparkSession, manifest.new_token()
    state = manifest.load(spark, path)
    layout = layout or state.layout
    if state.version == 0 and _has_data(spark, _join(path, "archive")) and _partition_values(spark, _join(path, "archive"), "year"):
        raise ValueError(f"{path}/archive was written without a manifest; read it and write it to a new path")
    if "year" not in df.columns:
        df = df.withColumn("year", year_of("time"))
    out = df.select(*CORE_COLUMNS, "year")
    keys = ["year", "time", "id"]
    if layout == "space":
        out, keys = out.withColumn("space_key", space_key("lat", "lon")), ["year", "space_key", "time", "id"]
    spread = out.repartitionByRange(partitions, *keys) if partitions else out.repartitionByRange(*keys)
    folder = _join(path, "archive", f"token={token}")
    writer = _writer(spread.sortWithinPartitions(*keys))
    if layout == "space":
        writer = writer.option("parquet.block.size", SPACE_ROW_GROUP)
    writer.partitionBy("year").parquet(folder)
    return token, _partition_values(spark, folder, "year")


def write_catalog(df: DataFrame, path: str, partitions: int | None = None, layout: str | None = None) -> None:
    """Replace the archive years present in ``df``, all at once. The id index starts anew with the next merge.

    ``layout`` is ``time`` or ``space``; an archive keeps the one it has, also through merges, and only one
    whose years are all replaced can change it.
    """
    token, years = write_years(df, path, partitions, layout)

    def change(state: Manifest) -> None:
        if layout and layout != state.layout:
            if set(state.years) - years:
                raise ValueError(f"{path} holds years in the layout {state.layout!r} that would stay")
            state.layout = layout
        state.put_years(token, years)
        state.drop_ids()

    manifest.commit(df.sparkSession, path, change)


def id_bucket(buckets: int):
    return F.pmod(F.xxhash64("id"), F.lit(int(buckets))).cast("int").alias("bucket")


def read_ids(spark: SparkSession, path: str, buckets: list[int] | None = None, at: Manifest | None = None) -> DataFrame:
    """(id, year, bucket) of the archive out of the id index, of all buckets or those given only."""
    state = at or manifest.load(spark, path)
    wanted = set(state.ids) if buckets is None else {str(b) for b in buckets} & set(state.ids)
    if not wanted:
        return spark.createDataFrame([], ID_SCHEMA)
    folders = [f"token={state.ids[b]}/bucket={b}" for b in sorted(wanted, key=int)]
    return _scan(spark, _join(path, "ids"), folders, ID_SCHEMA).select("id", "year", "bucket")


def write_ids(rows: DataFrame, path: str, buckets: int) -> tuple[str, set[str]]:
    """Write (id, year) rows as buckets of the id index that nothing reads yet: their token and buckets."""
    token = manifest.new_token()
    folder = _join(path, "ids", f"token={token}")
    dealt = rows.select("id", "year", id_bucket(buckets)).repartition("bucket").sortWithinPartitions("bucket", "id")
    _writer(dealt).partitionBy("bucket").parquet(folder)
    return token, _partition_values(rows.sparkSession, folder, "bucket")


def read_landing(spark: SparkSession, path: str, year: int | None = None, arrival: bool = False, at: Manifest | None = None) -> DataFrame:
    """Landed rows that are not merged yet (core + ``land_date`` + ``row_seq``), days landed again only as
    they landed last. ``arrival`` adds the batch number, by which later versions win. Rows of a
    stream have no ``land_date``; ``year`` keeps the days of one year."""
    state, base = at or manifest.load(spark, path), _join(path, "landing")
    batches = [b for b in state.batches if b["rows"]]
    if not batches:
        df = spark.createDataFrame([], LANDING_SCHEMA)
        return df.withColumn("batch", F.lit(None).cast("long")) if arrival else df
    df = _scan(spark, base, [f"token={b['token']}" for b in batches], LANDING_SCHEMA)
    if year is not None:
        df = df.filter(F.year("land_date") == F.lit(year))
    for token, ranges in manifest.hidden_days(state.batches).items():
        again = F.lit(False)
        for first, last in ranges:
            again = again | F.col("land_date").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
        df = df.filter((F.col("token") != token) | F.col("land_date").isNull() | ~again)
    if arrival:
        df = manifest.numbered(df, batches, "batch")
    return df.select(*[f.name for f in LANDING_SCHEMA.fields], *(["batch"] if arrival else []))


def read_landed_days(spark: SparkSession, path: str, at: Manifest | None = None) -> DataFrame:
    """(land_date, n) of every landed day, as its latest landing left it."""
    state = at or manifest.load(spark, path)
    if not state.landed:
        return spark.createDataFrame([], LANDED_DAYS_SCHEMA)
    tables = _scan(spark, _join(path, "landed_days"), [f"token={e['token']}" for e in state.landed], LANDED_DAYS_SCHEMA)
    return manifest.numbered(tables, state.landed, "at").groupBy("land_date").agg(F.max_by("n", "at").alias("n"))


def compact_landed_days(spark: SparkSession, path: str, most: int = 16) -> None:
    """Rewrite the landed-days tables as one when there are more than ``most`` (one row per day)."""
    state = manifest.load(spark, path)
    if len(state.landed) <= most:
        return
    token, tokens = manifest.new_token(), {e["token"] for e in state.landed}
    read_landed_days(spark, path, state).coalesce(1).write.parquet(_join(path, "landed_days", f"token={token}"))

    def change(now: Manifest) -> bool | None:
        if not tokens <= {e["token"] for e in now.landed}:
            return False                   # another job has done it
        now.landed = [{"n": max(e["n"] for e in state.landed), "token": token}, *[e for e in now.landed if e["token"] not in tokens]]
        for old in sorted(tokens):
            now.retire(f"landed_days/token={old}")
        return None

    manifest.commit(spark, path, change)


def _partition_values(spark: SparkSession, path: str, column: str) -> set[str]:
    """Values of the partition folders under ``path`` (at most one per day or year)."""
    if not _has_data(spark, path):
        return set()
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    names = [s.getPath().getName() for s in p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)]
    return {n.split("=", 1)[1] for n in names if n.startswith(f"{column}=")}


#: The folder value that stands for null.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"

# Salts per landing day: a day holding most rows is written by several tasks.
LANDING_SALTS = 32


def _write_batch(rows: DataFrame, path: str) -> tuple[str, set[str], bool]:
    """Write a landing batch that nothing reads yet: its token, its days, whether it has rows."""
    token = manifest.new_token()
    folder = _join(path, "landing", f"token={token}")
    spread = rows.repartition("land_date", F.pmod(F.xxhash64("id", "row_seq"), F.lit(LANDING_SALTS)))
    _writer(spread.sortWithinPartitions("land_date", "row_seq", "id")).partitionBy("land_date").parquet(folder)
    got = _partition_values(rows.sparkSession, folder, "land_date")
    return token, got - {NO_VALUE}, bool(got)


def land_daily(df: DataFrame, path: str, days: DataFrame | None = None, also: Callable[[Manifest], None] | None = None) -> None:
    """Land rows per ``land_date`` as one batch and record the landed days with their row counts.

    ``days`` (column ``land_date``) lists every day that was requested: a day that
    returned no rows loses what an earlier landing left, and is recorded with
    ``n = 0`` so that it is not asked for again. ``row_seq`` must hold the arrival
    order within a day (the service returns time ascending; ``time`` is used when
    absent). The source is evaluated once: rows are dealt by day and id, and the
    counts come from the partitions just written. Rows and record appear together;
    no file is moved. ``also`` is a further change that the same commit publishes.
    """
    spark = df.sparkSession
    if "row_seq" not in df.columns:
        df = df.withColumn("row_seq", F.col("time"))
    token, got, any_rows = _write_batch(df.select(*CORE_COLUMNS, "land_date", "row_seq"), path)
    counts = spark.createDataFrame([], LANDED_DAYS_SCHEMA)
    if got:
        landed = _scan(spark, _join(path, "landing"), [f"token={token}"], LANDING_SCHEMA)
        counts = landed.where("land_date IS NOT NULL").groupBy("land_date").agg(F.count(F.lit(1)).alias("n"))
    asked: set[str] = set()
    if days is not None:
        wanted = days.where("land_date IS NOT NULL").select("land_date").distinct()
        asked = {r[0].isoformat() for r in wanted.collect()}
        zeros = spark.createDataFrame([(date.fromisoformat(d),) for d in sorted(asked)], "land_date date").withColumn("n", F.lit(0).cast("long"))
        counts = counts.unionByName(zeros).groupBy("land_date").agg(F.max("n").alias("n"))
    counts.coalesce(1).write.parquet(_join(path, "landed_days", f"token={token}"))
    covered = manifest.day_ranges(got | asked)

    def change(state: Manifest) -> None:
        n = state.add_batch(token, covered, any_rows)
        state.landed.append({"n": n, "token": token})
        if also is not None:
            also(state)

    manifest.commit(spark, path, change)


def land_stream_batch(df: DataFrame, path: str, query: str, batch_id: int) -> bool:
    """Land a micro-batch once; later batches win. Returns whether it was new.

    ``query`` names the streaming query; a batch of it that has landed before (a replay, whether merged
    since or not) changes nothing. The rows have no ``land_date``, so no landed day is touched.
    """
    spark = df.sparkSession
    if manifest.load(spark, path).streams.get(query, -1) >= batch_id:
        return False
    rows = df.select(*CORE_COLUMNS, F.lit(None).cast("date").alias("land_date"), F.col("time").alias("row_seq"))
    token, _, any_rows = _write_batch(rows, path)

    def change(state: Manifest) -> bool | None:
        if state.streams.get(query, -1) >= batch_id:
            return False
        state.streams[query] = batch_id
        if any_rows:
            state.add_batch(token, [], True)
        return None

    return manifest.commit(spark, path, change).streams.get(query) == batch_id


def pending_years(spark: SparkSession, path: str) -> set[int]:
    """Years that a merge has changed and no export has written since."""
    return set(manifest.load(spark, path).pending)


def clear_pending(spark: SparkSession, path: str, years: set[int] | None = None) -> None:
    """Take years (all without ``years``) off the list of stale exports."""
    def change(state: Manifest) -> bool | None:
        left = [y for y in state.pending if years is not None and y not in years]
        if left == state.pending:
            return False
        state.pending = left
        return None

    manifest.commit(spark, path, change)


def drop_landing(spark: SparkSession, path: str, dates: list[str] | None = None) -> None:
    """Take landed rows (all, or those of the given ``YYYY-MM-DD`` dates) out of the landing area; the
    landed-days records stay."""
    def change(state: Manifest) -> None:
        if dates is not None:
            state.add_batch("", manifest.day_ranges(set(dates)), False)
            return
        for batch in state.batches:
            state.retire(f"landing/token={batch['token']}")
        state.batches = []

    manifest.commit(spark, path, change)
