"""Raw catalog CSV: scan, null markers, and normalization to the core schema."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from csv import reader as csv_lines

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import CORE_COLUMNS, RAW_CSV_COLUMNS, RAW_DOUBLE_COLUMNS, RAW_NULL_MARKERS, RAW_RENAMES

# Every raw column as text, in the service's order (streaming sources need a schema).
RAW_TEXT_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in RAW_CSV_COLUMNS])

# Fixed value: the raw time text format once the UTC 'Z' is removed.
RAW_TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS]"


def _null_markers(col: Column) -> Column:
    return F.when(col.isin(*RAW_NULL_MARKERS), F.lit(None)).otherwise(col)


#: Quotes inside a quoted field are doubled; a file whose header does not match a given schema fails.
CSV_OPTIONS = {"header": "true", "mode": "PERMISSIVE", "quote": '"', "escape": '"', "enforceSchema": "false"}


def _first_line(batches):
    """The first line that is not blank; the rest of the file is not asked for."""
    for batch in batches:
        for line, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if line.strip("\ufeff \t\r"):
                yield pa.RecordBatch.from_arrays([pa.array([line]), pa.array([file])], ["value", "file"])
                return


#: So many files' first lines are read by the driver, which lists them anyway; more are dealt to tasks.
HEADS_ON_DRIVER = 512


def _head(spark: SparkSession, file: str) -> str | None:
    """The first line of a file that is not blank."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
    stream = path.getFileSystem(conf).open(path)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
        line = reader.readLine()
        while line is not None and not line.strip("\ufeff \t\r"):
            line = reader.readLine()
        return line
    finally:
        stream.close()


def _first_lines(spark: SparkSession, path: str | list[str], days: tuple[str, str] | None) -> list[tuple[str, str]]:
    """(line, file) of every file that is not blank."""
    files = spark.read.text(path).inputFiles()
    if days is not None:
        known = [(re.search(r"/land_date=(\d{4}-\d\d-\d\d)/", f), f) for f in files]
        files = [f for at, f in known if at and str(days[0]) <= at[1] <= str(days[1])]
    if len(files) <= HEADS_ON_DRIVER:
        with ThreadPoolExecutor(16) as pool:
            lines = list(pool.map(lambda f: _head(spark, f), files))
        return [(line, file) for line, file in zip(lines, files, strict=True) if line is not None]
    # a session of its own deals one file to a task, and each task stops at the first line
    own = spark.newSession()
    for name, value in (("files.maxPartitionBytes", 1 << 40), ("files.openCostInBytes", 1 << 40), ("execution.arrow.maxRecordsPerBatch", 16)):
        own.conf.set(f"spark.sql.{name}", str(value))
    lines = _between_days(own.read.text(path), days).select("value", F.col("_metadata.file_path").alias("file"))
    return [(r.value, r.file) for r in lines.mapInArrow(_first_line, "value string, file string").collect()]


def _between_days(df: DataFrame, days: tuple[str, str] | None) -> DataFrame:
    if days is None:
        return df
    first, last = (F.lit(str(d)).cast("date") for d in days)
    return df.where(F.col("land_date").cast("date").between(first, last))


def _headers(spark: SparkSession, path: str | list[str], days: tuple[str, str] | None) -> dict[str, list[str]]:
    """Header line -> its files (the driver lists the files of a scan in any case); only heads are read."""
    found: dict[str, list[str]] = {}
    other: list[str] = []
    for line, file in _first_lines(spark, path, days):
        if {"id", "time"} <= set(_fields(line)):
            found.setdefault(line, []).append(file)
        else:
            other.append(file)
    if len(found) > 1 and other:     # else the whole path is read
        raise ValueError(f"no header with the fields id and time in {', '.join(sorted(other)[:3])}")
    return dict(sorted(found.items()))


def _fields(header: str) -> list[str]:
    return next(csv_lines([header.lstrip("\ufeff")]))


def read_event_csv(spark: SparkSession, path: str | list[str], days: tuple[str, str] | None = None) -> DataFrame:
    """Scan landed catalog CSV files (header row; every column text), columns matched by name.

    Files are read per distinct header, so a file with another column order or
    with fewer columns keeps its values under the right names; beside several
    headers, a file that is not empty and has no known header is an error. Only the first
    line of each file is read to find the headers. ``days`` (first and last, for paths of
    ``land_date=`` folders) leaves the files of other days unopened. Spark has a single
    ``nullValue``, so both markers (empty and ``null``) are mapped in a
    projection; numeric columns are converted by ``normalize`` with ``try_cast``,
    so a bad number becomes null instead of failing the file.
    """
    headers = _headers(spark, path, days)
    base = path if isinstance(path, str) else None
    if not headers:
        return apply_null_markers(_between_days(spark.read.options(**CSV_OPTIONS, inferSchema="false").csv(path), days))
    parts = []
    for header, files in headers.items():
        reader = spark.read.options(**CSV_OPTIONS).schema(T.StructType([T.StructField(c, T.StringType(), True) for c in _fields(header)]))
        reader = reader.option("basePath", base) if base else reader
        parts.append(_between_days(reader.csv(path if len(headers) == 1 else files), days))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return apply_null_markers(out)


def parse_event_time(col: Column) -> Column:
    """ISO text to Unix ms: drop the first literal ``Z``, parse, junk becomes null."""
    stripped = F.when(
        F.instr(col, "Z") > 0,
        F.concat(F.substring_index(col, "Z", 1), F.regexp_extract(col, "(?s)^[^Z]*Z(.*)$", 1)),
    ).otherwise(col)
    return F.unix_millis(F.try_to_timestamp(stripped, F.lit(RAW_TIME_FORMAT)))


def normalize(raw: DataFrame, keep: list[str] | tuple = ()) -> DataFrame:
    """Rename raw columns to core names, parse time, keep the 8 core columns, cast.

    Only the renames whose source is present are applied; a core column that is
    still missing makes the ``select`` fail, as in the reference. Extra columns
    are dropped (``keep`` names columns to carry along, e.g. landing keys).
    Numbers go text -> double -> float like the reference's float64 read
    followed by its float32 cast.
    """
    present = {k: v for k, v in RAW_RENAMES.items() if k in raw.columns}
    df = raw.withColumnsRenamed(present) if present else raw

    def num(name: str) -> Column:
        c = F.col(name)
        src = RAW_RENAMES_INV.get(name, name)
        if src in RAW_DOUBLE_COLUMNS and dict(df.dtypes).get(name) == "string":
            c = F.expr(f"try_cast(`{name}` AS DOUBLE)")
        return c.cast("float").alias(name)

    time_col = F.col("time")
    if dict(df.dtypes).get("time") == "string":
        time_col = parse_event_time(time_col)
    return df.select(
        F.col("id").cast("string").alias("id"),
        time_col.cast("long").alias("time"),
        num("lat"), num("lon"), num("depth_km"), num("magnitude"),
        F.col("mag_type").cast("string").alias("mag_type"),
        F.col("place").cast("string").alias("place"),
        *[F.col(c) for c in keep],
    ).select(*CORE_COLUMNS, *keep)


RAW_RENAMES_INV = {v: k for k, v in RAW_RENAMES.items()}


def raw_text_from_catalog(catalog: DataFrame) -> DataFrame:
    """Render catalog rows the way the catalog service writes CSV (all text).

    Null depth is written as an empty field and null place as the ``null`` marker,
    so ``normalize(raw_text_from_catalog(c))`` must give back ``c``'s core columns.
    """
    iso = F.date_format(F.timestamp_millis("time"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    given = {
        "time": iso,
        "latitude": F.col("lat").cast("string"),
        "longitude": F.col("lon").cast("string"),
        "depth": F.coalesce(F.col("depth_km").cast("string"), F.lit("")),
        "mag": F.col("magnitude").cast("string"),
        "magType": F.col("mag_type"),
        "id": F.col("id"),
        "place": F.coalesce(F.col("place"), F.lit("null")),
        "type": F.lit("earthquake"),
    }
    extra = [c for c in catalog.columns if c in ("land_date", "row_seq")]
    return catalog.select(*[given.get(c, F.lit("")).alias(c) for c in RAW_CSV_COLUMNS], *extra)


def write_event_csv(raw: DataFrame, path: str, by_day: bool = True) -> None:
    """Write raw text rows as header CSV, one folder per ``land_date`` (as landed files arrive)."""
    cols = list(RAW_CSV_COLUMNS)
    w = raw.select(*cols, *(["land_date"] if by_day else []))
    writer = w.write.mode("overwrite").option("header", "true").option("emptyValue", "").option("escape", '"')
    if by_day:
        writer = writer.partitionBy("land_date")
    writer.csv(path)


def apply_null_markers(raw: DataFrame) -> DataFrame:
    """Map both null markers to null in every text column (partition columns keep their type)."""
    types = dict(raw.dtypes)
    return raw.select([
        (_null_markers(F.col(f"`{c}`")) if types[c] == "string" else F.col(f"`{c}`")).alias(c)
        for c in raw.columns
    ])
