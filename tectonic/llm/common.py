"""Shared helpers of the training-data operators: tables, scratch space, components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_LIBC = ctypes.CDLL(None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a single-process ``local`` session may go without the setting: it gets a
    folder of its own, named in the session for later calls.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corpus-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends here, and no executor's
    loss repeats the work before it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


SCAN_TASKS_PER_CORE = 4


def scan_tasks(df: DataFrame) -> DataFrame:
    """At most a few tasks per core, without a shuffle: for scans that send a summary of fixed size per
    task, so that the summaries grow with the cluster and not with the table."""
    return df.coalesce(SCAN_TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism)


def release(df: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote and nothing reads any more; other files are left alone."""
    spark = df.sparkSession
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    shared = hadoop.Path(shared_dir(spark))
    shared = shared.getFileSystem(conf).makeQualified(shared)
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
        folder = hadoop.Path(path)
        files = folder.getFileSystem(conf)
        folder = files.makeQualified(folder)
        if folder.getParent().equals(shared):
            files.delete(folder, True)


def give_back() -> None:
    """Return what a task's arrays held to the system: a Python worker lives on, and what it keeps counts
    against the executor while other stages run."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(_LIBC, "malloc_trim", None)     # glibc only
    if trim is not None:
        trim(0)


def forget_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now.

    It does so when the driver's garbage collector meets their plans, which a job of many small steps may
    not see for long; what has been materialized needs them no more.
    """
    gc.collect()
    spark._jvm.System.gc()


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b): rows (id, component), component = smallest id.

    Alternates "link every larger neighbour to my smallest neighbour" with "link my smaller neighbours
    to the smallest of them" until every node hangs on its smallest reachable id; the number of rounds
    grows with the logarithm of a component's diameter. Neighbour minima are written before they are
    joined back, so that a hub's rows are an ordinary skewed join side that Spark can split.
    """
    edges = edges.select("a", "b").where("a <> b")
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    before = _digest(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialize(both.groupBy("a").agg(F.min("b").alias("m")), "cc-low")
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct()
        large = materialize(large, "cc-large")
        low2 = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "cc-low")
        hop = large.join(low2, "a")
        small = hop.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            low2.select("a", F.col("m").alias("b"))).distinct()
        small = materialize(small, "cc")
        after = _digest(small)
        for old in (edges, low, large, low2):
            release(old)
        edges = small
        if after == before:
            break
        before = after
    return edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
