"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by the SHA-256 of the text. New documents are reduced
to one row per digest (partial aggregates first, so a text that a third of all rows share is a few rows
after the map side), the digests already in the index are removed by a sort-merge anti-join on the
buckets, and the rest is appended, one file per bucket. Which row stays:

* a digest that the index holds: none of the new rows, ``keep_id`` is the index's,
* otherwise: the row with the largest id.

Every digest carries the name of the batch that brought it. Digests of the batch at hand count as new, so a
job that fails after its append, or whose result is lost, runs again under the same name and decides as
before; what it has appended already is not appended twice.

Defined results: null text counts as empty; texts are equal when their UTF-8 bytes are; of rows with
equal text and equal id each is a row of the result, kept or dropped alike; null ids rank below all
others; further columns, whatever their names, are ignored. An empty table gives an empty result and
appends nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch, table

INDEX_BUCKETS = 32


def create_index(spark: SparkSession, name: str, path: str, buckets: int = INDEX_BUCKETS) -> str:
    """Attach the digest index at ``path`` as table ``name``; a new folder gives an empty index."""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS `{name}` (digest BINARY, keep_id BIGINT, n BIGINT, batch STRING) USING parquet "
        f"CLUSTERED BY (digest) SORTED BY (digest) INTO {int(buckets)} BUCKETS LOCATION '{path}'")
    return name


def index_buckets(spark: SparkSession, name: str) -> int:
    rows = spark.sql(f"DESCRIBE FORMATTED `{name}`").where("col_name = 'Num Buckets'").collect()
    return int(rows[0]["data_type"])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(docs[text_col], F.lit(""))
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))


def append_new(digested: DataFrame, index: str, batch: str) -> DataFrame:
    """Append the digests that the index lacks; returns (digest, keep_id, n, is_new) of all digests given.

    ``keep_id`` is the row that stays for the digest, ``n`` the number of rows given with it. ``batch`` names
    the documents given; digests that an earlier run of the same batch appended are new still.
    """
    spark = digested.sparkSession
    groups = materialize(digested.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n")), "digests")
    known = spark.table(index)
    fresh = materialize(groups.join(known.hint("merge"), "digest", "left_anti").select("digest", "keep_id", "n"), "digests-new")
    met = groups.join(known.select("digest", F.col("keep_id").alias("old_id"), F.col("batch").eqNullSafe(F.lit(batch)).alias("is_new")).hint("merge"), "digest")
    result = fresh.withColumn("is_new", F.lit(True)).unionByName(
        met.select("digest", F.when(F.col("is_new"), F.col("keep_id")).otherwise(F.col("old_id")).alias("keep_id"), "n", "is_new"))
    result = materialize(result, "digests-kept")
    appended = fresh.withColumn("batch", F.lit(batch))
    appended.repartition(index_buckets(spark, index), "digest").sortWithinPartitions("digest").write.insertInto(index)
    return result


def exact_dedup(docs: DataFrame, index: str, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per document, dropped ones too.

    ``index`` is the name of a table made by ``create_index``; it holds all digests afterwards. ``batch``
    names these documents, so that a failed job can run again; without a name every call is a batch of its own.
    """
    digested = digests(docs, id_col, text_col)
    decided = append_new(digested, index, batch or uuid.uuid4().hex)
    joined = digested.join(decided, "digest")
    return joined.select(
        "doc_id", "keep_id", F.col("n").alias("group_size"),
        (F.col("is_new") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def fresh_index(spark: SparkSession) -> str:
    name = f"digest_index_{uuid.uuid4().hex[:12]}"
    return create_index(spark, name, scratch(spark, "digest-index"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = fresh_index(spark)
    out = exact_dedup(table(spark, sf_dir, "documents"), index)
    spark.sql(f"DROP TABLE `{index}`")    # the decisions are stored; the index's files stay where they are
    return out


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
