"""A corpus pipeline of the training-data operators: raw documents to packed training windows.

Each stage takes the documents that its predecessor kept and returns documents of the same columns; the
last returns packed pieces. Stages are written as Parquet in the shared folder and read again, so a lost
executor never repeats an earlier stage. Rows with a null doc_id leave at the first deduplication.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tectonic.llm import op1_substrings, op2_jaccard, op3_exact, op7_langid, op9_packing, wordbpe
from tectonic.llm.common import materialize, table


def _coded(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The same rows under names that no operator's own column has, and the new name of each old one."""
    names = {c: f"column_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose two nearest languages cannot be told apart, go; a missing lang
    is filled in."""
    rows, at = _coded(docs)
    model = op7_langid.fit(rows, at["doc_id"], at["text"], at["lang"])
    found = op7_langid.predict(rows, model, at["doc_id"], at["text"], keep=tuple(at.values()))
    kept = found.where((F.col("lang_pred") != op7_langid.UNKNOWN) & ~F.col("ambiguous"))
    kept = kept.withColumn(at["lang"], F.coalesce(at["lang"], "lang_pred"))
    return kept.select(*at.values()).toDF(*at)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays, once; rows of one id with different texts are
    different documents."""
    decided = op3_exact.exact_dedup(docs, op3_exact.fresh_index(spark))
    rows, at = _coded(docs)
    rows = rows.withColumn("digest", F.sha2(F.coalesce(at["text"], F.lit("")).cast("binary"), 256))
    # repeated rows of one id and text: one of them, by a partial aggregate, before any row is dealt by them
    whole = F.struct(*at.values())
    rows = rows.groupBy(at["doc_id"], "digest").agg(F.max_by(whole, F.xxhash64(*at.values())).alias("whole"))
    stays = decided.where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias(at["doc_id"]), F.col("text_sha256").alias("digest"))
    kept = rows.join(materialize(stays.distinct(), "stays"), [at["doc_id"], "digest"], "left_semi")
    return kept.select("whole.*").toDF(*at)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the smallest id stays."""
    groups = op2_jaccard.similar_documents(docs)
    stays = materialize(groups.where("doc_id = component_id").select("doc_id"), "stays")
    return docs.join(stays, "doc_id", "left_semi").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages stay where they stand first; a document of which nothing is left goes."""
    rows, at = _coded(docs)
    done = op1_substrings.substring_dedup(rows, at["doc_id"], at["text"])
    left = done.where((F.size("_spans") == 0) | (F.trim(at["text"]) != ""))
    size = F.length(at["text"]).cast(docs.schema["n_chars"].dataType)
    return left.withColumn(at["n_chars"], size).select(*at.values()).toDF(*at)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents in windows of up to 2048 tokens."""
    return op9_packing.pack_documents(docs, wordbpe.default_path())


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]

#: Near duplicates, chunking and packing are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
