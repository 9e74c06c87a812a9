"""The operators' queries by name and, where SQL can express them, their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    op1_substrings,
    op2_jaccard,
    op3_exact,
    op4_bpe,
    op5_counts,
    op6_licenses,
    op7_langid,
    op8_urls,
    op9_packing,
    op10_embeddings,
    op11_negatives,
    op12_quality,
    op13_lexical,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substrings.query,
    "op2_jaccard_join": op2_jaccard.query,
    "op3_exact_dedup": op3_exact.query,
    "op4_bpe_coding": op4_bpe.query,
    "op5_token_counts": op5_counts.query,
    "op6_license_scan": op6_licenses.query,
    "op7_language_id": op7_langid.query,
    "op8_url_filter": op8_urls.query,
    "op9_packing": op9_packing.query,
    "op10_embedding_dedup": op10_embeddings.query,
    "op11_hard_negatives": op11_negatives.query,
    "op12_quality_classifier": op12_quality.query,
    "op13_lexical_search": op13_lexical.query,
}

ORACLE: dict[str, str] = {
    "op3_exact_dedup": op3_exact.ORACLE_SQL,
    "op10_embedding_dedup": op10_embeddings.ORACLE_SQL,
    "op11_hard_negatives": op11_negatives.ORACLE_SQL,
    "op13_lexical_search": op13_lexical.ORACLE_SQL,
}
