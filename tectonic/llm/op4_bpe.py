"""BPE encoding and decoding over all texts, words through a prefix-sharing trie.

Every task splits its texts into words, looks up the words it has met and sends the distinct new ones
through the trie of ``wordbpe``; a document's ids are the ids of its words in order. The word cache is
bounded and only saves work. Rows stay where they are: no shuffle, no state beyond a task.

Defined results: null text counts as empty; an empty text has no ids, the decoded text is empty; the
strings of added tokens in a text become those tokens; rows with equal ids each give a row; other
columns, whatever their names, are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from . import wordbpe
from .common import table
from .textnum import text_slices


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>): the token ids of every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with wordbpe.loaded(path) as coder:
            for batch in batches:
                for lo, hi, *_ in text_slices(batch.column(1), wordbpe.SLICE_BYTES):
                    part = batch.slice(lo, hi - lo)
                    _, _, ids, first = coder.encode([t or "" for t in part.column(1).to_pylist()])
                    lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([part.column(0), lists], ["doc_id", "ids"])

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(
        run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text): the decoded text of (doc_id, ids) rows; null ids give an empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with wordbpe.loaded(path) as coder:
            for batch in batches:
                lists = batch.column(1)
                first = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())])
                texts = coder.decode_lists(pc.list_flatten(lists).to_numpy(), first)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """Encode, then decode the ids, in one pass; per document the number of ids and the digests of both results."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with wordbpe.loaded(path) as coder:
            for batch in batches:
                for lo, hi, *_ in text_slices(batch.column(1), wordbpe.SLICE_BYTES):
                    part = batch.slice(lo, hi - lo)
                    _, _, ids, first = coder.encode([t or "" for t in part.column(1).to_pylist()])
                    raw = memoryview(ids.astype("<u4").tobytes())
                    ids_sha = [hashlib.sha256(raw[4 * a:4 * b]).hexdigest() for a, b in zip(first[:-1], first[1:], strict=True)]
                    text_sha = [hashlib.sha256(text).hexdigest() for text in coder.decode_lists(ids, first)]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pa.array(np.diff(first).astype(np.int64)), pa.array(ids_sha), pa.array(text_sha)],
                        ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(table(spark, sf_dir, "documents"), wordbpe.default_path())
