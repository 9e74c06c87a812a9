"""Substring deduplication by content-defined chunks.

A gear rolling hash (h = 2 h + G[byte], 32 bits, so it sees the last 32 bytes) runs over every text; a
text is cut where the hash is small at a place between words, unless another such place lies just before.
Cuts thus depend on nearby content only: an insertion moves the chunks after it but does not change them,
and a passage has the same inner chunks wherever it stands.

A stretch of more than ``LONG_BYTES`` without such a cut (long data strings, scripts without spaces) is cut
at character boundaries by the same hash, so that it too has the same chunks wherever it stands; only what
repeats itself so closely that no place stands out is cut by length.

Chunks are grouped by 96 bits of their digest over the corpus: among 10^12 chunks two different ones are taken for
equal with a probability of one in 100,000. Of equal chunks the first (smallest doc_id,
then place) stays, the others are dropped where consecutive ones make up at least ``MIN_BYTES``: shorter
repeats are idiom and stay. Groups are reduced to their first chunk by partial aggregates and joined
back as an ordinary join that Spark can split, so a passage that a third of all documents hold is no
task's load. Texts move once, to meet their dropped spans.

Defined results: null text stays null and an empty text empty; texts without spaces between words are
cut between three-byte characters or as long stretches; equal rows count as one and
keep their text alike, rows of one id with different texts are different documents; rows with a null id
keep their text and lend nothing; other columns are carried along unchanged. An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, materialize, table
from .textnum import random_table, text_slices

CUT_SHARE = 1 / 4      # of the places between words
GAP_BYTES = 12         # a place with another one so near before it is no cut
LONG_BYTES = 1024      # a chunk beyond it is cut anew,
LONG_SHARE = 1 / 256   # at this share of its characters
MIN_BYTES = 80         # least length of a dropped run of chunks
WINDOW = 32

_GEAR = (random_table(31, 256) >> np.uint64(32)).astype(np.uint32)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def gear_hash(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte; every document starts anew."""
    pad = WINDOW
    spread = np.zeros(len(data) + pad * (len(offsets) - 1), np.uint32)
    for i in range(len(offsets) - 1):
        at = offsets[i] + pad * (i + 1)
        spread[at:at + offsets[i + 1] - offsets[i]] = _GEAR[data[offsets[i]:offsets[i + 1]]]
    size = 1
    while size < WINDOW:     # the sum over twice as many bytes, from two sums over so many
        shifted = spread[:-size] << np.uint32(size)
        spread[size:] += shifted
        size *= 2
    keep = np.ones(len(spread), bool)
    for i in range(len(offsets) - 1):
        keep[offsets[i] + pad * i:offsets[i] + pad * (i + 1)] = False
    return spread[keep]


def chunk_bounds(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ends of all chunks, document ends among them, in order."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    place = _SPACE[data]
    place[:-1] |= data[1:] >= 0xE0
    hashes = gear_hash(data, offsets)
    place &= hashes < np.uint32(int(CUT_SHARE * 2**32))
    cuts = np.flatnonzero(place) + 1
    doc = np.searchsorted(offsets, cuts, "left")
    near = np.zeros(len(cuts), bool)
    near[1:] = (np.diff(cuts) < GAP_BYTES) & (doc[1:] == doc[:-1])
    cuts = np.unique(np.concatenate([cuts[~near], offsets[1:][offsets[1:] > 0]]))
    starts = np.concatenate([[0], cuts[:-1]])
    more = [_long_cuts(data, hashes, at, end) for at, end in
            zip(starts[cuts - starts > LONG_BYTES].tolist(), cuts[cuts - starts > LONG_BYTES].tolist(), strict=True)]
    return np.sort(np.concatenate([cuts, *more]).astype(np.int64)) if more else cuts


def _long_cuts(data: np.ndarray, hashes: np.ndarray, start: int, end: int) -> np.ndarray:
    """Cuts within a stretch that has none: before characters where the hash is small, the first of close
    ones; then, where none stands out, every LONG_BYTES."""
    whole = (data[start + 1:end] & 0xC0) != 0x80          # before a character's first byte
    places = start + 1 + np.flatnonzero(whole & (hashes[start:end - 1] < np.uint32(int(LONG_SHARE * 2**32))))
    far = np.ones(len(places), bool)
    far[1:] = np.diff(places) >= GAP_BYTES
    cuts, at = [], start
    for stop in [*places[far].tolist(), end]:
        while stop - at > LONG_BYTES:
            at += LONG_BYTES
            while data[at] & 0xC0 == 0x80:    # not within a character
                at -= 1
            cuts.append(at)
        if stop < end:
            cuts.append(stop)
        at = stop
    return np.array(cuts, np.int64)


def chunks(docs: DataFrame) -> DataFrame:
    """(high, low, doc_id, text_hash, start) of every chunk of (doc_id, text_hash, text): 64 bits of its digest, 32 more
    with its length below them (a shuffled row has eight bytes for either column), and where it stands."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            ids, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, _, data, offsets in text_slices(batch.column(2)):
                ends = chunk_bounds(data, offsets)
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)[:len(ends)]
                raw = memoryview(data)
                digests = b"".join([digest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
                parts = np.frombuffer(digests, np.int32).reshape(-1, 4)
                doc = np.searchsorted(offsets, starts, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ascontiguousarray(parts[:, :2]).view(np.int64).ravel()),
                     pa.array(parts[:, 2].astype(np.int64) << 32 | (ends - starts)), pa.array(ids[lo + doc]),
                     pa.array(hashes[lo + doc]), pa.array((starts - offsets[doc]).astype(np.int32))],
                    ["high", "low", "doc_id", "text_hash", "start"])
        give_back()

    return docs.mapInArrow(run, "high long, low long, doc_id long, text_hash long, start int")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, start, length, kept_in) of the chunks that stand earlier in the corpus.

    The texts are cut twice, for the first places and for the join: as a table, all chunks would take
    most of the texts' size beside both shuffles."""
    place = F.struct("doc_id", "text_hash", "start")
    every = chunks(docs)
    first = every.groupBy("high", "low").agg(F.min(place).alias("first"), F.count("*").alias("m"))
    first = materialize(first.where("m > 1").select("high", "low", "first"), "repeated")
    later = every.join(first, ["high", "low"]).where(place != F.col("first"))
    length = F.col("low").bitwiseAND(F.lit(2**32 - 1)).cast("int").alias("length")
    return later.select("doc_id", "text_hash", "start", length, F.col("first.doc_id").alias("kept_in"))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = MIN_BYTES) -> DataFrame:
    """All columns of ``docs`` with the deduplicated text, and ``_spans`` (dropped byte ranges) and
    ``_kept_in`` (documents that keep them)."""
    plain = docs.where(docs[id_col].isNotNull()).select(
        docs[id_col].cast("long").alias("doc_id"), F.xxhash64(docs[text_col]).alias("text_hash"), docs[text_col].alias("text"))
    spans = repeated_spans(plain).groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(
        F.collect_set(F.struct("start", "length", "kept_in")).alias("_chunks"))
    same = (docs[id_col].cast("long") == spans["_id"]) & (F.xxhash64(docs[text_col]) == spans["_hash"])
    joined = docs.join(spans, same, "left").drop("_id", "_hash")
    joined = joined.withColumn("_text", docs[text_col]).drop(docs[text_col])
    others = [c for c in joined.columns if c not in ("_chunks", "_text")]
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, dropped, kept = [], [], []
            for text, found in zip(batch.column("_text"), batch.column("_chunks"), strict=True):
                text, found = text.as_py(), found.as_py()
                runs: list[list] = []
                for c in sorted(found or (), key=lambda c: c["start"]):
                    if runs and runs[-1][1] == c["start"]:
                        runs[-1][1] += c["length"]
                        runs[-1][2].add(c["kept_in"])
                    else:
                        runs.append([c["start"], c["start"] + c["length"], {c["kept_in"]}])
                runs = [r for r in runs if r[1] - r[0] >= min_bytes]
                if runs:
                    raw, at, left = text.encode(), 0, []
                    for a, b, _ in runs:
                        left.append(raw[at:a])
                        at = b
                    text = b"".join([*left, raw[at:]]).decode()
                texts.append(text)
                dropped.append([{"start": a, "stop": b} for a, b, _ in runs])
                kept.append(sorted(set().union(*[r[2] for r in runs])))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in others], pa.array(texts, pa.string()), pa.array(dropped, span),
                 pa.array(kept, pa.list_(pa.int64()))], [*others, text_col, "_spans", "_kept_in"])

    fields = ", ".join(f"`{c}` {joined.schema[c].dataType.simpleString()}" for c in others)
    out = joined.mapInArrow(run, f"{fields}, `{text_col}` string, _spans array<struct<start long, stop long>>, _kept_in array<long>")
    return out.select(*docs.columns, "_spans", "_kept_in")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    size = F.coalesce(F.aggregate("_spans", F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["start"]), F.lit(0))
    return done.select("doc_id", (F.size("_spans") > 0).alias("changed"), size.alias("removed_bytes"),
                       F.col("_spans").alias("spans"), F.col("_kept_in").alias("kept_in"), "text")
