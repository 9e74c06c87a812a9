"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated.

Words are runs of letters and digits and runs of other signs, in their own case. Every word hashes to one
of ``BUCKETS`` rows; each row has a fixed random index vector of a few +1 and -1, and its word vector is
the sum of the index vectors of the words beside it in all texts of the table (random indexing). Each
task sends its sums, blocks of rows are added where they meet, so the learned table has a fixed size.
Word vectors are taken per occurrence, centred on the corpus mean and set to length one.

A document is pooled to the mean of its word vectors, their root mean square and the mean product of
neighbouring words' vectors (how alike neighbours are). A two-layer network (tanh, logistic) is trained in
numpy on at most ``TRAIN_ROWS`` labelled documents, chosen by a hash of their id; word vectors cover all
rows. One part in ``CALIBRATION`` of the chosen rows is not trained on but sets the temperature by which the logits
are divided, so that scores are probabilities.

Labels come only from rows outside the held-out third. A score uses the text alone.

Defined results: null and empty texts are scored as documents without words; rows with a null id have
held_out false, are scored and never learned from; several labels of one document are several examples;
null labels and labels without a document are ignored; without labels of both kinds every score is the
smoothed share of good ones (0.5 without any); equal rows each give a row; other columns are ignored. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scan_tasks, table
from .textnum import PolyHash, random_table, text_slices

BUCKET_BITS = 12
BUCKETS = 1 << BUCKET_BITS
DIM = 32
NONZERO = 4
REACH = 2                # neighbours on each side
BLOCKS = 16              # blocks of rows in which sums travel
TRAIN_ROWS = 16_384      # bound of the sample of labelled rows that the network is fitted on
CALIBRATION = 6
PIECE_BYTES = 1 << 20
HIDDEN = 24
EPOCHS = 60
BATCH = 128
RATE = 3e-3
DECAY = 1e-4
_POLY, _BYTES = PolyHash(31), random_table(32, 256)
_KIND = np.array([0 if c <= 0x20 else 1 if c >= 0x80 or chr(c).isalnum() else 2 for c in range(256)], np.uint8)
#: Index vectors: for each bucket the places of its non-zero entries and their signs.
_DRAW = random_table(33, BUCKETS * NONZERO).reshape(BUCKETS, NONZERO)
PLACES = (_DRAW % np.uint64(DIM)).astype(np.int64)
SIGNS = 1 - 2 * (_DRAW >> np.uint64(63)).astype(np.int64)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word and each text's first word (one entry more than texts)."""
    kind = _KIND[data]
    begin = np.ones(len(data), bool)
    begin[1:] = kind[1:] != kind[:-1]
    begin[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], len(data))[:len(starts)]
    use = kind[starts] > 0
    starts, ends = starts[use], ends[use]
    buckets = (_POLY.ranges(_BYTES[data], starts, ends) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    return buckets, np.searchsorted(starts, offsets)


def context_sums(buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per bucket the sum of the index vectors of neighbouring words, and in the last column its words."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    pairs: list[np.ndarray] = []
    for step in range(1, REACH + 1):
        same = text[step:] == text[:-step]
        left, right = buckets[:-step][same], buckets[step:][same]
        pairs += [left * BUCKETS + right, right * BUCKETS + left]
    pair, times = np.unique(np.concatenate(pairs), return_counts=True)
    word, beside = pair // BUCKETS, pair % BUCKETS
    cells = (word[:, None] * (DIM + 1) + PLACES[beside]).reshape(-1)
    sums = np.bincount(cells, (times[:, None] * SIGNS[beside]).reshape(-1), BUCKETS * (DIM + 1)).astype(np.int64)
    sums = sums.reshape(BUCKETS, DIM + 1)
    sums[:, DIM] = np.bincount(buckets, minlength=BUCKETS)
    return sums


def learn_vectors(texts: DataFrame) -> np.ndarray:
    """Word vectors (float32, one row per bucket) of all texts."""
    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((BUCKETS, DIM + 1), np.int64)
        for batch in batches:
            for _, data, offsets in pieces(batch.column(0)):
                sums += context_sums(*words(data, offsets))
        yield _blocks((k, block) for k, block in enumerate(np.split(sums, BLOCKS)) if block.any())

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                block = np.frombuffer(raw, np.int64).reshape(-1, DIM + 1)
                sums[k] = sums[k] + block if k in sums else block
        yield _blocks(sums.items())

    schema = "block int, sums binary"
    sums = np.zeros((BLOCKS, BUCKETS // BLOCKS, DIM + 1), np.int64)
    for k, raw in scan_tasks(texts).mapInArrow(collect, schema).repartition(BLOCKS, "block").mapInArrow(add, schema).collect():
        sums[k] = np.frombuffer(raw, np.int64).reshape(-1, DIM + 1)
    sums = sums.reshape(BUCKETS, DIM + 1).astype(np.float64)
    seen = np.maximum(sums[:, DIM:], 1)
    vectors = sums[:, :DIM] / seen - sums[:, :DIM].sum(axis=0) / max(sums[:, DIM].sum(), 1)
    length = np.sqrt((vectors ** 2).sum(axis=1, keepdims=True))
    return np.where(sums[:, DIM:] > 0, vectors / np.maximum(length, 1e-9), 0.0).astype(np.float32)


def _blocks(rows) -> pa.RecordBatch:
    rows = [(k, block.tobytes()) for k, block in rows]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["block", "sums"])


def pieces(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of each piece, bytes, offsets): runs of texts; a text beyond ``PIECE_BYTES`` comes in pieces cut at
    white space, whose neighbours across the cut count as no neighbours."""
    for lo, hi, data, offsets in text_slices(column):
        if len(data) <= PIECE_BYTES:
            yield np.arange(lo, hi), data, offsets
            continue
        at, row = 0, np.array([lo])       # a slice this long is a single text
        while at < len(data):
            gaps = np.flatnonzero(data[at + PIECE_BYTES:] <= 0x20) if at + PIECE_BYTES < len(data) else ()
            end = at + PIECE_BYTES + int(gaps[0]) if len(gaps) else len(data)
            yield row, data[at:end], np.array([0, end - at])
            at = end


def pooled(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Per document: mean vector, root mean square, mean product of neighbours; zeros without words."""
    sums, n_words, n_pairs = np.zeros((len(column), 3 * DIM)), np.zeros(len(column)), np.zeros(len(column))
    for rows, data, offsets in pieces(column):
        buckets, first = words(data, offsets)
        n = np.diff(first)
        full = n > 0
        if not full.any():
            continue
        at, mine = first[:-1][full], vectors[buckets]
        beside = np.zeros_like(mine)
        np.multiply(mine[1:], mine[:-1], out=beside[:-1])
        beside[first[1:][full] - 1] = 0     # the last word of a text has no next one
        sums[rows[full]] += np.hstack([np.add.reduceat(x, at, axis=0, dtype=np.float64) for x in (mine, np.square(mine), beside)])
        n_words[rows[full]] += n[full]
        n_pairs[rows[full]] += n[full] - 1
    size = np.maximum(n_words, 1)[:, None]
    sums[:, :2 * DIM] /= size
    sums[:, 2 * DIM:] /= np.maximum(n_pairs, 1)[:, None]
    np.sqrt(sums[:, DIM:2 * DIM], out=sums[:, DIM:2 * DIM])
    return sums.astype(np.float32)


@dataclass
class Network:
    """Standardised inputs, one tanh layer, one logit, a temperature; ``prior`` stands for all without layers."""

    prior: float
    layers: tuple[np.ndarray, ...] = ()
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        centre, spread, w1, b1, w2, b2 = self.layers
        return np.tanh((x - centre) / spread @ w1 + b1) @ w2 + b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.layers:
            return np.full(len(x), self.prior)
        return _logistic(self.logits(x.astype(np.float64)) / self.temperature)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, calibrate: np.ndarray, seed: int = 34) -> Network:
    """Fit on the rows outside ``calibrate`` with Adam, then take the temperature of least log loss on the others."""
    prior = (y.sum() + 0.5) / (len(y) + 1)
    fit = ~calibrate
    if len(np.unique(y[fit])) < 2:
        return Network(float(prior))
    rng = np.random.default_rng(seed)
    x, y = x.astype(np.float64), y.astype(np.float64)
    centre, spread = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-6
    inputs, target = (x[fit] - centre) / spread, y[fit]
    p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN ** -0.5, HIDDEN), np.array(0.0)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(inputs))
        for rows in np.split(order, range(BATCH, len(order), BATCH)):
            hidden = np.tanh(inputs[rows] @ p[0] + p[1])
            error = (_logistic(hidden @ p[2] + p[3]) - target[rows]) / len(rows)
            back = np.outer(error, p[2]) * (1 - hidden ** 2)
            step += 1
            for i, g in enumerate((inputs[rows].T @ back + DECAY * p[0], back.sum(axis=0), hidden.T @ error + DECAY * p[2], error.sum())):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - rate * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.999 ** step)) + 1e-8)
    network = Network(float(prior), (centre, spread, *p))
    if len(np.unique(y[calibrate])) == 2:
        z, truth = network.logits(x[calibrate]), y[calibrate]
        grid = np.geomspace(0.25, 8.0, 61)
        loss = [-np.mean(np.log(np.where(truth > 0, q, 1 - q) + 1e-12)) for q in (_logistic(z / t) for t in grid)]
        network.temperature = float(grid[int(np.argmin(loss))])
    return network


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id",
        label_col: str = "quality", train_rows: int = TRAIN_ROWS) -> tuple[np.ndarray, Network]:
    """Word vectors of all documents, and the network fitted on a bounded sample of labelled ones."""
    vectors = learn_vectors(docs.select(docs[text_col].alias("text")))
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    order = F.xxhash64(F.col("doc_id"), F.lit("quality"))
    known = labels.select(labels[label_id_col].alias("doc_id"), labels[label_col].cast("int").alias("label"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    sample = known.orderBy(order, "label").limit(train_rows)
    texts = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pooled(batch.column(0), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([r.tobytes() for r in found], pa.binary())], ["place", "label", "x"])

    chosen = texts.join(F.broadcast(sample), "doc_id").select("text", order.alias("place"), "label")
    found = chosen.mapInArrow(features, "place long, label int, x binary").toArrow().combine_chunks()
    x = np.frombuffer(b"".join(found["x"].to_pylist()), np.float32).reshape(-1, 3 * DIM)
    y, place = found["label"].to_numpy(), found["place"].to_numpy()
    at = np.lexsort((*x.T[:1], y, place))     # whatever order the tasks ended in
    x, y, place = x[at], y[at], place[at]
    return vectors, train(x, y, place % CALIBRATION == 0) if len(y) else Network(0.5)


def score(docs: DataFrame, model: tuple[np.ndarray, Network], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(docs[text_col].alias("text"), docs[id_col].alias("doc_id"), held_out(docs[id_col]).alias("held_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network = shared.value
        for batch in batches:
            found = network.scores(pooled(batch.column(0), vectors))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(found), pa.array((found >= 0.5).astype(np.int32))],
                                             ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
