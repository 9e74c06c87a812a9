"""Language identification by error-correcting output codes over byte n-grams.

Every language gets a binary codeword; all codewords differ in many bits (all possible splits of the
languages for few of them, else a fixed random code of good distance). For each bit a binary classifier
predicts on which side of the split a text lies: a naive Bayes log-odds of hashed byte 2- and 3-grams,
its margin scaled by what the languages themselves score. Decoding adds, over the bits, the hinge loss
of the margin against each codeword, weighted by how well the bit separates the languages, and takes the
nearest codeword; the score is the relative gap to the runner-up, and a small gap flags ambiguity.

Learning counts n-grams per language over all labelled rows; each task sends one row of fixed size per
language and block of counters, and blocks are added up where they meet. Prediction uses the text only.

Defined results: null text, or one without a letter, is ``und`` with score 0; without any labelled row
every text is ``und``; with one learned language every text with a letter has it, score 1; a text too
short for n-grams gets the first language in order, flagged ambiguous with score 0; rows with a null id
or null lang are not learned from; equal rows each give a row; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, table
from .textnum import text_slices

BUCKET_BITS = 13
PARTS = 8                  # blocks of a language's counters
AMBIGUOUS = 0.02           # relative gap of the two nearest codewords
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
# A-Z in lower case, other characters below 0x80 that are not letters count as space.
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x61:0x7B] = _FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_NONE = 1 << BUCKET_BITS   # n-grams across documents or within space


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash bucket of the 3-gram and of the 2-gram that start at each byte."""
    n = len(data)
    x = np.zeros(n + 2, np.uint32)
    x[:n] = _FOLD[data]
    two = x[:n] | (x[1:n + 1] << np.uint32(8))
    three = two | (x[2:] << np.uint32(16))
    out = []
    for grams, size in ((three, 3), (two | np.uint32(0xFF0000), 2)):
        with np.errstate(over="ignore"):
            idx = ((grams * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)
        for k in range(1, size):   # the last size - 1 starts of each document
            ends = offsets[1:] - k
            idx[ends[ends >= offsets[:-1]]] = _NONE
        out.append(idx)
    space = two == 0x2020
    out[0][space] = _NONE
    out[1][space] = _NONE
    return out[0], out[1]


def _counts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, raw bytes, float32 n-gram counts per row) for runs of rows."""
    for lo, hi, data, offsets in text_slices(column):
        three, two = _buckets(data, offsets)
        for a in range(0, hi - lo, 64):
            b = min(a + 64, hi - lo)
            counts = np.empty((b - a, _NONE), np.float64)
            for i in range(a, b):
                s = slice(offsets[i], offsets[i + 1])
                counts[i - a] = (np.bincount(three[s], minlength=_NONE + 1) + np.bincount(two[s], minlength=_NONE + 1))[:_NONE]
            yield lo + a, lo + b, data, counts


def learn_counts(labelled: DataFrame) -> dict[str, np.ndarray]:
    """n-gram counts of each language over all rows (lang, text)."""
    width = _NONE // PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for lo, hi, _, counts in _counts(batch.column(1)):
                here = langs[lo:hi]
                for lang in set(here):
                    got = counts[here == lang].sum(axis=0).astype(np.int64)
                    sums[lang] = sums[lang] + got if lang in sums else got
        give_back()
        rows = [(lang, p, c[p * width:(p + 1) * width].tobytes()) for lang, c in sums.items() for p in range(PARTS)]
        yield _rows(rows)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for lang, part, raw in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                block = np.frombuffer(raw, np.int64)
                sums[lang, part] = sums[lang, part] + block if (lang, part) in sums else block
        yield _rows([(lang, part, c.tobytes()) for (lang, part), c in sums.items()])

    schema = "lang string, part int, counts binary"
    blocks = labelled.mapInArrow(count, schema).repartition("lang", "part").mapInArrow(add, schema).collect()
    out: dict[str, np.ndarray] = {}
    for lang, part, raw in blocks:
        out.setdefault(lang, np.zeros(_NONE, np.int64))[part * width:(part + 1) * width] = np.frombuffer(raw, np.int64)
    return dict(sorted(out.items()))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    lang, part, counts = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(part, pa.int32()), pa.array(counts, pa.binary())],
                                      ["lang", "part", "counts"])


def code(n: int, seed: int = 7) -> np.ndarray:
    """Codewords as rows of +1 and -1: all splits up to 6 languages, else the best of some random codes."""
    if n <= 1:
        return np.ones((n, 0))
    if n <= 6:
        splits = np.arange(1, 1 << (n - 1))
        return np.array([[1 - 2 * (s >> i & 1) for s in splits] for i in range(n)], float)
    rng, best, least = np.random.default_rng(seed), None, -1
    for _ in range(50):
        draw = rng.choice([-1.0, 1.0], (n, int(np.ceil(10 * np.log2(n)))))
        apart = min(int((draw[i] != draw[j]).sum()) for i in range(n) for j in range(i))
        usable = (np.abs(draw.sum(axis=0)) < n).all()
        if usable and apart > least:
            best, least = draw, apart
    return best


class Model:
    """Weights of the bit classifiers and their code."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.languages = list(counts)
        self.code = code(len(counts))
        if not self.code.shape[1]:
            return
        share = np.array([(c + 0.5) / (c.sum() + 0.5 * len(c)) for c in counts.values()])
        self.weights = np.empty((_NONE, self.code.shape[1]))
        for bit, side in enumerate(self.code.T):
            self.weights[:, bit] = np.log(share[side > 0].mean(axis=0)) - np.log(share[side < 0].mean(axis=0))
        expected = share @ self.weights * self.code     # each language's own margin, on its side
        self.scale = np.maximum(np.abs(expected).mean(axis=0), 1e-9)
        self.bit_weight = np.maximum(expected.min(axis=0) / self.scale, 0.0) + 1e-6

    def decode(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per row the nearest codeword's language and the relative gap to the next."""
        if not self.code.shape[1]:
            return np.zeros(len(counts), int), np.ones(len(counts))
        total = counts.sum(axis=1, keepdims=True)
        margin = counts @ self.weights / np.maximum(total, 1) / self.scale
        loss = np.stack([(np.maximum(0.0, 1.0 - margin * word) * self.bit_weight).sum(axis=1) for word in self.code], axis=1)
        order = np.sort(loss, axis=1)
        gap = (order[:, 1] - order[:, 0]) / np.maximum(order[:, 1] + order[:, 0], 1e-12)
        return loss.argmin(axis=1), np.clip(gap, 0.0, 1.0)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    rows = docs.where(docs[id_col].isNotNull() & docs[lang_col].isNotNull() & docs[text_col].isNotNull() & ~held_out(docs[id_col]))
    return Model(learn_counts(rows.select(docs[lang_col].cast("string").alias("lang"), docs[text_col].alias("text"))))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous) and the columns named in ``keep``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(docs[text_col].alias("text"), docs[id_col].alias("doc_id"), held_out(docs[id_col]).alias("held_out"),
                       *[docs[c].alias(f"kept_{i}") for i, c in enumerate(keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = shared.value
        names = np.array([*learned.languages, UNKNOWN], object)
        for batch in batches:
            texts = batch.column(0)
            best, score = np.full(len(batch), len(names) - 1), np.zeros(len(batch))
            if learned.languages:
                for lo, hi, _, counts in _counts(texts):
                    best[lo:hi], score[lo:hi] = learned.decode(counts)
            for i, text in enumerate(texts.to_pylist()):
                if text is None or not _LETTER.search(text):
                    best[i], score[i] = len(names) - 1, 0.0
            unsure = (score < AMBIGUOUS) & (best < len(names) - 1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(names[best], pa.string()), pa.array(score), pa.array(unsure)],
                [*batch.schema.names[1:], "lang_pred", "score", "ambiguous"])
        give_back()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    out = rows.mapInArrow(run, f"{fields}, lang_pred string, score double, ambiguous boolean")
    return out.select("doc_id", "held_out", "lang_pred", "score", "ambiguous",
                      *[F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))
