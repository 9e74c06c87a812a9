import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tectonic.llm import op12_quality as op

GOOD = "the river was calm and the old boat went on along its green banks in the morning".split()


def text(rng, good):
    if good:
        return " ".join(rng.choice(GOOD) for _ in range(60))
    word = rng.choice(GOOD)
    return " ".join([f"{word}!!" if rng.random() < 0.5 else word] * 60)


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    return [(i, text(rng, i % 4 != 0)) for i in range(n)], [(i, int(i % 4 != 0), 0) for i in range(n)]


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("label", F.lit("x"))


def out_of(i):
    return i is not None and zlib.crc32(str(i).encode()) % 3 == 1


@pytest.fixture(scope="module")
def learned(spark):
    docs, labels = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return op.fit(df, labels_of(spark, labels))


def test_held_out_accuracy_and_calibration(spark, make_docs, learned):
    docs, labels = corpus()
    got = {r.doc_id: r for r in op.score(make_docs(docs), learned).collect()}
    assert set(got) == {i for i, _ in docs}
    assert all(got[i].held_out == out_of(i) for i, _ in docs)
    assert all(got[i].predicted == (got[i].score >= 0.5) and 0 <= got[i].score <= 1 for i, _ in docs)
    unseen = [(got[i], y) for i, y, _ in labels if out_of(i)]
    assert np.mean([r.predicted == y for r, y in unseen]) > 0.97
    assert abs(np.mean([r.score for r, _ in unseen]) - np.mean([y for _, y in unseen])) < 0.05


def test_labels_of_the_held_out_third_change_nothing(spark, make_docs, learned):
    docs, labels = corpus()
    flipped = [(i, 1 - y if out_of(i) else y, t) for i, y, t in labels] + [(None, 1, 0), (10**9, 0, 0), (3, None, 0)]
    again = op.fit(spark.createDataFrame(docs, "doc_id long, text string"), labels_of(spark, flipped))
    a, b = ([r.score for r in op.score(make_docs(docs), m).orderBy("doc_id").collect()] for m in (learned, again))
    assert np.allclose(a, b, atol=1e-9)


def test_odd_rows(make_docs, learned):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "!"), (5, "x" * 300_000), (6, "é ß 漢字 " * 50_000), (None, "a b"), (7, "a b"), (7, "a b"), (8, "\x00 a")]
    got = op.score(make_docs(rows), learned).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[1] == by[2] == by[3] and by[None] == by[7]
    assert [r.held_out for r in got if r.doc_id is None] == [False]


def test_without_labels_or_rows(spark, make_docs):
    docs = make_docs([(1, "a b c"), (2, None)])
    assert {r.score for r in op.score(docs, op.fit(docs, labels_of(spark, []))).collect()} == {0.5}
    one = next(i for i in range(1, 50) if not out_of(i))
    docs = make_docs([(one, "a b c"), (99, "d")])
    assert {r.score for r in op.score(docs, op.fit(docs, labels_of(spark, [(one, 1, 0)]))).collect()} == {0.75}
    empty = make_docs([])
    assert op.score(empty, op.fit(empty, labels_of(spark, [(1, 1, 0)]))).collect() == []


def test_word_vectors_equal_a_plain_random_index(spark):
    texts = ["one two three two one", "two, two! three", "", "solo"]
    sums = np.zeros((op.BUCKETS, op.DIM))
    counts = np.zeros(op.BUCKETS)
    index = np.zeros((op.BUCKETS, op.DIM))
    for k in range(op.NONZERO):
        np.add.at(index, (np.arange(op.BUCKETS), op.PLACES[:, k]), op.SIGNS[:, k])
    for t in texts:
        raw = t.encode()
        b, _ = op.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        for i, w in enumerate(b):
            counts[w] += 1
            for j in range(max(0, i - op.REACH), min(len(b), i + op.REACH + 1)):
                if j != i:
                    sums[w] += index[b[j]]
    want = sums / np.maximum(counts, 1)[:, None] - sums.sum(axis=0) / counts.sum()
    want = np.where(counts[:, None] > 0, want / np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9), 0)
    got = op.learn_vectors(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert np.allclose(got, want, atol=1e-5)


def test_pieces_of_a_long_text_pool_alike(monkeypatch):
    import pyarrow as pa

    rng = random.Random(5)
    column = pa.array([" ".join(rng.choice(GOOD) for _ in range(200_000)), "a b", None, "x" * 1_200_000])
    vectors = np.random.default_rng(6).normal(size=(op.BUCKETS, op.DIM)).astype(np.float32)
    whole = op.pooled(column, vectors)
    monkeypatch.setattr(op, "PIECE_BYTES", 1 << 16)
    assert np.allclose(op.pooled(column, vectors), whole, atol=2e-4)


def test_temperature_lowers_the_loss_of_the_calibration_rows():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 3 * op.DIM))
    y = (x[:, 0] + rng.normal(scale=1.5, size=900) > 0).astype(int)
    hold = np.arange(900) % op.CALIBRATION == 0
    network = op.train(x, y, hold)
    z, t = network.logits(x[hold]), y[hold]
    loss = lambda temp: -np.mean(np.log(np.where(t > 0, op._logistic(z / temp), 1 - op._logistic(z / temp)) + 1e-12))
    assert network.temperature > 1 and loss(network.temperature) < loss(1.0)
