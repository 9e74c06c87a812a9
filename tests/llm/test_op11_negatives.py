import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tectonic.llm import op11_negatives as op

SCHEMA = "vec_id long, embedding array<double>, label int"


def coded(rows):
    out = []
    for vec_id, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * x) for x in v]
        if sum(x * x for x in q) <= op.MOST_SQUARED:
            out.append((vec_id, q, label))
    return out


def brute(rows, every=5):
    rows = coded(rows)
    out = []
    key = lambda c: (-c[0], c[1] is None, c[1] or 0)
    for i, (a, q, label) in enumerate(rows):
        if a is None or a % every:
            continue
        scored = [(sum(x * y for x, y in zip(q, w, strict=True)), b, other == label)
                  for j, (b, w, other) in enumerate(rows) if j != i and len(w) == len(q)]
        for ps, p, _ in sorted((s for s in scored if s[2]), key=key)[:5]:
            fit = [s for s in scored if not s[2] and 50 * ps <= 100 * s[0] <= 95 * ps]
            out += [(a, p, k, n, ps, ns) for k, (ns, n, _) in enumerate(sorted(fit, key=key)[:3], 1)]
    return sorted(out, key=str)


def run(spark, rows, every=5):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS uid", "2 AS code", "'x' AS vector", "3 AS anchor", "4 AS slot", "5 AS dim")
    found = op.hard_negatives(df, F.col("label"), F.col("vec_id") % every == 0)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, found.collect()), key=str)


def fixture(seed=0, n=240, dim=20):
    rng = np.random.default_rng(seed)
    shared = rng.normal(size=dim)
    rows = [(i, (shared + rng.normal(scale=0.8, size=dim)).tolist(), int(rng.integers(4))) for i in range(n)]
    v = rows[0][1]
    rows += [(1000 + i, v, i % 2) for i in range(12)] + [(1000, v, 1), (1000, v, 1), (None, v, 0), (None, v, 1)]      # ties, repeats, null ids
    rows += [(2000, None, 1), (2005, [], 1), (2006, [], 2), (2010, [0.0] * dim, 1), (2015, [None, *v[1:]], 1), (2020, [float("nan"), *v[1:]], 1),
             (2025, [float("inf"), *v[1:]], 1), (2030, v, None), (2035, v[:3], 1), (2036, v[:3], 2), (2037, v[:3], 1), (2040, [1e300] * dim, 1),
             (2045, [-x for x in v], 1), (2050, [1e6 * x for x in v], 2), (2055, [1e-9] * dim, 3)]
    return rows


def test_equals_brute_force(spark):
    rows = fixture()
    assert run(spark, rows) == brute(rows)


def test_small_blocks_and_batches_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK_ANCHORS", 9)
    monkeypatch.setattr(op, "PAIRS_AT_ONCE", 16)
    rows = fixture(1, 120)
    assert run(spark, rows) == brute(rows)


def test_empty_tables_and_no_anchor(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0, 0.0], 1), (2, [1.0, 0.1], 2)]) == []
    assert run(spark, [(5, [1.0, 0.0], 1), (2, [1.0, 0.1], 2)]) == []


def test_long_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=1500)
    rows = [(i, (base + rng.normal(scale=1.0, size=1500)).tolist(), i % 3) for i in range(40)]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("dim", [1, 3, 64, 100])
def test_intervals_hold_every_score_and_narrow_with_alignment(dim):
    rng = np.random.default_rng(dim)
    vectors = np.floor(256 * rng.normal(size=(400, dim))).astype(np.int64)
    vectors[0] = 0
    vectors[1] = 1
    codes, along, off, size = op.code_vectors(vectors)
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
    assert np.allclose(along ** 2 + off ** 2, size ** 2)
    for q in (vectors[0], vectors[1], vectors[2], 5 * vectors[3], np.floor(256 * rng.normal(size=dim)).astype(np.int64)):
        low, high = op.Planes(q).bounds(codes, ones, along, off, size)
        exact = vectors @ q
        assert (low <= exact).all() and (exact <= high).all()
        assert (high - low <= 2 * np.sqrt((q ** 2).sum()) * (off + 0.1 * size) + 1e-3).all()


def test_rotation_keeps_inner_products():
    rng = np.random.default_rng(9)
    v = rng.integers(-900, 900, (6, 37))
    turned = op.rotate(v)
    assert (turned @ turned.T == op.width(37) * (v @ v.T)).all()


def test_most_rows_of_other_clusters_are_never_scored(monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 64))
    q = np.floor(256 * (centres[rng.integers(12, size=3000)] + rng.normal(scale=0.1, size=(3000, 64)))).astype(np.int64)
    codes, along, off, size = op.code_vectors(q)
    names = [f.split()[0] for f in op.CODED.split(", ")]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(3000)), pa.array(range(3000)), pa.array([1] * 3000), pa.array([64] * 3000, pa.int32()), pa.array([False] * 3000),
         pa.array([v.tobytes() for v in q.astype("<i4")]), pa.array([c.tobytes() for c in codes]), pa.array(along), pa.array(off), pa.array(size)], names)
    part, scored = op.Part(batch, 64), []
    score = op.Part.score
    monkeypatch.setattr(op.Part, "score", lambda self, anchor, at: scored.append(len(at)) or score(self, anchor, at))
    anchor = op.Anchor(7, 1, q[7])
    anchor.search(part, [(0, 3000)])
    exact = q @ q[7]
    exact[7] = -(1 << 62)
    assert anchor.slots[0].scores.tolist() == sorted(exact.tolist(), reverse=True)[:5]
    assert sum(scored) < 600
