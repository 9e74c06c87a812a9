import math

import numpy as np
import pytest

from tectonic.llm import op10_embeddings as op


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(rows, cosine=op.COSINE):
    n, links = len(rows), {i: set() for i in range(len(rows))}
    for i in range(n):
        for j in range(i):
            (_, v, a), (_, w, b) = rows[i], rows[j]
            if a is not None and a == b and usable(v) and usable(w) and len(v) == len(w):
                x, y = np.array(v, float), np.array(w, float)
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= cosine:
                    links[i].add(j)
                    links[j].add(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        low = min(rows[j][0] for j in seen)
        out.append((rows[i][0], len(links[i]), low, rows[i][0] == low))
    return sorted(out)


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS id", "2 AS v", "3 AS links")
    return sorted(map(tuple, op.near_vectors(df, **more).collect()))


def fixture(seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for label in (1, 2):
        centre = rng.normal(size=16)
        rows += [(len(rows) + k, (centre + rng.normal(scale=s, size=16)).tolist(), label) for k, s in enumerate(np.linspace(0.01, 0.6, 70))]
        rows += [(len(rows) + k, rng.normal(size=16).tolist(), label) for k in range(60)]
    v = rows[0][1]
    rows += [(1000 + k, v, 1) for k in range(5)] + [(1010, [2 * x for x in v], 1), (1011, [-x for x in v], 1), (1012, v, 2), (1013, v, None)]
    rows += [(1020, None, 1), (1021, [], 1), (1022, [0.0] * 16, 1), (1023, [None, *v[1:]], 1), (1024, [float("nan"), *v[1:]], 1),
             (1025, [float("inf"), *v[1:]], 1), (1026, v[:8], 1), (1027, v[:8], 1), (1028, [x * 1e200 for x in v], 1), (1029, [0.0, -0.0], 7)]
    return rows


def test_equals_brute_force(spark):
    rows = fixture()
    assert run(spark, rows) == brute(rows)


def test_small_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK", 16)
    rows = fixture(3)
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("cosine", [0.5, 0.99])
def test_other_thresholds(cosine):
    rng = np.random.default_rng(1)
    x = op._unit(rng.normal(size=(200, 5)))
    y = op._unit(rng.normal(size=(150, 5)))
    for b in (None, y):
        (p, q), groups = op.dual_traversal(x, b, x, x if b is None else b, cosine)
        got = list(zip(p.tolist(), q.tolist(), strict=True))
        for u, v in groups:
            same = b is None and len(u) == len(v) and (u == v).all()
            got += [(i, j) for k, i in enumerate(u.tolist()) for m, j in enumerate(v.tolist()) if not same or k < m]
        full = x @ (x if b is None else b).T >= cosine
        want = {(i, j) for i, j in zip(*np.nonzero(full), strict=True) if b is not None or i < j}
        assert len(got) == len(want) and {(min(g), max(g)) if b is None else g for g in got} == want


def test_hot_tight_cluster_is_counted_without_pairs():
    rng = np.random.default_rng(2)
    x = op._unit(rng.normal(size=8) + rng.normal(scale=1e-4, size=(400, 8)))
    (p, _), groups = op.dual_traversal(x, None, x, x, 0.93)
    assert len(p) == 0 and sum(len(u) for u, _ in groups) <= 800


def test_empty_table_and_one_row(spark):
    assert run(spark, []) == []
    assert run(spark, [(3, [1.0], 1)]) == [(3, 0, 3, True)]
    assert run(spark, [(3, [1.0], 1), (3, [1.0], 1)]) == [(3, 1, 3, True)] * 2
