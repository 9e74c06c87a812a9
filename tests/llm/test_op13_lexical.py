import math
import re
from collections import Counter

import duckdb
import pytest

from tectonic.llm import op13_lexical as op


def terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, items, top=20):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, n_terms = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, n in held:
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            score = 0
            for t in terms(text):
                if c[t]:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, k, f[3], -f[0]) for k, f in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=str)


DOCS = [(1, "The cat sat on the mat."), (2, "the CAT; the cat, the\tcat"), (3, "concatenate scatter"), (4, ""), (5, None), (6, "..., !!"),
        (7, "école ÉCOLE École cafe café"), (8, "x1 2x 12 1 2"), (9, "cat"), (9, "cat"), (10, "cat"), (None, "cat"), (11, "a" * 200_000 + " mat"),
        (12, "mat " * 30_000), (13, "\x00cat\x7fmat\x00"), (14, "漢字 漢 字"), (15, "cat's mat_cat-mat@cat[mat]`cat{mat}~cat")]
ITEMS = [(100, "cat mat"), (101, "cat cat mat"), (102, ""), (103, None), (104, "École café 漢"), (105, "x1 1, 2x"), (106, "missing"), (100, "cat mat"),
         (None, "the"), (107, "THE the"), (108, "a" * 200_000), (109, "!!")]


@pytest.fixture
def run(spark, make_docs):
    def go(docs, items, **more):
        wanted = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS item", "2 AS doc_id", "3 AS score", "4 AS rank")
        found = op.search(make_docs(docs), wanted, **more)
        assert found.columns == ["item_id", "rank", "doc_id", "score"]
        return sorted(map(tuple, found.collect()), key=str)
    return go


def test_equals_brute_force(run):
    assert run(DOCS, ITEMS) == brute(DOCS, ITEMS)
    assert run(DOCS, ITEMS, top=2) == brute(DOCS, ITEMS, top=2)


def test_small_blocks_and_pieces_give_the_same(run, monkeypatch):
    monkeypatch.setattr(op, "BLOCK_ITEMS", 3)
    monkeypatch.setattr(op, "PIECE_BYTES", 64)
    monkeypatch.setattr(op, "SCORES_AT_ONCE", 5)
    docs = [d for d in DOCS if d[0] != 12] + [(12, "mat " * 300)]
    assert run(docs, ITEMS) == brute(docs, ITEMS)


def test_more_ties_than_places(run):
    docs = [(i, "one two" if i % 2 else "two one") for i in range(90, 0, -1)] + [(200 + i, f"filler{i}") for i in range(300)]
    items = [(1, "one"), (2, "two three")]
    assert run(docs, items) == brute(docs, items)


def test_empty_tables(run):
    assert run([], ITEMS) == run(DOCS, []) == run([(1, None), (2, "!")], ITEMS) == []


def test_sql_gives_the_same_on_the_test_tables(spark):
    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    assert sorted(map(tuple, op.query(spark, sf).collect())) == sorted(db.sql(op.ORACLE_SQL).fetchall())


def test_automaton_counts_whole_terms_only():
    import numpy as np

    machine = op.TermAutomaton(["he her hers", "HE"])
    raw = "she hers he,he HER usher he".encode()
    lengths, (doc, term, tf) = machine.scan(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert lengths.tolist() == [7]
    assert {machine.terms[t]: c for t, c in zip(term, tf, strict=True)} == {b"he": 3, b"her": 1, b"hers": 1}
    assert [machine.item[machine.first[t]:machine.first[t + 1]].tolist() for t in range(3)] == [[0, 1], [0], [0]]
