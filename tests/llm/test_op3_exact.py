import hashlib
from collections import defaultdict

from tectonic.llm import op3_exact as op


def run(spark, docs, index=None):
    return {(r.doc_id, r.text_sha256, r.kept, r.keep_id, r.group_size)
            for r in op.exact_dedup(docs, index or op.fresh_index(spark)).collect()}


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return {(i, hashlib.sha256((t or "").encode()).hexdigest(), i == max(groups[t or ""]), max(groups[t or ""]),
             len(groups[t or ""])) for i, t in rows}


def test_largest_id_stays_and_nulls_are_empty(spark, make_docs):
    rows = [(1, "a"), (5, "a"), (3, "b"), (9, None), (4, ""), (7, "A"), (2, "x" * 500_000), (8, "x" * 500_000), (6, "a ")]
    assert run(spark, make_docs(rows)) == brute(rows)


def test_empty_table_and_repeated_rows(spark, make_docs):
    assert run(spark, make_docs([])) == set()
    index = op.fresh_index(spark)
    out = op.exact_dedup(make_docs([(1, "a"), (1, "a"), (None, "a"), (None, "q")]), index).collect()
    assert sorted((str(r.doc_id), r.kept, r.group_size) for r in out) == [
        ("1", True, 3), ("1", True, 3), ("None", False, 3), ("None", True, 1)]


def test_index_persists_between_batches(spark, make_docs):
    index = op.fresh_index(spark)
    run(spark, make_docs([(1, "a"), (2, "b")]), index)
    second = run(spark, make_docs([(10, "a"), (11, "c"), (12, "c")]), index)
    assert {(r[0], r[2], r[3]) for r in second} == {(10, False, 1), (11, False, 12), (12, True, 12)}
    assert spark.table(index).count() == 3
    plan = spark.table(index).groupBy("digest").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan   # the buckets serve the digest's grouping


def test_corpus(spark, sf_docs):
    rows = [(r.doc_id, r.text) for r in sf_docs.select("doc_id", "text").collect()]
    assert run(spark, sf_docs) == brute(rows)


def test_a_batch_that_runs_again_decides_as_before(spark, make_docs):
    index = op.fresh_index(spark)
    first, second = make_docs([(2, "a"), (3, "b"), (1, "a")]), make_docs([(9, "a"), (8, "c"), (7, "c")])

    def decide(docs, batch):
        return sorted((r.doc_id, r.kept, r.keep_id, r.group_size) for r in op.exact_dedup(docs, index, batch=batch).collect())

    once = decide(first, "monday")
    assert once == [(1, False, 2, 2), (2, True, 2, 2), (3, True, 3, 1)]
    assert decide(first, "monday") == once                       # its result was lost: the same again
    late = decide(second, "tuesday")
    assert late == [(7, False, 8, 2), (8, True, 8, 2), (9, False, 2, 1)]
    assert decide(second, "tuesday") == late and decide(first, "monday") == once
    assert decide(first, None) == [(1, False, 2, 2), (2, False, 2, 2), (3, False, 3, 1)]
    assert spark.table(index).count() == 3                       # nothing was appended twice


def test_the_query_leaves_no_table(spark):
    before = {t.name for t in spark.catalog.listTables()}
    assert op.query(spark, "/root/testdata/sf0.001").count() > 0
    assert {t.name for t in spark.catalog.listTables()} == before
