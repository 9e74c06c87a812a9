"""The pipeline's stages against brute force, each on its predecessor's output."""

import random

import pytest
from llm.test_op1_substrings import dedup_by_hand
from llm.test_op2_jaccard import brute as near_by_hand
from llm.test_op4_op9_tokens import check_packing, library  # noqa: F401  (a fixture)

import corpus_pipeline
from tectonic.llm import op9_packing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def fixture_rows(sf_docs):
    rng = random.Random(9)
    rows = [(r.doc_id, r.text, r.lang) for r in sf_docs.select("doc_id", "text", "lang").collect()]
    english = [w for _, t, lang in rows if lang == "en" for w in t.lower().split()]

    def words(n):
        return " ".join(rng.choices(english, k=n))

    passage = words(90)
    rows += [(1000 + i, f"{words(50)} {passage} {words(70)}", None) for i in range(6)]
    rows += [(2000, None, "en"), (2001, "", None), (2002, "12 34 !", "de"), (2003, rows[3][1], "en"), (2004, rows[3][1], "en"),
             (2004, rows[3][1], "en"), (None, "a text without an id", "en"), (2005, "the long words " * 20_000, "en")]
    return rows


def test_stages_equal_brute_force(spark, make_docs, sf_docs, library):  # noqa: F811
    rows = fixture_rows(sf_docs)
    docs = make_docs(rows)
    names, steps = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(steps) == ["language_id", "exact_dedup", "near_dedup", "substring_dedup", "packing"]

    def run(name, docs):
        out = corpus_pipeline.materialize(steps[name](spark, docs, ""), name)
        return out, sorted(((r.doc_id, r.text) for r in out.select("doc_id", "text").collect()), key=str) if name != "packing" else None

    one, got = run("language_id", docs)
    assert one.columns == names and got == sorted(((i, t) for i, t, _ in rows if t and any(c.isalpha() for c in t)), key=str)
    assert one.where("lang IS NULL").count() == 0

    two, after = run("exact_dedup", one)
    best = {}
    for i, t in got:
        if i is not None:
            best[t] = max(i, best.get(t, i))
    assert two.columns == names and after == sorted(((i, t) for t, i in best.items()), key=str)

    three, kept = run("near_dedup", two)
    stays = {i for i, _, c in near_by_hand(after) if i == c}
    assert three.columns == names and kept == [r for r in after if r[0] in stays]

    four, left = run("substring_dedup", three)
    spans = dedup_by_hand(kept)
    want = []
    for doc_id, text in kept:
        raw, at, parts = text.encode(), 0, []
        for a, b in spans[doc_id]:
            parts.append(raw[at:a])
            at = b
        cut = b"".join([*parts, raw[at:]]).decode()
        if not spans[doc_id] or cut.strip(" "):
            want.append((doc_id, cut))
    assert four.columns == names and left == sorted(want, key=str)
    assert {r.n_chars == len(r.text) for r in four.select("n_chars", "text").collect()} == {True}

    five, _ = run("packing", four)
    check_packing(left, five.collect(), library)


def test_run_chains_the_stages(spark, tmp_path, sf_docs):
    sf_docs.limit(120).write.parquet(f"{tmp_path}/documents.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)), name)
    assert sorted(map(tuple, pieces.select("doc_id", "start", "length", "ids_crc32").collect()))
    assert pieces.agg({"length": "sum"}).first()[0] == op9_packing.pack_documents(docs, corpus_pipeline.wordbpe.default_path()).agg(
        {"length": "sum"}).first()[0]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_empty_tables(spark, make_docs, name):
    docs = make_docs([]).select(*COLUMNS)
    assert dict(corpus_pipeline.STAGES)[name](spark, docs, "").collect() == []


def test_exact_dedup_keeps_all_texts_of_an_id(spark, make_docs):
    rows = [(1, "shared"), (9, "shared"), (9, "another"), (9, "another"), (1, "only here"), (1, "a third")]
    out = corpus_pipeline.exact_dedup(spark, make_docs(rows), "")
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(1, "a third"), (1, "only here"), (9, "another"), (9, "shared")]
