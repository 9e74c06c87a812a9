import random
import re
from collections import Counter, defaultdict

from tectonic.llm import op2_jaccard as op


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    inverted, root = defaultdict(list), {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(sets):
        common = Counter(j for g in sets[i] for j in inverted[g])
        for j, n in common.items():
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for g in sets[i]:
            inverted[g].append(i)
    return sorted((i, len(sets[i]), find(i)) for i in sets)


def run(docs):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in op.similar_documents(docs).collect())


def test_corpus_edges_and_planted_groups(spark, make_docs, sf_docs):
    rng = random.Random(2)
    rows = [(r.doc_id, r.text) for r in sf_docs.select("doc_id", "text").collect()]
    base = [f"w{rng.randint(0, 999)}" for _ in range(160)]
    for i in range(60):                                 # near copies of one text, some of them not near each other
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"new{rng.randint(0, 10**6)}"
        rows.append((1000 + i, " ".join(w)))
    chain = [f"c{i}" for i in range(104)]
    for i in range(8):                                  # each near the next one only
        rows.append((2000 + i, " ".join(chain[i * 9:] + [f"d{j}" for j in range(i * 9)])))
    exact = " ".join(f"e{i}" for i in range(14))       # 10 shingles
    rows += [(3000, exact), (3001, exact + " x y"), (3002, exact + " x y z"),   # 10 of 12, 10 of 13
             (3010, "A b  c"), (3011, "a\tB c"), (3012, "a b"), (3013, ""), (3014, None), (3015, " \n"), (3016, ""),
             (3017, "a b c d e"), (3018, "a b c d e"), (3019, "É b"), (3020, "é b"), (3021, "long " * 40_000)]
    assert run(make_docs(rows)) == brute(rows)


def test_repeated_rows_and_null_ids(spark, make_docs):
    assert run(make_docs([(5, "a b c"), (5, "a b c"), (None, "a b c"), (9, "a b c")])) == [(5, 1, 5), (5, 1, 5), (9, 1, 5)]


def test_empty_table(make_docs):
    assert run(make_docs([])) == []


def test_similarity_at_the_bound():
    assert op._close_enough(8, 10, 8) and not op._close_enough(7, 9, 7)


def linked(rows):
    """Every document's number of links and smallest id of an equal set, by comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    n, equal = dict.fromkeys(sets, 0), {}
    for i, a in sets.items():
        equal[i] = min(j for j, b in sets.items() if a == b) if a else i
        n[i] = sum(1 for j, b in sets.items() if i != j and a and 100 * len(a & b) >= 80 * (len(a) + len(b) - len(a & b)))
    return sorted((i, equal[i], n[i]) for i in sets)


def test_every_link_is_counted(make_docs, monkeypatch):
    monkeypatch.setattr(op, "CHUNK_DOCS", 8)               # many cells, also across size classes
    rng = random.Random(3)
    base, rows = [f"w{i}" for i in range(110)], []
    for i in range(90):                                 # one component, in which many pairs are no links
        w = base[:rng.randint(80, 110)]
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"new{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, rows[i % 7][1].upper()) for i in range(20)]   # classes of several documents
    rows += [(200, ""), (201, None), (202, "a b c"), (203, "quite other words than those of all the rest")]
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in op.similarity_join(make_docs(rows + rows[:5])).distinct().collect())
    assert got == linked(rows)
    parts = {r.doc_id: r.component_id for r in op.similarity_join(make_docs(rows)).collect()}
    assert sorted((i, c) for i, c in parts.items()) == [(i, c) for i, _, c in brute(rows)]
    assert op.similarity_join(make_docs([])).collect() == []
