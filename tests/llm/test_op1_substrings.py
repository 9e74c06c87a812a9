import random

import numpy as np

from tectonic.llm import op1_substrings as op
from tectonic.llm.textnum import random_table


def cut_by_hand(raw: bytes) -> list[int]:
    """Ends of chunks by a plain rolling loop."""
    gear = [int(x) >> 32 for x in random_table(31, 256)]
    space = {0x20, *range(0x09, 0x0E)}
    h, places, hashes = 0, [], []
    for i, b in enumerate(raw):
        h = (2 * h + gear[b]) % 2**32
        hashes.append(h)
        if (b in space or i + 1 < len(raw) and raw[i + 1] >= 0xE0) and h < op.CUT_SHARE * 2**32:
            places.append(i + 1)
    cuts = [p for k, p in enumerate(places) if not k or p - places[k - 1] >= op.GAP_BYTES]
    ends, at = [], 0
    for end in sorted({*cuts, len(raw)} - {0}):
        if end - at > op.LONG_BYTES:              # a stretch without cuts: by the hash at any character
            inner = [p for p in range(at + 1, end) if raw[p] & 0xC0 != 0x80 and hashes[p - 1] < op.LONG_SHARE * 2**32]
            inner = [p for k, p in enumerate(inner) if not k or p - inner[k - 1] >= op.GAP_BYTES]
        else:
            inner = []
        for stop in [*inner, end]:
            while stop - at > op.LONG_BYTES:
                at += op.LONG_BYTES
                while raw[at] & 0xC0 == 0x80:
                    at -= 1
                ends.append(at)
            ends.append(stop)
            at = stop
    return ends


def dedup_by_hand(rows):
    seen, spans = {}, {}
    for doc_id, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        raw, at, found = (text or "").encode(), 0, []
        for end in cut_by_hand(raw):
            if seen.setdefault(raw[at:end], (doc_id, at)) != (doc_id, at):
                if found and found[-1][1] == at:
                    found[-1][1] = end
                else:
                    found.append([at, end])
            at = end
        spans[doc_id] = [(a, b) for a, b in found if b - a >= op.MIN_BYTES]
    return spans


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


def fixture():
    rng = random.Random(1)
    passage = words(rng, 80)
    rows = [(i, f"{words(rng, 60)}. {passage} {words(rng, 40)}") for i in range(1, 6)]
    rows += [(10, words(rng, 300)), (11, ""), (12, None), (13, "日本語の文章" * 300), (14, "日本語の文章" * 300),
             (15, "x" * 5000), (16, "x" * 5000), (17, words(rng, 60_000)), (18, passage), (None, passage), (19, " \n\t"),
             (20, "short"), (21, "short"), (22, rows[0][1]), (22, rows[0][1])]  # repeated rows
    return rows, passage


def test_equals_a_plain_loop(spark, make_docs, sf_docs):
    rows, _ = fixture()
    rows += [(1000 + r.doc_id, r.text) for r in sf_docs.select("doc_id", "text").collect()]
    got = op.substring_dedup(make_docs(rows)).collect()
    want, texts = dedup_by_hand(rows), dict(rows)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.text == texts[None] and not r._spans
            continue
        assert [(s.start, s.stop) for s in r._spans] == want[r.doc_id]
        if texts[r.doc_id] is None:
            assert r.text is None
            continue
        raw = texts[r.doc_id].encode()
        keep = np.ones(len(raw), bool)
        for s in r._spans:
            keep[s.start:s.stop] = False
        assert r.text.encode() == bytes(np.frombuffer(raw, np.uint8)[keep])


def test_passages_go_and_unique_text_stays(spark, make_docs):
    rows, passage = fixture()
    got = {r.doc_id: r for r in op.substring_dedup(make_docs(rows)).collect()}
    assert passage in got[1].text and got[1]._spans == []
    for i in range(2, 6):
        assert passage not in got[i].text and got[i]._kept_in[0] == 1
        assert sum(s.stop - s.start for s in got[i]._spans) > 0.6 * len(passage)
    for i in (10, 17, 20, 21):
        assert got[i]._spans == []


def test_an_insertion_shifts_chunks_but_does_not_change_them():
    rng = random.Random(3)
    text = words(rng, 2000).encode()
    moved = text[:500] + b"an insertion " + text[500:]
    a = {text[s:e] for s, e in zip([0, *cut_by_hand(text)], cut_by_hand(text), strict=False)}
    b = {moved[s:e] for s, e in zip([0, *cut_by_hand(moved)], cut_by_hand(moved), strict=False)}
    assert len(a - b) <= 4


def test_a_long_run_without_spaces_shares_its_chunks_after_a_shift(make_docs):
    rng = random.Random(7)
    run = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGH0123456789+/") for _ in range(20_000))
    a, b = run.encode(), ("some other letters" + run).encode()
    chunks = [{t[s:e] for s, e in zip([0, *cut_by_hand(t)], cut_by_hand(t), strict=False)} for t in (a, b)]
    assert len(chunks[0] & chunks[1]) >= len(chunks[0]) - 2 > 30
    for t in (a, b, "é".encode() * 3000, "漢字かな交じり文".encode() * 400, b"ab" * 3000):
        bounds = op.chunk_bounds(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        assert bounds.tolist() == cut_by_hand(t) and max(np.diff([0, *bounds])) <= op.LONG_BYTES
    got = {r.doc_id: r for r in op.substring_dedup(make_docs([(1, a.decode()), (2, b.decode())])).collect()}
    assert got[1].text == run and len(got[2].text) < 3000


def test_batch_neighbours_do_not_matter():
    rng = random.Random(4)
    texts = [words(rng, n).encode() for n in (3, 200, 50, 1, 400)] + [b"", b"a"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    ends = op.chunk_bounds(data, offsets)
    for i, t in enumerate(texts):
        mine = ends[(ends > offsets[i]) & (ends <= offsets[i + 1])] - offsets[i]
        assert mine.tolist() == cut_by_hand(t)


def test_empty_table(make_docs):
    assert op.substring_dedup(make_docs([])).collect() == []


def test_one_id_with_two_texts(make_docs):
    rng = random.Random(6)
    a, b = words(rng, 100), words(rng, 150)
    got = sorted(r.text for r in op.substring_dedup(make_docs([(1, a), (1, b), (2, "x " + a)])).collect())
    assert {a, b} <= set(got) and ("x " + a) not in got


def test_chunks_are_no_table_of_their_own(spark, monkeypatch):
    """Written out, all chunks took two thirds of the texts' size beside both shuffles of them."""
    names, write = [], op.materialize
    monkeypatch.setattr(op, "materialize", lambda df, name: names.append(name) or write(df, name))
    passage = " ".join(f"word{k} stands at {k * k} in both of them" for k in range(60))
    docs = spark.createDataFrame([(k, f"{k} begins here. {passage} {k} ends here.") for k in (1, 2)], "doc_id long, text string")
    done = {r.doc_id: r for r in op.substring_dedup(docs).collect()}
    assert names == ["repeated"] and not done[1]._spans and done[2]._kept_in == [1]
    assert len(done[2].text) + sum(s.stop - s.start for s in done[2]._spans) == len(docs.where("doc_id = 2").first().text)
