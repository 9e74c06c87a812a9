import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tectonic.llm import op4_bpe, op9_packing, wordbpe

PATH = wordbpe.default_path()
ODD = ["", None, "  \n\t", "Don't 'tis I'll WE'VE ''s 'S x'tra 12345 3rd '", "<|endoftext|>hi <|startoftext|> there",
       "ΣΑΣ Ωmega ﬁ İstanbul ñ é é", "日本語 テスト 👍🏽", "a" * 3000, "café naïve’s — “q”", "'re", "x y\u0085z",
       "\x00\x01", "½ ² ª º", "ab​cd", "don'", "<|", "a b", "É" * 50 + "'LL"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_words_through_the_trie_equal_plain_merging(library):
    coder = wordbpe.WordBPE(PATH)
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("aeinorstlhé!1") for _ in range(rng.randint(1, 14))) for _ in range(800)})
    words = sorted({"".join(coder.symbols[b] for b in w.encode()) for w in words})
    for word, tokens in zip(words, coder.encode_words(words), strict=True):
        assert tokens == coder.merge([*word[:-1], word[-1] + coder.suffix])


def test_ids_and_decoded_text_equal_the_library(make_docs, sf_docs, library):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100, "same"), (100, "same"), (None, "no id")]
    rows += [(1000 + r.doc_id, r.text) for r in sf_docs.select("doc_id", "text").collect()]
    docs = make_docs(rows)
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op4_bpe.digest_documents(docs, PATH).collect())
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want)


def test_decode_documents(make_docs, library):
    docs = make_docs([(i, t) for i, t in enumerate(ODD)])
    texts = {r.doc_id: r.text for r in op4_bpe.decode_documents(op4_bpe.encode_documents(docs, PATH), PATH).collect()}
    for i, t in enumerate(ODD):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert texts[i] == library.decode(ids, skip_special_tokens=False)


def test_cache_reset_keeps_results(monkeypatch):
    monkeypatch.setattr(wordbpe, "MAX_CACHED_WORDS", 2)
    coder = wordbpe.WordBPE(PATH)
    texts = ["one two three", "four five six", "one two three"]
    assert [coder.encode([t])[2].tolist() for t in texts] == [wordbpe.WordBPE(PATH).encode([t])[2].tolist() for t in texts]


def test_words_met_again_outlive_a_generation(monkeypatch):
    monkeypatch.setattr(wordbpe, "MAX_CACHED_WORDS", 3)
    coder, walked = wordbpe.WordBPE(PATH), []
    walk = coder.walk_together
    monkeypatch.setattr(coder, "walk_together", lambda words: walked.extend(words) or walk(words))
    for k in range(12):
        coder.encode([f"often rare{chr(97 + k)}x"])
    assert walked.count(b"often") == 1 and len(set(walked)) == 13
    assert len(coder.young) + len(coder.old) <= 2 * (3 + 2)


@pytest.mark.parametrize("slots", [1 << 20, 1])
def test_arrays_and_stack_walk_the_same_trie(monkeypatch, slots):
    """Also when the cache of pairs holds hardly any."""
    monkeypatch.setattr(wordbpe, "PAIR_SLOTS", slots)
    coder, rng = wordbpe.WordBPE(PATH), random.Random(6)
    words = {"".join(rng.choice("aeionrstlhdnéß漢!1'") for _ in range(rng.randint(1, 16))).encode() for _ in range(1500)}
    words |= {w[:k] for w in list(words)[:300] for k in range(1, len(w))} | {b"a", b"\x00", b"\xff\xfe", b"internationally", b"international"}
    words = sorted(words)
    for some in (words, words[:1], words[700:760]):
        ids, count = coder.walk_together(some)
        assert [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] == list(coder.walk(some))
    assert coder.walk_together([])[0].tolist() == []


def test_a_task_leaves_no_words_behind():
    with wordbpe.loaded(PATH) as coder:
        coder.encode(["some words"])
        assert coder.young
    with wordbpe.loaded(PATH) as again:
        assert again is coder and not again.young and not again.old


def test_decoding_reads_nothing_but_the_ids(library):
    coder = wordbpe.WordBPE(PATH)
    rng = np.random.default_rng(3)
    lists = [rng.integers(0, 49_408, n).tolist() for n in (0, 1, 7, 0, 300)]
    first = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    got = coder.decode_lists(np.array(sum(lists, []), np.int64), first)
    assert [g.decode() for g in got] == [library.decode(x, skip_special_tokens=False) for x in lists]


def test_empty_tables(make_docs):
    assert op4_bpe.digest_documents(make_docs([]), PATH).collect() == []
    assert op9_packing.pack_documents(make_docs([]), PATH).collect() == []


def check_packing(rows, pieces, library):
    ids_of = [np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for _, t in rows]
    want = defaultdict(list)
    for (doc_id, _), ids in zip(rows, ids_of, strict=True):
        want[doc_id].append(ids)
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_window[p.sequence_id].append(p)
    assert by_doc.keys() == want.keys()
    for doc_id, ps in by_doc.items():
        if len(want[doc_id]) == 1:
            at, ids = 0, want[doc_id][0]
            for p in sorted(ps, key=lambda p: p.start):
                assert (p.start, p.doc_tokens) == (at, len(ids))
                assert p.ids_crc32 == zlib.crc32(ids[at:at + p.length].tobytes())
                at += p.length
            assert at == len(ids)
    assert sum(p.length for p in pieces) == sum(map(len, ids_of))
    groups = defaultdict(int)
    for ps in by_window.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at == ps[0].window <= 2048 and not at & (at - 1)
        groups[ps[0].step_group] += at
    assert max(groups.values()) <= op9_packing.GROUP_TOKENS
    return groups


def test_every_token_is_packed_once_without_padding(make_docs, sf_docs, library):
    rows = [(-1 - i, t) for i, t in enumerate(ODD)] + [(7_000, "twice"), (7_000, "twice"), (8_000, "long " * 9000)]
    rows += [(r.doc_id, r.text) for r in sf_docs.select("doc_id", "text").collect()]
    docs = make_docs(rows)
    pieces = op9_packing.pack_documents(docs.coalesce(2), PATH).collect()
    groups = check_packing(rows, pieces, library)
    full = [g for g in groups.values() if g == op9_packing.GROUP_TOKENS]
    assert len(full) >= len(groups) - 2 * 2


def test_rerun_gives_the_same_windows(sf_docs):
    a, b = (sorted(map(tuple, op9_packing.pack_documents(sf_docs, PATH).collect())) for _ in range(2))
    assert a == b


def test_tiers_must_be_powers_of_two(sf_docs):
    with pytest.raises(ValueError, match="powers of two"):
        op9_packing.pack_documents(sf_docs, PATH, tiers=(100,))
