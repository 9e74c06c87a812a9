import re
import zlib

import pytest

from tectonic.llm import op6_licenses as lic
from tectonic.llm import op7_langid as lid

MIT = lic.TEMPLATES["mit-text"]


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def base_by_hand(text):
    w, at, labels = words_of(text), [], set()
    for phrase, label in lic.BASE.items():
        p = phrase.split()
        hits = [i for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
        at += hits
        labels |= {label} if hits else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


TEXTS = ["MIT License", "mit  license mit-LICENSE", "admit license", "mit licenses", "CC BY-NC 4.0", "CC\nBY", "ccby",
         "GNU General Public License, Apache License", "", None, "é mit license é", "émit license", "x" * 300_000, "12 cc by 3",
         "cc cc by by", "!!!", "under the GNU\x00General (Public) License"]


def test_base_phrases(make_docs, sf_docs):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(1000 + r.doc_id, r.text) for r in sf_docs.select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in lic.scan(make_docs(rows)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_by_hand(t), t
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def fill(markup, optional, owner):
    text = re.sub(r"<<optional>>(.*?)<</optional>>", r"\1" if optional else " ", markup)
    return re.sub(r"<<any \d+>>", owner, text)


@pytest.mark.parametrize("label", lic.TEMPLATES)
def test_templates_accept_their_regions_and_nothing_else(make_docs, label):
    whole = [fill(lic.TEMPLATES[label], o, w) for o in (True, False) for w in ("4", "7")]
    mandatory = lic.Automaton(lic.TEMPLATES[label]).anchor
    broken = whole[0].replace(mandatory[len(mandatory) // 2].decode(), "wrong")
    rows = [(i, f"Before this. {t.upper()}! After") for i, t in enumerate([*whole, broken])]
    got = {r.doc_id: r for r in lic.scan(make_docs(rows)).collect()}
    for i in range(len(whole)):
        assert label in got[i].labels.split(",")
        assert [s for s in got[i].spans if s.label == label]
    assert label not in got[len(whole)].labels.split(",")


@pytest.mark.parametrize("markup", ["", "<<any 3>>", "<<optional>> a b <</optional>>", "a <<optional>> b", "a <</optional>> b"])
def test_templates_without_mandatory_wording_are_refused(make_docs, markup):
    with pytest.raises(ValueError, match="template|optional region"):
        lic.Automaton(markup)


def stretches_by_hand(words, markup):
    """Accepted stretches, with the template as a regular expression over words joined by spaces."""
    body = re.sub(r"<<any (\d+)>>", r"(?:[^ ]+ ){0,\1}", markup)
    parts = re.split(r"(\(\?:\[\^ \]\+ \)\{0,\d+\})|(<<optional>>)|(<</optional>>)", body)
    regex, run, runs, depth = "", [], [], 0
    for part in filter(None, parts):
        if part == "<<optional>>":
            regex, depth, run = regex + "(?:", depth + 1, []
        elif part == "<</optional>>":
            regex, depth, run = regex + ")?", depth - 1, []
        elif part.startswith("(?:[^"):
            regex, run = regex + part, []
        else:
            regex += "".join(re.escape(w) + " " for w in part.split())
            if not depth and part.split():
                run = part.split()
                runs.append(run)
    anchor, pattern = max(runs, key=lambda r: sum(map(len, r))), re.compile(regex)
    out, done = [], 0
    for at in range(len(words) - len(anchor) + 1):
        if words[at:at + len(anchor)] != anchor or at < done:
            continue
        hit = next(((a, b) for a in range(done, at + 1) for b in range(len(words), at + len(anchor) - 1, -1)
                    if pattern.fullmatch("".join(w + " " for w in words[a:b]))), None)
        if hit:
            out.append(hit)
            done = hit[1]
    return out


def test_labels_spans_and_score_equal_brute_force(make_docs, monkeypatch):
    import random

    templates = {"one": "a b <<any 2>> c", "two": "<<optional>> x <</optional>> b a <<optional>> c <<any 1>> <</optional>> d",
                 "three": "d <<any 1>> <<optional>> a <<optional>> b <</optional>> c <</optional>> d d"}
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("aabbccddx") for _ in range(rng.randint(0, 24)))) for i in range(300)]
    got = {r.doc_id: r for r in lic.scan(make_docs(rows), base={"c d": "base", "x": "x"}, templates=templates).collect()}
    seen = 0
    for i, text in rows:
        words, covered, labels, spans = text.split(), set(), set(), []
        for label, phrase in (("base", ["c", "d"]), ("x", ["x"])):
            for k in range(len(words) - len(phrase) + 1):
                if words[k:k + len(phrase)] == phrase:
                    labels.add(label)
                    covered |= set(range(k, k + len(phrase)))
        for label, markup in templates.items():
            for a, b in stretches_by_hand(words, markup):
                labels.add(label)
                spans.append((label, a, b))
                covered |= set(range(a, b))
        seen += len(spans)
        assert sorted((s.label, s.start, s.stop) for s in got[i].spans) == sorted(spans), text
        assert got[i].labels == ",".join(sorted(labels))
        assert abs(got[i].score - (len(covered) / len(words) if words else 0)) < 1e-12
    assert seen > 100


def test_replaceable_region_is_bounded():
    a = lic.Automaton("start <<any 2>> end")
    assert [a.longest([b"start", *[b"x"] * n, b"end"], 0) for n in range(4)] == [2, 3, 4, None]


def test_empty_tables(make_docs):
    assert lic.scan(make_docs([])).collect() == []
    assert lid.predict(make_docs([]), lid.fit(make_docs([]))).collect() == []


def test_held_out_accuracy_and_unknown(spark, make_docs, sf_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = lid.predict(docs, lid.fit(docs), keep=("lang",)).collect()
    out = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and sum(r.lang_pred == r.lang for r in out) >= 0.98 * len(out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    odd = make_docs([(1, None), (2, ""), (3, "123 !!"), (4, "a"), (5, "é"), (6, "日本語"), (None, "the of"), (7, "— …")])
    got = {r.doc_id: r for r in lid.predict(odd, lid.fit(docs)).collect()}
    assert {i for i, r in got.items() if r.lang_pred == "und"} == {1, 2, 3, 7}
    assert got[4].ambiguous and got[None].held_out is False


def test_learns_from_labelled_rows_only(make_docs):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2]
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2]
    one = make_docs([(ids[0], "ein wort", "de"), (held[0], "a word", "en"), (ids[1], "x y", None), (None, "abc", "fr")])
    model = lid.fit(one)
    assert model.languages == ["de"]
    assert {(r.lang_pred, r.score) for r in lid.predict(one, model).collect()} == {("de", 1.0)}


def test_many_languages_have_distant_codewords():
    c = lid.code(40)
    assert min((c[i] != c[j]).sum() for i in range(40) for j in range(i)) >= c.shape[1] // 4


def test_numbers_are_no_letters(make_docs):
    docs = make_docs([(i, "the of and", "en") for i in range(1, 9)] + [(20, "½ ² ①"), (21, "Ⅷ ٣"), (22, "² a"), (23, "ª"), (24, "_")])
    got = {r.doc_id: r.lang_pred for r in lid.predict(docs, lid.fit(docs)).collect()}
    assert [got[i] for i in (20, 21, 22, 23, 24)] == ["und", "und", "en", "en", "und"]


def plain_grams(text):
    raw = [b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in (text or "").encode()]
    out = {}
    for i in range(len(raw)):
        if i + 1 < len(raw) and raw[i] == raw[i + 1] == 0x20:
            continue
        for size in (2, 3):
            if i + size <= len(raw):
                gram = sum(b << 8 * k for k, b in enumerate(raw[i:i + size])) | (0xFF0000 if size == 2 else 0)
                bucket = (gram * 0x9E3779B1 & 0xFFFFFFFF) >> 32 - lid.BUCKET_BITS
                out[bucket] = out.get(bucket, 0) + 1
    return out


def test_decoding_equals_a_plain_version(spark, make_docs):
    """Counts, bit classifiers, margins and loss-weighted decoding, each written out for one document at a time."""
    import math

    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").limit(150).collect()]
    docs += [(9_000, docs[0][1], "fr"), (9_000, docs[0][1], "fr"), (9_001, "zz", None)]
    counts = {}
    for i, text, lang in docs:
        if lang and zlib.crc32(str(i).encode()) % 4 != 2:
            mine = counts.setdefault(lang, {})
            for g, n in plain_grams(text).items():
                mine[g] = mine.get(g, 0) + n
    langs, size = sorted(counts), 1 << lid.BUCKET_BITS
    words = [[1 - 2 * (s >> k & 1) for s in range(1, 1 << len(langs) - 1)] for k in range(len(langs))]
    total = {x: sum(counts[x].values()) for x in langs}
    share = {x: [(counts[x].get(g, 0) + 0.5) / (total[x] + 0.5 * size) for g in range(size)] for x in langs}
    bits = []
    for bit in range(len(words[0])):
        pos, neg = ([share[x] for k, x in enumerate(langs) if words[k][bit] == side] for side in (1, -1))
        weight = [math.log(sum(s[g] for s in pos) / len(pos)) - math.log(sum(s[g] for s in neg) / len(neg)) for g in range(size)]
        own = [words[k][bit] * sum(a * b for a, b in zip(share[x], weight, strict=True)) for k, x in enumerate(langs)]
        scale = max(sum(map(abs, own)) / len(own), 1e-9)
        bits.append((weight, scale, max(min(own) / scale, 0.0) + 1e-6))
    got = {}
    frame = make_docs(docs).selectExpr("*", "'x' AS lang_pred", "'y' AS kept_0", "'z' AS held_out")
    for r in lid.predict(frame, lid.fit(frame)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert len(got[9_000]) == 2 and got[9_000][0] == got[9_000][1]
    for i, text, _ in docs:
        grams = plain_grams(text)
        margin = [sum(w[g] * n for g, n in grams.items()) / max(sum(grams.values()), 1) / s for w, s, _ in bits]
        loss = [sum(max(0.0, 1 - m * c) * b[2] for m, c, b in zip(margin, word, bits, strict=True)) for word in words]
        order = sorted(loss)
        assert got[i][0].lang_pred == langs[loss.index(order[0])]
        assert abs(got[i][0].score - (order[1] - order[0]) / (order[1] + order[0])) < 1e-6
