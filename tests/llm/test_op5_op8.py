import base64
import random

import numpy as np
import public_tokenizers
import pytest

from tectonic.llm import op5_counts as cnt
from tectonic.llm import op8_urls as url

VOCAB, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def spans_by_hand(text, encoding):
    at = 0
    for token in encoding.encode_ordinary(text):
        size = len(encoding.decode_single_token_bytes(token))
        yield at, at + size
        at += size


@pytest.mark.parametrize("rule", cnt.RULES)
def test_counts_per_line(make_docs, sf_docs, rule):
    rows = [(1, "a\n\n\nb"), (2, None), (3, ""), (4, "no end"), (5, "\n"), (6, "é日本\n👍🏽 x\n\n \n"), (7, "<|endoftext|>\nx"),
            (8, "long " * 50_000), (9, "y" * 20_000), (10, "twice\n"), (10, "twice\n"), (None, "z")]
    rows += [(1000 + r.doc_id, r.text) for r in sf_docs.limit(60).select("doc_id", "text").collect()]
    got = sorted(map(tuple, cnt.section_counts(make_docs(rows), VOCAB, PATTERN, rule).collect()))
    encoding, want = cnt.coder(VOCAB, PATTERN)[0], []
    for doc_id, text in rows:
        if doc_id is None or not text:
            continue
        lines = text.split("\n")
        lines = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
        ends = np.cumsum([len(x.encode()) for x in lines])
        starts = ends - [len(x.encode()) for x in lines]
        n, crossing = [0] * len(lines), [0] * len(lines)
        for a, b in spans_by_hand(text, encoding):
            share = [max(0, min(b, e) - max(a, s)) for s, e in zip(starts, ends, strict=True)]
            to = share.index(max(share)) if rule == "majority" else next(i for i, x in enumerate(share) if x)
            n[to] += 1
            crossing[to] += sum(map(bool, share)) > 1
        at = 0
        for i, x in enumerate(lines):
            want.append((doc_id, i, at, at + len(x), n[i], crossing[i]))
            at += len(x)
    assert got == sorted(want)


def test_unknown_rule(sf_docs):
    with pytest.raises(ValueError, match="rule"):
        cnt.section_counts(sf_docs, VOCAB, PATTERN, "most")


def judge(spark, urls, **more):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    return {r.page_id: r for r in url.filter_urls(df, **more).collect()}


def test_hosts_paths_and_rules(spark):
    urls = ["https://Example.ORG/es/1", "http://a.example.org/en/12?x=/es/", "https://badexample.org/es/", "x.org/", None, "",
            "ftp://b.com/de/", "ftp://b.com/fr", "ftp://b.com/fr/#://", "http://com/fr/", "http://q.org", "http://q.org?a", "HTTP://É.Org/A://b",
            "://x.com/de/1", "http://n.net/es/1"]
    got = judge(spark, urls)
    parsed = [(got[i].host, got[i].path, got[i].rule, got[i].verdict if got[i].rule else None) for i in range(len(urls))]
    assert parsed == [
        ("example.org", "/es/1", "example.org/es/", "block"), ("a.example.org", "/en/12", "example.org/en/1", "block"),
        ("badexample.org", "/es/", "org/", "allow"), ("", "", None, None), ("", "", None, None), ("", "", None, None),
        ("b.com", "/de/", "com/de/", "block"), ("b.com", "/fr", None, None), ("b.com", "/fr/", "com/fr/", "allow"),
        ("com", "/fr/", "com/fr/", "allow"), ("q.org", "", None, None), ("q.org", "", None, None),
        ("É.org".replace("É", "É"), "/A://b", "org/", "allow"), ("x.com", "/de/1", "com/de/", "block"), ("n.net", "/es/1", None, None)]
    assert all(r.verdict in ("allow", "block") for r in got.values())


def test_templates_follow_labels(spark):
    urls = [f"https://h.net/bad/{i}" for i in range(60)] + [f"https://h.net/good/{i}.html" for i in range(60)]
    urls += ["https://h.net/bad/999", "https://h.net/good/777.html", "https://other.net/x"]
    df = spark.createDataFrame([(i, u, 1 if i < 60 else 0 if i < 120 else None) for i, u in enumerate(urls)],
                               "page_id long, url string, label int")
    got = {r.page_id: r for r in url.filter_urls(df, rules=(), label=df["label"]).collect()}
    assert [got[i].verdict for i in (0, 119, 120, 121, 122)] == ["block", "allow", "block", "allow", "allow"]
    assert got[0].template == got[120].template != got[121].template


def test_labels_below_the_fourth_segment(spark):
    urls = [f"https://h.net/2024/05/12/news/{kind}/more/{i}" for kind in ("bad", "good") for i in range(60)]
    urls += ["https://h.net/2024/05/12/news/bad/more/999/", "https://h.net/2023/1/2/news/good/more/777", "https://h.net/2023/1"]
    df = spark.createDataFrame([(i, u, 1 if i < 60 else 0 if i < 120 else None) for i, u in enumerate(urls)],
                               "page_id long, url string, label int")
    got = {r.page_id: r for r in url.filter_urls(df, rules=(), label=df["label"]).collect()}
    assert [got[i].verdict for i in (0, 59, 60, 119, 120, 121)] == ["block", "block", "allow", "allow", "block", "allow"]
    assert got[0].template == got[120].template != got[121].template == got[60].template
    assert len(got) == len(urls)


def test_variable_segments_become_wildcards(spark):
    urls = [f"https://h.net/u/name{chr(97 + i % 26)}{chr(97 + i // 26)}/post" for i in range(300)]
    assert {r.template for r in judge(spark, urls).values()} == {"/u/*/post"}


def test_empty_and_repeated(spark):
    assert judge(spark, []) == {}
    df = spark.createDataFrame([(1, "http://a.com/de/")] * 2, "page_id long, url string")
    assert [r.verdict for r in url.filter_urls(df).collect()] == ["block", "block"]


def test_vocabulary_file_is_whole():
    with open(VOCAB, "rb") as f:
        assert len({base64.b64decode(line.split()[0]) for line in f}) == 50_256


def plain_verdicts(pages):
    """The template tree written out: {(host, shape): (template, score)} from (host, shape, label) rows."""
    def grow(shapes, source, name_children):
        """Names per shape: recursion over forks, one segment at a time."""
        out = {}

        def go(members, names, level):
            rests = {source(m)[level:] for m in members}
            if len(rests) == 1:
                for m in members:
                    out[m] = (*names, *rests.copy().pop())
                return
            children = {}
            for m in members:
                rest = source(m)[level:]
                children.setdefault(rest[0] if rest else "", []).append(m)
            named = {}
            for child, name in name_children(children).items():
                named.setdefault(name, []).extend(children[child])
            for name, below in named.items():
                go(below, (*names, name), level + 1)

        hosts = {}
        for m in shapes:
            hosts.setdefault(m[0], []).append(m)
        for members in hosts.values():
            go(members, (), 0)
        return out

    count, blocked, labelled = {}, {}, {}
    for host, s, label in pages:
        key = (host, s)
        count[key] = count.get(key, 0) + 1
        blocked[key] = blocked.get(key, 0) + (label or 0)
        labelled[key] = labelled.get(key, 0) + (label is not None)

    def wildcards(children):
        total = sum(count[m] for ms in children.values() for m in ms)
        return {c: url.WILD if c and sum(count[m] for m in ms) < total * url.RARE else c for c, ms in children.items()}

    def merged(children):
        stat = {c: (sum(blocked[m] for m in ms), sum(labelled[m] for m in ms)) for c, ms in children.items()}
        all_b, all_n = map(sum, zip(*stat.values(), strict=True))
        out = {}
        for c, (b, n) in stat.items():
            rate = all_b / all_n if all_n else 0
            differs = n and abs(b / n - rate) > url.DIFFERENT * (rate * (1 - rate) / n) ** 0.5
            out[c] = c if differs or len(children) == 1 else url.MERGED
        return out

    general = grow(count, lambda m: m[1], wildcards)
    final = grow(count, lambda m: general[m], merged)
    groups, hosts = {}, {}
    for m, t in final.items():
        for store, key in ((groups, (m[0], t)), (hosts, m[0])):
            b, n = store.get(key, (0, 0))
            store[key] = (b + blocked[m], n + labelled[m])
    all_b, all_n = map(sum, zip(*hosts.values(), strict=True))
    prior = (all_b + 0.5 * url.WEIGHT) / (all_n + url.WEIGHT)
    out = {}
    for m, t in final.items():
        rate = (hosts[m[0]][0] + url.WEIGHT * prior) / (hosts[m[0]][1] + url.WEIGHT)
        b, n = groups[m[0], t]
        out[m] = ("/" + "/".join(x for x in t if x), (b + url.WEIGHT * rate) / (n + url.WEIGHT))
    return out


def shape_of(link):
    import re

    rest = link.split("://", 1)[1] if link and "://" in link else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0].rstrip("/")
    parts = [re.sub(r"^[0-9]+(?=$|\.)", "{n}", p) for p in path.split("/")[1:]]
    return host.lower(), tuple(re.sub(r"^(?=[0-9a-fA-F-]*[0-9])[0-9a-fA-F-]{8,}(?=$|\.)", "{h}", p) for p in parts)


def test_templates_equal_a_plain_tree(spark):
    rng = random.Random(4)
    urls = []
    for _ in range(1500):
        host = rng.choice(["a.test", "b.test", "b.test", "b.test", "c.test"])
        depth = rng.randint(0, 4)
        parts = [rng.choice(["news", "news", "shop", "x", f"user{rng.randint(0, 400)}", str(rng.randint(0, 99)), "deadbeef01"]) for _ in range(depth)]
        urls.append((f"http://{host}/{'/'.join(parts)}", rng.choice([None, 0, 1]) if "shop" not in parts else rng.choice([1, 1, 1, 0])))
    urls += [("http://d.test/" + "/".join(f"p{k}" for k in range(40)), 1), ("http://d.test/" + "/".join(f"p{k}" for k in range(39)), 0),
             (None, 1), ("no url", None), ("http://e.test", None), ("http://e.test//x//", 0)]
    rows = [(i, u, label) for i, (u, label) in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, label int").selectExpr("*", "'c' AS child", "'n' AS name", "'t' AS t", "'s' AS s", "'r' AS rest")
    got = {r.page_id: r for r in url.filter_urls(pages, rules=(), label=pages["label"]).collect()}
    want = plain_verdicts([(*shape_of(u), label) for u, label in urls])
    for i, (u, _) in enumerate(urls):
        template, score = want[shape_of(u)]
        assert (got[i].template, round(got[i].block_score, 9)) == (template, round(score, 9)), u


def test_a_deep_path_adds_no_rounds(spark, monkeypatch):
    written = []
    keep = url.materialize
    monkeypatch.setattr(url, "materialize", lambda df, name: written.append(name) or keep(df, name))

    def jobs(urls):
        written.clear()
        pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
        assert url.filter_urls(pages).count() == len(urls)
        return len(written)

    shallow = [f"http://h.test/{a}/{b}" for a in "xyz" for b in range(10)]
    deep = "http://h.test/" + "/".join(f"s{k}" for k in range(300))
    assert jobs([*shallow, deep, deep + "/end"]) <= jobs(shallow) + 4
