"""p9 against brute force."""

import random

import numpy as np

from codeweft.llm import spans as sp


def brute(texts: dict) -> dict:
    seen: dict = {}
    for i, t in texts.items():
        for k in range(len(t or "") - sp.SPAN + 1):
            seen.setdefault(t[k : k + sp.SPAN], set()).add(i)
    out = {}
    for i, t in texts.items():
        hit = {c for k in range(len(t or "") - sp.SPAN + 1) if len(seen[t[k : k + sp.SPAN]]) > 1 for c in range(k, k + sp.SPAN)}
        if hit:
            out[i] = len(hit)
    return out


def test_window_min():
    r = np.random.default_rng(1)
    for n, w in [(101, 101), (500, 101), (7, 3), (6, 3), (5, 1)]:
        h = r.integers(0, 1 << 60, n).astype(np.uint64)
        assert (sp.window_min(h, w) == np.lib.stride_tricks.sliding_window_view(h, w).min(axis=1)).all()


def test_coverage(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh é🙂") for _ in range(r.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))[: n * 5]
    a, hot = text(150), text(90)
    texts = {1: a, 2: text(40) + a[100:300] + text(40), 3: text(40) + a[100:299] + text(40), 4: a, 5: None, 6: "", 7: "=" * 500, 8: "=" * 199, 9: "=" * 201 + "x", 10: hot + hot, 11: text(20) + a[300:520] + text(5) + a[100:330]}
    texts |= {100 + i: text(r.randint(0, 60)) + hot[i % 7 : 260 + i % 11] + text(r.randint(0, 60)) for i in range(40)}
    texts[200] = "long " * 60_000
    df = spark.createDataFrame([(i, t, 0) for i, t in texts.items()], "doc_id bigint, text string, id int")
    got = {x.doc_id: x.shared_chars for x in sp.coverage(df).collect()}
    assert got == brute(texts)
    assert {x.doc_id for x in sp.found(df).collect()} == set(got)
    assert {x.doc_id: x.shared_chars for x in sp.coverage(df.union(df)).collect()} == got
    cluster = {x.doc_id: x.cluster for x in sp.clusters(df).collect()}
    assert set(cluster) == set(got) and cluster[1] == cluster[2] == cluster[4] == cluster[11] == 1 and cluster[100] == cluster[139] == 10 and cluster[7] == cluster[9] == 7
    assert sp.found(df.limit(0)).collect() == []


def test_paragraphs_are_cut_alike():
    r = random.Random(8)
    for text in ("".join(r.choice("ab ") for _ in range(900)), "long " * 200, "=" * 700, "".join(chr(r.randrange(32, 900)) for _ in range(1500))):
        h = sp.grams(sp.codes_of(text))
        whole = set(sp.anchors(h).tolist())
        for s in range(0, len(text) - sp.SPAN + 1, 37):
            part = {s + int(x) for x in sp.anchors(sp.grams(sp.codes_of(text[s : s + sp.SPAN])))}
            assert part and part <= whole


def test_collision_curve():
    bands = sp.bands_for()
    assert 1 - (1 - sp.LIKE**sp.BAND) ** bands >= sp.RECALL
    r, met, n = random.Random(9), 0, 200
    for _ in range(n):
        a = [r.choice("abcdefghij ") for _ in range(sp.PARAGRAPH)]
        b = a[:-2] + ["x", "y"]  # about two of 93 shingles differ
        keys = [sp.band_keys(sp.grams(sp.codes_of("".join(x))), np.array([0]), bands) for x in (a, b)]
        met += bool((keys[0][0] == keys[1][0]).any())
        assert keys[0][1] != keys[1][1]
    assert met >= 0.93 * n
