"""p6: pieces join to the whole value, fit, overlap and carry the right lines."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from codeweft.llm import chunks as ch


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["def f(x):\n", "    y = 1\r\n", "\n", "word. next, more ", "x" * 130, "é🙂 ", "    }\n", "\r"]), min_size=1, max_size=120).map("".join), st.sampled_from([(160, 20), (300, 100), (1600, 100)]))
def test_pieces(text, sizes):
    limit, overlap = sizes
    out = ch.cut_text(text, limit, overlap)
    assert "".join(t[a - h :] for _, t, h, a, _, _ in out) == text
    for n, (k, t, h, a, before, upto) in enumerate(out):
        assert k == n and 0 < len(t) <= limit and text[h : h + len(t)] == t
        assert before == len(re.findall("\r\n|\r|\n", text[:h])) or text[h - 1 : h + 1] == "\r\n"
        assert before <= upto <= len(re.findall("\r\n|\r|\n", text))
        if n:
            assert a - h >= min(overlap, len(out[n - 1][1]))
            if a - h > overlap:
                assert text[h - 1] in "\r\n" or h == 0


def test_weak_boundaries_go_first():
    block = "def f():\n" + "    x = 1\n" * 30
    out = ch.cut_text((block + "\n") * 6, 700, 50)
    assert all(t[a - h :].startswith("def f") for _, t, h, a, _, _ in out)


def test_frame(spark):
    long = "line one\n" * 400
    rows = [(1, 10, 500, long, None, "x"), (2, None, None, "", long, "x"), (3, 1, 2, "s" * 1600, None, "x"), (4, 5, 6, "q" * 1601, "z" * 30000, None), (1, 10, 500, long, None, "x")]
    df = spark.createDataFrame(rows, "ord bigint, start_line int, end_line int, snippet string, text string, piece string")
    assert {(r.ord, r.field) for r in ch.found(df).collect()} == {(1, "snippet"), (2, "text"), (4, "snippet"), (4, "text")}
    got = ch.pieces(df).filter("ord = 1").orderBy("piece").collect()
    assert got[0].start_line == 10 and got[-1].end_line == 10 + 399 and len(got) % 2 == 0
    assert all(r.start_line is None for r in ch.pieces(df).filter("ord = 2").collect())
    assert ch.pieces(df.limit(0)).collect() == []
