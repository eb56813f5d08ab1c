"""p7 against the public library, texts of all kinds."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeweft.llm import tokenize as tk

VOCABULARY = f"{tk.TOKENIZER_DIR}/byte_bpe_50k.tiktoken"
tiktoken = pytest.importorskip("tiktoken")
RANKS = tk.load_ranks(VOCABULARY)
ENC = tiktoken.Encoding("own", pat_str=tk.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.binary(min_size=1, max_size=80) | st.text(min_size=1, max_size=40).map(str.encode) | st.integers(1, 300).map(lambda n: b"ab " * n))
def test_merge_equals_library(piece):
    assert tk.merge(piece, RANKS) == ENC._core_bpe.encode_single_piece(piece)


def test_ids(spark):
    texts = [None, "", "hello  world\n\n x", "<|endoftext|> don't", "é漢字🙂\x00\x07", "=" * 5000, " " * 3000 + "a", "same", "same"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, ids int")
    got = {r.doc_id: r.ids for r in tk.token_ids(df).collect()}
    assert got == {i: ENC.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert tk.token_ids(df.limit(0)).collect() == []
    assert tk.token_ids(df.union(df)).count() == 2 * len(texts)


def test_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in tk.token_ids(docs).collect():
        assert r.ids == ENC.encode_ordinary(text[r.doc_id] or "")
