"""Problem 7: encoding of a whole corpus with a public byte-level BPE tokenizer.

Texts are cut into pre-tokens by the published pattern; every distinct pre-token is merged with a
segment tree over its byte positions. A leaf holds the rank of the pair that starts there, an inner
node the minimum of its children, so the leftmost lowest pair is found by one descent and a merge
updates three leaves in logarithmic time: a pre-token of n bytes costs O(n log n) however long it is.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeweft.session import spread

TOKENIZER_DIR = "/opt/tokenizers"
#: Fixed value: the published pre-token pattern of this family of byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = 1 << 60
#: Merged pre-tokens that a worker remembers; beyond it the memory starts afresh. Speed only.
MEMO = 200_000


def ranks_of(data: bytes) -> dict[bytes, int]:
    """Ranks of a vocabulary with one base64 token and its rank a line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return ranks_of(f.read())


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token. Ties go to the leftmost pair, as the merge order demands."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    part = [piece[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    width = 1
    while width < n - 1:
        width *= 2
    tree = [NONE] * (2 * width)
    for i in range(n - 1):
        tree[width + i] = ranks.get(part[i] + part[i + 1], NONE)
    for k in range(width - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def put(i: int, rank: int) -> None:
        k = width + i
        tree[k] = rank
        while k > 1:
            k >>= 1
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

    while tree[1] != NONE:
        k = 1
        while k < width:
            k = 2 * k if tree[2 * k] == tree[k] else 2 * k + 1
        i = k - width
        j = after[i]
        part[i] += part[j]
        part[j] = b""
        after[i] = nxt = after[j]
        if nxt < n:
            before[nxt] = i
        if j < n - 1:
            put(j, NONE)
        put(i, ranks.get(part[i] + part[nxt], NONE) if nxt < n else NONE)
        if (p := before[i]) >= 0:
            put(p, ranks.get(part[p] + part[i], NONE))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[part[i]])
        i = after[i]
    return ids


def encode(text: Column, vocabulary: str) -> Column:
    """array<int> of a text column; a null and an empty text both give the empty list.

    The vocabulary file is read where the query is built and shipped to the executors, which need no copy of it.
    """
    with open(vocabulary, "rb") as f:
        shipped = SparkSession.active().sparkContext.broadcast(f.read())  # one vocabulary, about a megabyte

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ranks, cut, memo = ranks_of(shipped.value), regex.compile(PATTERN), {}
        for texts in batches:
            out = []
            for text in texts:
                row: list[int] = []
                for word in cut.findall(text or ""):
                    if (got := memo.get(word)) is None:
                        if len(memo) >= MEMO:
                            memo.clear()
                        got = memo[word] = merge(word.encode(), ranks)
                    row += got
                out.append(row)
            yield pd.Series(out, index=texts.index, dtype=object)

    return ids(text)


def token_ids(documents: DataFrame, vocabulary: str = f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken") -> DataFrame:
    """doc_id and ids of every row of documents.

    Null and empty texts have an empty list, repeated rows each give a row, columns other than
    doc_id and text are not read, an empty table gives an empty result. Marks that look like
    special tokens are ordinary text. One narrow stage: no shuffle unless the scan is too coarse.
    """
    docs = spread(documents.select("doc_id", "text"))
    return docs.select("doc_id", encode(F.col("text"), vocabulary).alias("ids"))
