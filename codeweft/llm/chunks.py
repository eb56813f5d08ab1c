"""Problem 6: cutting oversized values at natural boundaries, with overlap.

Agglomerative: a value starts as atomic segments (lines; overlong lines fall apart at sentence ends,
then blanks, then anywhere); adjacent segments are held in a heap by the strength of the boundary
between them and the weakest boundary is merged first, while the merged content and the overlap fit.
Only values over the limit reach Python; the filter runs in the scan stage.
"""

from __future__ import annotations

import heapq
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT, OVERLAP = 1600, 100
PIECES = "array<struct<piece:int,text:string,start_char:int,content_char:int,lines_before:int,lines_to_end:int>>"
LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+")
BREAK = re.compile(r"\r\n|\r|\n")
OPENER = re.compile(r"\s*(?:def|class|async|function|func|fn|pub|impl|export|interface|type|struct|enum|trait|const|@|#{1,6} |/\*\*|///?)")


def split_long(line: str, room: int) -> list[tuple[str, float]]:
    """Parts of an overlong line with the strength of the boundary before each."""
    parts: list[tuple[str, float]] = []
    for sentence in re.split(r"(?<=[.!?;,])(?=\s)", line):
        first = True
        for word in re.findall(r"\s*\S+|\s+$", sentence) or [sentence]:
            for at in range(0, len(word), room):
                parts.append((word[at : at + room], 0.0 if at else 2.0 if first else 1.0))
            first = False
    return parts


def atoms(text: str, room: int) -> tuple[list[int], list[float]]:
    """Lengths of the atomic segments and the strength of the boundary before each.

    Stronger: blank line before, less indentation, a line that opens a definition or a heading.
    """
    sizes: list[int] = []
    strength: list[float] = []
    blank = False
    for match in LINE.finditer(text):
        line = match.group()
        body = line.strip()
        indent = len(line) - len(line.lstrip())
        s = 10.0 - min(indent, 40) / 10 + (20.0 if blank and body else 0.0) + (8.0 if body and OPENER.match(line) else 0.0) - (6.0 if body[:1] in (")", "]", "}") else 0.0)
        if not body:
            s = 3.0
        for n, (part, inner) in enumerate(split_long(line, room) if len(line) > room else [(line, 0.0)]):
            sizes.append(len(part))
            strength.append(s if n == 0 else inner)
        blank = not body
    return sizes, strength


def agglomerate(sizes: list[int], strength: list[float], room: int) -> list[int]:
    """Start offsets of the merged runs. Equal boundaries merge the smaller result first, then the left."""
    n = len(sizes)
    size, after, before, live = sizes[:], list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(strength[j], sizes[j - 1] + sizes[j], j) for j in range(1, n)]
    heapq.heapify(heap)
    while heap:
        s, both, j = heapq.heappop(heap)
        if not live[j]:
            continue
        i = before[j]
        now = size[i] + size[j]
        if now > room:
            continue  # sizes only grow: this boundary stays
        if now != both:
            heapq.heappush(heap, (s, now, j))
            continue
        size[i], live[j], after[i] = now, False, after[j]
        if after[i] < n:
            before[after[i]] = i
    starts, at = [], 0
    for k in range(n):
        if live[k]:
            starts.append(at)
        at += sizes[k]
    return starts


def cut_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple]:
    """Pieces (number, text, first character, first new character, line breaks before it, line breaks up to its last character)."""
    if len(text) <= limit:
        return [(0, text, 0, 0, 0, sum(m.end() < len(text) for m in BREAK.finditer(text)))]
    reach = min(2 * overlap, limit // 2)  # how far the overlap may go back for a line start
    starts = agglomerate(*atoms(text, limit - reach), limit - reach) + [len(text)]
    begins = {m.end() for m in BREAK.finditer(text)} | {0}
    out = []
    for k, (a, b) in enumerate(zip(starts, starts[1:])):
        head = a
        if k:
            floor = out[-1][2]
            head = max(floor, a - overlap)
            head = next((x for x in range(head, max(floor, a - reach) - 1, -1) if x in begins), head)
        out.append((k, text[head:b], head, a))
    ends = [m.end() - 1 for m in BREAK.finditer(text)]
    lines = pd.Series(ends, dtype="int64").to_numpy()
    return [(k, t, h, a, int(lines.searchsorted(h)), int(lines.searchsorted(h + len(t) - 1))) for k, t, h, a in out]


def pieces(components: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """ord, field, piece, text, start_char, content_char, start_line, end_line of every value over the limit.

    Null, empty and short values are not cut and give no rows; each row counts by itself, repeated
    rows give repeated pieces. Lines are null where start_line is null; they never pass end_line.
    A piece without its overlap starts at content_char, so the contents join to the whole value.
    """

    @F.pandas_udf(PIECES)
    def cut_values(values: pd.Series) -> pd.Series:
        return pd.Series([cut_text(v, limit, overlap) for v in values], dtype=object)

    long = components.select(
        "ord", "start_line", "end_line",
        F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("snippet", "text")])).alias("v"),
    ).select("ord", "start_line", "end_line", "v.field", "v.value").filter(F.length("value") > limit)
    p = long.withColumn("p", F.explode(cut_values("value")))
    line = lambda c: F.least(F.col("start_line") + F.col(c), F.coalesce("end_line", F.col("start_line") + F.col(c)))
    return p.select("ord", "field", "p.piece", "p.text", "p.start_char", "p.content_char", "p.lines_before", "p.lines_to_end", "start_line", "end_line").select(
        "ord", "field", "piece", "text", "start_char", "content_char",
        line("lines_before").cast("int").alias("start_line"), line("lines_to_end").cast("int").alias("end_line"),
    )


def found(components: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """ord and field of the values that had to be cut: those whose pieces are several."""
    return pieces(components, limit, overlap).filter(F.col("piece") == 1).select("ord", "field").distinct()
