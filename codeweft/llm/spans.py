"""Problem 9: long exact spans shared between records.

Paragraphs are stretches of PARAGRAPH characters at anchors that the text itself chooses: the least shingle of every
window of SPAN - PARAGRAPH + 1 positions is one (winnowing), so any SPAN characters hold a whole paragraph that is cut
alike wherever they stand, and paragraphs need no line breaks. MinHash signatures of the paragraphs over shingles of
SHINGLE characters go into bands, their number from the collision curve for a wanted recall. Paragraphs that collide
with one of another text are verified: as spans are verbatim their Jaccard likeness must be 1, which their whole hashes
tell inside the band. They mark where spans may be; there every stretch of SPAN characters is hashed, equal stretches
of two texts are joined by their least and greatest text, successive ones are merged into spans, and the characters of
both ends are compared: the edit distance must be 0. Equal texts are one class first, and groups are aggregated to
their least member, so no pairs inside a group are ever made; hot keys are split. Links between texts and their
components give the clusters of removals.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweft.operators.graph import connected_components
from codeweft.session import cut, forget, spread, staged, unskewed

SPAN, PARAGRAPH, SHINGLE = 200, 100, 8
#: Least likeness of paragraphs that the bands are tuned for, rows of a band, and the recall wanted there.
LIKE, BAND, RECALL = 0.95, 3, 0.97
#: Two primes of 31 bits; a hash joins the residues, 62 bits.
PRIMES, BASES = (2147483647, 2147483629), (1000003, 998244353)
BATCH_ROWS = 200_000


def bands_for(like: float = LIKE, rows: int = BAND, recall: float = RECALL) -> int:
    """Bands that the collision curve 1 - (1 - s^r)^b needs for a recall at a likeness."""
    return math.ceil(math.log(1 - recall) / math.log(1 - like**rows))


@lru_cache(maxsize=8)
def _powers(n: int, p: int, base: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        step = np.uint64(pow(base, len(out), p))
        out = np.concatenate([out, out * step % np.uint64(p)])
    return out[:n]


def _rolling(codes: np.ndarray, width: int) -> np.ndarray:
    """62-bit hashes of all stretches of a width, from prefix sums of both residues."""
    n = len(codes)
    size = 1 << max(10, n.bit_length())
    mixed = np.zeros(n - width + 1, np.uint64)
    for p, base in zip(PRIMES, BASES):
        power, inverse = _powers(size, p, base), _powers(size, p, pow(base, -1, p))
        total = np.concatenate([[np.uint64(0)], np.cumsum((codes + np.uint64(1)) * power[:n] % np.uint64(p))])
        h = (total[width:] - total[:-width]) % np.uint64(p) * inverse[: n - width + 1] % np.uint64(p)
        mixed = (mixed << np.uint64(31)) ^ h
    return mixed


def _scramble(h: np.ndarray) -> np.ndarray:
    """A random-looking order of hashes, for minima."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB) >> np.uint64(1)


def window_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every window of w values, in linear time (prefix and suffix minima of blocks)."""
    n = len(h)
    padded = np.concatenate([h, np.full(-n % w, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    left = np.minimum.accumulate(padded, axis=1).ravel()
    right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def grams(codes: np.ndarray) -> np.ndarray:
    """Hashes of the shingles at all positions."""
    h, n = np.zeros(len(codes) - SHINGLE + 1, np.uint64), len(codes) - SHINGLE + 1
    for k in range(SHINGLE):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n]
    return _scramble(h)


def anchors(h: np.ndarray) -> np.ndarray:
    """Starts of the paragraphs: shingles that are the least of a window of starts."""
    w = SPAN - PARAGRAPH + 1
    starts = h[: len(h) + SHINGLE - PARAGRAPH]  # a paragraph must end within the text
    least = window_min(starts, w)
    edge = np.full(w - 1, np.iinfo(np.uint64).max, np.uint64)
    most = ~window_min(np.concatenate([edge, ~least, edge]), w)
    return np.nonzero(starts == most)[0]


def band_keys(h: np.ndarray, at: np.ndarray, bands: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the bands and hash of all shingles in order, for the paragraphs that start at the given places."""
    r = np.random.default_rng(9)
    a, b = (r.integers(1, (1 << 63) - 1, bands * BAND, np.int64).astype(np.uint64) | np.uint64(1) for _ in range(2))
    view, out = np.lib.stride_tricks.sliding_window_view(h, PARAGRAPH - SHINGLE + 1), []
    order = r.integers(1, (1 << 63) - 1, view.shape[1], np.int64).astype(np.uint64) | np.uint64(1)
    for k in range(0, len(at), 2048):
        rows = view[at[k : k + 2048]]
        keys = np.zeros((len(rows), bands), np.uint64)
        for f in range(bands * BAND):
            low = (rows * a[f] + b[f]).min(axis=1)
            n = f // BAND
            keys[:, n] = (keys[:, n] ^ _scramble(low + np.uint64(n))) * np.uint64(0x9E3779B97F4A7C15)
        out.append((keys, _scramble((rows * order).sum(axis=1, dtype=np.uint64))))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros((0, bands), np.uint64), np.zeros(0, np.uint64))


def _sketch(bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Band keys and whole hashes of paragraphs; successive equal paragraphs are one row from first to last."""
        for b in batches:
            for k in range(0, b.num_rows, 500):
                ids, texts = (b[c].slice(k, 500).to_pylist() for c in ("id", "text"))
                hashes = [grams(codes_of(t)) for t in texts]
                at = [anchors(h) for h in hashes]
                base = np.cumsum([0] + [len(h) for h in hashes])
                places, owner = np.concatenate(at), np.repeat(np.arange(len(ids)), [len(x) for x in at])
                every = np.concatenate(hashes)
                keys, whole = band_keys(every, places + base[owner], bands)
                new = np.ones(len(places), bool)
                new[1:] = (np.diff(places) != 1) | (whole[1:] != whole[:-1]) | (owner[1:] != owner[:-1])
                first = np.nonzero(new)[0]
                last = np.append(first[1:], len(places)) - 1
                wide = lambda x, kind: pa.array(np.repeat(x, bands).astype(kind))
                columns = [wide(np.array(ids, np.int64)[owner[first]], np.int64), pa.array(keys[first].ravel().view(np.int64)), wide(whole[first].view(np.int64), np.int64), wide(places[first], np.int32), wide(places[last], np.int32)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "band", "whole", "first", "last"])

    return run


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the stretches of SPAN characters that hold a paragraph which collides with one of another text."""
    out: list = []

    def flush() -> pa.RecordBatch:
        b = pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["id", "start", "hash"])
        out.clear()
        return b

    n = 0
    for b in batches:
        for i, text, places in zip(b["id"].to_pylist(), b["text"].to_pylist(), b["places"].to_pylist()):
            codes = codes_of(text)
            steps = np.zeros(len(codes) + 1, np.int32)
            np.add.at(steps, np.maximum([p["first"] - SPAN + PARAGRAPH for p in places], 0), 1)
            np.add.at(steps, [p["last"] + 1 for p in places], -1)
            starts = np.nonzero(np.cumsum(steps)[: len(codes) - SPAN + 1])[0]
            out.append((np.full(len(starts), i, np.int64), starts.astype(np.int32), _rolling(codes, SPAN)[starts].view(np.int64)))
            n += len(starts)
            if n >= BATCH_ROWS:
                yield flush()
                n = 0
    if out:
        yield flush()


def classes(documents: DataFrame) -> DataFrame:
    """doc_id, id of the class of equal texts and whether others share it; only texts that can hold a span."""
    d = documents.select("doc_id", F.length("text").alias("n_chars"), F.md5("text").alias("digest")).filter(F.col("n_chars") >= SPAN)
    c = d.groupBy("digest", "n_chars").agg(F.min("doc_id").alias("id"), (F.max("doc_id") > F.min("doc_id")).alias("copied"), F.count("*").alias("rows"))
    key = F.concat_ws(" ", "digest", "n_chars").alias("digest")
    return unskewed(d.select("doc_id", "n_chars", key), cut(c.select(key, "id", "copied", "rows")), "digest", "rows").select("doc_id", "id", "n_chars", "copied").distinct()


def spans(documents: DataFrame, members: DataFrame) -> DataFrame:
    """id, start, size and other of the spans that the text of a class shares with that of another class.

    Of the classes that hold a stretch each is joined with the least one, and the least with the greatest.
    """
    reps = members.filter(F.col("doc_id") == F.col("id")).select("id")
    texts = spread(documents.select(F.col("doc_id").alias("id"), "text").filter(F.length("text") >= SPAN), "id").join(reps, "id", "left_semi")
    sketch = texts.mapInArrow(_sketch(bands_for()), "id bigint, band bigint, whole bigint, first int, last int")
    sketch = staged(sketch.select("id", F.xxhash64("band", "whole").alias("band"), "first", "last"), "sketch")
    met = cut(sketch.groupBy("band").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("rows")).filter("a < b").select("band", "rows"))
    places = unskewed(sketch, met, "band", "rows").groupBy("id").agg(F.collect_set(F.struct("first", "last")).alias("places"))
    rows = staged(texts.join(places, "id").mapInArrow(_stretches, "id bigint, start int, hash bigint"), "stretches")
    forget(sketch)
    twice = staged(rows.groupBy("hash").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("rows")).filter("low < high"), "twice")
    other = F.when(F.col("id") == F.col("low"), F.col("high")).otherwise(F.col("low"))
    s = unskewed(rows, twice, "hash", "rows").select("id", "start", other.alias("other"))
    w = Window.partitionBy("id").orderBy("start")
    s = s.withColumn("again", F.lag("start").over(w) == F.col("start")).filter("again IS NOT TRUE")  # repeated rows
    goes_on = (F.lag("other").over(w) == F.col("other")) & (F.lag("start").over(w) == F.col("start") - 1)
    s = s.withColumn("n", F.sum(F.when(goes_on, 0).otherwise(1)).over(w)).groupBy("id", "n", "other").agg(F.min("start").alias("start"), F.count("*").alias("k"))
    s = cut(s.select("id", "start", (F.col("k") + SPAN - 1).cast("int").alias("size"), "other"))
    forget(rows)
    forget(twice)
    unlike = unlike_spans(s, texts)
    if unlike.isEmpty():
        return s
    # stretches that follow one another here need not there, as in periodic texts: those are compared one by one
    one = unlike.select("id", F.explode(F.sequence("start", F.col("start") + F.col("size") - SPAN)).alias("start"), F.lit(SPAN).alias("size"), "other")
    whole = s.join(unlike, ["id", "start", "size", "other"], "left_anti")
    return whole.unionByName(one.join(unlike_spans(one, texts), ["id", "start", "size", "other"], "left_anti"))


def unlike_spans(s: DataFrame, texts: DataFrame) -> DataFrame:
    """The spans whose characters do not stand in the other text, compared once for all texts that share them."""
    said = s.join(texts, "id").select("id", "start", "size", "other", F.substring("text", F.col("start") + 1, F.col("size")).alias("said"))
    there = texts.select(F.col("id").alias("other"), F.col("text").alias("there"))
    wrong = said.select("other", "said").distinct().join(there, "other").filter(~F.contains("there", "said")).select("other", "said")
    return cut(said.join(wrong, ["other", "said"], "left_semi").select("id", "start", "size", "other"))


def coverage(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, shared_chars and share of every text that shares a span.

    Texts that are null, empty or shorter than a span share nothing; a text that occurs twice is shared as a whole.
    Characters are code points; rows that repeat a doc_id and its text are one record. Two equal spans inside one text
    alone are not shared.
    """
    members = cut(classes(documents))
    s = spans(documents, members).select("id", "start", (F.col("start") + F.col("size")).alias("end"))
    w = Window.partitionBy("id").orderBy("start", "end")
    before = F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    covered = s.withColumn("new", F.greatest(F.col("end") - F.greatest("start", before), F.lit(0))).groupBy("id").agg(F.sum("new").alias("covered"))
    m = members.join(covered, "id", "left").withColumn("shared_chars", F.when(F.col("copied"), F.col("n_chars")).otherwise(F.col("covered")).cast("bigint"))
    m = m.filter(F.col("shared_chars") > 0)
    return m.groupBy("doc_id").agg(F.max("n_chars").cast("bigint").alias("n_chars"), F.max("shared_chars").alias("shared_chars")).withColumn("share", F.col("shared_chars") / F.col("n_chars"))


def found(documents: DataFrame) -> DataFrame:
    """doc_id of every text that shares a span with another."""
    return coverage(documents).select("doc_id")


def clusters(documents: DataFrame) -> DataFrame:
    """doc_id, cluster (its least doc_id), links (other texts its spans are joined with) and removed: all but the least of a cluster."""
    members = cut(classes(documents))
    links = cut(spans(documents, members).select(F.col("id").alias("src"), F.col("other").alias("dst")).distinct())
    comps = connected_components(links)
    degree = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).groupBy(F.col("src").alias("id")).agg(F.countDistinct("dst").alias("links"))
    m = members.join(comps.withColumnRenamed("node", "id"), "id", "left").join(degree, "id", "left").filter(F.col("copied") | F.col("component").isNotNull())
    g = m.groupBy("doc_id").agg(F.min(F.coalesce("component", "id")).alias("cluster"), F.max(F.coalesce("links", F.lit(0))).cast("bigint").alias("links"))
    return g.withColumn("removed", F.col("doc_id") != F.col("cluster"))
