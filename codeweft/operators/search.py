"""Ranking: BM25, exact cosine, rank fusion, similar documents, packing under a token budget."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.functions import text as T
from codeweft.session import cut, staged

K1, B, RRF = 1.2, 0.75, 60
TOKEN = r"([\p{L}\p{N}_]+)"


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(1))


def bm25(docs: DataFrame, key: str, body: str, query: str) -> DataFrame:
    """key and score of the documents that hold a word of the query (SCH-02).

    One scan splits the texts; what is kept of each, its length and the words of the query in it, is staged and serves the
    statistics and the counts.
    """
    terms = sorted(set(re.findall(r"[^\W]+", query.lower())))
    d = staged(docs.select(key, tokens(F.col(body)).alias("t")).select(key, F.size("t").alias("dl"), F.filter("t", lambda x: x.isin(terms)).alias("hits")), "tokens")
    stats = d.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    tf = d.filter(F.size("hits") > 0).select(key, "dl", F.explode("hits").alias("term")).groupBy(key, "dl", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    s = tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))  # one row a term of the query, one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return s.groupBy(key).agg(F.sum(score).alias("score"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(vectors: DataFrame, key: str, vector: str, query: DataFrame) -> DataFrame:
    """key and cosine to the one vector of query (column q); null and zero vectors take no part (SCH-03)."""
    return vectors.filter(F.col(vector).isNotNull()).crossJoin(F.broadcast(query.limit(1))).select(key, cosine(F.col(vector), F.col("q")).alias("score")).filter("score IS NOT NULL")


def nearest_each(vectors: DataFrame, key: str, vector: str, queries: DataFrame, k: int, block: int = 1024, digits: int = 6) -> DataFrame:
    """query, key, score and rank of the k rows nearest to each row of queries (query, q), ties to the smaller key.

    Vectors and queries are dealt into blocks by hash; a task compares one block of each and keeps its k best a query,
    which are merged by query. Null and zero vectors take no part, and those of another length than the query's neither.
    """
    v = vectors.filter(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    q = cut(queries.filter("q IS NOT NULL").select("query", F.col("q").cast("array<double>").alias("q")))
    nv, nq = (max(1, -(-d.count() // block)) for d in (v, q))
    v = v.withColumn("vb", F.pmod(F.xxhash64("key"), F.lit(nv)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    q = q.withColumn("qb", F.pmod(F.xxhash64("query"), F.lit(nq)).cast("int")).withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(nv - 1))))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        a, b = a.sort_values("key"), b.assign(n=b["q"].map(len))
        sizes = a["v"].map(len)
        for n, asked in b.groupby("n"):
            rows = a[sizes == n]
            if not len(rows) or not n:
                continue
            x, y = np.stack(rows["v"].to_numpy()), np.stack(asked["q"].to_numpy())
            lx, ly = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))
            with np.errstate(divide="ignore", invalid="ignore"):
                score = np.floor((y @ x.T) / ly[:, None] / lx[None, :] * 10**digits + 0.5) / 10**digits
            keys = rows["key"].to_numpy()
            for name, line in zip(asked["query"], score):
                first = [j for j in np.argsort(-line, kind="stable")[:k] if not np.isnan(line[j])]
                out.append(pd.DataFrame({"query": name, "key": keys[first], "score": line[first]}))
        return pd.concat(out) if out else pd.DataFrame({"query": [], "key": [], "score": []})

    kinds = f"query {q.schema['query'].dataType.simpleString()}, key {v.schema['key'].dataType.simpleString()}, score double"
    part = v.groupBy("vb", "qb").cogroup(q.groupBy("vb", "qb")).applyInPandas(best, kinds)
    w = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    return part.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k).select("query", F.col("key").alias(key), "score", "rank")


def top(scored: DataFrame, key: str, k: int, digits: int = 6) -> DataFrame:
    """The k best with their rank (SRT-01, WIN-10): a distributed top-k, then numbers for k rows. Ties go to the smaller key."""
    best = scored.select(key, F.round("score", digits).alias("score")).orderBy(F.desc("score"), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)).cast("bigint"))


def numbered(scored: DataFrame, key: str, digits: int = 6) -> DataFrame:
    """key and rank of every row, in the order of top().

    A range-partitioned sort; a row's rank is its place in its partition and the rows of the partitions before, of
    which there is one count a partition. The sorted rows are checkpointed, as their places must not change.
    """
    rows = scored.select(key, F.round("score", digits).alias("score")).orderBy(F.desc("score"), key)
    placed = cut(rows.select(key, F.spark_partition_id().alias("p"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("i")))
    before = placed.groupBy("p").agg(F.count("*").alias("n")).select("p", (F.sum("n").over(Window.orderBy("p")) - F.col("n")).alias("before"))
    return placed.join(F.broadcast(before), "p").select(key, (F.col("before") + F.col("i") + 1).alias("rank"))


def fused(legs: list[DataFrame], key: str, depth: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of the ranks of several legs (SCH-01), whole or, with depth, of the first ranks only."""
    parts = None
    for leg in legs:
        r = (numbered(leg, key) if depth is None else top(leg, key, depth)).select(key, (1.0 / (RRF + F.col("rank"))).alias("part"))
        parts = r if parts is None else parts.unionByName(r)
    return parts.groupBy(key).agg(F.sum("part").alias("score"))


def above(ranked: DataFrame, threshold: float) -> DataFrame:
    """Threshold after the limit, so fewer rows may be left (FLT-04)."""
    return ranked.filter(F.col("score") >= threshold)


def packed(ranked: DataFrame, budget: int, group: str = "g") -> DataFrame:
    """Results packed under a token budget per group (WIN-07): detail falls with rank and budget, the first always fits.

    ranked: group, rank, header, full, signature; at most a page of rows a group. A true left fold, run inside the engine
    over the group's array: full for the first three while over 300 tokens are left, signature up to the tenth while over
    100 are, else the header; it ends at the first row that does not fit.
    """
    size = lambda c: F.coalesce(T.estimate_tokens(c), F.lit(0).cast("bigint"))
    number = lambda c: F.concat(F.col("rank").cast("string"), F.lit(". "), c)
    r = ranked.select(group, F.struct(F.col("rank").cast("bigint").alias("rank"), *[size(number(F.concat_ws("\n", "header", *([x] if x else [])))).alias(y) for x, y in (("full", "f"), ("signature", "s"), (None, "m"))]).alias("r"))
    rows = r.groupBy(group).agg(F.array_sort(F.collect_list("r")).alias("rows"))
    kind = "struct<used:bigint,done:boolean,out:array<struct<rank:bigint,level:string,tokens:bigint>>>"
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(False).alias("done"), F.array().cast("array<struct<rank:bigint,level:string,tokens:bigint>>").alias("out")).cast(kind)

    def step(a, x):
        left = F.lit(budget) - a.used
        level = F.when((x["rank"] <= 3) & (left > 300), "full").when((x["rank"] <= 10) & (left > 100), "signature").otherwise("minimal")
        cost = F.when(level == "full", x["f"]).when(level == "signature", x["s"]).otherwise(x["m"])
        stop = a.done | ((a.used + cost > budget) & (x["rank"] > 1))
        row = F.struct(x["rank"].alias("rank"), level.alias("level"), cost.alias("tokens"))
        return F.struct(F.when(stop, a.used).otherwise(a.used + cost).alias("used"), stop.alias("done"), F.when(stop, a.out).otherwise(F.concat(a.out, F.array(row))).alias("out")).cast(kind)

    return rows.select(group, F.explode(F.aggregate("rows", start, step).out).alias("o")).select(group, "o.*")
