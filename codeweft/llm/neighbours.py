"""Problem 3: the k most similar vectors of every vector, by a permutation index.

A sample of vectors are pivots. Every vector is represented by its nearest pivots in order and is posted in the
inverted files of the first of them. Inside a file (in blocks of bounded size, so that a dense region is many tasks)
candidates are ranked by the footrule distance of their pivot orders, read from the columns of a vector's own pivots,
and only the best are reranked by the exact cosine; the files' results are merged per vector. Equal vectors are one
class, expanded at the end only as far as k. The pivots grow with the square root of the rows, so files stay short: the
pairs ranked grow as n to 1.5. exact=True puts all vectors in one file and reranks all of it, as do rows whose vectors
have another length than most: their files are their lengths.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweft.session import cut, spread

K = 10
#: Nearest pivots kept in order, inverted files a vector is posted in, candidates reranked per file.
ORDER, POSTED, RERANKED = 12, 6, 120
#: Pivots are so many times the root of the rows, at least 16 (126 491 pivots for a thousand million rows), shipped once to every executor.
PIVOTS = 4
BLOCK = 2_000


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, vector and its hashes for rows with a finite vector that is not all zero; of several vectors of an id the least."""
    v = vectors.select("vec_id", F.col("vector").cast("array<float>").alias("vector")).filter("vec_id IS NOT NULL AND size(vector) > 0 AND NOT exists(vector, x -> x IS NULL)")
    v = v.withColumn("norm", F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))
    v = v.filter((F.col("norm") > 0) & (F.col("norm") < float("inf")) & ~F.isnan("norm")).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    return v.select("vec_id", "vector", F.xxhash64("vector").alias("h1"), F.hash("vector").alias("h2"))


def _permute(shared, order: int):
    """id, unit and perm: the vector at unit length and its nearest pivots; of another length than theirs, minus that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        lists = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, a.shape[1], dtype=np.int32)), pa.array(a.ravel()))
        for b in batches:
            sizes = np.diff(b["vector"].offsets.to_numpy())
            for size in np.unique(sizes):
                part = b.filter(pa.array(sizes == size))
                x = np.asarray(part["vector"].flatten(), np.float32).reshape(part.num_rows, -1)
                x = x / np.sqrt((x.astype(np.float64) ** 2).sum(1))[:, None].astype(np.float32)
                if size != pivots.shape[1]:
                    first = np.full((len(x), 1), -size)
                else:
                    near = x @ pivots.T
                    take = min(order, len(pivots))
                    first = np.argpartition(-near, take - 1, axis=1)[:, :take]
                    first = np.take_along_axis(first, np.argsort(-np.take_along_axis(near, first, 1), axis=1, kind="stable"), 1)
                yield pa.RecordBatch.from_arrays([part["id"], lists(x), lists(first.astype(np.int32))], ["id", "unit", "perm"])

    return run


def _search(k: int, reranked: int):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        """The k best per vector of one pair of blocks: footrule first, then the cosine of the best; a file of one pivot is compared whole."""
        ids, unit, perm, block = g["id"].to_numpy(), np.stack(g["unit"].to_numpy()), np.stack(g["perm"].to_numpy()), g["block"].to_numpy()
        n, order = perm.shape
        pivots, at = np.unique(perm, return_inverse=True)
        at = at.reshape(n, order)
        small = np.int8 if order <= 15 else np.int32  # what the sum of all weights needs
        weights = order - np.arange(order, dtype=small)
        # footrule = order (order + 1) - 2 * sum of the lesser weights that two orders give to a pivot
        posted = np.zeros((len(pivots), n), small)
        posted[at.ravel(), np.repeat(np.arange(n), order)] = np.tile(weights, n)
        cross, every = block.min() != block.max(), len(pivots) == 1 or n <= reranked
        left, right, value = [], [], []
        for a in range(0, n, 128):
            rows = np.arange(a, min(n, a + 128))
            if every:
                best = np.broadcast_to(np.arange(n), (len(rows), n))
                cos = unit[rows] @ unit.T
            else:
                agree = np.zeros((len(rows), n), small)
                for j in range(order):
                    agree += np.minimum(posted[at[rows, j]], weights[j])
                best = np.argpartition(-agree, reranked, axis=1)[:, : reranked + 1]
                cos = np.einsum("rd,rbd->rb", unit[rows], unit[best])
            cos[best == rows[:, None]] = -2
            if cross:
                cos[block[best] == block[rows][:, None]] = -2
            top = np.argpartition(-cos, min(k, cos.shape[1]) - 1, axis=1)[:, :k]
            left.append(np.repeat(ids[rows], top.shape[1]))
            right.append(ids[np.take_along_axis(best, top, 1)].ravel())
            value.append(np.take_along_axis(cos, top, 1).ravel())
        out = pd.DataFrame({"id": np.concatenate(left), "other": np.concatenate(right), "cosine": np.concatenate(value).astype(np.float64)})
        return out[out.cosine > -2]

    return run


def class_neighbours(reps: DataFrame, n: int, k: int, order: int, posted: int, reranked: int, exact: bool) -> DataFrame:
    """id, other, cosine: the k best other classes found for every class (id, vector)."""
    spark = reps.sparkSession
    usual = reps.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if usual is None:
        return spark.createDataFrame([], "id bigint, other bigint, cosine double")
    count = 1 if exact else min(max(16, int(PIVOTS * math.sqrt(n))), n)
    sample = reps.filter(F.size("vector") == usual.d).orderBy(F.xxhash64("id"), "id").limit(count).select("vector").toPandas()
    pivots = np.stack(sample["vector"].to_numpy()).astype(np.float64)
    pivots = (pivots / np.sqrt((pivots**2).sum(1))[:, None]).astype(np.float32)
    shared = spark.sparkContext.broadcast(pivots)
    index = cut(spread(reps.select("id", "vector"), "id").mapInArrow(_permute(shared, order), "id bigint, unit array<float>, perm array<int>"))
    post = index.select("id", "unit", "perm", F.explode(F.slice("perm", 1, posted)).alias("pivot"))
    sizes = post.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    post = post.join(F.broadcast(sizes), "pivot")  # one row a pivot or length of vectors, fewer bytes than the pivots
    post = post.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    post = post.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    post = post.select("pivot", F.least("block", "x").alias("low"), F.greatest("block", "x").alias("high"), "id", "unit", "perm", "block")
    pairs = spread(post, "pivot", "low", "high").groupBy("pivot", "low", "high").applyInPandas(_search(k, reranked), "id bigint, other bigint, cosine double")
    best = pairs.groupBy("id", "other").agg(F.max("cosine").alias("cosine"))
    w = Window.partitionBy("id").orderBy(F.desc("cosine"), "other")
    return best.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).drop("r")


def neighbours(vectors: DataFrame, k: int = K, order: int = ORDER, posted: int = POSTED, reranked: int = RERANKED, exact: bool = False) -> DataFrame:
    """vec_id, rank, other, cosine: the k most similar other rows of every row.

    Rows without an id and with null, zero or non-finite vectors take no part; vectors are compared with those of their
    length. Equal vectors are neighbours of cosine 1; ties go to the smaller vec_id. An empty table gives no rows, fewer
    than k other rows all of them. Of rows that repeat a vec_id the least vector counts.
    """
    v = cut(usable(vectors))
    classes = v.groupBy("h1", "h2").agg(F.min("vec_id").alias("id"))
    members = cut(v.join(classes, ["h1", "h2"]).select("vec_id", "id", "vector"))
    reps = members.filter("vec_id = id").select("id", "vector")
    near = cut(class_neighbours(reps, reps.count(), k, order, posted, reranked, exact))
    first = Window.partitionBy("id").orderBy("vec_id")
    mates = members.select("id", "vec_id").withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1).drop("r")
    mates = mates.withColumnRenamed("vec_id", "other")
    others = near.join(mates.select(F.col("id").alias("other_id"), F.col("other").alias("row")), F.col("other") == F.col("other_id"))
    w = Window.partitionBy("id").orderBy(F.desc("cosine"), "row")
    others = others.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).select("id", F.col("row").alias("other"), "cosine")
    own = mates.select("id", "other", F.lit(1.0).alias("cosine"))
    options = members.select("vec_id", "id").join(own.unionByName(others), "id").filter("vec_id <> other")
    w = Window.partitionBy("vec_id").orderBy(F.desc("cosine"), "other")
    return options.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("vec_id", "rank", "other", "cosine")


def found(vectors: DataFrame, k: int = K) -> DataFrame:
    """vec_id_a < vec_id_b: pairs of which one is among the k most similar of the other."""
    n = neighbours(vectors, k)
    return n.select(F.least("vec_id", "other").alias("vec_id_a"), F.greatest("vec_id", "other").alias("vec_id_b")).distinct()
