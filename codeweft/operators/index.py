"""The index: current components, documents to embed, merge and upsert plans, predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.functions import text as T


def current(components: DataFrame) -> DataFrame:
    """Latest row of each component of a repository, with path and language made plain (SNK-01, WIN-01).

    The window keeps one row a key, so Spark limits each key's rows before the shuffle.
    """
    w = Window.partitionBy("repo", "id").orderBy(F.desc_nulls_last("indexed_at"), F.desc("ord"))
    c = components.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
    return c.withColumn("path", F.concat_ws("/", "repo", "file")).withColumn("language", T.language_of(F.col("language"), F.col("file")))


def documents_to_embed(c: DataFrame) -> DataFrame:
    """Rows as they are embedded and stored: renamed path, kept metadata, text (PRJ-01..06, FLT-01)."""
    return c.select(
        F.concat_ws("/", "repo", "id").alias("id"), "path", "type", "name", "language", "exported", F.col("start_line").cast("bigint").alias("start_line"),
        T.document_text(F.col("type"), F.col("name"), F.col("text")).alias("text"),
        F.concat_ws("\n", F.concat_ws(" ", "type", "name"), "signature", "docstring").alias("embedding_text"),
        T.truncated_snippet(F.col("snippet")).alias("snippet"),
    )


def digest(*columns: str) -> Column:
    return F.sha2(F.concat_ws("\x01", *[F.coalesce(F.col(c).cast("string"), F.lit("\x02")) for c in columns]), 256)


def merge_plan(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key and action (insert, update, keep, delete) of a full synchronisation by content hash (SNK-02).

    Only keys and hashes are shuffled. Null keys are left out, repeated keys count once, by their least hash.
    """
    side = lambda d, name: d.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(digest(*columns)).alias(name))
    j = side(old, "was").join(side(new, "now"), key, "full")
    action = F.when(F.col("was").isNull(), "insert").when(F.col("now").isNull(), "delete").when(F.col("was") == F.col("now"), "keep").otherwise("update")
    return j.select(key, action.alias("action"))


def upsert_and_delete(table: DataFrame, upserts: DataFrame, deletes: DataFrame, key: str) -> DataFrame:
    """The table after upserts and deletes by key: an anti join and a union (SNK-03, SNK-04)."""
    gone = upserts.select(key).unionByName(deletes.select(key)).distinct()
    return table.join(gone, key, "left_anti").unionByName(upserts)


def ids_of_paths(table: DataFrame, paths: DataFrame) -> DataFrame:
    """Stored ids of the given paths: what a deleted file takes with it (JN-14, FLT-12)."""
    return table.join(paths.select("path").distinct(), "path", "left_semi").select("id", "path")
