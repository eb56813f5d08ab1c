"""Markdown sections in the engine: lines as rows, fence and heading flags, running section numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweft.functions.text import extension, slugify

FENCE = r"^ {0,3}(?:```|~~~)"


def sections(files: DataFrame) -> DataFrame:
    """file_id, start_line, end_line, level, title, slug and body of every section with a paragraph or code (SRC-26, WIN-08).

    Text before the first heading is dropped; list, table and quote lines are no paragraph. Null contents have no rows.
    Lines of a file meet in one window; a file is the unit of its own order.
    """
    md = files.filter(extension(F.col("file")).isin("md", "mdx", "markdown")).select("file_id", F.split(F.regexp_replace("content", "\r\n?", "\n"), "\n").alias("ls"))
    lines = md.select("file_id", F.posexplode("ls").alias("n", "t")).withColumn("line", F.col("n") + 1)
    w = Window.partitionBy("file_id").orderBy("line")
    fence = F.col("t").rlike(FENCE)
    lines = lines.withColumn("inside", F.sum(fence.cast("int")).over(w) % 2 == 1)
    lines = lines.withColumn("head", F.col("t").rlike(r"^#{1,6} +\S") & ~F.col("inside"))
    lines = lines.withColumn("section", F.sum(F.col("head").cast("int")).over(w)).filter("section > 0")
    text = ~F.col("head") & (F.trim("t") != "") & (F.col("inside") | fence | ~F.col("t").rlike(r"^\s*(?:[-*+>|]|[0-9]+\.)\s?"))
    g = lines.groupBy("file_id", "section").agg(
        F.min("line").cast("bigint").alias("start_line"), F.max("line").cast("bigint").alias("end_line"), F.min_by("t", "line").alias("h"), F.count_if(text).alias("body_lines"),
        F.array_sort(F.collect_list(F.when(text, F.struct("line", "t")))).alias("body"),
    ).filter("body_lines > 0")
    title = F.trim(F.regexp_replace(F.regexp_replace("h", "^#+ +", ""), r"\s*#*\s*$", ""))
    return g.select("file_id", "start_line", "end_line", F.length(F.regexp_extract("h", "^#+", 0)).cast("bigint").alias("level"), title.alias("title"), slugify(title).alias("slug"), F.array_join(F.transform("body", lambda b: b.t), "\n").alias("body"))
