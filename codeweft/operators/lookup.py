"""Reading the index: scans, point lookups, filters over metadata and paths, projections of hits, related files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeweft.functions import text as T


def scanned(c: DataFrame) -> DataFrame:
    """All rows of the index with score 1 (SRC-27)."""
    return c.withColumn("score", F.lit(1.0))


def by_id(c: DataFrame, asked: DataFrame) -> DataFrame:
    """The row of every asked id, nulls where there is none (SRC-28). asked: id, once or more."""
    return asked.select("id").distinct().join(c, "id", "left")


def by_metadata(c: DataFrame, wanted: dict) -> DataFrame:
    """Rows whose columns have the wanted values (FLT-05): plain equalities, which reach the scan."""
    for name, value in wanted.items():
        c = c.filter(F.col(name) == F.lit(value))
    return c


def of_file_types(c: DataFrame, endings: list[str]) -> DataFrame:
    """Rows whose path ends with any of the endings (FLT-06); without endings all rows."""
    return c.filter(F.exists(F.array(*[F.lit(e) for e in endings]), lambda e: F.endswith("path", e))) if endings else c


def same_kind(hits: DataFrame, limit: int) -> DataFrame:
    """Hits in other files of the same extension as the asked file, ranked anew up to the limit (FLT-08). hits: query, asked, path, rank."""
    ext = lambda p: F.lower(F.substring_index(p, ".", -1))
    kept = hits.filter((ext("path") == ext("asked")) & (F.col("path") != F.col("asked")))
    w = Window.partitionBy("query").orderBy("rank")
    return kept.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= limit)


def hits_with_metadata(hits: DataFrame, key: str, metadata: str, schema: str) -> DataFrame:
    """Stored hits as id, score and parsed metadata; what is no JSON object gives empty metadata (PRJ-07)."""
    return hits.select(F.col(key).alias("id"), "score", F.coalesce(F.from_json(metadata, schema, {"mode": "PERMISSIVE"}), F.create_map().cast(schema)).alias("metadata"))


def views(c: DataFrame) -> DataFrame:
    """Typed fields of each hit with the defaults of absent ones (PRJ-09)."""
    return c.select("ord", F.coalesce("path", F.lit("")).alias("path"), F.coalesce("type", F.lit("")).alias("type"), F.coalesce("name", F.lit("")).alias("name"), F.coalesce(F.col("start_line").cast("bigint"), F.lit(0)).alias("start_line"), F.coalesce("exported", F.lit(False)).alias("exported"))


def reason(title: Column, name: Column, kind: Column) -> Column:
    """Why a hit is relevant to a title (PRJ-10): its name is in the title (an empty name always is), else its kind."""
    return F.when(F.contains(F.lower(title), F.lower(F.coalesce(name, F.lit("")))), "name in the title").when(kind.isin("function", "method"), "similar function").when(kind == "class", "similar class").when(kind.isin("interface", "type"), "similar type").otherwise("related")


def unlisted(usages: DataFrame, listed: DataFrame) -> DataFrame:
    """Usages at places that are not listed before, one a place (SET-05). Both: file, line."""
    return usages.join(listed.select("file", "line").distinct(), ["file", "line"], "left_anti").groupBy("file", "line").agg(F.min("callee").alias("callee"))


def coverage(indexed: DataFrame, files: DataFrame) -> DataFrame:
    """repo, files, indexed and the percentage, 0 of no files (AGG-19)."""
    f = files.select("repo", "file").distinct()
    i = indexed.select("repo", "file", F.lit(True).alias("has")).distinct()
    g = f.join(i, ["repo", "file"], "left").groupBy("repo").agg(F.count("*").alias("files"), F.count("has").alias("indexed"))
    return g.withColumn("percent", F.when(F.col("files") > 0, F.round(F.col("indexed") * 100 / F.col("files"), 6)).otherwise(0.0))


IMPORTS = 5


def formatted(c: DataFrame, key: str) -> DataFrame:
    """Texts of each hit in the three levels of detail (SCH-14): a header, with the signature, or with the snippet and the first imports.

    Absent parts are left out; a snippet is cut to ten lines with a note of the rest.
    """
    place = F.concat(F.lit("("), F.col("path"), F.coalesce(F.concat(F.lit(":"), F.col("start_line").cast("string")), F.lit("")), F.lit(")"))
    header = F.concat_ws(" ", F.concat("type", F.lit(":")), "name", place)
    indented = F.concat(F.lit("   "), F.replace(T.truncated_snippet(F.col("snippet"), 10), F.lit("\n"), F.lit("\n   ")))
    imports = F.when(F.size("imports") > 0, F.concat(F.lit("   Imports: "), F.concat_ws(", ", F.slice("imports", 1, IMPORTS)), F.when(F.size("imports") > IMPORTS, " ...").otherwise("")))
    return c.select(key, header.alias("minimal"), F.concat_ws("\n", header, F.concat(F.lit("   "), "signature")).alias("signature"), F.concat_ws("\n", header, indented, imports).alias("full"))


def repositories(r: DataFrame) -> DataFrame:
    """Remote as a plain name, branch, head and whether there are changes, of every repository (SRC-30)."""
    return r.select("repo", T.normalize_remote(F.col("remote")).alias("remote"), "branch", "head", F.coalesce("dirty", F.lit(False)).alias("dirty"))


def related_tests(files: DataFrame, limit: int = 5) -> DataFrame:
    """Test files that are named after a source file of their repository (SCH-07), nearest folders first.

    The name of a test without its marks is an equi-join key; files that share one name are ranked a source file each.
    """
    stem = F.regexp_replace(T.basename(F.col("file")), r"\.[^.]*$", "")
    f = files.select("repo", "file", stem.alias("stem"), T.is_test_file(F.col("file")).alias("test")).distinct()
    bare = F.regexp_replace("stem", r"^test_|_test$|\.(?:test|spec)$", "")
    tests = f.filter("test").select("repo", bare.alias("stem"), F.col("file").alias("test_file"))
    near = (T.dirname(F.col("file")) != T.dirname(F.col("test_file"))).cast("int")
    w = Window.partitionBy("repo", "file").orderBy(near, "test_file")
    return f.filter("NOT test").join(tests, ["repo", "stem"]).withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= limit).select("repo", "file", "rank", "test_file")


def other_models(vectors: DataFrame, configured: str) -> DataFrame:
    """Rows by stored model that is not the configured one (SCH-13); a caller stops where there are any."""
    return vectors.filter(~F.col("model").eqNullSafe(F.lit(configured))).groupBy("model").agg(F.count("*").alias("rows"))


def save_graph(edges: DataFrame, calls: DataFrame, root: str) -> None:
    """The graph artifact of format 2: edges and calls as tables with a count and a format mark, the mark last (SNK-06)."""
    edges.write.mode("overwrite").parquet(f"{root}/edges")
    calls.write.mode("overwrite").parquet(f"{root}/calls")
    spark = edges.sparkSession
    mark = spark.createDataFrame([(2,)], "format int").crossJoin(spark.read.parquet(f"{root}/edges").agg(F.count("*").alias("edges")))
    mark.coalesce(1).write.mode("overwrite").json(f"{root}/format")


def load_graph(spark: SparkSession, root: str, build) -> tuple[DataFrame, DataFrame | None]:
    """Edges and calls of an artifact (SRC-32); format 1 has no calls. What is absent, unknown or broken is built by build()."""
    try:
        mark = spark.read.json(f"{root}/format").first()
        if mark is not None and mark.format in (1, 2):
            edges = spark.read.parquet(f"{root}/edges")
            return edges, spark.read.parquet(f"{root}/calls") if mark.format == 2 else None
    except Exception:  # noqa: BLE001 - any unreadable artifact is rebuilt
        pass
    return build()
