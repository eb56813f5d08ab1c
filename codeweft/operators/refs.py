"""Callers and callees: the reverse index as a table of calls, name lookups, symbol resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweft.functions import text as T


def calls(c: DataFrame) -> DataFrame:
    """The reverse index: one row per call, keyed by the callee (JN-01, PRJ-08).

    callee_key is repo/file:name where the file of the callee is known, else the bare name.
    """
    e = c.select("ord", "repo", F.coalesce("path", F.lit("")).alias("file"), F.coalesce("name", F.lit("unknown")).alias("caller"), F.coalesce("type", F.lit("unknown")).alias("type"), F.posexplode("callees").alias("pos", "callee"))
    key = F.when(F.col("callee.file").isNotNull(), F.concat(F.concat_ws("/", "repo", "callee.file"), F.lit(":"), F.col("callee.name"))).otherwise(F.col("callee.name"))
    return e.filter("callee.name IS NOT NULL").select(key.alias("callee_key"), F.col("callee.name").alias("callee"), "caller", "file", F.col("callee.line").cast("bigint").alias("line"), "type", "ord", F.col("pos").cast("bigint").alias("pos"))


def name_index(calls_: DataFrame) -> DataFrame:
    """segment, callee_key: a key under its whole name, its last and its first dotted part (JN-02)."""
    k = calls_.select("callee_key", "callee").distinct()
    name = F.regexp_replace("callee", "^new ", "")
    segments = F.array_distinct(F.array(name, F.substring_index(name, ".", -1), F.substring_index(name, ".", 1)))
    return k.select(F.explode(segments).alias("segment"), "callee_key")


def callers(calls_: DataFrame, targets: DataFrame, limit: int = 50) -> DataFrame:
    """Callers of every target (name, file): exact key first, then keys of the name; one row per caller, in order (JN-03).

    targets: name, file. A target without calls has no rows; the limit is the feature's own, per target.
    """
    t = targets.select("name", "file").distinct()
    hit = F.min(F.struct("ord", "pos", "line", "type")).alias("f")
    keyed = calls_.withColumnRenamed("file", "caller_file")
    exact = t.withColumn("callee_key", F.concat_ws(":", "file", "name")).join(keyed, "callee_key").groupBy("name", "file", "caller_file", "caller").agg(hit).withColumn("way", F.lit(0))
    # callers by name are the same for all targets of the name: ranked once, twice the limit is enough beside the exact ones
    asked = t.select(F.col("name").alias("segment")).distinct()
    named = name_index(calls_).join(asked, "segment").join(keyed, "callee_key").groupBy("segment", "caller_file", "caller").agg(hit)
    w = Window.partitionBy("segment").orderBy("f.ord", "f.pos")
    named = named.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= 2 * limit).drop("r")
    named = t.join(named, F.col("name") == F.col("segment")).drop("segment").withColumn("way", F.lit(1))
    first = exact.unionByName(named).groupBy("name", "file", "caller_file", "caller").agg(F.min(F.struct("way", "f")).alias("m")).select("name", "file", "caller_file", "caller", "m.way", "m.f")
    w = Window.partitionBy("name", "file").orderBy("way", "f.ord", "f.pos")
    return first.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select("name", "file", F.col("rank").cast("bigint").alias("rank"), "caller_file", "caller", "f.line", "f.type")


def class_callers(calls_: DataFrame, classes: DataFrame, limit: int = 50) -> DataFrame:
    """Callers of any constructor or method of every class name (JN-04)."""
    t = classes.select(F.col("name").alias("segment")).distinct()
    hits = t.join(name_index(calls_), "segment").join(calls_, "callee_key")
    first = hits.groupBy("segment", "file", "caller").agg(F.min(F.struct("ord", "pos", "line")).alias("f"))
    w = Window.partitionBy("segment").orderBy("f.ord", "f.pos")
    return first.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select(F.col("segment").alias("class"), F.col("rank").cast("bigint").alias("rank"), "file", "caller", "f.line")


def updated_calls(calls_: DataFrame, rebuilt: DataFrame, changed: DataFrame, deleted: DataFrame) -> DataFrame:
    """The calls after changed and deleted caller files are replaced and keys of deleted files dropped (GRF-05)."""
    gone = changed.select(F.col("path").alias("file")).unionByName(deleted.select(F.col("path").alias("file"))).distinct()
    kept = calls_.join(gone, "file", "left_anti")
    target = F.when(F.contains("callee_key", F.lit(":")), F.regexp_replace("callee_key", ":[^:]*$", ""))
    kept = kept.withColumn("target", target).join(deleted.select(F.col("path").alias("target")).distinct(), "target", "left_anti").drop("target")
    return kept.unionByName(rebuilt.select(*kept.columns))


def resolved(hits: DataFrame, asked: str) -> DataFrame:
    """Best hit per query: the exact name or its last dotted part, else the first hit (JN-15). hits: query, name, rank."""
    exact = (F.col("name") == F.col(asked)) | F.endswith("name", F.concat(F.lit("."), F.col(asked)))
    w = Window.partitionBy(asked).orderBy(F.when(exact, 0).otherwise(1), "rank")
    return hits.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def resolved_by_service(hits: DataFrame, asked: str, limit: int = 10) -> DataFrame:
    """Best of the first hits per query: one whose name is the asked one or whose path or signature holds it, else the first (JN-16)."""
    fits = (F.col("name") == F.col(asked)) | F.contains("path", F.col(asked)) | F.contains("signature", F.col(asked))
    first = hits.filter(F.col("rank") <= limit)
    w = Window.partitionBy(asked).orderBy(F.when(F.coalesce(fits, F.lit(False)), 0).otherwise(1), "rank")
    return first.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def resolved_callees(c: DataFrame) -> DataFrame:
    """Calls with the file of the callee where it is known or can be told (SRC-10): ord, pos, src, callee, dst and way.

    A callee with a file keeps it, built paths of other files made source paths. Else it is looked up by its last dotted part among the
    components of the repository: its own file goes first, then a file that an import of the caller names, then the only
    file that has the name. Others have no dst.
    """
    k = c.select("ord", "repo", "file", "path", "imports", F.posexplode("callees").alias("pos", "e")).filter("e.name IS NOT NULL")
    k = k.withColumn("name", F.substring_index(F.regexp_replace("e.name", "^new ", ""), ".", -1))
    known = k.filter("e.file IS NOT NULL").select("ord", "pos", F.col("path").alias("src"), F.col("e.name").alias("callee"), F.concat_ws("/", "repo", F.when(F.col("e.file") == F.col("file"), F.col("file")).otherwise(T.source_path(F.col("e.file")))).alias("dst"), F.lit("stated").alias("way"))
    defs = c.filter("name IS NOT NULL AND type <> 'documentation'").select("repo", F.substring_index("name", ".", -1).alias("name"), F.col("path").alias("dst"), F.col("file").alias("there")).distinct()
    module = F.regexp_replace(F.regexp_replace("there", r"\.[^./]*$", ""), r"/(?:index|__init__|mod)$", "")
    tail = lambda i: F.regexp_replace(F.regexp_replace(i, r"^(?:\.{1,2}/)+|^@[^/]*/|\.(?:js|ts|mjs|cjs)$", ""), "[.:]+", "/")
    named = F.exists("imports", lambda i: F.endswith(F.concat(F.lit("/"), module), F.concat(F.lit("/"), tail(i))))
    way = F.when(F.col("there") == F.col("file"), 0).when(F.coalesce(named, F.lit(False)), 1).otherwise(2)
    option = k.filter("e.file IS NULL").join(defs, ["repo", "name"]).select("ord", "pos", "dst", way.alias("w"))
    best = option.groupBy("ord", "pos").agg(F.min(F.struct("w", "dst")).alias("m"), F.count("*").alias("n")).filter("m.w < 2 OR n = 1")
    rest = k.filter("e.file IS NULL").join(best, ["ord", "pos"], "left")
    label = F.when(F.col("m.w") == 0, "own file").when(F.col("m.w") == 1, "import").when(F.col("m.w") == 2, "only file")
    return known.unionByName(rest.select("ord", "pos", F.col("path").alias("src"), F.col("e.name").alias("callee"), F.col("m.dst").alias("dst"), label.alias("way")))
