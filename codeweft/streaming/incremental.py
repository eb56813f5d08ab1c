"""Incremental index maintenance: streams of file changes applied to a versioned table."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from codeweft.operators.stats import debounced
from codeweft.sources.scanner import scan


#: Parts of an index table by hash of the path; a batch rewrites the parts that it touches.
PARTS = 64


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def current_version(spark: SparkSession, root: str) -> int:
    """Last published version of the table below a folder, -1 where there is none."""
    fs, p = _files(spark, os.path.join(root, "versions"))
    return max((int(f.getPath().getName()) for f in fs.listStatus(p) if f.getPath().getName().isdigit()), default=-1) if fs.exists(p) else -1


def manifest(spark: SparkSession, root: str) -> dict[int, int]:
    """Version in which each part of the table was last written."""
    v = current_version(spark, root)
    if v < 0:
        return {}
    return {int(k): n for k, n in json.loads(spark.read.text(os.path.join(root, "versions", str(v)), wholetext=True).first()[0]).items()}


def read_table(spark: SparkSession, root: str, schema: str, parts: list[int] | None = None) -> DataFrame:
    """The published table, or some parts of it."""
    paths = [os.path.join(root, f"v={v}", f"part={p}") for p, v in manifest(spark, root).items() if parts is None or p in parts]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def part_of(path: Column) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(PARTS)).cast("int")


def publish(df: DataFrame, root: str, touched: list[int] | None = None) -> int:
    """Write the touched parts (all, unless told) as the next version, then make it the current one.

    The version's manifest is written beside and renamed, which a file system does at once; what is read is never
    overwritten and the old version stays current until then, so a crash at any point loses nothing. Parts without
    rows leave the manifest.
    """
    spark = df.sparkSession
    v = current_version(spark, root) + 1
    folder = os.path.join(root, f"v={v}")
    df.withColumn("part", part_of(F.col("path"))).repartition("part").write.mode("overwrite").partitionBy("part").parquet(folder)
    fs, p = _files(spark, folder)
    written = {int(f.getPath().getName()[5:]) for f in fs.listStatus(p) if f.getPath().getName().startswith("part=")}
    old = {} if touched is None else {k: n for k, n in manifest(spark, root).items() if k not in touched}
    fs, draft = _files(spark, os.path.join(root, "versions", f".draft-{uuid.uuid4().hex}"))
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(old | {k: v for k in written}).encode()))
    out.close()
    if not fs.rename(draft, _files(spark, os.path.join(root, "versions", str(v)))[1]):
        raise RuntimeError(f"version {v} of {root} was published by another writer")
    return v


def compacted(spark: SparkSession, root: str, schema: str) -> int:
    """All parts written anew as one version, each in few files (SNK-05)."""
    return publish(read_table(spark, root, schema), root)


INDEX = "path string, type string, name string, start_line int, end_line int, signature string, docstring string"


def apply_changes(index: DataFrame, changes: DataFrame) -> DataFrame:
    """The index after a batch of changes (path, kind, content, ts): last state per path, stale rows go (STM-02, STM-05).

    Of changes at the same time the update goes before the delete, then the greater content counts.
    """
    w = Window.partitionBy("path").orderBy(F.desc("ts"), F.desc("kind"), F.desc("content"))
    last = changes.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn").withColumn("file_id", F.xxhash64("path"))
    kept = index.join(last.select("path"), "path", "left_anti")
    new = last.filter("kind <> 'delete'").select("file_id", F.col("path").alias("file"), F.lit(None).cast("string").alias("language"), "content")
    rows = scan(new).filter("type <> 'error'").join(last.select("file_id", "path"), "file_id")
    return kept.unionByName(rows.select(*kept.columns))


def maintain(changes: DataFrame, root: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep an index table up to date with a stream of changes (STM-03 to STM-06, SRC-34): batches are serial, retried,
    and resume from the checkpoint, which is the snapshot that a restart catches up from; a batch that is seen again
    gives the same table. The stored rows of a path are found by its part, of which only the touched are read and written."""

    def batch(df: DataFrame, _: int) -> None:
        touched = [r[0] for r in df.select(part_of(F.col("path"))).distinct().collect()]  # at most PARTS
        if touched:
            publish(apply_changes(read_table(df.sparkSession, root, INDEX, touched), df), root, touched)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def debounced_stream(events: DataFrame, gap: str, late: str) -> DataFrame:
    """STM-01 over a stream: batches close when the watermark passes the gap, so state stays bounded."""
    return debounced(events.withWatermark("ts", late), gap)
