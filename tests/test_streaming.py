"""Streams with bounded sources: debouncing, buckets, index maintenance."""

import datetime as dt

from pyspark.sql import functions as F

from codeweft.operators.stats import debounced
from codeweft.streaming import folds, incremental

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def run(query):
    assert query.awaitTermination(120)
    assert query.exception() is None


def test_debounce(spark, tmp_path):
    rows = [(1, "a", "update", at(0), 1), (1, "a", "delete", at(4), 2), (1, "a", "update", at(20), 3), (2, "a", "update", at(1), 4)]
    df = spark.createDataFrame(rows, "key bigint, path string, kind string, ts timestamp, seq bigint")
    want = {(1, at(0), "delete", 2), (1, at(20), "update", 1), (2, at(1), "update", 1)}
    assert {(r.key, r.started, r.kind, r.events) for r in debounced(df, "5 seconds").collect()} == want
    df.unionByName(spark.createDataFrame([(9, "z", "update", at(9999), 9)], df.schema)).coalesce(1).write.parquet(str(tmp_path / "in"))
    s = incremental.debounced_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "5 seconds", "10 seconds")
    run(s.writeStream.format("memory").queryName("batches").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())
    assert {(r.key, r.started, r.kind, r.events) for r in spark.table("batches").collect()} == want


def test_bucket(spark, tmp_path):
    rows = [(1, at(0), 1), (1, at(0), 2), (1, at(0), 3), (1, at(10), 4), (2, at(0), 5)]
    df = spark.createDataFrame(rows, "key bigint, ts timestamp, seq bigint")
    want = {1: True, 2: True, 3: False, 4: True, 5: True}
    assert {r.seq: r.allowed for r in folds.rate_limited(df, 2, 0.1).collect()} == want
    assert folds.rate_limited(df.limit(0), 2, 0.1).collect() == []
    for n, part in enumerate([df.filter("seq < 4"), df.filter("seq >= 4")]):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        s = folds.rate_limited_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 2, 0.1)
        run(s.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())
    assert {r.seq: r.allowed for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want


def test_index(spark, tmp_path):
    schema = "path string, kind string, content string, ts timestamp"
    first = [("a.py", "update", "def f(): pass\n", at(0)), ("b.py", "update", "def g(): pass\n", at(0)), ("a.py", "update", "def f2(): pass\n", at(1))]
    second = [("a.py", "delete", None, at(5)), ("b.py", "update", "\n\ndef g(): pass\ndef h(): pass\n", at(6)), ("c.py", "update", "x = (", at(7))]
    for n, rows in enumerate([first, second]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run(incremental.maintain(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "t"), str(tmp_path / "c")))
        got = {(r.path, r.name, r.start_line) for r in incremental.read_table(spark, str(tmp_path / "t"), incremental.INDEX).collect()}
        assert got == ({("a.py", "f2", 1), ("b.py", "g", 1)} if not n else {("b.py", "g", 3), ("b.py", "h", 4)})


def test_bucket_rule():
    assert folds.bucket(0.5, 0.0, 10.0, 2, 0.1) == (True, 0.5) and folds.bucket(0.0, 0.0, 1.0, 2, 0.1) == (False, 0.1)


def test_publish_loses_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    schema = "path string, v int"
    df = lambda rows: spark.createDataFrame(rows, schema)
    read = lambda: {(r.path, r.v) for r in incremental.read_table(spark, root, schema).collect()}
    rows = [(f"p{n}", n) for n in range(50)]
    assert incremental.publish(df(rows), root) == 0 and read() == set(rows)
    part = df([("p7", 0)]).select(incremental.part_of(F.col("path"))).first()[0]
    mine = incremental.read_table(spark, root, schema, [part]).filter("path <> 'p7'")
    monkeypatch.setattr(incremental.json, "dumps", lambda x: 1 / 0)
    try:
        incremental.publish(mine, root, [part])
    except ZeroDivisionError:
        pass
    assert read() == set(rows)  # a crash before the version is current
    monkeypatch.undo()
    assert incremental.publish(mine, root, [part]) == 1 and read() == {r for r in rows if r[0] != "p7"}
    files = {f for f in spark.read.schema(schema).parquet(f"{root}/v=1").inputFiles()}
    assert len(files) <= 1  # only the touched part was written
    assert incremental.compacted(spark, root, schema) == 2 and read() == {r for r in rows if r[0] != "p7"}
