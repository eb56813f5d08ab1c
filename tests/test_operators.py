"""Index, statistics, maps, search and packing on small tables."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from codeweft import session
from codeweft.operators import graph, index, lookup, patterns, refs, search, stats, tree

COLUMNS = "ord bigint, id string, repo string, file string, type string, language string, name string, start_line int, end_line int, signature string, exported boolean, docstring string, snippet string, text string, imports array<string>, callees array<struct<name:string,file:string,line:int>>, indexed_at timestamp"


def rows(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    make = lambda o, f, name, **k: (o, f"{f}:{name}:1", k.get("repo", "o/r"), f, k.get("type", "function"), k.get("language", "Go"), name, 1, k.get("end", 10), f"func {name}()", k.get("exported", True), None, "s", k.get("text", "t"), None, None, k.get("at", t(1)))
    return spark.createDataFrame([make(1, "a/b/x.go", "A"), make(2, "a/b/x.go", "A", text="newer", at=t(2)), make(3, "a/b/x.go", "B", language=None), make(4, "a/c/d/y.py", "C", language="PYTHON", end=None), make(5, "z.rs", "D", language="", exported=False), make(6, "a/b/x.go", "A", repo="p/q")], COLUMNS)


def test_current_and_stats(spark):
    c = index.current(rows(spark))
    assert {(r.ord, r.language) for r in c.collect()} == {(2, "go"), (3, "go"), (4, "python"), (5, "rust"), (6, "go")}
    got = {r.language: (r.files, r.components, r.lines) for r in stats.by_language(c).collect()}
    assert got == {"go": (2, 3, 30), "python": (1, 1, 0), "rust": (1, 1, 10)}
    packages = spark.createDataFrame([("o/r",), ("o/r/a",), ("o/r/a/b",)], "package string")
    assert {(r.package, r.components) for r in stats.by_package(c, packages).collect()} == {("o/r/a/b", 2), ("o/r/a", 1), ("o/r", 1)}
    totals = {(r.language, r.type): r.components for r in stats.with_totals(c).collect()}
    assert totals["(all)", "(all)"] == 5 and totals["go", "(all)"] == 3
    assert {r.json for r in stats.to_json_rows(stats.by_type(c), "type").collect()} == {'{"components":5,"type":"function"}'}
    assert stats.by_language(c.limit(0)).collect() == []


def test_merge(spark):
    old = spark.createDataFrame([("a", "1"), ("b", None), ("c", "3"), (None, "x")], "id string, v string")
    new = spark.createDataFrame([("a", "1"), ("b", ""), ("d", "4")], "id string, v string")
    assert {(r.id, r.action) for r in index.merge_plan(old, new, "id", ["v"]).collect()} == {("a", "keep"), ("b", "update"), ("c", "delete"), ("d", "insert")}
    assert {r.id for r in index.upsert_and_delete(old, new.filter("id = 'd'"), old.filter("id = 'a'").select("id"), "id").collect()} == {"b", "c", "d", None}


def test_tree(spark):
    t = tree.rolled_up(index.current(rows(spark)))
    got = {r.path: (r.depth, r.components) for r in t.collect()}
    assert got["o/r"] == (2, 4) and got["o/r/a"] == (3, 3) and got["o/r/a/c/d"] == (5, 1) and got["p"] == (1, 1)
    assert {r.path for r in tree.smart_pruned(t, 9, 3).collect()} == {"o", "o/r", "o/r/a", "o/r/a/b", "o/r/a/c", "p", "p/q", "p/q/a"}
    assert {r.path for r in tree.pruned(t, 1).collect()} == {"o", "p"} and {r.text for r in tree.rendered(tree.pruned(t, 1)).collect()} == {"o/  4 components", "p/  1 components"}
    lines = [r.text for r in tree.rendered(tree.pruned(t, 4)).orderBy("sort").collect()]
    assert lines == ["o/  4 components", "└─ r/  4", "   └─ a/  3", "      ├─ b/  2", "      └─ c/  1", "p/  1 components", "└─ q/  1", "   └─ a/  1", "      └─ b/  1"], lines
    chosen = {r.depth: r.chosen for r in tree.depth_for_budget(t, 10**6).collect()}
    assert chosen[max(chosen)] and sum(chosen.values()) == 1 and {r.depth for r in tree.depth_for_budget(t, 1).filter("chosen").collect()} == {1}
    assert {(r.folder, r.name) for r in tree.exports_per_folder(index.current(rows(spark)), 1).collect()} == {("o/r/a/b", "A"), ("o/r/a/c/d", "C"), ("p/q/a/b", "A")}


def test_frequency(spark):
    d = lambda x: dt.datetime(2024, 3, x)
    f = [("a/b.ts", None, "modified", 1, 2)]
    commits = spark.createDataFrame([("r", "h1", ("n", "A@x", "d"), d(1), f, None), ("r", "h1", ("n", "A@x", "d"), d(1), f, None), ("r", "h2", ("n", "a@X", "d"), d(20), f, None), ("r", "h3", ("n", "b", "d"), None, None, None)],
                                    "repo string, hash string, author struct<name:string,email:string,date:string>, committed_at timestamp, files array<struct<path:string,previous_path:string,status:string,additions:int,deletions:int>>, ingested_at timestamp")
    changes = stats.file_changes(commits)
    r = stats.change_frequency(changes).collect()
    assert [(x.path, x.commits, x.last_change, x.authors) for x in r] == [("r/a/b.ts", 2, d(20), 1)]
    g = stats.directory_frequency(changes, F.lit(d(31))).collect()
    assert {(x.path, x.last_30, x.last_90) for x in g} == {("r", 2, 2), ("r/a", 2, 2)}
    assert {(x.hash, x.additions, x.files) for x in stats.commit_stats(commits).collect()} == {("h1", 1, 1), ("h2", 1, 1), ("h3", 0, 0)}


def test_metrics(spark):
    q = spark.createDataFrame([(float(i), i % 4 == 0) for i in range(1, 21)], "duration double, failed boolean")
    r = stats.request_metrics(q).first()
    assert (r.total, r.failed, r.mean, r.p50, r.p95, r.p99) == (20, 5, 11, 10, 19, 20)
    z = stats.request_metrics(q.limit(0)).first()
    assert (z.total, z.mean, z.p99) == (0, 0, 0)
    a, b = (spark.createDataFrame(x, "k string, n bigint") for x in ([("x", 5), ("y", 1)], [("x", 20), ("z", 0)]))
    assert {(r.k, r.change, r.absolute, r.percent, r.trend) for r in stats.compare(a, b, "k", "n").collect()} == {("x", "common", 15, 300.0, "growing"), ("y", "removed", -1, -100.0, "stable"), ("z", "added", 0, 0.0, "stable")}


def test_search(spark):
    d = spark.createDataFrame([(1, "red fox red"), (2, "red dog"), (3, None), (4, ""), (5, "The FOX-trot")], "id bigint, text string")
    got = [r.id for r in search.top(search.bm25(d, "id", "text", "fox red"), "id", 3).orderBy("rank").collect()]
    assert got[0] == 1 and set(got) == {1, 2, 5}
    assert search.bm25(d, "id", "text", "absent").collect() == [] and search.bm25(d.limit(0), "id", "text", "red").collect() == []
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 1.0])], "id bigint, v array<float>")
    q = spark.createDataFrame([([2.0, 0.0],)], "q array<float>")
    near = {r.id: r.score for r in search.nearest(v, "id", "v", q).collect()}
    assert near == {1: pytest.approx(1), 4: pytest.approx(0.5**0.5)}
    f = search.fused([search.bm25(d, "id", "text", "fox red"), search.nearest(v, "id", "v", q)], "id").orderBy(F.desc("score")).collect()
    assert f[0].id == 1 and f[0].score == pytest.approx(2 / 61)


def test_packing(spark):
    page = [("g", i, f"h{i}", "word " * 200, "sig") for i in range(1, 30)]
    got = search.packed(spark.createDataFrame(page, "g string, rank int, header string, full string, signature string"), 600).orderBy("rank").collect()
    assert got[0].level == "full" and sum(r.tokens for r in got) <= 600 and [r["rank"] for r in got] == list(range(1, len(got) + 1))
    one = search.packed(spark.createDataFrame([("g", 1, "h", "word " * 900, "s")], "g string, rank int, header string, full string, signature string"), 400).collect()
    assert len(one) == 1 and one[0].tokens > 400


def test_patterns(spark):
    f = spark.createDataFrame([("r", "a.py", "import os\ntry:\n    x = [i for i in y]\nexcept E:\n    raise\n", 1), ("r", "b.ts", "import x\nawait import('y')\n", 2), ("r", "c.py", "x = (", 3), ("r", "d.go", " ", 4), ("r", "b.test.ts", "", 5), ("r", "b.ts", "old", 1)], "repo string, file string, content string, file_id bigint")
    m = {r.file: r.matches for r in patterns.rule_counts(patterns.latest(f)).collect()}
    assert m["a.py"]["try-except"] == 1 and m["a.py"]["raise"] == 1 and m["a.py"]["import-module"] == 1 and m["b.ts"]["dynamic-import"] == 1 and m["c.py"] == {} and m["d.go"] == {}
    assert {(r.ext, r.files, r.tested) for r in patterns.tested(f.select("repo", "file").distinct()).collect()} == {("py", 2, 0), ("ts", 1, 1), ("go", 1, 0)}


def test_small_reports(spark):
    f = spark.createDataFrame([("a/b/x", 10), ("a/y", None)], "path string, size_bytes bigint")
    assert {(r.path, r.bytes, r.files) for r in stats.folder_sizes(f).collect()} == {("a", 10, 2), ("a/b", 10, 1)}
    d = spark.createDataFrame([(1, "Retry it", "s"), (2, "retry", "t"), (3, None, "u")], "doc_id bigint, text string, source string")
    assert [(r.term, r.hits, r.source) for r in stats.term_insights(d, ["retry", "none"], 1).collect()] == [("retry", 2, "s")]
    e = spark.createDataFrame([("error", "LexError: x"), ("error", "LexError: y"), ("function", None)], "type string, error string")
    assert [(r.phase, r.errors) for r in stats.errors_by_phase(e).collect()] == [("LexError", 2)]


def test_fusion_of_whole_legs(spark):
    a = {f"k{i:03}": ((i * 37) % 101) / 100 for i in range(300)}
    b = {f"k{i:03}": ((i * 53) % 97) / 100 for i in range(150, 450)}
    legs = [spark.createDataFrame(sorted(x.items()), "id string, score double").repartition(5) for x in (a, b)]
    ranks = [{k: r for r, k in enumerate(sorted(x, key=lambda k: (-x[k], k)), 1)} for x in (a, b)]
    assert {r.id: r["rank"] for r in search.numbered(legs[0], "id").collect()} == ranks[0]
    got = {r.id: r.score for r in search.fused(legs, "id").collect()}
    assert got.keys() == a.keys() | b.keys()
    assert all(abs(s - sum(1 / (60 + r[k]) for r in ranks if k in r)) < 1e-12 for k, s in got.items())


def test_nearest_to_each_query(spark):
    r = random.Random(5)
    x = {i: [r.gauss(0, 1) for _ in range(6)] for i in range(230)}
    x[7] = x[9] = x[20] = x[40]
    rows = [*x.items(), (900, None), (901, [0.0] * 6)]
    v = spark.createDataFrame(rows, "id bigint, v array<float>")
    queries = v.filter("id % 20 = 0").select(F.col("id").alias("query"), F.col("v").alias("q"))
    got = search.nearest_each(v, "id", "v", queries, 5, block=4).collect()
    near = v.crossJoin(queries).select("query", "id", F.round(search.cosine(F.col("v"), F.col("q")), 6).alias("score")).filter("score IS NOT NULL").collect()
    for q in range(0, 230, 20):
        want = sorted(((-n.score, n.id) for n in near if n.query == q))[:5]
        mine = sorted((g["rank"], g.id, g.score) for g in got if g.query == q)
        assert [(i, n) for n, i, _ in mine] == [(i, n) for n, (_, i) in enumerate(want, 1)]
        assert all(abs(s + w) < 2e-6 for (_, _, s), (w, _) in zip(mine, want))
    assert {g.query for g in got} == set(range(0, 230, 20))


def test_lookups(spark, tmp_path):
    c = index.current(rows(spark)).select("id", "path", "name")
    asked = spark.createDataFrame([("none",), (c.first().id,), (c.first().id,)], "id string")
    got = {r.id: r.path for r in lookup.by_id(c.dropDuplicates(["id"]), asked).collect()}
    assert len(got) == 2 and got["none"] is None and all(got[k] for k in got if k != "none")
    assert lookup.of_file_types(c, []).count() == c.count() and lookup.of_file_types(c, [".nope"]).count() == 0
    hits = spark.createDataFrame([(1, "a/x.ts", "a/x.ts", 1), (1, "a/x.ts", "b/y.TS", 2), (1, "a/x.ts", "b/y.go", 3), (1, "a/x.ts", "c.ts", 4)], "query int, asked string, path string, rank int")
    assert [(r.rank, r.path) for r in lookup.same_kind(hits, 5).orderBy("rank").collect()] == [(1, "b/y.TS"), (2, "c.ts")]
    bad = spark.createDataFrame([(1, 0.5, '{"k": 1}'), (2, 0.1, "no json"), (3, 0.2, None)], "n int, score double, m string")
    assert {r.id: r.metadata.get("k") for r in lookup.hits_with_metadata(bad, "n", "m", "map<string,string>").collect()} == {1: "1", 2: None, 3: None}
    files = spark.createDataFrame([("r", x) for x in ("src/a.ts", "src/a.test.ts", "t/a.spec.ts", "b.py", "t/test_b.py", "c.go")], "repo string, file string")
    assert {(r.file, r.rank, r.test_file) for r in lookup.related_tests(files).collect()} == {("src/a.ts", 1, "src/a.test.ts"), ("src/a.ts", 2, "t/a.spec.ts"), ("b.py", 1, "t/test_b.py")}
    edges, calls = (spark.createDataFrame([("a", "b")], "src string, dst string") for _ in range(2))
    build = lambda: ("built", None)
    root = str(tmp_path / "graph")
    assert lookup.load_graph(spark, root, build) == ("built", None)
    lookup.save_graph(edges, calls, root)
    e, k = lookup.load_graph(spark, root, build)
    assert e.collect() == edges.collect() and k.count() == 1
    spark.createDataFrame([(9, 1)], "format int, edges int").coalesce(1).write.mode("overwrite").json(f"{root}/format")
    assert lookup.load_graph(spark, root, build) == ("built", None)


def test_callees(spark):
    e = "array<struct<name:string,file:string,line:int>>"
    rows_ = [
        (1, "r", "a.ts", "r/a.ts", "f", "function", ["./lib/b", "x"], [("g", None, 1), ("obj.h", None, 2), ("new K", "dist/k.js", 3), ("q", None, 4), ("t", None, 5)]),
        (2, "r", "a.ts", "r/a.ts", "g", "function", None, None), (3, "r", "z.ts", "r/z.ts", "g", "function", None, None), (4, "r", "lib/b/index.ts", "r/lib/b/index.ts", "h", "function", None, None),
        (5, "r", "y.ts", "r/y.ts", "h", "function", None, None), (6, "r", "y.ts", "r/y.ts", "q", "function", None, None), (7, "r", "m.ts", "r/m.ts", "t", "function", None, None), (8, "r", "n.ts", "r/n.ts", "t", "function", None, None),
    ]
    c = spark.createDataFrame(rows_, f"ord int, repo string, file string, path string, name string, type string, imports array<string>, callees {e}")
    got = {r.callee: (r.dst, r.way) for r in refs.resolved_callees(c).collect()}
    assert got == {"g": ("r/a.ts", "own file"), "obj.h": ("r/lib/b/index.ts", "import"), "new K": ("r/src/k.ts", "stated"), "q": ("r/y.ts", "only file"), "t": (None, None)}
    w = {(r.src, r.dst) for r in graph.weighted(refs.resolved_callees(c).filter("dst IS NOT NULL")).collect()}
    assert w == {("r/a.ts", "r/lib/b/index.ts"), ("r/a.ts", "r/src/k.ts"), ("r/a.ts", "r/y.ts")}


def test_hot_keys_are_split(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS", 5)
    monkeypatch.setattr(session, "HOT", 4)
    left = spark.createDataFrame([(1, n) for n in range(40)] + [(k, k) for k in range(2, 12)], "key int, v int")
    right = session.cut(left.groupBy("key").count().filter("key <> 3").withColumnRenamed("count", "rows"))
    got = session.unskewed(left, right, "key", "rows")
    assert sorted((r.key, r.v, r.rows) for r in got.collect()) == sorted((r.key, r.v, r.rows) for r in left.join(right, "key").collect())
    assert "BroadcastHashJoin" in got._jdf.queryExecution().toString()
    assert session.unskewed(left, right.limit(0), "key", "rows").collect() == []


def test_percentiles(spark):
    r = [(k, float(v), v % 3 == 0) for k in ("a", "b") for v in [5] * 50 + list(range(100 if k == "a" else 7))] + [("c", None, False)]
    df = spark.createDataFrame(r, "k string, duration double, failed boolean")
    for row in stats.request_metrics(df, "k").collect():
        v = sorted(x[1] for x in r if x[0] == row.k and x[1] is not None)
        want = [v[math.ceil(q * len(v)) - 1] if v else 0.0 for q in (0.5, 0.95, 0.99)]
        assert [row.p50, row.p95, row.p99] == want
    assert [tuple(x) for x in stats.request_metrics(df.limit(0)).collect()] == [(0, 0, 0, 0, 0.0, 0.0, 0.0)]
