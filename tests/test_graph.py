"""Hand graphs: ranks, components, paths, weights, incremental updates."""

import random

import pytest

from codeweft.operators import graph, refs

EDGE = "src string, dst string, weight double"


def ranks(spark, edges, **kw):
    e = spark.createDataFrame([(a, b, float(w)) for a, b, w in edges], EDGE)
    return {r.node: r["rank"] for r in graph.pagerank(e, graph.graph_nodes(e), **kw).collect()}


def test_pagerank(spark):
    r = ranks(spark, [("A", "B", 1), ("A", "C", 1), ("B", "C", 1), ("X", "Y", 10), ("X", "Z", 1), ("P", "Q", 1), ("Q", "P", 1)], rounds=20)
    assert r["C"] > r["A"] and r["C"] > r["B"] and r["Y"] > r["Z"] and abs(r["P"] - r["Q"]) < 0.01
    assert sum(r.values()) == pytest.approx(1, abs=1e-9)
    ring = ranks(spark, [(str(i), str((i + 1) % 20), 1) for i in range(20)], rounds=10)
    assert all(x == pytest.approx(1 / 20) for x in ring.values())
    assert ranks(spark, []) == {}


def test_components_and_paths(spark):
    e = spark.createDataFrame([("A", "B"), ("B", "C"), ("D", "E"), ("A", "A"), (None, "A"), ("A", "B")], "src string, dst string")
    nodes = spark.createDataFrame([("A",), ("Z",), (None,)], "node string")
    got = {r.node: r.component for r in graph.connected_components(e).collect()}
    assert got == {"A": "A", "B": "A", "C": "A", "D": "D", "E": "D"}
    assert {r.node: r.component for r in graph.connected_components(e, nodes).collect()} == {"A": "A", "Z": "Z"}
    chain = spark.createDataFrame([(i, i + 1) for i in range(150)], "src bigint, dst bigint")
    assert {r.component for r in graph.connected_components(chain).collect()} == {0}
    p = spark.createDataFrame([("A", "B"), ("B", "D"), ("A", "C"), ("C", "X"), ("X", "D")], "src string, dst string")
    hops = {r.node: (r.hops, r.parent) for r in graph.hops_from(p, spark.createDataFrame([("A",)], "node string")).collect()}
    assert hops["D"] == (2, "B") and hops["X"] == (2, "C") and hops["A"] == (0, None)
    assert graph.hops_from(p, spark.createDataFrame([("none",)], "node string")).count() == 1


def test_incremental(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "b", 1.0)], EDGE)
    new = graph.updated_edges(e, spark.createDataFrame([("a", "c", 2.0)], EDGE), spark.createDataFrame([("b",)], "path string"))
    assert {tuple(x) for x in new.collect()} == {("a", "c", 2.0), ("c", "b", 1.0)}


COMPONENT = "ord bigint, repo string, path string, name string, type string, callees array<struct<name:string,file:string,line:int>>"


def components(spark):
    return spark.createDataFrame([
        (1, "r", "r/a.ts", "f", "function", [("g", "x.ts", 3), ("h", None, 4), ("new Box", None, 5)]),
        (2, "r", "r/b.ts", "k", "function", [("g", "x.ts", 7), ("this.svc.h", None, 8), ("g", "x.ts", 9), ("Box.open", "y.ts", 1), ("g", "x.ts", 10)]),
        (3, "r", "r/x.ts", "g", "function", None),
    ], COMPONENT)


def test_callers(spark):
    c = components(spark)
    calls = refs.calls(c)
    keys = {(r.callee_key, r["count"]) for r in calls.groupBy("callee_key").count().collect()}
    assert ("r/x.ts:g", 4) in keys and ("h", 1) in keys
    ask = lambda rows, **kw: refs.callers(calls, spark.createDataFrame(rows, "name string, file string"), **kw).orderBy("rank").collect()
    assert [(r.caller, r.line) for r in ask([("g", "r/x.ts")])] == [("f", 3), ("k", 7)]
    assert len(ask([("g", "r/wrong.ts")])) == 2 and len(ask([("g", "r/x.ts")], limit=1)) == 1 and ask([("nothing", "r/x.ts")]) == []
    assert [r.caller for r in ask([("h", "r/q.ts")])] == ["f", "k"]
    assert {r.caller for r in refs.class_callers(calls, spark.createDataFrame([("Box",)], "name string")).collect()} == {"f", "k"}
    w = graph.dependency_edges(c).collect()
    assert {(r.src, r.dst, r.weight) for r in w} == {("r/a.ts", "r/x.ts", 1.0), ("r/b.ts", "r/x.ts", 3**0.5), ("r/b.ts", "r/y.ts", 1.0)}
    paths = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    left = refs.updated_calls(calls, calls.limit(0), paths("r/b.ts"), paths("r/x.ts"))
    assert {r.callee for r in left.collect()} == {"h", "new Box"}


def test_resolution(spark):
    hits = spark.createDataFrame([("run", "runner", 1), ("run", "Task.run", 2), ("go", "gone", 1)], "asked string, name string, rank int")
    assert {(r.asked, r.name) for r in refs.resolved(hits, "asked").collect()} == {("run", "Task.run"), ("go", "gone")}


def test_shuffled_chain_is_one_component(spark):
    ids = list(range(1000))
    random.Random(7).shuffle(ids)
    chain = spark.createDataFrame(list(zip(ids, ids[1:])) + [(2000, 2001)], "src bigint, dst bigint")
    assert {r.component: r["count"] for r in graph.connected_components(chain).groupBy("component").count().collect()} == {0: 1000, 2000: 2}


def test_hops_of_a_long_chain(spark):
    chain = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(54)], "src string, dst string")
    start = spark.createDataFrame([("000",)], "node string")
    assert {r.node: r.hops for r in graph.hops_from(chain, start).collect()} == {f"{i:03}": i for i in range(55)}
    assert graph.hops_from(chain, start, limit=3).count() == 4


def test_registered_pagerank_converges(spark, small):
    entry = pytest.importorskip("__spark_entry__")
    got = {r.node: r["rank"] for r in entry.queries()["pagerank_converged"](spark, small).collect()}
    edges = entry.queries()["dependency_edges"](spark, small).collect()
    total = {}
    for e in edges:
        total[e.src] = total.get(e.src, 0) + e.weight
    n, want = len(got), dict.fromkeys(got, 1 / len(got))
    for _ in range(300):
        lost = sum(x for k, x in want.items() if k not in total)
        new = {k: 0.15 / n + 0.85 * lost / n for k in want}
        for e in edges:
            new[e.dst] += 0.85 * want[e.src] * e.weight / total[e.src]
        want = new
    assert sum(abs(got[k] - want[k]) for k in want) < 1e-5 + n * 1e-7
