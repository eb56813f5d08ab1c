"""p3: recall against brute force, equal vectors, edge cases."""

import numpy as np

from codeweft.llm import neighbours as nb


def brute(rows, k=10):
    ok = {i: np.array(v, float) for i, v in rows if v is not None and len(v) == len(rows[0][1]) and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = np.array(sorted(ok))
    x = np.stack([ok[i] / np.linalg.norm(ok[i]) for i in ids])
    s = x @ x.T
    np.fill_diagonal(s, -2)
    return {i: (set(ids[np.lexsort((ids, -s[n].round(9)))[:k]]), np.sort(s[n])[::-1][:k]) for n, i in enumerate(ids)}


def test_recall(spark, small):
    v = spark.read.parquet(f"{small}/component_vectors.parquet".replace("sf0.001", "sf0.01"))
    true = brute([(r.vec_id, r.vector) for r in v.filter("vector IS NOT NULL").collect()])
    got = {}
    for r in nb.neighbours(v).collect():
        got.setdefault(r.vec_id, set()).add(r.other)
    assert set(got) == set(true) and all(len(x) == 10 for x in got.values())
    assert sum(len(got[i] & true[i][0]) for i in true) / (10 * len(true)) > 0.95


def test_hot_and_equal(spark, monkeypatch):
    monkeypatch.setattr(nb, "BLOCK", 40)
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.normal(size=8) * 0.01 + (np.eye(8)[0] if i % 3 else r.normal(size=8))]) for i in range(500)]
    rows += [(1000 + i, rows[0][1]) for i in range(60)] + [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] * 8), (2003, [1.0] * 5), (2005, [1.0, 1.0, 1.0, 1.0, 0.5]), (2004, [])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, vector array<float>, id int")
    true = brute(rows)
    got = {}
    for x in nb.neighbours(df).collect():
        got.setdefault(x.vec_id, {})[x.other] = x.cosine
    assert set(got.pop(2003)) == {2005} and set(got.pop(2005)) == {2003}
    assert set(got) == set(true) and all(len(x) == 10 and i not in x for i, x in got.items())
    assert set(got[1059]) == {0, *range(1000, 1009)} and set(got[1000]) == {0, *range(1001, 1010)}
    assert np.mean([np.isclose(sorted(got[i].values(), reverse=True), true[i][1], atol=1e-5).mean() for i in true]) > 0.93
    pairs = nb.found(df).collect()
    assert all(p.vec_id_a < p.vec_id_b for p in pairs) and len(set(pairs)) == len(pairs)
    assert nb.found(df.limit(0)).collect() == []
    few = {x.vec_id: x.other for x in nb.neighbours(df.filter("vec_id < 2")).collect()}
    assert few == {0: 1, 1: 0}


def test_exact(spark, monkeypatch):
    monkeypatch.setattr(nb, "BLOCK", 60)
    r = np.random.default_rng(4)
    rows = [(i, [float(x) for x in r.normal(size=6)]) for i in range(250)]
    true = brute(rows)
    got = {}
    for x in nb.neighbours(spark.createDataFrame(rows, "vec_id bigint, vector array<float>"), exact=True).collect():
        got.setdefault(x.vec_id, set()).add(x.other)
    assert got == {i: s for i, (s, _) in true.items()}
