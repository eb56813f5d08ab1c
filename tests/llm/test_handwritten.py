"""p1: features, notices, and verdicts over hand-written, made and foreign files."""

from codeweft.llm import handwritten as hw


def test_notices_are_hidden():
    code = "export function f(a) {\n  return a + 1; // sum\n}\n"
    for notice in ("// Code generated by tool. DO NOT EDIT.\n", "/*\n * Fichier produit par x, ne pas modifier.\n */\n", "// @generated SignedSource<<ab>>\n"):
        assert hw.parts(notice + code, "javascript")[1] and hw.parts(notice + code, "javascript")[4] == hw.parts(code, "javascript")[4]
    for fine in ("const A = 'Code generated by x. DO NOT EDIT.';\n", "// The lines below were generated once by a script and are now maintained by hand.\n", "const B = '@generated';\n", "// Do not edit the order of these values by hand without asking.\n"):
        assert not hw.parts(fine + code, "javascript")[1]
    assert hw.parts("# Copied from x 1.2.3, do not change here; send fixes upstream.\nx = 1\n", "python")[2]
    assert hw.parts(None, None)[0] and hw.parts("", "go")[0]


def test_data_share():
    share = lambda c: hw.parts(c, "python")[4][hw.FEATURES.index("data_share")]
    assert share("X = [\n" + "    0x8b, 0xd4, 0x24,\n" * 50 + "]\n") > hw.DATA and share("X = [1, 2, 3, 4, 5, 6, 7]\n") > hw.DATA
    assert share("X = [1, 2, 3]\n\ndef compute(values):\n    return sum(v * X[0] for v in values if v) % len(X)\n" * 2) < 0.5
    assert len(hw.parts(None, "go")[4]) == len(hw.FEATURES)


def test_likeness_of_small_files(spark):
    rows = [(1, "a.py", "python", "import os\nx = f(1)\n"), (2, "b.py", "python", "import os\n"), (3, None, "python", None)]
    files = spark.createDataFrame(rows, "file_id bigint, file string, language string, content string")
    known = spark.createDataFrame([(7, "a.py", "python", "import os\nx = f(1)\n")], "upstream_id bigint, file string, language string, content string")
    e = {r.file_id: r for r in hw.evidence(files, known).collect()}
    assert 0 < e[1].likeness < 1 and e[2].likeness <= 0.2 and e[3].label is None and e[3].likeness == 0
    assert {r.file_id for r in hw.found(files, known).collect()} == set()


def test_verdicts(spark, small):
    d = small.replace("sf0.001", "sf0.01")
    files, upstream = spark.read.parquet(f"{d}/source_files.parquet"), spark.read.parquet(f"{d}/upstream_files.parquet")
    own = files.filter("file LIKE '%.py'").limit(1).collect()[0]
    mine = "import os\n\ndef size_of(path):\n    # follow links\n    return os.stat(path).st_size if os.path.exists(path) else None\n"
    known = upstream.filter("language = 'go'").limit(1).collect()[0]
    mini = "!function(p){var q=p.a_(1);for(var i=0;i<q.length;i++)q[i]^=3;p.z=[7,q,!0]}(r_);" * 40
    extra = [(10**6 + n, own.repo, f, lang, c, 1, None) for n, (f, lang, c) in enumerate([
        ("src/vendor/x/a.py", "python", mine), ("src/copy.go", None, known.content.replace("return", "return ", 1)), ("src/m.js", "javascript", mini), ("a.py", "python", "T = [" + "1, 2, " * 400 + "]\n"),
        ("vendors/b.py", "python", ""), ("c.md", "markdown", "Code generated by x. DO NOT EDIT."), (None, None, "x"), ("vendor/e.ts", "typescript", "")])]
    f = files.unionByName(spark.createDataFrame(extra, files.schema))
    got = {r.file_id: r.verdict for r in hw.judged(f, upstream).collect()}
    assert [got.get(10**6 + n) for n in range(8)] == ["forest", "forest", "forest", "forest", None, None, None, None]
    assert set(got.values()) == {"forest", "notice", None}
    assert {r.file_id for r in hw.found(f, upstream).collect()} == {i for i, v in got.items() if v}
    assert hw.found(f.limit(0), upstream).collect() == []


def test_held_out(spark, small):
    """Notices of tools and banners are found without being seen; hand-written files are not."""
    d = small.replace("sf0.001", "sf0.1")
    got = {(r.label, r.notice): (r.rows, r.found) for r in hw.held_out(spark.read.parquet(f"{d}/source_files.parquet"), spark.read.parquet(f"{d}/upstream_files.parquet")).collect()}
    rows, hit = (got[1.0, "tool"][k] + got.get((1.0, "banner"), (0, 0))[k] for k in (0, 1))
    assert hit >= 0.75 * rows and rows > 20
    assert got[0.0, "none"][1] <= 0.1 * got[0.0, "none"][0] and got[-1.0, "none"][1] >= 0.8 * got[-1.0, "none"][0]
