"""Column functions on literal cases."""

from pyspark.sql import functions as F

from codeweft.functions import text as T


def values(spark, f, *inputs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r.v for r in df.select("i", f(F.col("x")).alias("v")).orderBy("i").collect()]


def test_tokens_and_truncation(spark):
    assert values(spark, T.estimate_tokens, "", " \n ", "abc", "a b c d", "x" * 45, "a\u00a0 b", None) == [0, 0, 2, 5, 10, 3, None]
    assert values(spark, lambda c: T.truncate_to_budget(c, 2), "ab", "word " * 10) == ["ab", "word ..."]
    assert values(spark, lambda c: T.truncate_text(c, 5), "abcde", "abcdef", None) == ["abcde", "ab...", None]
    assert values(spark, T.clean_text, "  a   b\n\n\n\nc\t") == ["a b\n\nc"]
    assert values(spark, T.slugify, "  Hello, World! ", "--") == ["hello-world", ""]


def test_remotes_and_refs(spark):
    assert values(spark, T.normalize_remote, "git@f.example:Own/Repo.git", "https://f.example/Own/Repo/", "ssh://git@f.example/o/r.git", None) == ["own/repo", "own/repo", "o/r", None]
    assert values(spark, lambda c: T.remote_part(c, 1), "git@f.example:Own/Repo.git", "nothing") == ["Own", None]
    assert values(spark, T.pr_refs, "Merge pull request #12, PR #12 and PR#3", None) == [[12, 3], []]
    assert values(spark, T.issue_refs, "fix #4 #4, PR #9 and #9, #5", "none") == [[4, 5], []]


def test_paths(spark):
    assert values(spark, T.dirname, "a/b/c.ts", "c.ts") == ["a/b", "."] and values(spark, T.extension, "a.b/C.TS", "x") == ["ts", ""]
    assert values(spark, lambda c: T.strip_focus(c, "src/"), "src/a", "srcs/a") == ["a", "srcs/a"]
    assert values(spark, T.common_prefix, ["a/b/c/x", "a/b/d/y"], ["a/x", "a/y"], ["q"], kind="array<string>") == ["a/b", "", ""]
    assert values(spark, T.is_test_file, "a.test.ts", "test_a.py", "a_test.go", "a/tests/b.rs", "a.ts", "latest.py") == [True, True, True, True, False, False]
    assert values(spark, T.test_candidates, "src/a.py", "a.ts", "c/src/m.rs") == [["src/test_a.py", "src/a_test.py"], ["a.test.ts", "a.spec.ts"], ["c/tests/m.rs", "c/src/m_test.rs"]]


def test_styles(spark):
    assert values(spark, T.import_style, "import a\nimport b", "x = require('a')", "import a\nrequire(b)", "", None)[:4] == ["esm", "cjs", "mixed", "unknown"]
    assert values(spark, T.error_style, "throw new TypeError()", "Result<A>", "throw new Error(); Result<B>", "x") == ["throw", "result", "mixed", "unknown"]
    assert values(spark, T.annotated, "f(a): string", "f(a)", "def f() -> int") == [True, False, True]
    assert values(spark, T.coverage_label, 1.0, 0.5, 0.3, 0.0, kind="double") == ["full", "partial", "minimal", "none"]
    assert values(spark, T.human_bytes, 10, 2048, 3 << 20, kind="bigint") == ["10 B", "2.0 KB", "3.0 MB"]
    assert values(spark, lambda c: T.truncated_snippet(c, 2), "a\nb", "a\nb\nc\nd") == ["a\nb", "a\nb\n// ... 2 more lines"]
    assert values(spark, lambda c: T.lines_between(c, F.lit(2), F.lit(3)), "a\nb\nc\nd", "a") == ["b\nc", ""]


def test_diff(spark):
    df = spark.createDataFrame([(0, 0), (0, 5), (10, 5)], "a bigint, b bigint")
    absolute, percent = T.numeric_diff(F.col("a"), F.col("b"))
    assert [tuple(r) for r in df.select(absolute, percent).collect()] == [(0, 0.0), (5, 100.0), (-5, -50.0)]


def test_sources_of_paths(spark):
    assert values(spark, T.source_path, "a/dist/x.d.ts", "dist/y.js", "src/z.ts") == ["a/src/x.ts", "src/y.ts", "src/z.ts"]
    assert values(spark, T.go_exported, "Run", "run", "_x", "") == [True, False, False, False]
    assert values(spark, T.go_type_parameters, "func F[T any, K comparable](x T)", "func F()") == [["T any", "K comparable"], []]
    df = spark.createDataFrame([("a.go", "// Code generated by x\npackage a"), ("a.go", "package a // DO NOT EDIT\n"), ("b_pb2.py", ""), ("m/migrations/1.py", "x"), ("c.py", "# hand\n"), ("d.ts", "@generated")], "p string, c string")
    assert [r[0] for r in df.select(T.is_generated(F.col("p"), F.col("c"))).collect()] == [True, True, True, True, False, False]
