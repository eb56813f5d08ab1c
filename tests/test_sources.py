"""Scanner, Markdown sections, git logs, blame, repository files."""

from pyspark.sql import functions as F

from codeweft.functions import text as T
from codeweft.sources import gitlog, markdown, scanner

TS = """import { a } from './a';
export * from "b";

/** Adds numbers. */
export async function add(x: number, y = 2): Promise<number> { return a(x) + this.svc.run(y) + new Box(1); }
export const twice = (x: number): number => { return add(x); };
export const LIMIT = 5;
interface Shape { area(): number; }
type Id = string;
export class Box {
  private hidden() { return 1; }
  /** Opens it. */
  @log()
  static async open(x) { if (x) { close(x); } }
}
"""
GO = """package p

import "fmt"

// Area of a shape.
func (s *Set[T]) Area(x int) (int, error) { return fmt.Sprint(x), nil }

func helper() {}

type Shape interface { Area() int }
type Point struct { X int }
"""
RUST = """use std::fmt;
/// Adds.
#[inline]
pub fn add(a: u8) -> u8 { go(a) }
pub struct P { x: u8 }
trait T { fn f(&self); }
impl<'a> P { pub async fn run(&self) { self.go(1); } fn quiet() {} }
"""


def names(text, language):
    return {(r[0], r[1], r[5]) for r in scanner.components_of(text, language)}


def test_scanners():
    assert names(TS, "typescript") == {("function", "add", True), ("function", "twice", True), ("variable", "LIMIT", True), ("interface", "Shape", False), ("type", "Id", False), ("class", "Box", True), ("method", "Box.hidden", False), ("method", "Box.open", True)}
    add = next(r for r in scanner.components_of(TS, "typescript") if r[1] == "add")
    assert add[2] == 5 and add[6] == "Adds numbers." and {n for n, _ in add[8]} == {"a", "this.svc.run", "new Box"} and add[9] == ["./a", "b"]
    assert next(r for r in scanner.components_of(TS, "typescript") if r[1] == "Box.open")[6] == "Opens it."
    assert names(GO, "go") == {("method", "Set.Area", True), ("function", "helper", False), ("interface", "Shape", True), ("class", "Point", True)}
    assert next(r for r in scanner.components_of(GO, "go") if r[1] == "Set.Area")[6] == "Area of a shape."
    assert names(RUST, "rust") == {("function", "add", True), ("class", "P", True), ("interface", "T", False), ("method", "P.run", True), ("method", "P.quiet", False)}
    py = 'import os\n__all__ = ["f"]\ndef f(a,\n      b):\n    """Doc."""\n    return os.path.join(a, g(b))\nclass C(D):\n    def _m(self): pass\n    async def n(self): pass\ndef g(): pass\n'
    assert names(py, "python") == {("function", "f", True), ("class", "C", False), ("method", "_m", False), ("method", "n", True), ("function", "g", False)}
    assert scanner.python_components(py)[0][6] == "Doc." and ("os.path.join", 6) in scanner.python_components(py)[0][8]


def test_scan(spark, tmp_path):
    rows = [(1, "a.ts", None, TS), (2, "b.py", "python", "x = ("), (3, "vendor/c.go", "go", GO), (4, "d.rs", None, None), (5, "e.go", None, " \n"), (6, "f.txt", None, "x"), (7, "g.js", "", "function f() {} '")]
    df = spark.createDataFrame(rows, "file_id bigint, file string, language string, content string")
    got = scanner.scan(df).collect()
    assert {r.file_id for r in got} == {1, 2, 7} and {r.file_id for r in got if r.type == "error"} == {2, 7}
    assert scanner.scan(df.limit(0)).collect() == []
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src" / "x.py").write_text("def f(): pass\n")
    (tmp_path / "node_modules" / "y.py").write_text("def g(): pass\n")
    assert [(r.file, r.content) for r in scanner.read_repository(spark, str(tmp_path)).collect()] == [("src/x.py", "def f(): pass\n")]


def test_markdown(spark):
    text = "intro\n# One\npara\n\n- list only\n## Two\n- item\n```\n# no heading\n```\n### Three ###\n> quote\n#### Four\r\nlast"
    df = spark.createDataFrame([(1, "a.md", text), (2, "b.md", None), (3, "c.ts", "# x\ny"), (4, "d.md", "")], "file_id bigint, file string, content string")
    got = markdown.sections(df).orderBy("start_line").collect()
    assert [(r.title, r.level, r.start_line, r.end_line, r.slug) for r in got] == [("One", 1, 2, 5, "one"), ("Two", 2, 6, 10, "two"), ("Four", 4, 13, 14, "four")]


def test_git_log(spark):
    log = "3\t4\tlost.txt\n" + "a" * 40 + "\x1f2024-01-01\n10\t5\tsrc/a.ts\n-\t-\timg.png\n1\t0\told.md => new.md\n2\t2\tsrc/{lib => core}/x.go\n\n0\t1\tp/{ => q}/z.rs"
    df = spark.createDataFrame([("r", log), ("r", ""), ("r", None)], "repo string, log string")
    got = {(r.path, r.previous, r.additions, r.deletions) for r in gitlog.parse_log(df).collect()}
    assert got == {("src/a.ts", None, 10, 5), ("img.png", None, 0, 0), ("new.md", "old.md", 1, 0), ("src/core/x.go", "src/lib/x.go", 2, 2), ("p/q/z.rs", "p/z.rs", 0, 1)}
    blame = ["b" * 40 + " 1 1 2", "author Ann", "author-time 0", "summary s", "\tfirst", "b" * 40 + " 2 2", "\tsecond"]
    b = spark.createDataFrame([("f", n, t) for n, t in enumerate(blame)], "file string, n int, text string")
    assert [(r.line, r.author, r.content) for r in gitlog.parse_blame(b).orderBy("line").collect()] == [(1, "Ann", "first"), (2, "Ann", "second")]


def test_no_window_limits_declarations():
    fields = " ".join(f"field{n}: string;" for n in range(60))
    ts = f"export const TABLE: Record<string, {{ {fields} }}> = {{}};\nexport const run: (a: number) => void = async (a: number): Promise<{{ {fields} }}> => {{ go(a); }};\nconst one = (x) => twice(x) + 1\nconst two = 2;\n"
    got = {(r[0], r[1]): r for r in scanner.components_of(ts, "typescript")}
    assert set(got) == {("variable", "TABLE"), ("function", "run"), ("function", "one")}
    assert got["function", "run"][8] == [("go", 2)] and got["function", "one"][8] == [("twice", 3)]
    imports = "\n".join(f'\t"p{n}"' for n in range(50))
    parameters = ", ".join(f"T{n} any" for n in range(16))
    go = f'package a\n\nimport (\n{imports}\n)\nimport q "z"\n\ntype S[{parameters}] struct {{ a int }}\ntype N [5]int\nfunc F() {{ g("p", "q") }}\n'
    got = {(r[0], r[1]): r for r in scanner.components_of(go, "go")}
    assert set(got) == {("class", "S"), ("type", "N"), ("function", "F")} and len(got["function", "F"][9]) == 51


def test_places(spark):
    paths = {".github/a.py": True, ".storybook/b.ts": True, "cdk.out/c.ts": False, "analysis-reports/d.md": False, "x/.git/e.py": False, "mock_f.go": False, "amock_f.go": True, "g.d.ts": False, "h.min.js": False, "dist.ts": True, "a/dist/i.ts": False, ".env.ts": False, "src/vendors/j.go": True}
    df = spark.createDataFrame([(p, "x") for p in paths], "file string, content string")
    assert {r.file for r in scanner.eligible(df).collect()} == {p for p, k in paths.items() if k}
    assert {r.file for r in scanner.eligible(df, include=["**/*.ts"], exclude=[".storybook/**"]).collect()} == {"dist.ts"}
    marks = [("a.go", "// do not edit by hand\n", True), ("b.go", "// Code generated by x. DO NOT EDIT.\n", False), ("c.py", "# we do not edit\n", True), ("d.py", "#!x\n# Generated by y\n", False), ("e_pb2.py", "x", False)]
    m = spark.createDataFrame(marks, "file string, content string, kept boolean").withColumn("made", T.is_generated(F.col("file"), F.col("content")))
    assert all(r.made != r.kept for r in m.collect())


def test_records(spark):
    sep = "\x1f"
    good = sep.join(["h", "s", "Ann", "a@x", "d", "Bob", "b@x", "e", "Fix #3", "see PR #4", "p1 p2"]) + "\x1e\n\n1\t2\ta.ts\n-\t-\tb.png\n"
    df = spark.createDataFrame([("r", good), ("r", "h" + sep + "x"), ("r", ""), ("r", None)], "repo string, record string")
    [r] = gitlog.parse_records(df).collect()
    assert (r.message, r.additions, r.deletions, r.files, r.parents, r.issue_refs, r.pr_refs) == ("Fix #3\n\nsee PR #4", 1, 2, 2, ["p1", "p2"], [3], [4])
