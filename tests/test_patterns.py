"""Pattern rules over tokens and syntax trees against a literal table, and the styles that they give."""

from codeweft.operators import patterns

TS = """import a from 'x';
export * from './y'; export { b } from './z';
// throw in a comment; await x
class HttpError extends BaseError {}
const K = class extends Foo {};
type Fn = (a: number) => void;
async function load(id: string): Promise<Map<string, number>> {
  try {
    const r = await get(id);
    const q = await b(), z = await c();
    if (r) { const t = await d(); }
    await e();
    throw new HttpError('throw');
  } catch (err) { return x.catch((e) => null); }
}
function plain(a) { return require('fs'); }
const f = (a: number, b: number): number => a + b;
const g = async (x): Promise<{ a: number }> => { return import('./lazy'); };
const h = x => x, i = (cb: (n: number) => void) => cb(1);
"""
PY = """from __future__ import annotations
import os, sys
from . import x
from a.b import c
async def f(a: int, b: int = 1, *args: str, c, d: int, **k) -> int:
    try:
        raise X
    except (A, B):
        pass
    except C: pass
def g(x): return 'raise'
"""
GO = """package a
func f() error {
\tif err := g(); err != nil {
\t\treturn err
\t}
\tif a != nil && b != nil {
\t}
\tdefer c()
\tgo func() { ch <- 1 }()
\tx := <-ch
\tvar s chan<- int
\treturn nil // defer
}
"""
RUST = """unsafe impl Send for X {}
impl<T: ?Sized> A<T> { fn f(&self, x: impl Fn()) -> Result<u8, E> { let a = g()?; match a { _ => unsafe { h() } } } }
trait B { unsafe fn q(); }
"""
WANT = {
    "typescript": {"try-catch": 1, "throw": 1, "promise-catch": 1, "await-in-try": 3, "error-class": 1, "dynamic-import": 1, "re-export": 2, "require": 1, "arrow-return-type": 2, "function-return-type": 1, "arrow-total": 5, "function-total": 2},
    "python": {"try-except": 1, "raise": 1, "except-clause": 2, "import-module": 1, "from-import": 2, "relative-import": 1, "typed-parameter": 3, "py-function-return-type": 1, "py-function-total": 2},
    "go": {"go-if-err": 1, "go-defer": 1, "go-goroutine": 1, "go-channel-send": 1},
    "rust": {"rust-try-operator": 1, "rust-match": 1, "rust-unsafe-block": 1, "rust-impl-block": 2, "rust-trait-def": 1},
}


def test_rules(spark):
    rows = [("r", "a.ts", TS), ("r", "b.py", PY), ("r", "c.go", GO), ("r", "d.rs", RUST), ("r", "e.py", "x = ("), ("r", "f.ts", "  "), ("r", "g.go", None), ("r", "h.md", "throw")]
    got = {r.file: r.matches for r in patterns.rule_counts(spark.createDataFrame(rows, "repo string, file string, content string")).collect()}
    assert got == {"a.ts": WANT["typescript"], "b.py": WANT["python"], "c.go": WANT["go"], "d.rs": WANT["rust"], "e.py": {}, "f.ts": {}, "g.go": {}}


def test_styles(spark):
    rows = [("r", "a.ts", TS), ("r", "b.ts", "throw new X()\n"), ("r", "c.ts", "const a = require('b');\n"), ("r", "d.ts", "// throw new Error\nimport('x');\n"), ("r", "e.ts", "")]
    files = spark.createDataFrame(rows, "repo string, file string, content string")
    signatures = spark.createDataFrame([("r", "a.ts", 3, 1), ("r", "e.ts", 2, 2)], "repo string, file string, n bigint, annotated bigint")
    got = {r.file: (r.error_style, r.import_style, r.imports, r.type_coverage) for r in patterns.styled(files, signatures).collect()}
    assert got["a.ts"] == ("mixed", "mixed", 3, "minimal") and got["b.ts"][:2] == ("throw", "unknown") and got["c.ts"][1:3] == ("cjs", 1)
    assert got["d.ts"] == ("throw", "esm", 1, "none") and got["e.ts"] == ("unknown", "unknown", 0, "full")
