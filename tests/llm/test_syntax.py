"""p2: python against the library's own parser, the other languages on valid and damaged samples."""

import ast
import sys
import warnings

import pytest

from codeweft.llm import syntax

GOOD = {
    "python": ["", "# only\n", "x = 1\n", "@d\nasync def f[T](a, /, b: int = 1, *c, d, **e) -> dict[str, int]:\n    return {**a, 'k': [y for y in b if y]}\n", "match x:\n    case {'a': [1, *_]} | None if y: pass\n    case P(q=-1) as z:\n        pass\n", "f'{x!r:>{w}} {\"n\"}'\n", "with (a as b, c): pass\nx: int = yield\n", "if (n := 3) > 2: print(n); y = lambda *a, k=1: a\nelse: z = a if b else c\n", "for i, (j, *k) in e: del a[1:2, ::3], b.c\ntry: pass\nexcept* E as e: raise X from e\n", "type A[T] = list[T]\n"],
    "javascript": ["// x\n", "const a = b / c / d, re = /[/]x/g\nlet {x, ...y} = z\n", "export default class extends A { static #p = 1; get x() { return this.#p } async *g() {} static { f() } [k]() {} }", "for (const x of await y) if (x) continue; else break\nlabel: while (1) do x++; while (y)", "const t = `a${b + `n${c}`}d`; f`x`", "import x, { a as b } from './m.js'\nexport * from 'y'\nexport { q as default }\n", "const f = async ({ a = 1, b: [c] }, ...d) => ({ ...a, [b]: 1, get z() { return 1 } })", "var x = a ? b : c, y = new (f())(1), z = a?.b?.[1] ?? 2n", "if (a) /re/.test(b)\n", "x\n++y\n", "!function(p){\"use strict\";p.t=1}(q)"],
    "typescript": ["type A<T> = T extends (infer U)[] ? U : { readonly [K in keyof T]?: T[K] }\n", "export abstract class X<T = string> extends Y<T> implements Z { private readonly a?: number = 1; constructor(public b: string) { super() } abstract m(): void; static async n<U>(x: U): Promise<U> { return x as U } }", "interface I { (a: string): void; new (x: number): I; [k: string]: unknown; m?(): this }\nenum E { A = 1, B }\ndeclare global { interface W {} }", "const f = <T,>(a: T, b?: { id: string; n: number }): a is T => a! as unknown as T\nlet m: Map<string, Set<number>> = new Map<string, Set<number>>()\n", "function g(this: X, ...a: [x: number, ...y: string[]]): asserts a {}\nimport type { A } from 'a'\nexport type { A }\nx satisfies Y\n"],
    "go": ["package a\n", "package a\n\nimport (\n\t\"fmt\"\n\t. \"x\"\n)\n\ntype S[T any] struct {\n\ta, b int `json:\"x\"`\n\t*E\n}\n\nfunc (s *S[T]) M(x ...int) (r int, err error) {\n\tfor i, v := range x {\n\t\tif y := f(v); y == nil || (y == T{1}) {\n\t\t\tcontinue\n\t\t}\n\t}\n\tswitch v := x.(type) {\n\tcase int, []string:\n\tdefault:\n\t}\n\tselect {\n\tcase c <- 1:\n\tcase m, ok := <-c:\n\t}\n\tdefer func() { recover() }()\n\tm := map[string][]int{\"a\": {1, 2}}\n\treturn a[1:2], nil\n}\n", "package a\nconst (\n\tA = iota\n\tB\n)\nvar x = []func(int) string{}\n"],
    "rust": ["//! d\nuse a::{b, c::*};\n", "#[derive(A)]\npub struct S<'a, T: B + 'a = u8>(pub &'a T) where T: C;\nimpl<'a, T> Tr for S<'a, T> {\n    pub(crate) async fn f(&mut self, x: impl Fn(u8) -> u8) -> Result<Vec<u8>, Box<dyn E>> {\n        let Some(y) = x else { return Err(1)? };\n        if let Some(a @ 1..=5) | None = b && c { d }\n        match z { A { b, .. } if q => 1, (x, _) => {} _ => m!{ a } }\n        for i in 0..n { v[i] = S { a: 1, ..d }; }\n        let c = move |x: u8| -> u8 { x };\n        let e = a as usize < b || x.iter().map(|x| x).collect::<Vec<_>>().len() > 1;\n        'l: loop { break 'l; }\n    }\n}\n", "fn main() { let s = r#\"a\"b\"#; /* a /* n */ */ println!(\"{}\", 'x'); }\n", "enum E { A = 1, B(u8), C { d: u8 } }\ntrait T: A { const X: u8; type Y; fn f(); }\n"],
}
BAD = {
    "python": ["def f(:\n", "print 'x'\n", "x = (1\n", "if x\n    y\n", "<<<<<<< HEAD\nx = 1\n", "x = “a”\n", "'''abc\n", "f'{x'\n", "f() = 1\n", "  x = 1\n y = 2\n", "a = 1 if b\n", "x = 012\n"],
    "javascript": ["const a: number = 1", "function f( { }", "x => => 1", "let = = 1", "`abc${", "'abc\n'", "if (a { }", "}", "interface A {}\n", "class A { x( }", "<<<<<<< ours\nx", "const x\n= ", "foo bar"],
    "typescript": ["const a: = 1", "interface A { x: }", "type = ", "function f(a: string", "class A { m(): void { }", "# x\n"],
    "go": ["x := 1\n", "package a\nfunc f( {\n}\n", "package a\nfunc f() {\n", "package a\nvar x = \"a\n", "package a\nfunc f() { if x {} } }\n", "package a\nimport x from 'y'\n"],
    "rust": ["fn f( {}", "let x = 1;", "fn f() { let x = ; }", "fn f() -> { }", "struct S { a u8 }", "fn f() { \"abc }", "/* a", "fn f() { x y }", "fn f() {} }"],
}


@pytest.mark.parametrize("language", GOOD)
def test_samples(language):
    sys.setrecursionlimit(100_000)
    for text in GOOD[language]:
        assert syntax.check(text, language) is None, text
    for text in BAD[language]:
        assert syntax.check(text, language) is not None, text


def test_python_against_library(small):
    import pandas as pd

    warnings.simplefilter("ignore")
    files = pd.read_parquet(f"{small}/source_files.parquet")
    for text in files.content[files.file.str.endswith(".py")].dropna():
        try:
            ast.parse(text)
            valid = True
        except (SyntaxError, ValueError):
            valid = False
        assert (syntax.check(text, "python") is None) == valid


def test_positions():
    assert syntax.check("x = 1\ny = = 2\n", "python")[:2] == (10, 2)
    assert syntax.check("a()\n<<<<<<< HEAD\nb()\n=======\nc()\n>>>>>>> x\n", "javascript")[3] == "merge conflict"
    assert syntax.check("function f() {\n", "javascript")[3] == "truncated"


def test_deep_and_long():
    sys.setrecursionlimit(100_000)
    assert syntax.check("x = " + "[" * 500 + "]" * 500 + "\n", "python") is None
    assert syntax.check("x = [" + "1, " * 50_000 + "]\n", "python") is None
    assert syntax.check("[" * 400_000, "javascript") is not None


def test_frame(spark):
    rows = [(1, "a/b", "x.py", None, "x = (", 1), (2, "a/b", "x.py", "python", "", 1), (3, None, "x.md", None, "((", 1), (4, "a/b", "y.js", " JavaScript ", "let a", 1), (5, "a/b", "z.rs", "rust", None, 1), (6, "a/b", None, None, "x", 1), (1, "a/b", "x.py", None, "x = (", 1)]
    df = spark.createDataFrame(rows, "file_id bigint, repo string, file string, language string, content string, error int")
    assert sorted(r.file_id for r in syntax.found(df).collect()) == [1, 1]
    got = {(r.repo, r.language): (r.files, r.failed, r.rate) for r in syntax.rates(df).collect()}
    assert got == {("a/b", "python"): (3, 2, 2 / 3), ("a/b", "javascript"): (1, 0, 0.0), ("a/b", "rust"): (1, 0, 0.0)}
    assert syntax.found(df.limit(0)).collect() == []


def test_depth_is_not_bounded():
    """Valid code is valid however deep it nests, and a fault at its end is found there."""
    deep = 30_000
    text = "const a = " + "[" * deep + "]" * deep + ";\n"
    assert syntax.check(text, "javascript") is None
    at, _, _, _ = syntax.check(text + "let = = 1;\n", "javascript")
    assert at > len(text)
