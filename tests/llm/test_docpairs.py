"""p5: documented functions of the five languages, traps and edge cases."""

import ast

from codeweft.llm import docpairs as dp

DOC = "Waits until every queued batch has been written out."
TS = f"""import x from 'x';
/** {DOC} */
export async function drainQueue(a: {{ id: string; n: number }}, b?: number): Promise<Map<string, number>> {{
  return a;
}}

/**
 * {DOC}
 * @param a - thing
 */
// eslint-disable-next-line
export const flushAll = async (
  a: string,
): Promise<void> => {{
  g(`${{a}}`);
}};

// {DOC}
function plainComment() {{}}

/** {DOC} */
const table = [1, 2];

/** {DOC} */
interface Options {{
  /** {DOC} */
  theme?: string;
  /** {DOC} */
  size(): number;
}}

/** {DOC} */
export class Pump {{
  /** {DOC} */
  @cache(10)
  private async runOnce<T>(x: T) {{ return x; }}
  /** {DOC} */
  level = 3;
  /** runTwice runs twice */
  runTwice() {{}}
}}

const s = `/** {DOC} */ function inString() {{}}`;
/* /** {DOC} *​/ */
/** {DOC} */
g(1);

/** {DOC} */

function farAway() {{}}
"""
GO = f"""package a

// {DOC}
//go:noinline
func (s *Set[T]) Drain(x int) error {{
\treturn nil
}}

// {DOC}

func apart() {{}}

// TODO: document this
func todo() {{}}

/*
{DOC}
TODO: later
*/
func block() {{ f := func() {{}}; f() }} // {DOC}
func trailing() {{}}
"""
RUST = f"""/// {DOC}
///
/// # Examples
/// ```
/// fn other() {{}}
/// ```
#[inline]
pub(crate) async fn drain<'a>(x: &'a str) -> usize {{ 1 }}

/// {DOC}
pub struct S {{ a: u8 }}

impl S {{
    // {DOC}
    fn plain(&self) {{}}
    /**
     * {DOC}
     */
    #[must_use]
    pub fn block(&self) {{}}
}}
"""
PY = f'''import a

@dec(1)
async def drain(
    a, b: dict[str, int] = {{1: 2}}, key=lambda p: p,
) -> dict[str, int]:
    """
    {DOC}

    Args:
        a: one
    """
    return 1

def one(): "{DOC}"

def trivial(x):
    """This will trivial the x."""

def formatted():
    f"""{DOC}"""

def late():
    # comment
    r\'\'\'{DOC}\'\'\'

class A:
    """{DOC}"""
    def m(self):
        x = 1
        """{DOC}"""
    def n(self):
        """{DOC}""" % 1
    def o(self):
        """Documentation to be added at some later time."""
'''


def frame(spark, rows):
    return spark.createDataFrame(rows, "file_id bigint, file string, language string, content string, name int, start_line int")


def test_functions(spark):
    rows = [(1, "a.ts", None, TS, 1, 1), (2, "a.go", "go", GO, 1, 1), (3, "a.rs", "rust", RUST, 1, 1), (4, "a.py", "python", PY, 1, 1), (5, "a.ts", None, TS.replace("\n", "\r\n"), 1, 1),
            (6, "b.py", "python", PY + "(", 1, 1), (7, "c.py", "python", None, 1, 1), (8, "c.py", "python", "", 1, 1), (9, "d.md", None, TS, 1, 1), (4, "a.py", "python", PY, 1, 1)]
    got = {}
    for r in dp.pairs(frame(spark, rows)).collect():
        got.setdefault(r.file_id, []).append((r.name, r.start_line, r.signature))
    names = {k: sorted(n for n, _, _ in v) for k, v in got.items()}
    assert names == {1: ["drainQueue", "flushAll", "runOnce"], 5: ["drainQueue", "flushAll", "runOnce"], 2: ["Drain", "block"], 3: ["block", "drain"], 4: ["drain", "late", "one"]}
    lines = {n: l for n, l, _ in got[1]}
    assert TS.split("\n")[lines["flushAll"] - 1].startswith("export const flushAll") and TS.split("\n")[lines["runOnce"] - 1].strip().startswith("private async")
    assert {n: l for n, l, _ in got[5]} == lines
    assert ("Drain", 5, "func (s *Set[T]) Drain(x int) error") in got[2]
    assert PY.split("\n")[{n: l for n, l, _ in got[4]}["drain"] - 1].startswith("async def drain")
    found = dp.found(frame(spark, rows)).collect()
    assert sorted((r.file_id, r.start_line) for r in found) == sorted((k, l) for k, v in got.items() for _, l, _ in v)
    assert dp.pairs(frame(spark, rows).limit(0)).collect() == []


def test_python_against_library(spark, small):
    """Every long docstring that the library's parser sees is paired with its function."""
    files = spark.read.parquet(f"{small}/source_files.parquet")
    got = {(r.file_id, r.start_line) for r in dp.found(files.filter("file LIKE '%.py'")).collect()}
    for r in files.filter("file LIKE '%.py'").collect():
        try:
            tree = ast.parse(r.content)
        except SyntaxError:
            continue
        for f in ast.walk(tree):
            if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)):
                doc = ast.get_docstring(f) or ""
                assert ((r.file_id, f.lineno) in got) <= bool(doc)
                if len(doc.split("\n\n")[0]) > 90:
                    assert (r.file_id, f.lineno) in got, doc
