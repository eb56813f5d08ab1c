"""Repository scan: eligible files by path, then components of each file by a lexer, Python by its syntax tree."""

from __future__ import annotations

import ast
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.functions import text as T
from codeweft.session import spread
from codeweft.sources.lexers import LEXERS, LexError, Tokens

# Folders and names that a scan leaves out, as globs; a star stands for any characters but a slash.
EXCLUDED_FOLDERS = """
node_modules bower_components vendor third_party dist build out target .next .turbo .nuxt mocks testdata .git .svn .hg .vscode .idea .vs .fleet
.cache .parcel-cache .vite coverage .nyc_output logs tmp temp __fixtures__ __snapshots__ fixtures analysis-reports .research benchmarks generated
.terraform .serverless cdk.out public static .claude .changeset
""".split()
EXCLUDED_NAMES = """
*.pb.go *.gen.go *_gen.go *.pb.gw.go mock_*.go .eslintcache *.log *.tmp package-lock.json yarn.lock pnpm-lock.yaml Cargo.lock Gemfile.lock .DS_Store
Thumbs.db .env* *.min.js *.min.css *.map *.d.ts *.wasm
""".split()


def globs(names: list[str]) -> str:
    """One expression for names with stars."""
    return "|".join(re.escape(n).replace(r"\*", "[^/]*") for n in names)


EXCLUDED = f"/(?:{globs(EXCLUDED_FOLDERS)})/|/(?:{globs(EXCLUDED_NAMES)})$"
SCHEMA = "file_id bigint, type string, name string, start_line int, end_line int, signature string, exported boolean, docstring string, snippet string, callees array<struct<name:string,line:int>>, imports array<string>, error string"


def read_repository(spark: SparkSession, root: str) -> DataFrame:
    """file, size_bytes and content of the files below a folder; excluded paths are dropped before contents are decoded (SRC-01, AGG-29)."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.split("://", 1)[-1].rstrip("/")
    below = F.expr(f"substring(path, instr(path, '{base}') + {len(base)})")
    return f.filter(~below.rlike(EXCLUDED)).select(F.expr(f"substring(path, instr(path, '{base}') + {len(base) + 1})").alias("file"), F.col("length").alias("size_bytes"), F.col("content").cast("string").alias("content"))


def eligible(files: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Files with a known extension, in no excluded place, that are not blank (SRC-02, SRC-03, SRC-06, FLT-10).

    include and exclude are globs of whole paths in which ** stands for any folders; one of include must match where given.
    """
    path = F.concat(F.lit("/"), F.col("file"))
    whole = lambda g: "^" + "(?:.*/)?".join(globs([x]) for x in g.split("**/")).replace("(?:.*/)?" + globs(["**"]), ".*").replace(globs(["**"]), ".*") + "$"
    if include:
        files = files.filter(F.col("file").rlike("|".join(map(whole, include))))
    if exclude:
        files = files.filter(~F.col("file").rlike("|".join(map(whole, exclude))))
    return files.filter(~path.rlike(EXCLUDED) & T.extension(F.col("file")).isin(*T.INDEXABLE) & F.col("content").rlike(r"\S"))


def python_components(text: str) -> list[tuple]:
    """Functions, classes and methods of a Python file (SRC-18 to SRC-21)."""
    tree, lines = ast.parse(text), text.split("\n")
    names = next((n.value for n in tree.body if isinstance(n, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in n.targets)), None)
    public = {e.value for e in getattr(names, "elts", []) if isinstance(e, ast.Constant)}
    imports = [a.name for n in tree.body if isinstance(n, ast.Import) for a in n.names] + [n.module or "." for n in tree.body if isinstance(n, ast.ImportFrom)]
    out = []

    def put(n, kind: str, exported: bool) -> None:
        head = next((x.strip() for x in lines[n.lineno - 1 :] if x.strip()), "")
        calls = [] if kind == "class" else [(ast.unparse(c.func), c.lineno) for c in ast.walk(n) if isinstance(c, ast.Call) and isinstance(c.func, (ast.Name, ast.Attribute))]
        out.append((kind, n.name, n.lineno, n.end_lineno, head.rstrip(":").rstrip(), exported, ast.get_docstring(n), "\n".join(lines[n.lineno - 1 : n.end_lineno]), list(dict.fromkeys(calls)), imports if kind == "function" else []))

    def shown(name: str) -> bool:
        return name in public if public else not name.startswith("_")

    for n in tree.body:
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            put(n, "function", shown(n.name))
        elif isinstance(n, ast.ClassDef):
            put(n, "class", shown(n.name))
            for m in n.body:
                if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    put(m, "method", not m.name.startswith("_"))
    return out


#: Kinds that begin a statement, and kinds that may end one.
STARTS = ("const", "let", "var", "function", "class", "export", "import", "if", "for", "while", "return", "switch", "try", "throw", "do", "break", "continue")
ENDS = ("NAME", "NUM", "STR", "TN", "TT", "REGEX", "PRIV", ")", "]", "}", "this", "super", "null", "true", "false", "++", "--")


def partners(t: Tokens) -> dict[int, int]:
    """Closing token of each opening bracket."""
    stack, out = [], {}
    for i, k in enumerate(t.kinds):
        if k in ("(", "[", "{"):
            stack.append(i)
        elif k in (")", "]", "}") and stack:
            out[stack.pop()] = i
    return out


def doc_before(text: str, t: Tokens, at: int, language: str) -> str | None:
    """Comment lines directly above a token, attributes and decorators skipped (SRC-17, SRC-25)."""
    got: list[str] = []
    limit = text.rfind("\n", 0, at) + 1
    for a, b in reversed(t.comments):
        if b > limit:
            continue
        between = text[b:limit].strip()
        if between and not re.fullmatch(r"(?:[@#][^\n]*\s*)+", between) or text.count("\n", b, limit) > 1 and language == "go":
            break
        c = text[a:b]
        block = c.startswith("/*")
        if language in ("javascript", "typescript") and not c.startswith("/**") or language == "rust" and not c.startswith(("///", "/**")):
            break
        got.append(re.sub(r"(?m)^[ \t]*\*(?!/) ?", "", re.sub(r"^/\*+|\*+/$", "", c)).strip() if block else re.sub(r"^//[/!]? ?", "", c).rstrip())
        if block:
            break
        limit = a
    return "\n".join(reversed(got)) or None


def lexed_components(text: str, language: str) -> list[tuple]:
    """Declarations of the other languages, told by their tokens (SRC-07 to SRC-16, SRC-23, SRC-24)."""
    t = LEXERS[language](text)
    k, w, close = t.kinds, t.words, partners(t)
    line = lambda i: text.count("\n", 0, t.starts[i]) + 1
    script = language in ("javascript", "typescript")
    if language == "rust":
        imports = re.findall(r"(?m)^use\s+([\w:]+)", text)
    elif language == "go":
        blocks = [range(i + 1, close[i + 1] if k[i + 1] == "(" and i + 1 in close else min(i + 3, len(k))) for i in range(len(k)) if k[i] == "import"]
        imports = list(dict.fromkeys(w[j][1:-1] for block in blocks for j in block if k[j] == "STR"))
    else:
        imports = list(dict.fromkeys(w[i][1:-1] for i in range(1, len(k)) if k[i] == "STR" and (w[i - 1] == "from" or k[i - 1] == "import")))
    out: list[tuple] = []

    def put(kind: str, name: str, first: int, body: int | None, exported: bool, end: int | None = None) -> None:
        last = end if end is not None else close.get(body, body) if body is not None else first
        sig = re.sub(r"\s+", " ", text[t.starts[first] : t.starts[body] if body is not None else t.ends[last]]).strip(" =;")
        calls: dict = {}
        if kind in ("function", "method") and last > first:
            for i in range(body if body is not None else first + 2, last):
                if k[i] == "NAME" and k[i + 1] == "(" and k[i - 1] not in ("function", "fn", "func"):
                    j = i
                    while j >= 2 and k[j - 1] in (".", "::", "?.") and k[j - 2] in ("NAME", "this", "self"):
                        j -= 2
                    calls["".join(("new " if k[j - 1] == "new" else "", *w[j : i + 1])), line(i)] = 1
        out.append((kind, name, line(first), line(last), sig, exported, doc_before(text, t, t.starts[first], language), text[t.starts[first] : t.ends[last]], list(calls), imports if kind == "function" else []))

    def body_after(i: int) -> int | None:
        """First block that opens at this level before a statement ends."""
        while i < len(k) - 1:
            if k[i] == "{":
                return i
            if k[i] in ("(", "["):
                i = close.get(i, len(k))
            elif k[i] in (";", "}"):
                return None
            i += 1
        return None

    def past_type(i: int, end: int, stops: tuple) -> int:
        """First of the stops at this level, brackets passed over; a statement's end or the start of another ends the search."""
        while i < end and k[i] not in stops:
            if k[i] == ";" or t.breaks[i] and k[i] in STARTS:
                return end
            i = close.get(i, i) + 1
        return i

    def expression_end(i: int, end: int) -> int:
        """Last token of an expression: before a separator at its level, or a line break that no operator spans."""
        last = i
        while i < end and k[i] not in (";", ",", ")", "]", "}"):
            if i > last and t.breaks[i] and k[i] in (*STARTS, "NAME", "@", "}") and k[i - 1] in ENDS:
                break
            last = close.get(i, i)
            i = last + 1
        return last

    def walk(i: int, end: int, owner: str | None, top: bool) -> None:
        while i < end:
            if script and k[i] == "@" or language == "rust" and k[i] == "#":  # decorators and attributes
                i += 2 if script else 1 + (k[i + 1] == "!")
                while script and k[i] == ".":
                    i += 2
                i = close.get(i, i) + 1 if k[i] in ("(", "[") else i
                continue
            first, exported = i, False
            while i < end and (k[i] in ("export", "default", "pub", "async", "unsafe", "extern") or w[i] in ("async", "abstract", "declare", "static", "public", "private", "protected", "readonly", "override")) and k[i + 1] not in ("(", "=", ":", ";"):
                exported |= w[i] in ("export", "pub", "public")
                i += 1
                if w[i - 1] == "pub" and k[i] == "(":
                    i = close.get(i, i) + 1
            name = w[i + 1] if i + 1 < end else ""
            body = None
            if script and k[i] == "function" and k[i + 1] == "NAME" or language == "rust" and k[i] == "fn":
                body = body_after(i + 2)
                put("method" if owner else "function", f"{owner}.{name}" if owner else name, first, body, exported, None if body is not None else i + 1)
            elif language == "go" and k[i] == "func" and top:
                receiver = k[i + 1] == "("
                at = close.get(i + 1, i) + 1 if receiver else i + 1
                name, body = w[at], body_after(at + 1)
                kind = re.sub(r"^\w+\s+|[*\s]|\[.*", "", text[t.ends[i + 1] : t.starts[close[i + 1]]]) if receiver and i + 1 in close else ""
                put("method" if receiver else "function", f"{kind}.{name}" if receiver else name, first, body, name[:1].isupper(), None if body is not None else at)
            elif script and k[i] == "class" and k[i + 1] == "NAME":
                body = body_after(i + 2)
                if body is not None:
                    put("class", name, first, body, exported)
                    walk(body + 1, close.get(body, body), name, False)
            elif script and w[i] == "interface" and k[i + 1] == "NAME" or language == "rust" and k[i] == "trait":
                body = body_after(i + 2)
                if body is not None:
                    put("interface", name, first, body, exported)
            elif language == "rust" and k[i] in ("struct", "enum") and k[i + 1] == "NAME":
                body = body_after(i + 2)
                put("class", name, first, body, exported, None if body is not None else i + 1)
            elif language == "rust" and k[i] == "impl":
                body = body_after(i + 1)
                if body is not None:
                    target = re.sub(r"<.*", "", re.sub(r"^impl\s*(?:<[^{]*?>\s*)?|.*\bfor\s+", "", text[t.starts[i] : t.starts[body]].strip()), flags=re.S).strip()
                    walk(body + 1, close.get(body, body), target, False)
            elif language == "go" and k[i] == "type" and k[i + 1] == "NAME":
                kinds = {"struct": "class", "interface": "interface"}
                body = body_after(i + 2)
                at = close.get(i + 2, i + 1) + 1 if k[i + 2] == "[" else i + 2 + (k[i + 2] == "=")
                put(kinds.get(k[at], "type"), name, first, body, name[:1].isupper(), None if body is not None else i + 1)
            elif script and w[i] == "type" and k[i + 1] == "NAME" and k[i + 2] in ("=", "<"):
                put("type", name, first, None, exported, i + 1)
            elif script and k[i] == "const" and k[i + 1] == "NAME" and not owner:
                at = past_type(i + 2, end, ("=",))
                if at < end - 1:
                    value = at + 1 + (w[at + 1] == "async")
                    value = next((j + 1 for j in range(value, end) if k[j] == ">" and k[j + 1] == "("), value) if k[value] == "<" else value
                    arrow = past_type(close.get(value, value) + 1, end, ("=>",)) if k[value] == "(" and k[close.get(value, value) + 1] in ("=>", ":") else value + 1 if k[value] == "NAME" and k[value + 1] == "=>" else end
                    if k[value] == "function":
                        body = body_after(value + 1)
                        put("function", name, first, body, exported, None if body is not None else at)
                    elif arrow < end - 1:
                        block = arrow + 1 if k[arrow + 1] == "{" else None
                        put("function", name, first, block, exported, None if block is not None else expression_end(arrow + 1, end))
                        body = block
                    elif exported:
                        put("variable", name, first, None, True, at - 1)
            elif script and owner and k[i] in ("NAME", "PRIV") and k[i + 1] == "(":
                body = body_after(close.get(i + 1, i) + 1)
                if body is not None:
                    put("method", f"{owner}.{w[i]}", first, body, "private" not in w[first:i])
            elif k[i] == "{":
                body = i
            i = close.get(body, i) + 1 if body is not None else max(i, first) + 1

    walk(0, len(k) - 1, None, True)
    return out


def components_of(text: str, language: str) -> list[tuple]:
    return python_components(text) if language == "python" else lexed_components(text, language)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sys.setrecursionlimit(50_000)
    callees = pa.list_(pa.struct([("name", pa.string()), ("line", pa.int32())]))
    schema = pa.schema([("file_id", pa.int64()), ("type", pa.string()), ("name", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("signature", pa.string()), ("exported", pa.bool_()), ("docstring", pa.string()), ("snippet", pa.string()), ("callees", callees), ("imports", pa.list_(pa.string())), ("error", pa.string())])
    for b in batches:
        ids, languages, texts = (b[c].to_pylist() for c in ("file_id", "language", "content"))
        for at in range(0, len(ids), 500):
            rows = []
            for i, language, text in zip(ids[at : at + 500], languages[at : at + 500], texts[at : at + 500]):
                try:
                    rows += [(i, *r[:8], [{"name": n, "line": x} for n, x in r[8]], r[9], None) for r in components_of(text, language)]
                except (SyntaxError, ValueError, LexError, RecursionError, IndexError) as e:
                    rows.append((i, "error", None, None, None, None, None, None, None, [], [], f"{type(e).__name__}: {e}"[:200]))
            columns = list(zip(*rows)) or [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def scan(files: DataFrame) -> DataFrame:
    """Components of every eligible code file (SRC-01, SRC-05); a file that cannot be read gives one row of type error,
    Go and Python files that say they are generated give none.

    Null and blank contents give no rows; a file that occurs twice is scanned twice. One narrow stage.
    """
    f = eligible(files.select("file_id", "file", "language", "content")).withColumn("language", T.language_of(F.col("language"), F.col("file"))).filter(F.col("language").isin(*LEXERS) & ~T.is_generated(F.col("file"), F.col("content")))
    return spread(f.select("file_id", "language", "content")).mapInArrow(_scan, SCHEMA)
