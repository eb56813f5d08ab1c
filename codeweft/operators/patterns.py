"""Facts of files and their comparison with like files."""

from __future__ import annotations

import ast
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweft.functions import text as T
from codeweft.session import spread
from codeweft.sources.lexers import LEXERS, LexError, Tokens
from codeweft.sources.scanner import partners


def latest(files: DataFrame) -> DataFrame:
    """Content of the latest scan of each file of a repository."""
    return files.groupBy("repo", "file").agg(F.max_by("content", "file_id").alias("content"))


def facts(files: DataFrame, components: DataFrame) -> DataFrame:
    """Size, import style, error style and type coverage of every file (SCH-10)."""
    f = latest(files)
    g = components.filter(F.col("type").isin("function", "method")).groupBy("repo", "file").agg(F.count("signature").alias("n"), F.count_if(T.annotated(F.col("signature"))).alias("a"))
    c, (esm, cjs) = F.col("content"), T.import_count(F.col("content"))
    j = f.join(g, ["repo", "file"], "left")
    return j.select(
        "repo", "file", F.length(c).cast("bigint").alias("chars"), F.size(F.split(c, "\n")).cast("bigint").alias("lines"), T.import_style(c).alias("import_style"), (esm + cjs).cast("bigint").alias("imports"),
        T.error_style(c).alias("error_style"), T.coverage_label(F.coalesce(F.try_divide("a", "n"), F.lit(0.0))).alias("type_coverage"),
    )


def sizes(files: DataFrame) -> DataFrame:
    """Mean, upper median and range of lines per repository and extension (AGG-13).

    The upper median is the discrete median of the values in descending order; the aggregate merges counts of equal
    values, so a hot group is not sorted in one task.
    """
    k = files.select("repo", T.extension(F.col("file")).alias("ext"), F.size(F.split("content", "\n")).alias("lines"))
    return k.groupBy("repo", "ext").agg(
        F.count("*").alias("files"), F.floor(F.avg("lines") + 0.5).cast("bigint").alias("mean"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY lines DESC)").cast("bigint").alias("median"),
        F.min("lines").cast("bigint").alias("low"), F.max("lines").cast("bigint").alias("high"),
    )


def most_common(files: DataFrame) -> DataFrame:
    """Most common import style per extension, its files and share; ties to the first seen (AGG-15)."""
    k = files.select(T.extension(F.col("file")).alias("ext"), T.import_style(F.col("content")).alias("style"), F.concat_ws("/", "repo", "file").alias("path"))
    g = k.groupBy("ext", "style").agg(F.count("*").alias("n"), F.min("path").alias("first"))
    w = Window.partitionBy("ext")
    g = g.withColumn("total", F.sum("n").over(w)).withColumn("rn", F.row_number().over(w.orderBy(F.desc("n"), "first"))).filter("rn = 1")
    return g.select("ext", F.col("style").alias("common"), F.col("n").alias("files"), F.floor(F.col("n") * 100.0 / F.col("total") + 0.5).cast("bigint").alias("percent"))


def tested(files: DataFrame) -> DataFrame:
    """Source files per repository and extension and those with a test file, found by its likely paths (JN-13, AGG-14)."""
    src = files.filter(~T.is_test_file(F.col("file"))).withColumn("ext", T.extension(F.col("file")))
    tests = files.select("repo", F.col("file").alias("test"))
    have = src.select("repo", "file", F.explode(T.test_candidates(F.col("file"))).alias("test")).join(tests, ["repo", "test"], "left_semi").select("repo", "file").distinct().withColumn("has", F.lit(True))
    return src.join(have, ["repo", "file"], "left").groupBy("repo", "ext").agg(F.count("*").alias("files"), F.count_if(F.col("has")).alias("tested"))


# The rules of each language.
SCRIPT_RULES = (
    "try-catch", "throw", "promise-catch", "await-in-try", "error-class", "dynamic-import", "re-export", "require",
    "arrow-return-type", "function-return-type", "arrow-total", "function-total",
)
PYTHON_RULES = (
    "try-except", "raise", "except-clause", "import-module", "from-import", "relative-import", "typed-parameter",
    "py-function-return-type", "py-function-total",
)
GO_RULES = ("go-if-err", "go-defer", "go-goroutine", "go-channel-send")
RUST_RULES = ("rust-try-operator", "rust-match", "rust-unsafe-block", "rust-impl-block", "rust-trait-def")


def python_counts(text: str) -> dict[str, int]:
    """Rules of Python over its syntax tree."""
    nodes = list(ast.walk(ast.parse(text)))
    kinds = Counter(type(n) for n in nodes)
    froms = [n for n in nodes if isinstance(n, ast.ImportFrom) and n.module != "__future__"]
    defs = [n for n in nodes if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
    typed = 0
    for a in (n.args for n in defs):
        plain = [*a.posonlyargs, *a.args]
        plain = plain[: len(plain) - len(a.defaults)] + [x for x, d in zip(a.kwonlyargs, a.kw_defaults) if d is None]
        typed += sum(x is not None and x.annotation is not None for x in (*plain, a.vararg, a.kwarg))
    counts = (
        kinds[ast.Try] + kinds[ast.TryStar], kinds[ast.Raise], kinds[ast.ExceptHandler], kinds[ast.Import], len(froms),
        sum(n.level > 0 for n in froms), typed, sum(n.returns is not None for n in defs), len(defs),
    )
    return dict(zip(PYTHON_RULES, counts))


def script_counts(t: Tokens) -> dict[str, int]:
    """Rules of TypeScript and JavaScript over tokens: strings and comments hold none."""
    k, w, close = t.kinds, t.words, partners(t)
    opens = {b: a for a, b in close.items()}
    out = dict.fromkeys(SCRIPT_RULES, 0)
    value = ("=", "(", ",", "return", ":", "=>", "[", "?")  # what stands before an expression

    def typed(i: int) -> bool:
        """Whether the bracket at i is a list of parameters with a result type before an arrow or a body."""
        j = close.get(i, len(k)) + 1
        if j >= len(k) or k[j] != ":":
            return False
        j, depth = j + 1, 0
        while j < len(k) and k[j] not in ("=>", ";", "=", ")", "]", "}", "EOF") and (depth or k[j] != ","):
            if k[j] == "{" and k[j - 1] not in (":", "|", "&", "<", ","):
                return True
            depth += (k[j] == "<") - (k[j] == ">")
            j = close.get(j, j) + 1
        return j < len(k) and k[j] == "=>"

    for i, x in enumerate(k[:-1]):
        before, after = k[i - 1] if i else "", k[i + 1]
        if x == "try" and after == "{":
            out["try-catch"] += 1
            out["await-in-try"] += awaited(t, i + 2, close.get(i + 1, i + 1), close)
        elif x == "throw":
            out["throw"] += 1
        elif x == "NAME" and w[i] == "catch" and before in (".", "?.") and after == "(":
            out["promise-catch"] += 1
        elif x == "class" and before not in value and after == "NAME":
            j = i + 2
            while k[j] not in ("{", "extends", "EOF"):
                j += 1
            out["error-class"] += k[j] == "extends"
        elif x == "import" and after == "(":
            out["dynamic-import"] += 1
        elif x == "export":
            j = i + 1 + (w[i + 1] == "type")
            j = close.get(j, j) + 1 if k[j] == "{" else j + 1 + 2 * (w[j + 1] == "as") if k[j] == "*" else i
            out["re-export"] += j > i and w[j] == "from" and k[j + 1] == "STR"
        elif x == "NAME" and w[i] == "require" and after == "(" and before not in (".", "?.", "function"):
            out["require"] += 1
        elif x == "function" and after == "NAME" and before not in value:
            out["function-total"] += 1
            j = next((j for j in range(i + 2, len(k)) if k[j] in ("(", "{", "EOF")), i)
            out["function-return-type"] += k[j] == "(" and typed(j)
        elif x == "=>":
            start = opens.get(i - 1, i - 1)
            known = k[start - 1] if start else ""
            named = start >= 3 and (w[start - 3] == "type" or w[start - 2] == "type")
            out["arrow-total"] += not (before == ")" and (known in (":", "|", "&", "<") or known == "=" and named)) and (before == ")" or before == "NAME" and known not in (":", "|", "&", "."))
        if x == "(" and before in (*value, "async", "{", ";", "}", "NAME") and (before != "NAME" or w[i - 1] == "async") and typed(i):
            j = close[i] + 1
            while k[j] not in ("=>", ";", "EOF") and not (k[j] == "{" and k[j - 1] not in (":", "|", "&", "<", ",")):
                j = close.get(j, j) + 1
            if k[j] == "=>":
                out["arrow-return-type"] += 1
                out["arrow-total"] += k[j - 1] != ")" and (k[j - 1] != "NAME" or k[opens.get(j - 1, j - 1) - 1] in (":", "|", "&", "."))
    return out


def awaited(t: Tokens, first: int, last: int, close: dict[int, int]) -> int:
    """Declarations between two tokens, at their own level, whose value is awaited."""
    k, found, declared, i = t.kinds, 0, False, first
    while i < last:
        if k[i] in ("const", "let"):
            declared = True
        elif k[i] == ";" or t.breaks[i] and k[i - 1] not in (",", "=", "const", "let"):
            declared = False
        found += declared and k[i] == "=" and k[i + 1] == "await"
        i = close.get(i, i) + 1
    return found


def go_counts(t: Tokens) -> dict[str, int]:
    """Rules of Go over tokens."""
    k, w, close = t.kinds, t.words, partners(t)
    out = dict.fromkeys(GO_RULES, 0)
    for i, x in enumerate(k[:-1]):
        if x == "if":
            j = at = i + 1
            joined = False
            while k[j] not in ("{", "EOF"):
                if k[j] == ";":
                    at, joined = j + 1, False
                joined |= k[j] in ("&&", "||")
                j = close.get(j, j) + 1
            out["go-if-err"] += not joined and j - at >= 3 and w[j - 1] == "nil" and k[j - 2] in ("==", "!=")
        elif x in ("defer", "go"):
            out["go-defer" if x == "defer" else "go-goroutine"] += 1
        elif x == "<-" and i and k[i - 1] in ("NAME", ")", "]") and k[i + 1] != "chan":
            out["go-channel-send"] += 1
    return out


def rust_counts(t: Tokens) -> dict[str, int]:
    """Rules of Rust over tokens."""
    k = t.kinds
    out = dict.fromkeys(RUST_RULES, 0)
    for i, x in enumerate(k[:-1]):
        before = k[i - 1] if i else ";"
        out["rust-try-operator"] += x == "?" and before in (")", "]", "}", "NAME", "await", "self", "NUM", "STR")
        out["rust-match"] += x == "match"
        out["rust-unsafe-block"] += x == "unsafe" and k[i + 1] == "{"
        out["rust-impl-block"] += x == "impl" and before in (";", "{", "}", "]", "unsafe", "default")
        out["rust-trait-def"] += x == "trait" and k[i + 1] == "NAME"
    return out


COUNTERS = {"typescript": script_counts, "javascript": script_counts, "go": go_counts, "rust": rust_counts}


def counted(text: str | None, language: str | None) -> dict[str, int]:
    """Rule matches of a text; blank texts and those that cannot be read have none."""
    if not text or not text.strip() or language not in LEXERS:
        return {}
    try:
        return python_counts(text) if language == "python" else COUNTERS[language](LEXERS[language](text))
    except (SyntaxError, ValueError, RecursionError, LexError):
        return {}


def rule_counts(files: DataFrame) -> DataFrame:
    """repo, file and the matches of each rule of its language (AGG-28, SCH-15), over the tokens or the syntax tree.

    Files that cannot be read and blank ones have an empty map. One narrow stage.
    """

    def count(content: pd.Series, language: pd.Series) -> pd.Series:
        return pd.Series([counted(c, x) for c, x in zip(content, language)], dtype=object)

    f = files.withColumn("language", T.lookup(T.EXTENSIONS, T.extension(F.col("file")))).filter(F.col("language").isin(*LEXERS))
    return spread(f).select("repo", "file", F.pandas_udf(count, "map<string,int>").asNondeterministic()("content", "language").alias("matches"))


def styled(files: DataFrame, signatures: DataFrame) -> DataFrame:
    """Error style, import style and type coverage from rule matches and expressions together (FN-25). signatures: repo, file, n, annotated.

    A throw with a try, a caught promise or a result type is mixed; dynamic imports, re-exports and requires count as
    imports of their kind, only dynamic ones are added to the number; of annotated and all functions the larger counts.
    Without matches the expressions stand alone.
    """
    r = rule_counts(files).withColumnRenamed("matches", "m")
    n = lambda rule: F.coalesce(F.try_element_at("m", F.lit(rule)), F.lit(0))
    j = files.select("repo", "file", "content").join(r, ["repo", "file"]).join(signatures, ["repo", "file"], "left")
    c, told = F.col("content"), F.size("m") > 0
    error, style, (esm, cjs) = T.error_style(c), T.import_style(c), T.import_count(c)
    also = (n("try-catch") > 0) | (n("promise-catch") > 0) | (error == "result")
    by_esm = F.when(style.isin("esm", "mixed"), esm + cjs).otherwise(0) + n("dynamic-import") + n("re-export")
    is_esm, is_cjs = (by_esm > 0) | style.isin("esm", "mixed"), (n("require") > 0) | style.isin("cjs", "mixed")
    annotated = F.greatest(F.coalesce("annotated", F.lit(0)), n("arrow-return-type") + n("function-return-type"))
    total = F.greatest(F.coalesce("n", F.lit(0)), n("arrow-total") + n("function-total"))
    return j.select(
        "repo", "file", F.when(told & (n("throw") > 0), F.when(also, "mixed").otherwise("throw")).otherwise(error).alias("error_style"),
        F.when(told & ((by_esm > 0) | (n("require") > 0)), F.when(is_esm & is_cjs, "mixed").when(is_esm, "esm").otherwise("cjs")).otherwise(style).alias("import_style"),
        (esm + cjs + F.when(told & ((by_esm > 0) | (n("require") > 0)), n("dynamic-import")).otherwise(0)).cast("bigint").alias("imports"),
        T.coverage_label(F.coalesce(F.try_divide(F.when(told, annotated).otherwise(F.coalesce("annotated", F.lit(0))), F.when(told, total).otherwise(F.coalesce("n", F.lit(0)))), F.lit(0.0))).alias("type_coverage"),
    )


def compared(facts_: DataFrame, peers: DataFrame) -> DataFrame:
    """A file's size and styles beside those of its peers (SCH-09, AGG-13). peers: repo, file, peer; equal files may repeat."""
    one = facts_.select("repo", "file", "lines", "import_style", "error_style")
    other = facts_.select("repo", F.col("file").alias("peer"), F.col("lines").alias("peer_lines"), F.col("import_style").alias("peer_import"), F.col("error_style").alias("peer_error"))
    g = one.join(peers, ["repo", "file"]).join(other, ["repo", "peer"]).groupBy("repo", "file", "lines").agg(
        F.count("*").alias("peers"), F.floor(F.avg("peer_lines") + 0.5).cast("bigint").alias("mean"),
        F.count_if(F.col("import_style") == F.col("peer_import")).alias("same_imports"), F.count_if(F.col("error_style") == F.col("peer_error")).alias("same_errors"),
    )
    share = F.try_divide(F.col("lines") - F.col("mean"), F.col("mean"))
    return g.withColumn("size", F.when(share > 0.2, "larger").when(share < -0.2, "smaller").otherwise("similar"))
