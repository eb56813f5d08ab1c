"""Problem 5: functions paired with their documentation.

Files are lexed once and their tokens become rows. Windows over the rows do the rest: a running sum of brackets
gives the depth, windows per depth give the neighbours of a token among its siblings and the next closing
bracket or body, gaps and islands join comments to the token that follows them without a blank line, and lag
and lead windows read what stands before and after. All windows share one partitioning by file.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.llm import syntax
from codeweft.sources.lexers import LEXERS, LexError, Tokens
from codeweft.session import spread

TOKENS = "file_id bigint, copy bigint, language string, i int, k string, v string, line int, end_line int, a int, b int"
BATCH_ROWS = 50_000
#: Words that may stand before the word that names a function.
MODIFIERS = {
    "javascript": frozenset("export default async static public private protected readonly override abstract declare get set".split()),
    "rust": frozenset("pub const async unsafe extern default".split()),
    "python": frozenset(["async"]),
    "go": frozenset(),
}
MODIFIERS["typescript"] = MODIFIERS["javascript"]
SINGLE = frozenset("( ) [ ] { } ; : = => < > ?".split())
CALLS, BEFORE_NAME = frozenset("( < ? = =>".split()), frozenset("mod function const let var def func fn ) doc cmt dir attr".split())
WORDS = frozenset("function const let var def func fn class".split())
#: How comments begin that speak to tools.
DIRECTIVE = re.compile(r"(?://|/\*+|#)\s*(?:eslint|prettier|biome|@ts-|tslint|istanbul|c8 |v8 |webpack|jshint|jscs|noinspection|clang-format|rustfmt|cspell|nosec|noqa|pylint|type:|#\s*sourceMapping)|//(?:go:|nolint|line |export |lint:|\+build)|//#")


def condensed(text: str, language: str, t: Tokens) -> list[tuple]:
    """Rows of the structural tokens and comments; runs of other tokens become one row."""
    starts = [0] + [m.end() for m in re.finditer(r"\r\n|\r|\n", text)]
    line = lambda at: bisect.bisect_right(starts, at)
    out: list[tuple] = []
    put = lambda k, v, a, b: out.append((k, v, line(a), line(max(a, b - 1)), a, b))
    mods, n, i, ci = MODIFIERS[language], len(t.kinds) - 1, 0, 0
    comments = [] if language == "python" else t.comments
    kinds, words = t.kinds, t.words

    def closing(j: int) -> int:
        """Index after the bracket that closes the one at j."""
        depth = 0
        while j < n:
            depth += (kinds[j] in "([{") - (kinds[j] in ")]}") if len(kinds[j]) == 1 else 0
            j += 1
            if not depth:
                break
        return j

    while i <= n:
        while ci < len(comments) and comments[ci][0] < (t.starts[i] if i < n else len(text) + 1):
            a, b = comments[ci]
            c = text[a:b]
            alone = not text[starts[line(a) - 1] : a].strip()
            doc = c.startswith("/**") and not c.startswith("/***") and len(c) > 4 or language == "rust" and c.startswith("///") and not c.startswith("////")
            kind = "x" if not alone else "dir" if DIRECTIVE.match(c) else "doc" if doc and language != "go" or language == "go" else "cmt"
            if kind != "x" or not out or out[-1][0] != "x":
                put(kind, c if kind == "doc" else None, a, b)
            ci += 1
        if i == n:
            break
        k, w, a, b = kinds[i], words[i], t.starts[i], t.ends[i]
        after = kinds[i + 1]
        if language == "rust" and k == "#" and after in ("[", "!"):
            j = closing(i + 1 + (after == "!"))
            put("attr", None, a, t.ends[j - 1])
            i = j
            continue
        if language in ("javascript", "typescript") and k == "@":
            j = i + 2 if after != "(" else closing(i + 1)
            while j < n and kinds[j] == ".":
                j += 2
            if kinds[j] == "(" and after != "(":
                j = closing(j)
            put("attr", None, a, t.ends[j - 1])
            i = j
            continue
        if w in mods and k not in ("STR", "FSTR") and after not in ("(", "=", ":", ";", ",", ")", "?", ".", "<", "!", "=>"):
            put("mod", w, a, b)
        elif w == "pub" and k == "pub" and after == "(" and language == "rust":
            i = closing(i + 1)
            put("mod", w, a, t.ends[i - 1])
            continue
        elif language == "rust" and k == "STR" and out and out[-1][0] == "mod" and out[-1][1] == "extern":
            put("mod", w, a, b)
        elif k == "*" and (out and out[-1][0] in ("mod", "function") or after in ("NAME", "[")) and language in ("javascript", "typescript") and (not out or out[-1][0] in ("mod", "function", "{", "}", ";", "doc", "cmt", "dir", "attr")):
            if out and out[-1][0] != "function":
                put("mod", w, a, b)
        elif k in SINGLE or k in WORDS:
            put(k, None, a, b)
        elif k in ("NAME", "PRIV") and (after in CALLS or not out or out[-1][0] in BEFORE_NAME) or k in ("STR", "NUM") and after == "(" and language != "python":
            put("name", w, a, b)
        elif k == "STR" and language == "python" and (out and out[-1][0] in ("indent", "nl", ":", "str")):
            put("str", w if out[-1][0] != "str" else None, a, b)
        elif k in ("NEWLINE", "INDENT", "DEDENT"):
            put({"NEWLINE": "nl"}.get(k, k.lower()), None, a, b)
        elif not out or out[-1][0] != "x":
            put("x", None, a, b)
        i += 1
    return out


def read_by_rules(rows: list[tuple], language: str) -> list[tuple]:
    """The rows without those that no rule reads: the insides of brackets in which no function can begin, and of Python all but its def lines."""
    kinds = [r[0] for r in rows]
    n, close, stack = len(rows), {}, []
    for i, k in enumerate(kinds):
        if k in ("(", "[", "{"):
            stack.append(i)
        elif k in (")", "]", "}") and stack:
            close[stack.pop()] = i
    kind = lambda i: kinds[i] if i < n else ""
    if language == "python":
        keep: set[int] = set()
        for i in (i for i, k in enumerate(kinds) if k == "def"):
            j = i
            while j < n and kinds[j] != ":":
                keep.update((j, close.get(j, j)))
                j = close.get(j, j) + 1
            keep.update(range(j, min(n, j + 5)))
        return [rows[i] for i in sorted(keep)]

    def begins(i: int) -> bool:
        """Whether a function may begin here."""
        k = kinds[i]
        if language in ("go", "rust"):
            return k == ("func" if language == "go" else "fn")
        if k == "name":
            return kind(i + 1) in ("<", "?") or kind(i + 1) == "(" and kind(close.get(i + 1, n) + 1) in ("{", ":")
        if k not in ("const", "let", "var"):
            return k == "function"
        value = kind(i + 3)
        if kind(i + 2) != "=":
            return kind(i + 2) == ":"
        return value in ("<", "mod") or value == "(" and kind(close.get(i + 3, n) + 1) in ("=>", ":") or value == "name" and kind(i + 4) == "=>"

    holds, starts = set(), [i for i in range(n) if begins(i)]
    opened: list[int] = []
    at = iter([*starts, n])
    nxt = next(at)
    for i, k in enumerate(kinds):
        if i == nxt:
            nxt = next(at, n)
            for o in reversed(opened):
                if o in holds:
                    break
                holds.add(o)
        if i in close:
            opened.append(i)
        elif k in (")", "]", "}") and opened and close[opened[-1]] == i:
            opened.pop()
    out, i = [], 0
    while i < n:
        out.append(rows[i])
        i = close[i] if i in close and i not in holds else i + 1
    return out


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token rows of the files that parse, in small batches."""
    schema = pa.schema([("file_id", pa.int64()), ("copy", pa.int64()), ("language", pa.string()), ("i", pa.int32()), ("k", pa.string()), ("v", pa.string()), ("line", pa.int32()), ("end_line", pa.int32()), ("a", pa.int32()), ("b", pa.int32())])
    rows: list[tuple] = []
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    for b in batches:
        for file_id, copy, language, text in zip(*(b[c].to_pylist() for c in ("file_id", "copy", "language", "content"))):
            try:
                t = LEXERS[language](text)
                if not syntax.parsed(t, language)[0]:
                    continue
            except LexError:
                continue
            rows += [(file_id, copy, language, i, *r) for i, r in enumerate(read_by_rules(condensed(text, language, t), language))]
            if len(rows) >= BATCH_ROWS:
                yield batch()
                rows = []
    if rows:
        yield batch()


KEY = ("file_id", "copy")
NEAREST = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)


def token_rows(files: DataFrame) -> DataFrame:
    """Token rows of the valid files with depth, siblings and islands.

    Equal rows of a file meet in one window; their tokens are made single by position before anything is counted.
    """
    f = files.select("file_id", syntax.language_of(F.col("language"), F.col("file")).alias("language"), "content").filter(F.length("content") > 0)
    f = spread(f.filter(F.col("language").isin(*LEXERS))).withColumn("copy", F.xxhash64("language", "content"))
    t = f.select("file_id", "copy", "language", "content").mapInArrow(_tokens, TOKENS)
    t = t.withColumn("again", F.lag("i").over(Window.partitionBy(*KEY).orderBy("i")) == F.col("i")).filter("again IS NOT TRUE").drop("again")
    order = Window.partitionBy(*KEY).orderBy("i")
    opens, closes = F.col("k").isin("(", "[", "{").cast("int"), F.col("k").isin(")", "]", "}").cast("int")
    comment = lambda c: c.isin("doc", "cmt", "dir", "attr")
    before = F.lag("k").over(order)
    joined = comment(before) & (F.col("line") <= F.lag("end_line").over(order) + 1)
    t = t.withColumn("depth", F.sum(opens - closes).over(order) - opens)
    t = t.withColumn("gap", F.when(joined, 0).otherwise(1)).withColumn("island", F.sum("gap").over(order))
    for n in (1, 2, 3, 4):
        t = t.withColumn(f"k{n}", F.lead("k", n).over(order))
    t = t.withColumn("v1", F.lead("v", 1).over(order)).withColumn("v3", F.lead("v", 3).over(order))
    by = Window.partitionBy(*KEY, "depth")
    along, back = by.orderBy("i"), by.orderBy(F.desc("i"))
    for n in (1, 2, 3):
        t = t.withColumn(f"s{n}", F.lead("k", n).over(along))
    t = t.withColumn("sv1", F.lead("v", 1).over(along)).withColumn("sv3", F.lead("v", 3).over(along))
    nearest = lambda kinds, value: F.last(F.when(F.col("k").isin(*kinds), value), ignorenulls=True).over(NEAREST(back))
    t = t.withColumn("body", nearest(["{", ";", "=>", "}"], F.struct("k", "a")))
    t = t.withColumn("colon", nearest([":"], F.struct("a", "k1", "k2", "k3", "k4", "v1", "v3")))
    t = t.withColumn("close", nearest([")"], F.struct(F.col("s1").alias("after"), F.col("body.k").alias("body"), F.col("body.a").alias("body_a"), "colon")))
    t = t.withColumn("value", nearest(["="], F.struct("s1", "s2", "s3", "close")))
    return t.withColumn("word", F.last(F.when(F.col("k") != "mod", F.struct("k", "v", "line", "s1", "s2", "sv1", "sv3", "close", "value")), ignorenulls=True).over(NEAREST(back)))


def documented(t: DataFrame) -> DataFrame:
    """Functions with their raw documentation.

    Python: the string that opens the body; a string that goes on as an expression is none. Otherwise the comments
    joined by island to the function that they stand above. One aggregation by island serves both.
    """
    comment, python = F.col("k").isin("doc", "cmt", "dir", "attr"), F.col("language") == "python"
    rows = t.filter(F.when(python, F.col("k") == "def").otherwise(comment | (F.col("gap") == 0)))
    own = F.struct("k", "v", "line", "s1", "s2", "sv1", "sv3", "close", "value")
    rows = rows.withColumn("w", F.when(F.col("k") == "mod", F.col("word")).otherwise(own))
    g = rows.groupBy(*KEY, "language", "island").agg(
        F.max(F.when(~comment, F.struct("i", "depth", "a", "w", "v1"))).alias("head"),
        F.array_sort(F.collect_list(F.when(F.col("k").isin("doc", "cmt"), F.struct("i", "k", "v")))).alias("said"),
    ).filter(F.col("head").isNotNull() & (python | (F.size("said") > 0)))
    w, close = F.col("head.w"), F.col("head.w.close")
    value, script = F.col("head.w.value"), F.col("language").isin("javascript", "typescript")
    arrow = value.s1.isin("(", "<") & value.close.after.isin("=>", ":") | (value.s1 == "name") & (value.s2 == "=>") | value.s1.isin("name", "mod") & (value.s2.isin("(", "<") & value.close.after.isin("=>", ":") | (value.s2 == "name") & (value.s3 == "=>"))
    name = (
        F.when(script & (w.k == "function") & (close.body == "{"), F.coalesce(F.when(w.s1 == "name", w.sv1), F.lit("")))
        .when(script & w.k.isin("const", "let", "var") & (w.s1 == "name") & arrow, w.sv1)
        .when(script & (w.k == "name") & (w.s1.isin("(", "<") | (w.s1 == "?") & (w.s2 == "(")) & close.after.isin("{", ":") & (close.body == "{"), w.v)
        .when((F.col("language") == "go") & (w.k == "func") & (F.col("head.depth") == 0) & w.s1.isin("name", "("), F.when(w.s1 == "name", w.sv1).otherwise(w.sv3))
        .when((F.col("language") == "rust") & (w.k == "fn"), w.sv1)
        .when(python, F.col("head.v1"))
    )
    colon = close.colon
    ends = lambda k: k.isin("nl", ";", "str")
    opening = F.when((colon.k1 == "str") & ends(colon.k2), colon.v1).when((colon.k1 == "nl") & (colon.k2 == "indent") & (colon.k3 == "str") & ends(colon.k4), colon.v3)
    said = F.col("said")
    last_other = F.array_max(F.transform(F.filter(said, lambda s: s.k == "cmt"), lambda s: s.i))
    docs = F.filter(said, lambda s: last_other.isNull() | (s.i > last_other))
    docs = F.when(script, F.slice(docs, -1, 1)).otherwise(docs)
    raw = F.array_join(F.transform(docs, lambda s: s.v), "\n")
    raw = F.when(python, opening).when(F.size(docs) > 0, raw)
    end = F.when(python, colon.a).when(w.k.isin("const", "let", "var"), F.coalesce(value.close.body_a, close.body_a)).otherwise(close.body_a)
    return g.select(*KEY, "language", w.line.alias("start_line"), name.alias("name"), F.col("head.a").alias("a"), end.alias("b"), raw.alias("raw")).filter(F.col("name").isNotNull() & F.col("raw").isNotNull())


# How tags, lists of parameters and examples begin, notes of missing documentation, and small words.
SECTION = r"(?im)^[ \t]*(?:@[a-z]+|[:\\](?:param|parameter|arg|argument|key|keyword|return|returns|rtype|raise|raises|type|yield|yields|var|ivar)\b|(?:#+[ \t]*)?(?:args|arguments|parameters|params|returns?|raises|yields?|throws|errors|panics|safety|examples?|usage|attributes|see also)[ \t]*:?[ \t]*\r?$)"
NOTE = r"(?ism)^[ \t]*(?:todo|fixme|tbd|xxx)\b.*?(?=\n[ \t]*\r?\n|\z)|[^.\n]*\b(?:document(?:ation)? (?:this|me|to be (?:added|written|done)|(?:is )?(?:missing|pending)|will (?:be added|follow)|goes here|comes later)|to be documented|(?:needs|missing) (?:documentation|a docstring|a description)|write (?:the )?(?:docs|documentation)|add (?:docs|documentation|a docstring|a description))\b[^.\n]*\.?"
SMALL = "a an the this that these those it its is are be been was were will shall would can may does do did has have of to for from in on at by with and or as into function method helper class func fn def value values here we you i".split()


def running_text(raw: Column, language: Column) -> Column:
    """The doc without comment marks and quotes, up to the first tag, list or example; code blocks are left out."""
    py = F.regexp_replace(F.regexp_replace(raw, r"^[rRbBuU]*(?:\"\"\"|'''|\"|')", ""), r"(?:\"\"\"|'''|\"|')$", "")
    c = F.regexp_replace(F.regexp_replace(raw, r"(?m)^[ \t]*(?://[/!]?|/\*\*?)", ""), r"\*+/[ \t]*(?=\r?$|\r?\n)", "")
    c = F.when(raw.rlike(r"/\*"), F.regexp_replace(c, r"(?m)^[ \t]*\*(?!\*)[ ]?", "")).otherwise(F.regexp_replace(c, r"(?m)^ ", ""))
    return F.when(language == "python", py).otherwise(c)


def prose(doc: Column, language: Column) -> Column:
    """Running text of a documentation, without notes that it is still to be written."""
    d = F.regexp_replace(doc, r"(?s)(?:```|~~~).*?(?:```|~~~|$)", " ")
    d = F.regexp_replace(d, r"(?s)<(pre|code)>.*?</\1>", " ")
    d = F.regexp_replace(d, r"(?m)^[ \t]*(?:>>>|\.\.\. ).*$", " ")
    indented = F.regexp_replace(d, r"(?m)(^|\n)[ \t]*\r?\n((?: {4,}|\t)[^\n]*(?:\n|$))+", "\n")
    d = F.when(language.isin("go", "rust"), indented).otherwise(d)
    d = F.regexp_replace(F.substring_index(F.regexp_replace(d, SECTION, "\u0001"), "\u0001", 1), r"\{@[a-z]+ ([^}]*)\}", "$1")
    return F.regexp_replace(d, NOTE, "")


def stem(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), r"(?<=\p{L}{2})(?:ies|es|s|ed|ing|y|e)$", "")


def telling(text: Column, name: Column) -> Column:
    """At least five words, of which some are neither in the name nor small words."""
    words = F.regexp_extract_all(text, F.lit(r"(\p{L}[\p{L}\p{M}\p{N}_'’]*|[\p{IsHan}\p{IsHiragana}\p{IsKatakana}])"), F.lit(1))
    own = F.transform(F.regexp_extract_all(name, F.lit(r"(\p{Lu}?\p{Ll}+|\p{Lu}+(?!\p{Ll})|\p{L}+)"), F.lit(1)), stem)
    small = F.array(*[F.lit(x) for x in SMALL])
    parts = F.flatten(F.transform(words, lambda w: F.regexp_extract_all(w, F.lit(r"(\p{Lu}?\p{Ll}+|\p{Lu}+(?!\p{Ll})|\p{L}+|[^_])"), F.lit(1))))
    more = F.filter(parts, lambda p: ~F.array_contains(small, F.lower(p)) & ~F.array_contains(own, stem(p)))
    return (F.size(words) >= 5) & (F.size(more) >= 2)


def pairs(files: DataFrame, signatures: bool = True) -> DataFrame:
    """file_id, start_line, name, docstring and signature of every documented function.

    Files that do not parse, empty and null contents and other languages give no rows; equal rows of a file count once.
    Without signatures several functions on one line are one row. Documentation that is missing, trivial or a note is left out.
    """
    f = documented(token_rows(files))
    f = f.withColumn("docstring", F.trim(running_text(F.col("raw"), F.col("language"))))
    f = f.filter(telling(prose(F.col("docstring"), F.col("language")), F.col("name")))
    if not signatures:
        return f.select("file_id", "start_line").distinct()
    f = f.dropDuplicates([*KEY, "a"])
    source = files.select("file_id", syntax.language_of(F.col("language"), F.col("file")).alias("language"), "content").distinct()
    source = source.select("file_id", F.xxhash64("language", "content").alias("copy"), "content")
    f = f.join(source, [*KEY])
    cut = F.when(F.col("b") > F.col("a"), F.substring(F.col("content"), F.col("a") + 1, F.col("b") - F.col("a"))).otherwise(F.substring_index(F.substring(F.col("content"), F.col("a") + 1, F.length("content")), "\n", 1))
    return f.select("file_id", "start_line", "language", "name", F.trim(F.regexp_replace(cut, r"\s+", " ")).alias("signature"), "docstring")


def found(files: DataFrame) -> DataFrame:
    """file_id and start_line of every documented function."""
    return pairs(files, signatures=False)
