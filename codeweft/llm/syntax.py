"""Problem 2: source files that do not parse.

Every file is lexed and parsed by the packrat grammar of its language, which must consume the whole input;
the furthest failure position, its line and a cause are reported per file and rates per repository and
language. Parsing is one narrow stage over the scan; rates are one partially aggregated shuffle.
"""

from __future__ import annotations

import re
import sys

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.llm.grammars import grammar
from codeweft.sources.lexers import LEXERS, LexError, Tokens
from codeweft.session import spread

#: File extensions of the languages.
EXTENSIONS = {"py": "python", "ts": "typescript", "js": "javascript", "go": "go", "rs": "rust", "md": "markdown"}
#: Rules that may be open at once for each token; a parse can nest no deeper than its tokens, and its frames are on the heap.
FRAMES = 64
ERROR = "struct<position:int,line:int,token:string,cause:string>"
MARKER = re.compile(r"^(?:<{7}|={7}|>{7}|\|{7})(?: |\r?$)", re.M)


def language_of(language: Column, file: Column) -> Column:
    """Language as stated, in lower case; where it is null or blank, by the extension of the file."""
    ext = F.lower(F.regexp_extract(file, r"\.([A-Za-z0-9]+)$", 1))
    known = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return F.coalesce(F.nullif(F.lower(F.trim(language)), F.lit("")), known[ext])


def cause_of(text: str, at: int, said: str) -> str:
    """Why a file fails: what stands around the furthest position."""
    head = text[:200].lstrip()
    if head.startswith("version ") and "oid sha256" in text[:300] or head.startswith("version https://git-lfs"):
        return "pointer file"
    if re.match(r"<!doctype|<html", head, re.I):
        return "html page"
    if head.startswith("diff --git") or head.startswith("--- a/"):
        return "patch"
    if any(m.start() - 400 <= at <= m.end() + 400 for m in MARKER.finditer(text)):
        return "merge conflict"
    if "�" in text[:200] or re.search(r"[\x00-\x08]", text[:200]):
        return "binary data"
    if at >= len(text.rstrip()):
        return "truncated"
    return said


def parsed(t: Tokens, language: str) -> tuple[bool, int]:
    """Whether the tokens are a sentence of the language, and the furthest token; any depth of nesting is allowed."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 10_000 + FRAMES * len(t.kinds)))
    return grammar(language).parse(t.kinds, t.words, t.breaks)


def check(text: str, language: str) -> tuple | None:
    """None for a valid file, else position, line, token and cause of the furthest failure."""
    try:
        t = LEXERS[language](text)
        ok, far = parsed(t, language)
        if ok:
            return None
        at, token, said = t.starts[far], t.words[far] or t.kinds[far], "unexpected token"
    except LexError as e:
        at, token, said = e.at, text[e.at : e.at + 1], e.cause
    return at, len(re.findall(r"\r\n|\r|\n", text[:at])) + 1, token[:40], cause_of(text, at, said)


def errors(content: Column, language: Column) -> Column:
    """Struct of the furthest failure, its fields null where the content parses."""

    def judge(contents: pd.Series, languages: pd.Series) -> pd.DataFrame:
        rows = [check(c, x) if c and x in LEXERS else None for c, x in zip(contents, languages)]
        return pd.DataFrame([r or (None, None, None, None) for r in rows], columns=["position", "line", "token", "cause"]).astype({"position": "Int32", "line": "Int32"})

    # not to be evaluated twice when a filter meets its result
    return F.pandas_udf(judge, ERROR).asNondeterministic()(content, language)


def checked(files: DataFrame) -> DataFrame:
    """Each file of the five languages with the error of its content, null where it parses.

    Null and empty contents and other languages have no error. Repeated rows are judged each by itself;
    other columns are kept.
    """
    known = files.withColumn("language", language_of(F.col("language"), F.col("file")))
    return spread(known).withColumn("error", errors(F.col("content"), F.col("language")))


def syntax_errors(files: DataFrame) -> DataFrame:
    """file_id, repo, file, language, position, line, token and cause of the files that do not parse."""
    bad = checked(files.select("file_id", "repo", "file", "language", "content")).filter(F.col("error.position").isNotNull())
    return bad.select("file_id", "repo", "file", "language", "error.*")


def found(files: DataFrame) -> DataFrame:
    """file_id of the files that do not parse."""
    return syntax_errors(files).select("file_id")


def rates(files: DataFrame) -> DataFrame:
    """Files, failures, their rate and the failures by conflict per repository and language.

    Markdown and unknown languages are left out. A null repo is a group of its own.
    """
    c = checked(files.select("repo", "file", "language", "content")).filter(F.col("language").isin(*LEXERS))
    bad = F.col("error.position").isNotNull()
    g = c.groupBy("repo", "language").agg(
        F.count("*").alias("files"), F.count_if(bad).alias("failed"),
        F.count_if(F.col("error.cause") == "merge conflict").alias("conflicts"), F.count_if(F.col("error.cause") == "truncated").alias("truncated"),
    )
    return g.withColumn("rate", F.col("failed") / F.col("files"))
