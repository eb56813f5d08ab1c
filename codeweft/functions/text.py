"""Column functions: text, paths, tokens, styles. Null in, null out unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as scripts trim it; the same class in every engine.
WS = r"[\t\n\x0B\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"

# Languages by extension.
EXTENSIONS = {"ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "go": "go", "py": "python", "rs": "rust", "md": "markdown", "mdx": "markdown"}
INDEXABLE = ("ts", "tsx", "js", "jsx", "mjs", "cjs", "go", "py", "rs", "md", "mdx", "markdown")


def lookup(mapping: dict, key: Column) -> Column:
    """Literal lookup (FN-21, FN-26); unknown keys give null."""
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[key]


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def collapsed(c: Column) -> Column:
    return F.regexp_replace(trimmed(c), f"{WS}+", " ")


def estimate_tokens(c: Column) -> Column:
    """Tokens of a text: the larger of characters / 4.5 and words * 1.25, rounded up (FN-01)."""
    t = collapsed(c)
    words = F.size(F.split(t, " "))
    return F.when(t == "", 0).otherwise(F.greatest(F.ceil(F.length(t) / 4.5), F.ceil(words * 1.25))).cast("bigint")


def truncate_to_budget(c: Column, budget: int) -> Column:
    """The text, or its first budget * 4 - 3 characters and dots where it is over the budget (FN-02)."""
    return F.when(estimate_tokens(c) <= budget, c).otherwise(F.concat(F.substring(c, 1, budget * 4 - 3), F.lit("...")))


def truncate_text(c: Column, width: int) -> Column:
    """FN-06."""
    return F.when(F.length(c) <= width, c).otherwise(F.concat(F.substring(c, 1, width - 3), F.lit("...")))


def clean_text(c: Column) -> Column:
    """Runs of blanks become one, three and more line breaks two, ends are trimmed (FN-07)."""
    return trimmed(F.regexp_replace(F.regexp_replace(c, " +", " "), "\n{3,}", "\n\n"))


def slugify(c: Column) -> Column:
    """FN-08."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def normalize_remote(c: Column) -> Column:
    """owner/repo of the usual notations of a git remote, in lower case (FN-09)."""
    ssh = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "^git@", ""), r"\.git$", ""), "^[^:]*:", "")
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "^(?:https?://|ssh://git@)", ""), r"/$", ""), r"\.git$", "")
    return F.lower(F.when(c.startswith("git@"), ssh).otherwise(F.regexp_replace(plain, "^[^/]*/(?=.)", "")))


def storage_key(c: Column) -> Column:
    """First eight hexadecimal digits of the MD5 (FN-10)."""
    return F.substring(F.md5(c), 1, 8)


def remote_part(c: Column, part: int) -> Column:
    """Owner (1) or name (2) of a remote, case kept (FN-12)."""
    return F.nullif(F.regexp_extract(c, r"^(?:git@[^:]+:|\w+://[^/]+/)([^/]+)/(.+?)(?:\.git)?/?$", part), F.lit(""))


def pr_refs(c: Column) -> Column:
    """Distinct pull request numbers in order (FN-13); none gives an empty list."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?i)(?:\bPR\s*#|pull\s+request\s*#)([0-9]+)"), F.lit(1)), lambda x: x.cast("bigint")))


def issue_refs(c: Column) -> Column:
    """Distinct issue numbers in order, without those of pull requests (FN-13)."""
    rest = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)(?:\bPR\s*#|pull\s+request\s*#)[0-9]+", "")
    found = F.array_distinct(F.transform(F.regexp_extract_all(rest, F.lit("#([0-9]+)"), F.lit(1)), lambda x: x.cast("bigint")))
    return F.array_except(found, pr_refs(c))


def dirname(c: Column) -> Column:
    """Folder of a path, '.' at the top (FN-20)."""
    return F.when(F.contains(c, F.lit("/")), F.regexp_replace(c, "/[^/]*$", "")).otherwise(F.lit("."))


def basename(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def extension(c: Column) -> Column:
    """Lower-case extension without the dot, empty without one."""
    return F.lower(F.regexp_extract(c, r"\.([A-Za-z0-9]+)$", 1))


def language_of(language: Column, path: Column) -> Column:
    """Language in lower case; where it is null or blank by the extension, else unknown (FN-21)."""
    return F.coalesce(F.nullif(F.lower(F.trim(language)), F.lit("")), lookup(EXTENSIONS, extension(path)), F.lit("unknown"))


def strip_focus(path: Column, focus: str) -> Column:
    """Path below a folder; others are left alone (FN-18)."""
    f = focus.rstrip("/")
    return F.when(path.startswith(f + "/"), F.substring(path, F.lit(len(f) + 2), F.length(path))).otherwise(path)


def common_prefix(paths: Column) -> Column:
    """Deepest folder that all paths of an array share, empty where it has fewer than two parts (FN-19)."""
    parts = F.transform(paths, lambda p: F.slice(F.split(p, "/"), 1, F.greatest(F.size(F.split(p, "/")) - 1, F.lit(0))))
    n = F.aggregate(parts, F.lit(1 << 30), lambda a, p: F.least(a, F.size(p)))
    same = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: (k <= n) & F.forall(parts, lambda p: F.slice(p, 1, k) == F.slice(parts[0], 1, k)))
    depth = F.coalesce(F.array_max(same), F.lit(0))
    return F.when(depth >= 2, F.array_join(F.slice(parts[0], 1, depth), "/")).otherwise(F.lit(""))


def is_test_file(path: Column) -> Column:
    """Test files by the habits of each language (FLT-11)."""
    ext, name = extension(path), basename(path)
    return (
        F.when(ext == "go", path.endswith("_test.go"))
        .when(ext == "py", name.startswith("test_") | name.endswith("_test.py") | (name == "conftest.py"))
        .when(ext == "rs", F.contains(path, F.lit("/tests/")) | name.endswith("_test.rs"))
        .otherwise(F.contains(path, F.lit(".test.")) | F.contains(path, F.lit(".spec.")))
    )


def test_candidates(path: Column) -> Column:
    """Where the test of a source file may be, best first (JN-13)."""
    ext, base, name = extension(path), F.regexp_replace(path, r"\.[^./]*$", ""), F.regexp_replace(basename(path), r"\.[^./]*$", "")
    folder = F.when(F.contains(path, F.lit("/")), F.concat(dirname(path), F.lit("/"))).otherwise(F.lit(""))
    parent = F.when(F.contains(dirname(path), F.lit("/")), F.concat(dirname(dirname(path)), F.lit("/"))).otherwise(F.lit(""))
    return (
        F.when(ext == "py", F.array(F.concat(folder, F.lit("test_"), name, F.lit(".py")), F.concat(folder, name, F.lit("_test.py"))))
        .when(ext == "rs", F.array(F.concat(parent, F.lit("tests/"), name, F.lit(".rs")), F.concat(folder, name, F.lit("_test.rs"))))
        .when(ext == "go", F.array(F.concat(base, F.lit("_test.go"))))
        .otherwise(F.array(F.concat(base, F.lit(".test."), ext), F.concat(base, F.lit(".spec."), ext)))
    )


# Patterns of import styles, error styles and annotated signatures.
ESM, CJS = r"(?m)^import\s", r"require\s*\("
THROWN, RESULT = r"throw\s+new\s+\w*Error", r"Result<|\{\s*ok:\s*(?:true|false)"
ANNOTATED = r"(?:\)|=>)\s*(?::|->)\s*\w+"
#: Errors as second values: also a named result list and a result list before a body.
ERROR_RETURN = r"\)\s*:\s*\([^)]*,\s*error\)|\([^()]*,\s*error\)\s*\{"


def import_count(c: Column) -> tuple[Column, Column]:
    """Counts of module imports and of require calls (FN-22)."""
    return F.regexp_count(c, F.lit(ESM)), F.regexp_count(c, F.lit(CJS))


def import_style(c: Column) -> Column:
    esm, cjs = import_count(c)
    return F.when((esm > 0) & (cjs > 0), "mixed").when(esm > 0, "esm").when(cjs > 0, "cjs").otherwise("unknown")


def error_style(c: Column) -> Column:
    """How errors are told: thrown, as results, as second values, mixed or unknown (FN-23)."""
    kinds = [F.regexp_count(c, F.lit(p)) for p in (THROWN, RESULT, ERROR_RETURN)]
    used = sum((k > 0).cast("int") for k in kinds)
    return F.when(used == 0, "unknown").when(used > 1, "mixed").when(kinds[0] > 0, "throw").when(kinds[1] > 0, "result").otherwise("error-return")


def annotated(signature: Column) -> Column:
    """Whether a signature tells its result type (FN-24)."""
    return signature.rlike(ANNOTATED)


def coverage_label(ratio: Column) -> Column:
    return F.when(ratio >= 0.9, "full").when(ratio >= 0.5, "partial").when(ratio > 0, "minimal").otherwise("none")


def numeric_diff(before: Column, after: Column) -> tuple[Column, Column]:
    """Absolute and percent change; percent is 100 from zero and 0 between zeros (FN-27)."""
    pct = F.when((before == 0) & (after == 0), 0.0).when(before == 0, 100.0).otherwise((after - before) * 100.0 / F.nullif(before, F.lit(0)))
    return after - before, F.round(pct, 2)


def document_text(type_: Column, name: Column, text: Column, separator: str = "\n\n") -> Column:
    """type: name, then the text; empty parts are left out (PRJ-02)."""
    head = F.when(F.coalesce(name, F.lit("")) != "", F.concat(type_, F.lit(": "), name))
    return F.concat_ws(separator, head, F.nullif(text, F.lit("")))


def truncated_snippet(c: Column, lines: int = 50, mark: str = "//") -> Column:
    """First lines of a snippet and a note of how many more there are (PRJ-05)."""
    parts = F.split(c, "\n")
    note = F.concat(F.lit(f"\n{mark} ... "), (F.size(parts) - lines).cast("string"), F.lit(" more lines"))
    return F.when(F.size(parts) <= lines, c).otherwise(F.concat(F.array_join(F.slice(parts, 1, lines), "\n"), note))


def lines_between(c: Column, first: Column, last: Column) -> Column:
    """Lines of a text from first to last, both counted from 1 (FN-43)."""
    parts = F.split(c, "\n")
    return F.when((first >= 1) & (last >= first), F.array_join(F.slice(parts, first, last - first + 1), "\n")).otherwise(F.lit(""))


def human_bytes(c: Column) -> Column:
    """FN-36: powers of 1024 with one decimal."""
    size = lambda power, unit: F.concat(F.format_number(c / 1024**power, 1), F.lit(f" {unit}"))
    return F.when(c < 1024, F.concat(c.cast("bigint").cast("string"), F.lit(" B"))).when(c < 1024**2, size(1, "KB")).when(c < 1024**3, size(2, "MB")).otherwise(size(3, "GB"))


def human_duration(ms: Column) -> Column:
    """FN-36: milliseconds, seconds with two decimals, or minutes and seconds."""
    minutes = F.concat(F.floor(ms / 60000).cast("string"), F.lit("m "), F.floor(ms / 1000 % 60).cast("string"), F.lit("s"))
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).when(ms < 60000, F.format_string("%.2fs", ms / 1000)).otherwise(minutes)


def human_age(at: Column, now: Column) -> Column:
    """FN-36: minutes, hours or days before now, the date from a week on."""
    m = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / 60_000_000)
    said = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))
    hours, days = F.floor(m / 60), F.floor(m / 1440)
    return F.when(m < 1, "just now").when(m < 60, said(m, "minute")).when(m < 1440, said(hours, "hour")).when(m < 10080, said(days, "day")).otherwise(F.date_format(at, "yyyy-MM-dd"))


def source_path(c: Column) -> Column:
    """Path of the source a built file stands for (SRC-10): dist to src, declaration and script files to their source."""
    p = F.regexp_replace(c, "(^|/)dist/", "$1src/")
    return F.regexp_replace(F.regexp_replace(p, r"\.d\.ts$", ".ts"), r"\.js$", ".ts")


def go_exported(name: Column) -> Column:
    """Whether the first letter is a capital (SRC-13)."""
    first = F.substring(name, 1, 1)
    return (F.upper(first) == first) & (F.lower(first) != first)


def go_type_parameters(signature: Column) -> Column:
    """Names and bounds in the first brackets of a signature, an empty list without any (SRC-14)."""
    inside = F.regexp_extract(signature, r"\[([^\]]*)\]", 1)
    return F.when(inside == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(inside, ","), lambda x: F.trim(x)))


# Marks of generated files, case and all.
GO_GENERATED = ("Code generated", "DO NOT EDIT")
PY_GENERATED = ("# Generated by", "# DO NOT EDIT", "# Auto-generated")


def is_generated(path: Column, content: Column) -> Column:
    """Files that scanners of Go and Python leave out as generated or as migrations (SRC-12, SRC-22)."""
    head = F.array_join(F.slice(F.split(content, "\n"), 1, 3), "\n")
    go = F.substring_index(content, "\n", 1).rlike("|".join(GO_GENERATED))
    py = path.rlike(r"_pb2(?:_grpc)?\.py$|/migrations/|/versions/") | head.rlike("|".join(PY_GENERATED))
    return F.when(extension(path) == "go", go).when(extension(path) == "py", py).otherwise(False)
