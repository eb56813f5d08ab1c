"""Git log text as rows: printing commits as a log and reading a log back by carrying headers forward."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.functions import text as T
from codeweft.operators.stats import delivered_once
from codeweft.session import spread

HEADER = r"^([0-9a-f]{7,40})\x{1f}(.*)$"


def numstat(line: Column) -> Column:
    """additions, deletions, path and previous path of a numstat line, renames plain and with braces (FN-14)."""
    p = F.split(line, "\t", 3)
    path = F.try_element_at(p, F.lit(3))
    brace = r"^(.*?)\{(.*?)\s*=>\s*(.*?)\}(.*)$"
    part = lambda n: F.regexp_extract(path, brace, n)
    tidy = lambda *c: F.regexp_replace(F.concat(*c), "/+", "/")
    plain = r"^(.+?)\s*=>\s*(.+)$"
    new = F.when(path.rlike(brace), tidy(part(1), part(3), part(4))).when(path.rlike(plain), F.trim(F.regexp_extract(path, plain, 2))).otherwise(path)
    old = F.when(path.rlike(brace), tidy(part(1), part(2), part(4))).when(path.rlike(plain), F.trim(F.regexp_extract(path, plain, 1)))
    count = lambda n: F.coalesce(F.expr(f"try_cast(split({{}}, '\\t')[{n}] AS BIGINT)".format("line")), F.lit(0))
    return F.struct(count(0).cast("bigint").alias("additions"), count(1).cast("bigint").alias("deletions"), new.alias("path"), old.alias("previous"))


def printed(commits: DataFrame) -> DataFrame:
    """repo and the log text of one commit a row, as a log with numstat prints it; the unit that a log is split into."""
    c = delivered_once(commits)
    line = lambda f: F.concat_ws("\t", F.coalesce(f.additions, F.lit(0)).cast("string"), F.coalesce(f.deletions, F.lit(0)).cast("string"), F.when((f.status == "renamed") & f.previous_path.isNotNull(), F.concat_ws(" => ", f.previous_path, f.path)).otherwise(f.path))
    body = F.array_join(F.transform("files", line), "\n")
    return c.select("repo", "hash", F.concat_ws("\n", F.concat("hash", F.lit("\x1f"), F.coalesce("author.date", F.lit(""))), body).alias("log"))


def parse_log(logs: DataFrame) -> DataFrame:
    """repo, hash, date, path, previous, additions and deletions of every file line of log texts (FN-16, WIN-09).

    Lines are rows; the header applies to the lines after it until the next one. A text is the unit of order, so the
    window is partitioned by text. Blank lines and lines before any header are dropped.
    """
    lines = spread(logs.select("repo", F.xxhash64("repo", "log").alias("text_id"), "log"), "text_id").select("repo", "text_id", F.posexplode(F.split("log", "\n")).alias("n", "line"))
    w = Window.partitionBy("repo", "text_id").orderBy("n")
    head = F.col("line").rlike(HEADER)
    lines = lines.withColumn("hash", F.last(F.when(head, F.regexp_extract("line", HEADER, 1)), ignorenulls=True).over(w)).withColumn("date", F.last(F.when(head, F.regexp_extract("line", HEADER, 2)), ignorenulls=True).over(w))
    files = lines.filter(~head & F.col("hash").isNotNull() & (F.size(F.split("line", "\t")) >= 3)).withColumn("s", numstat(F.col("line")))
    return files.select("repo", "hash", F.nullif("date", F.lit("")).alias("date"), "s.path", "s.previous", "s.additions", "s.deletions")


FIELD, RECORD = "\x1f", "\x1e"


def records(commits: DataFrame) -> DataFrame:
    """repo and the text of each commit as eleven separated fields, the record mark and its numstat lines (SRC-29)."""
    c = delivered_once(commits)
    text = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(""))
    head = F.concat_ws(FIELD, "hash", text("short_hash"), *[text(f"{who}.{x}") for who in ("author", "committer") for x in ("name", "email", "date")], text("subject"), text("body"), F.lit(""))
    line = lambda f: F.concat_ws("\t", F.coalesce(f.additions, F.lit(0)).cast("string"), F.coalesce(f.deletions, F.lit(0)).cast("string"), f.path)
    return c.select("repo", F.concat(head, F.lit(RECORD + "\n\n"), F.coalesce(F.array_join(F.transform("files", line), "\n"), F.lit(""))).alias("record"))


def parse_records(rows: DataFrame) -> DataFrame:
    """Commits of records (FN-15): fields, whole message, references, totals of the numstat lines; fewer than eleven fields give no row."""
    f = F.split(F.split("record", RECORD)[0], FIELD)
    lines = F.filter(F.split(F.coalesce(F.try_element_at(F.split("record", RECORD), F.lit(2)), F.lit("")), "\n"), lambda x: F.size(F.split(x, "\t")) >= 3)
    count = lambda n: F.aggregate(lines, F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(F.split(x, "\t")[n].try_cast("bigint"), F.lit(0)))
    r = rows.filter(F.size(f) >= 11)
    subject, body = f[8], f[9]
    message = F.when(body == "", subject).otherwise(F.concat(subject, F.lit("\n\n"), body))
    return r.select(
        "repo", f[0].alias("hash"), f[1].alias("short_hash"), f[2].alias("author_name"), f[3].alias("author_email"), f[4].alias("author_date"), subject.alias("subject"), message.alias("message"),
        T.issue_refs(message).alias("issue_refs"), T.pr_refs(message).alias("pr_refs"), count(0).alias("additions"), count(1).alias("deletions"), F.size(lines).cast("bigint").alias("files"), F.filter(F.split(f[10], " "), lambda x: x != "").alias("parents"),
    )


def selected(commits: DataFrame, since=None, until=None, author: str | None = None, path: str | None = None, merges: bool = True) -> DataFrame:
    """Commits of a log by its options (SRC-29): dates, a part of the author's name or address, a touched file or folder,
    and subjects that do not begin a merge. Filters reach the scan where they are plain."""
    c = commits
    if since is not None:
        c = c.filter(F.col("committed_at") >= F.lit(since))
    if until is not None:
        c = c.filter(F.col("committed_at") <= F.lit(until))
    if author is not None:
        c = c.filter(F.contains(F.concat_ws(" ", "author.name", "author.email"), F.lit(author)))
    if path is not None:
        c = c.filter(F.exists("files", lambda f: (f.path == path) | f.path.startswith(path.rstrip("/") + "/")))
    return c if merges else c.filter(~F.coalesce(F.col("subject").startswith("Merge "), F.lit(False)))


def blamed(commits: DataFrame) -> DataFrame:
    """file, n and text of porcelain blame lines: the subject and the lines of the body of each commit as its own lines of a file."""
    c = delivered_once(commits.select("repo", "hash", "author", "subject", "body", "committed_at", "ingested_at"))
    lines = F.split(F.concat_ws("\n", "subject", F.nullif("body", F.lit(""))), "\n")
    mark = lambda x, i: F.array(F.concat("hash", F.lit(" "), (i + 1).cast("string"), F.lit(" "), (i + 1).cast("string")), F.concat(F.lit("\t"), x))
    head = F.array(F.concat(F.lit("author "), F.coalesce("author.name", F.lit(""))), F.concat(F.lit("author-time "), F.coalesce(F.unix_seconds(F.col("committed_at").cast("timestamp")), F.lit(0)).cast("string")))
    text = F.flatten(F.transform(lines, lambda x, i: F.concat(F.slice(mark(x, i), 1, 1), head, F.slice(mark(x, i), 2, 1))))
    return c.select(F.concat_ws("/", "repo", "hash").alias("file"), F.posexplode(text).alias("n", "text"))


def parse_blame(blame: DataFrame) -> DataFrame:
    """file, line, hash, author, time and content of porcelain blame lines (FN-17). blame: file, n, text."""
    w = Window.partitionBy("file").orderBy("n")
    carry = lambda rx, g=1: F.last(F.when(F.col("text").rlike(rx), F.regexp_extract("text", rx, g)), ignorenulls=True).over(w)
    header = r"^([0-9a-f]{40}) \d+ (\d+)(?: \d+)?$"
    b = blame.withColumn("hash", carry(header)).withColumn("line", carry(header, 2).cast("bigint")).withColumn("author", carry("^author (.*)$")).withColumn("time", F.timestamp_seconds(carry(r"^author-time (\d+)$").cast("bigint")))
    return b.filter(F.col("text").startswith("\t")).select("file", "line", "hash", "author", "time", F.substring("text", F.lit(2), F.length("text")).alias("content"))
