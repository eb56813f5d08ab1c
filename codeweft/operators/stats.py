"""Statistics of the index and their comparison, change frequency, request metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweft.functions import text as T
from codeweft.session import cut

#: Lines of a component, 0 where they are unknown.
LINES = "sum(coalesce(greatest(end_line - start_line + 1, 0), 0))"


def by_language(c: DataFrame) -> DataFrame:
    """Files, components and lines per language; a file counts once, under the language of its first row (AGG-01)."""
    first = F.row_number().over(Window.partitionBy("path").orderBy("ord")) == 1
    return c.withColumn("first", first).groupBy("language").agg(F.count_if("first").alias("files"), F.count("*").alias("components"), F.expr(LINES).cast("bigint").alias("lines"))


def by_type(c: DataFrame) -> DataFrame:
    """AGG-02."""
    return c.groupBy("type").agg(F.count("*").alias("components"))


def packages_of(paths: DataFrame, packages: DataFrame, path: str = "path") -> DataFrame:
    """Longest package whose folder holds the path (JN-10): an equi join on every prefix, no nested loop."""
    p = paths.withColumn("prefix", F.explode(ancestors(F.col(path))))
    return p.join(packages.select(F.col("package").alias("prefix")).distinct(), "prefix").groupBy(path).agg(F.max_by("prefix", F.length("prefix")).alias("package"))


def ancestors(path):
    """Folders above a path, from the top."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def by_package(c: DataFrame, packages: DataFrame) -> DataFrame:
    """Files, components and languages per package (AGG-03)."""
    p = packages_of(c.filter(F.contains("path", F.lit("/"))).select("path").distinct(), packages)
    return c.join(p, "path").groupBy("package").agg(F.countDistinct("path").alias("files"), F.count("*").alias("components"), F.countDistinct("language").alias("languages"))


def cardinalities(c: DataFrame) -> DataFrame:
    """AGG-04."""
    return c.agg(*[F.countDistinct(x).alias(f"{x}s") for x in ("language", "type", "path", "repo")])


def with_totals(c: DataFrame) -> DataFrame:
    """Components per language and type with subtotals and shares (AGG-23, AGG-25)."""
    r = c.rollup("language", "type").agg(F.count("*").alias("components"), F.expr(LINES).cast("bigint").alias("lines"))
    total = F.max("components").over(Window.partitionBy())  # the rolled-up table: languages times types
    return r.withColumn("share", F.round(F.col("components") * 100.0 / total, 1)).select(F.coalesce("language", F.lit("(all)")).alias("language"), F.coalesce("type", F.lit("(all)")).alias("type"), "components", "lines", "share")


def compare(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Values of two snapshots by key, their difference and what was added or removed (JN-07, JN-08, FN-27, FN-28)."""
    j = before.select(key, F.col(value).alias("before")).join(after.select(key, F.col(value).alias("after")), key, "full")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("common")
    j = j.withColumn("change", change).na.fill(0, ["before", "after"])
    absolute, percent = T.numeric_diff(F.col("before"), F.col("after"))
    trend = F.when(absolute > 10, "growing").when(absolute < -10, "shrinking").otherwise("stable")
    return j.withColumn("absolute", absolute).withColumn("percent", percent).withColumn("trend", trend)


def export_long(c: DataFrame, packages: DataFrame) -> DataFrame:
    """Statistics as rows of category, subcategory, metric and value, ready for CSV (SNK-08); commas of package names become semicolons."""
    lang = by_language(c)
    unpivot = lambda d, category, key, metrics: d.unpivot([key], metrics, "metric", "value").select(F.lit(category).alias("category"), F.col(key).alias("subcategory"), "metric", F.col("value").cast("bigint").alias("value"))
    overview = lang.agg(*[F.sum(x).alias(x) for x in ("files", "components", "lines")]).withColumn("all", F.lit("all"))
    return unpivot(overview, "overview", "all", ["files", "components", "lines"]).unionByName(unpivot(lang, "language", "language", ["files", "components", "lines"])).unionByName(unpivot(by_type(c), "component", "type", ["components"])).unionByName(
        unpivot(packages.withColumn("package", F.replace("package", F.lit(","), F.lit(";"))), "package", "package", ["files", "components", "languages"])
    )


def to_json_rows(d: DataFrame, key: str) -> DataFrame:
    """One JSON object a row (SNK-07)."""
    return d.select(key, F.to_json(F.struct(*sorted(d.columns))).alias("json"))


def markdown_table(d: DataFrame, key: str = "language", metrics: list[str] = ("files", "components", "lines")) -> DataFrame:
    """Statistics by language or package as lines of a Markdown table, most components first (SNK-09, SRT-07); one row a group."""
    row = F.format_string("| %s |" + " %d |" * len(metrics), key, *metrics)
    return d.select(F.row_number().over(Window.orderBy(F.desc("components"), key)).cast("bigint").alias("line"), row.alias("text"))


# ---------------------------------------------------------------- change frequency


def delivered_once(commits: DataFrame) -> DataFrame:
    """Each commit of a repository once, as it was delivered first; of deliveries at one time the one of the least hash."""
    rest = [c for c in commits.columns if c not in ("repo", "hash")]
    return commits.groupBy("repo", "hash").agg(F.min_by(F.struct(*rest), F.struct("ingested_at", F.xxhash64(*rest))).alias("c")).select("repo", "hash", "c.*")


def file_changes(commits: DataFrame) -> DataFrame:
    """One row per commit and touched file; commits that were delivered twice count once (AGG-05 input)."""
    c = delivered_once(commits.select("repo", "hash", "committed_at", "ingested_at", F.col("author.email").alias("author"), "files"))
    return c.select("repo", "hash", "committed_at", F.lower("author").alias("author"), F.explode("files").alias("f")).select(
        F.concat_ws("/", "repo", "f.path").alias("path"), "repo", "hash", "committed_at", "author", F.col("f.additions").alias("additions"), F.col("f.deletions").alias("deletions"), F.col("f.status").alias("status"),
    )


def change_frequency(changes: DataFrame) -> DataFrame:
    """Commits, latest date and distinct authors per file (AGG-05, SRC-31)."""
    return changes.groupBy("path").agg(F.countDistinct("hash").alias("commits"), F.max("committed_at").alias("last_change"), F.countDistinct("author").alias("authors"))


def frequency_by(frequency: DataFrame, group) -> DataFrame:
    """Files, commits, commits per file and latest date per group (AGG-06, AGG-07, JN-11)."""
    return frequency.groupBy(group.alias("grp")).agg(
        F.count("*").alias("files"), F.sum("commits").cast("bigint").alias("commits"), F.round(F.sum("commits") / F.count("*"), 6).alias("per_file"), F.max("last_change").alias("last_change"),
    )


def directory_frequency(changes: DataFrame, now) -> DataFrame:
    """Commits of the last 30 and 90 days before a given time per folder, over one grouped log (AGG-08)."""
    age = lambda days: F.col("committed_at") >= F.lit(now) - F.expr(f"interval {days} days")
    recent = changes.filter(age(90) & (F.col("committed_at") <= F.lit(now)))
    d = recent.select("repo", "hash", "committed_at", F.explode(ancestors(F.col("path"))).alias("path")).groupBy("path", "repo", "hash").agg(F.max("committed_at").alias("committed_at"))
    return d.groupBy("path").agg(F.count_if(age(30)).alias("last_30"), F.count("*").alias("last_90"), F.max("committed_at").alias("last_commit"))


def commit_stats(commits: DataFrame) -> DataFrame:
    """Added and deleted lines and files of each commit, inside its row (AGG-27)."""
    total = lambda x: F.aggregate(F.coalesce("files", F.array().cast("array<struct<path:string,previous_path:string,status:string,additions:int,deletions:int>>")), F.lit(0).cast("bigint"), lambda a, f: a + F.coalesce(f[x], F.lit(0)))
    return delivered_once(commits.select("repo", "hash", "ingested_at", "files")).select("repo", "hash", total("additions").alias("additions"), total("deletions").alias("deletions"), F.greatest(F.size("files"), F.lit(0)).cast("bigint").alias("files"))


# ---------------------------------------------------------------- requests


def request_metrics(requests: DataFrame, *group: str) -> DataFrame:
    """Requests, failures, rounded mean and nearest-rank percentiles of the duration (AGG-16); a row of zeros when empty.

    Percentiles are read from counts of equal durations, sorted by range over all tasks: a value's rank is its place in
    its partition and the rows of the partitions and groups before, of which there is one sum each. No task holds the
    values of a group.
    """
    ranks = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    g = list(group)
    out = requests.groupBy(*g).agg(
        F.count("*").alias("total"), F.count_if("failed").alias("failed"), F.count_if(~F.col("failed")).alias("success"),
        F.floor(F.coalesce(F.avg("duration"), F.lit(0.0)) + 0.5).cast("bigint").alias("mean"),
    )
    counts = requests.filter("duration IS NOT NULL").groupBy(*g, "duration").agg(F.count("*").alias("n")).orderBy(*g, "duration")
    placed = cut(counts.withColumn("p", F.spark_partition_id()))
    sums = lambda keys: placed.groupBy(*keys).agg(F.sum("n").alias("rows"))
    parts = sums(["p"]).select("p", (F.sum("rows").over(Window.orderBy("p")) - F.col("rows")).alias("before"))  # one row a partition
    groups = sums(g).withColumn("below", F.sum("rows").over(Window.orderBy(*g)) - F.col("rows") if g else F.lit(0))  # one row a group
    w = Window.partitionBy("p").orderBy(*g, "duration")
    run = placed.withColumn("local", F.sum("n").over(w)).join(F.broadcast(parts), "p")
    same = lambda x, y: F.expr(" AND ".join(f"{x}.{c} <=> {y}.{c}" for c in g))
    run = run.alias("r").join(groups.alias("s"), same("r", "s")) if g else run.alias("r").crossJoin(F.broadcast(groups).alias("s"))
    run = run.select("r.*", "s.rows", (F.col("local") + F.col("before") - F.col("below")).alias("upto"))
    at = run.groupBy(*g).agg(*[F.min(F.when(F.col("upto") >= F.ceil(F.lit(q) * F.col("rows")), F.col("duration"))).alias(c) for c, q in ranks.items()])
    j = out.alias("o").join(at.alias("a"), same("o", "a"), "left") if g else out.alias("o").crossJoin(F.broadcast(at).alias("a"))
    return j.select("o.*", *[F.coalesce(f"a.{c}", F.lit(0.0)).cast("double").alias(c) for c in ranks])


def last_n(rows: DataFrame, n: int, *order) -> DataFrame:
    """The n latest rows, oldest first: a distributed top-n (WIN-05, WIN-06)."""
    return rows.orderBy(*[o.desc() for o in order]).limit(n).orderBy(*order)


def debounced(events: DataFrame, gap: str) -> DataFrame:
    """Batches of events with less quiet than gap between them, per key, the last state of each path (STM-01, STM-02).

    events: key, path, kind, ts, seq. Works on tables and streams alike.
    """
    per = events.groupBy("key", "path", F.session_window("ts", gap).alias("w")).agg(F.max_by("kind", F.struct("ts", "seq")).alias("kind"), F.count("*").alias("events"))
    return per.select("key", "path", F.col("w.start").alias("started"), "kind", "events")


def paired_requests(events: DataFrame) -> DataFrame:
    """Started and ended requests paired by id, unknown ids left out (STM-08). events: id, phase, ts."""
    e = events.groupBy("id").agg(F.min(F.when(F.col("phase") == "started", F.col("ts"))).alias("started"), F.max(F.when(F.col("phase") != "started", F.col("ts"))).alias("ended"))
    return e.filter("started IS NOT NULL AND ended IS NOT NULL")


def folder_sizes(files: DataFrame) -> DataFrame:
    """Bytes and files below every folder (AGG-29). files: path, size_bytes; unknown sizes count as 0."""
    up = files.select(F.coalesce("size_bytes", F.lit(0)).alias("size"), F.explode(ancestors(F.col("path"))).alias("path"))
    return up.groupBy("path").agg(F.sum("size").cast("bigint").alias("bytes"), F.count("*").alias("files"))


def errors_by_phase(scanned: DataFrame) -> DataFrame:
    """Error rows of a scan by their kind (AGG-26)."""
    return scanned.filter("type = 'error'").groupBy(F.substring_index("error", ":", 1).alias("phase")).agg(F.count("*").alias("errors"))


def term_insights(docs: DataFrame, terms: list[str], limit: int = 10) -> DataFrame:
    """Documents that hold each term and the first sources of them (AGG-20): one scan for all terms."""
    hit = docs.select("doc_id", "source", F.explode(F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(F.lower("text"), t))).alias("term"))
    first = hit.groupBy("term", "source").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    w = Window.partitionBy("term")
    first = first.withColumn("rank", F.row_number().over(w.orderBy("first"))).withColumn("hits", F.sum("n").over(w))
    return first.filter(F.col("rank") <= limit).select("term", F.col("hits").cast("bigint").alias("hits"), F.col("rank").cast("bigint").alias("rank"), "source")


def store_stats(components: DataFrame, vectors: DataFrame) -> DataFrame:
    """Rows, vectors, dimension and models of the store (AGG-24)."""
    v = vectors.agg(F.count("vector").alias("vectors"), F.max(F.size("vector")).cast("bigint").alias("dimension"), F.countDistinct("model").alias("models"))
    return components.agg(F.count("*").alias("documents")).crossJoin(v)  # one row each


def by_path(c: DataFrame) -> DataFrame:
    """Rows of each file in order, as a count and the first and last names (JN-09)."""
    return c.groupBy("path").agg(F.count("*").alias("rows"), F.min_by("name", "ord").alias("first"), F.max_by("name", "ord").alias("last"))
