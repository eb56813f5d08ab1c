"""The queries over the operators and their SQL. Every query reads whole tables of the data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeweft.functions import text as T
from codeweft.operators import graph, index, patterns, refs, search, stats, tree
from codeweft.session import cut, table
from codeweft.sources import gitlog, markdown, scanner
from codeweft.streaming import folds

QUERIES: dict = {}
ORACLES: dict = {}

WS = T.WS
C = """c AS (
    SELECT * EXCLUDE (rn, language), coalesce(nullif(lower(trim(language)), ''), CASE regexp_extract(file, '\\.([A-Za-z0-9]+)$', 1)
        WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'go' THEN 'go' WHEN 'rs' THEN 'rust' WHEN 'md' THEN 'markdown' ELSE 'unknown' END) AS language
    FROM (SELECT *, repo || '/' || file AS path, row_number() OVER (PARTITION BY repo, id ORDER BY indexed_at DESC NULLS LAST, ord DESC) AS rn FROM components) WHERE rn = 1)"""
CALLS = C + """, k AS (SELECT ord, repo, path, name, type, unnest(callees) AS e, generate_subscripts(callees, 1) - 1 AS pos FROM c),
    calls AS (SELECT CASE WHEN e.file IS NOT NULL THEN repo || '/' || e.file || ':' || e.name ELSE e.name END AS callee_key, e.name AS callee,
        coalesce(name, 'unknown') AS caller, path AS file, CAST(e.line AS BIGINT) AS line, coalesce(type, 'unknown') AS type, ord, CAST(pos AS BIGINT) AS pos FROM k WHERE e.name IS NOT NULL)"""
EDGES = C + """, k AS (SELECT path AS src, repo, unnest(callees) AS e FROM c), calls AS (SELECT src, repo || '/' || e.file AS dst FROM k WHERE e.file IS NOT NULL),
    edges AS (SELECT src, dst, sqrt(count(*)) AS weight FROM calls WHERE src <> dst GROUP BY ALL)"""
CHANGES = """d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, hash ORDER BY ingested_at) AS rn FROM commits) WHERE rn = 1),
    e AS (SELECT repo, hash, committed_at, lower(author.email) AS author, unnest(files) AS f FROM d),
    changes AS (SELECT repo || '/' || f.path AS path, repo, hash, committed_at, author, f.additions AS additions, f.deletions AS deletions FROM e)"""
PREFIXES = "list_transform(range(1, len(string_split({0}, '/'))), lambda k: array_to_string(string_split({0}, '/')[1:k], '/'))"
TREE = C + f""", per AS (SELECT path, count(*) AS n FROM c GROUP BY path), up AS (SELECT n, unnest({PREFIXES.format('path')}) AS path FROM per),
    nodes AS (SELECT path, CAST(len(string_split(path, '/')) AS BIGINT) AS depth, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS parent,
        string_split(path, '/')[-1] AS name, CAST(sum(n) AS BIGINT) AS components, count(*) AS files FROM up GROUP BY path)"""
TERMS = "merge shard ledger timeout"
SQL_TERMS = "['ledger', 'merge', 'shard', 'timeout']"
NOW = "2024-10-01 00:00:00"


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL where there is one."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def components(s: SparkSession, d: str) -> DataFrame:
    return index.current(table(s, d, "components"))


# ---------------------------------------------------------------- search

BM25 = """d AS (SELECT {key}, regexp_extract_all(lower(coalesce({body}, '')), '[\\p{{L}}\\p{{N}}_]+') AS t FROM {source}), st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d),
    tf AS (SELECT {key}, len(t) AS dl, unnest(list_filter(t, lambda x: list_contains({terms}, x))) AS term FROM d),
    tg AS (SELECT {key}, dl, term, count(*) AS tf FROM tf GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tg GROUP BY term),
    bm AS (SELECT {key}, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score FROM tg JOIN df USING (term), st GROUP BY {key})"""


@query("WITH " + BM25.format(key="doc_id", body="text", source="documents", terms=SQL_TERMS) + """
    SELECT doc_id, score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS BIGINT) AS rank FROM (SELECT doc_id, round(score, 6) AS score FROM bm) ORDER BY rank LIMIT 10""")
def search_bm25_topk(s, d):
    """SCH-02, SRT-01, WIN-10."""
    return search.top(search.bm25(table(s, d, "documents"), "doc_id", "text", TERMS), "doc_id", 10)


VECTORS = """v AS (SELECT vec_id, id, vector::DOUBLE[] AS x FROM component_vectors WHERE vector IS NOT NULL AND list_sum(list_transform(vector, lambda e: abs(e))) > 0), q AS (SELECT x AS q FROM v ORDER BY vec_id LIMIT 1),
    cs AS (SELECT vec_id, id, list_dot_product(x, q) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(q, q))) AS score FROM v, q)"""


def first_vector(s, d) -> tuple[DataFrame, DataFrame]:
    v = table(s, d, "component_vectors").filter("vector IS NOT NULL AND aggregate(vector, 0D, (a, x) -> a + abs(x)) > 0")
    return v, v.orderBy("vec_id").limit(1).select(F.col("vector").alias("q"))


@query("WITH " + VECTORS + " SELECT vec_id, score, CAST(row_number() OVER (ORDER BY score DESC, vec_id) AS BIGINT) AS rank FROM (SELECT vec_id, round(score, 6) AS score FROM cs) ORDER BY rank LIMIT 10")
def search_vector_topk(s, d):
    """SCH-03: exact cosine of one query vector against all."""
    v, q = first_vector(s, d)
    return search.top(search.nearest(v, "vec_id", "vector", q), "vec_id", 10)


@query()
def search_vector_topk_each(s, d):
    """SCH-03 for the whole query set: every row whose id is divisible by 20, against all rows."""
    v = table(s, d, "component_vectors").filter("vector IS NOT NULL AND aggregate(vector, 0D, (a, x) -> a + abs(x)) > 0")
    queries = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("vector").alias("q"))
    return search.nearest_each(v, "vec_id", "vector", queries, 10)


def hybrid_legs(s, d) -> list[DataFrame]:
    v, q = first_vector(s, d)
    best = search.nearest(v.select("vec_id", "id", "vector"), "vec_id", "vector", q).join(v.select("vec_id", "id"), "vec_id").groupBy("id").agg(F.max("score").alias("score"))
    t = table(s, d, "components").groupBy("id").agg(F.min_by("text", "ord").alias("text"))
    return [search.bm25(t, "id", "text", TERMS), best]


@query("WITH " + VECTORS + ", t AS (SELECT id, arg_min(text, ord) AS text FROM components GROUP BY id), " + BM25.format(key="id", body="text", source="t", terms=SQL_TERMS) + """,
    a AS (SELECT id, row_number() OVER (ORDER BY round(score, 6) DESC, id) AS r FROM bm), b AS (SELECT id, row_number() OVER (ORDER BY round(max(score), 6) DESC, id) AS r FROM cs GROUP BY id),
    u AS (SELECT id, sum(1.0::DOUBLE / (60 + r)) AS score FROM (SELECT * FROM a WHERE r <= 100 UNION ALL SELECT * FROM b WHERE r <= 100) GROUP BY id)
    SELECT id, score, CAST(row_number() OVER (ORDER BY score DESC, id) AS BIGINT) AS rank FROM (SELECT id, round(score, 6) AS score FROM u) ORDER BY rank LIMIT 10""")
def search_hybrid_rrf(s, d):
    """SCH-01 over the first 100 of each leg, as its SQL has it; search_hybrid_rrf_whole is without that cut."""
    return search.top(search.fused(hybrid_legs(s, d), "id", depth=100), "id", 10)


@query(ORACLES["search_hybrid_rrf"].replace(" WHERE r <= 100", ""))
def search_hybrid_rrf_whole(s, d):
    """SCH-01: BM25 and vector legs, whole, fused by reciprocal ranks."""
    return search.top(search.fused(hybrid_legs(s, d), "id"), "id", 10)


@query("WITH " + VECTORS + """, own AS (SELECT split_part(id, ':', 1) AS file FROM v ORDER BY vec_id LIMIT 1), own_n AS (SELECT count(*) AS n FROM v, own WHERE split_part(id, ':', 1) = file),
    r AS (SELECT vec_id, id, score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM (SELECT vec_id, id, round(score, 6) AS score FROM cs))
    SELECT r.id, r.vec_id, r.score, CAST(r.rank AS BIGINT) AS rank FROM r, own, own_n WHERE rank <= 10 + n AND score >= 0.7 AND split_part(id, ':', 1) <> file""")
def find_similar_file(s, d):
    """SCH-04, SCH-05, FLT-04, FLT-07: rows most like a file's first row, without the file; threshold after the limit."""
    v, q = first_vector(s, d)
    v = v.withColumn("file", F.substring_index("id", ":", 1))
    own = v.orderBy("vec_id").limit(1).select(F.col("file").alias("own"))
    n = v.join(F.broadcast(own), F.col("file") == F.col("own")).agg(F.count("*").alias("n"))
    scored = search.nearest(v, "vec_id", "vector", q).select("vec_id", F.round("score", 6).alias("score"))
    w = Window.orderBy(F.desc("score"), "vec_id")
    page = scored.orderBy(F.desc("score"), "vec_id").limit(10 + n.first().n).withColumn("rank", F.row_number().over(w).cast("bigint"))
    return search.above(page, 0.7).join(v.select("vec_id", "id", "file"), "vec_id").join(F.broadcast(own), F.col("file") != F.col("own")).select("id", "vec_id", "score", "rank")


@query("WITH " + C + """, r AS (SELECT repo, name, start_line, type, path, signature, row_number() OVER (PARTITION BY repo ORDER BY ord) AS rank FROM c),
    p AS (SELECT repo AS g, rank, type || ': ' || name || ' (' || path || ':' || start_line || ')' AS header, signature FROM r WHERE rank <= 20 AND name IS NOT NULL),
    t AS (SELECT g, CAST(rank AS BIGINT) AS rank, rank || '. ' || header AS m, rank || '. ' || concat_ws(chr(10), header, '   ' || signature) AS s FROM p),
    z AS (SELECT g, rank, """ + ", ".join(f"CASE WHEN {x} = '' THEN 0 ELSE greatest(ceil(length({x}) / 4.5), ceil(len(string_split({x}, ' ')) * 1.25))::BIGINT END AS {y}" for x, y in (("sm", "m"), ("ss", "s"))) + f"""
        FROM (SELECT g, rank, regexp_replace(regexp_replace(m, '^{WS}+|{WS}+$', '', 'g'), '{WS}+', ' ', 'g') AS sm, regexp_replace(regexp_replace(s, '^{WS}+|{WS}+$', '', 'g'), '{WS}+', ' ', 'g') AS ss FROM t)),
    o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY rank) AS i FROM z)""".replace("WITH ", "") + """,
    f AS (WITH RECURSIVE f AS (
        SELECT g, rank, i, s AS tokens, 'full' AS level, s AS used FROM o WHERE i = 1 AND rank <= 3
        UNION ALL SELECT g, rank, i, m, 'minimal', m FROM o WHERE i = 1 AND rank > 10
        UNION ALL SELECT g, rank, i, s, 'signature', s FROM o WHERE i = 1 AND rank BETWEEN 4 AND 10
        UNION ALL SELECT o.g, o.rank, o.i, x.tokens, x.level, f.used + x.tokens FROM f JOIN o ON o.g = f.g AND o.i = f.i + 1,
            LATERAL (SELECT CASE WHEN o.rank <= 3 AND 400 - f.used > 300 THEN 'full' WHEN o.rank <= 10 AND 400 - f.used > 100 THEN 'signature' ELSE 'minimal' END AS level,
                CASE WHEN (o.rank <= 3 AND 400 - f.used > 300) OR (o.rank <= 10 AND 400 - f.used > 100) THEN o.s ELSE o.m END AS tokens) x
            WHERE f.used + x.tokens <= 400) SELECT * FROM f)
    SELECT g, rank, level, tokens FROM f""")
def budget_packing(s, d):
    """WIN-07, SCH-14: a page of each repository's components packed under 400 tokens, detail by rank and budget."""
    w = Window.partitionBy("repo").orderBy("ord")
    c = components(s, d).withColumn("rank", F.row_number().over(w)).filter("rank <= 20 AND name IS NOT NULL")
    header = F.concat("type", F.lit(": "), "name", F.lit(" ("), "path", F.lit(":"), F.col("start_line").cast("string"), F.lit(")"))
    sig = F.concat(F.lit("   "), "signature")
    return search.packed(c.select(F.col("repo").alias("g"), "rank", header.alias("header"), sig.alias("full"), sig.alias("signature")), 400)


# ---------------------------------------------------------------- rows of the index, filters, text functions


@query("WITH " + C + """ SELECT repo || '/' || id AS id, path, type, name, language, exported, CAST(start_line AS BIGINT) AS start_line,
    concat_ws(chr(10) || chr(10), CASE WHEN coalesce(name, '') <> '' THEN type || ': ' || name END, nullif(text, '')) AS text, concat_ws(chr(10), concat_ws(' ', type, name), signature, docstring) AS embedding_text,
    CASE WHEN len(string_split(snippet, chr(10))) <= 50 THEN snippet ELSE array_to_string(string_split(snippet, chr(10))[1:50], chr(10)) || chr(10) || '// ... ' || (len(string_split(snippet, chr(10))) - 50) || ' more lines' END AS snippet FROM c""")
def index_documents(s, d):
    """PRJ-01 to PRJ-06."""
    return index.documents_to_embed(components(s, d))


@query("WITH " + C + " SELECT ord, path FROM c WHERE exported AND type IN ('function', 'method') AND language IN ('python', 'go') AND NOT contains(path, '.test.')")
def filter_components(s, d):
    """FLT-01, FLT-02, FLT-03, FLT-11."""
    c = components(s, d).filter(F.col("exported") & F.col("type").isin("function", "method") & F.col("language").isin("python", "go"))
    return c.filter(~F.contains("path", F.lit(".test."))).select("ord", "path")


@query(f"""WITH t AS (SELECT doc_id, text, regexp_replace(regexp_replace(text, '^{WS}+|{WS}+$', '', 'g'), '{WS}+', ' ', 'g') AS n FROM documents WHERE text IS NOT NULL),
    k AS (SELECT doc_id, text, CASE WHEN n = '' THEN 0 ELSE greatest(ceil(length(n) / 4.5), ceil(len(string_split(n, ' ')) * 1.25))::BIGINT END AS tokens FROM t)
    SELECT doc_id, tokens, CASE WHEN tokens <= 40 THEN text ELSE substring(text, 1, 157) || '...' END AS short FROM k""")
def token_estimate(s, d):
    """FN-01, FN-02."""
    t = table(s, d, "documents").filter("text IS NOT NULL")
    return t.select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"), T.truncate_to_budget(F.col("text"), 40).alias("short"))


@query(f"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, ' +', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^{WS}+|{WS}+$', '', 'g') AS clean,
    CASE WHEN length(text) <= 80 THEN text ELSE substring(text, 1, 77) || '...' END AS short,
    regexp_replace(regexp_replace(lower(string_split(text, chr(10))[1]), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM documents WHERE text IS NOT NULL""")
def text_clean_truncate_slug(s, d):
    """FN-06, FN-07, FN-08."""
    t = F.col("text")
    return table(s, d, "documents").filter("text IS NOT NULL").select("doc_id", T.clean_text(t).alias("clean"), T.truncate_text(t, 80).alias("short"), T.slugify(F.split(t, "\n")[0]).alias("slug"))


@query("""WITH r AS (SELECT repo, remote, CASE WHEN starts_with(remote, 'git@') THEN regexp_replace(regexp_replace(remote, '\\.git$', ''), '^[^:]*:', '')
        ELSE regexp_replace(regexp_replace(regexp_replace(regexp_replace(remote, '^(?:https?://|ssh://git@)', ''), '/$', ''), '\\.git$', ''), '^[^/]*/', '') END AS n FROM repositories)
    SELECT repo, lower(n) AS normal, substring(md5(lower(n)), 1, 8) AS key, string_split(n, '/')[1] AS owner, string_split(n, '/')[2] AS name FROM r""")
def git_remotes(s, d):
    """FN-09, FN-10, FN-12."""
    r, n = F.col("remote"), T.normalize_remote(F.col("remote"))
    return table(s, d, "repositories").select("repo", n.alias("normal"), T.storage_key(n).alias("key"), T.remote_part(r, 1).alias("owner"), T.remote_part(r, 2).alias("name"))


@query("""WITH m AS (SELECT repo, hash, subject || chr(10) || coalesce(body, '') AS t FROM (SELECT DISTINCT repo, hash, subject, body FROM commits)),
    p AS (SELECT *, list_transform(regexp_extract_all(t, '(?i)(?:\\bPR\\s*#|pull\\s+request\\s*#)([0-9]+)', 1), lambda x: x::BIGINT) AS pl,
        list_transform(regexp_extract_all(regexp_replace(t, '(?i)(?:\\bPR\\s*#|pull\\s+request\\s*#)[0-9]+', '', 'g'), '#([0-9]+)', 1), lambda x: x::BIGINT) AS il FROM m)
    SELECT repo, hash, CAST(len(list_distinct(pl)) AS BIGINT) AS prs, CAST(coalesce(list_sum(list_distinct(pl)), 0) AS BIGINT) AS pr_sum,
        CAST(len(list_distinct(list_filter(il, lambda x: NOT list_contains(pl, x)))) AS BIGINT) AS issues, CAST(coalesce(list_sum(list_distinct(list_filter(il, lambda x: NOT list_contains(pl, x)))), 0) AS BIGINT) AS issue_sum FROM p""")
def commit_refs(s, d):
    """FN-13: pull requests and issues that a message names."""
    m = table(s, d, "commits").select("repo", "hash", "subject", "body").distinct().withColumn("t", F.concat("subject", F.lit("\n"), F.coalesce("body", F.lit(""))))
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda x, y: x + y)
    m = m.withColumn("p", T.pr_refs(F.col("t"))).withColumn("i", T.issue_refs(F.col("t")))
    return m.select("repo", "hash", F.size("p").cast("bigint").alias("prs"), total("p").alias("pr_sum"), F.size("i").cast("bigint").alias("issues"), total("i").alias("issue_sum"))


@query("""SELECT DISTINCT repo, file, CASE WHEN contains(file, '/') THEN regexp_replace(file, '/[^/]*$', '') ELSE '.' END AS folder, string_split(file, '/')[-1] AS base, lower(regexp_extract(file, '\\.([A-Za-z0-9]+)$', 1)) AS ext,
    CASE WHEN starts_with(file, 'src/') THEN substring(file, 5) ELSE file END AS below FROM source_files""")
def path_parts(s, d):
    """FN-18, FN-20, FLT-09."""
    f = F.col("file")
    return table(s, d, "source_files").select("repo", "file", T.dirname(f).alias("folder"), T.basename(f).alias("base"), T.extension(f).alias("ext"), T.strip_focus(f, "src").alias("below")).distinct()


@query("""WITH p AS (SELECT repo, string_split(file, '/')[:-2] AS d FROM source_files), l AS (SELECT repo, list(d) AS ds, min(len(d)) AS n FROM p GROUP BY repo),
    k AS (SELECT repo, ds, coalesce(list_max(list_filter(range(1, n + 1), lambda k: len(list_distinct(list_transform(ds, lambda x: array_to_string(x[1:k], '/')))) = 1)), 0) AS depth FROM l)
    SELECT repo, CASE WHEN depth >= 2 THEN array_to_string(ds[1][1:depth], '/') ELSE '' END AS prefix FROM k""")
def common_prefixes(s, d):
    """FN-19: deepest folder shared by the files of a group, folded pairwise as a minimum and maximum of paths.

    Sorted paths share what the first and the last share, so two values a group are enough.
    """
    g = table(s, d, "source_files").groupBy("repo").agg(F.min("file").alias("a"), F.max("file").alias("b"))
    return g.select("repo", T.common_prefix(F.array("a", "b")).alias("prefix"))


@query("WITH " + C + """ SELECT c.ord, array_to_string(string_split(f.content, chr(10))[c.start_line:least(c.end_line, c.start_line + 2)], chr(10)) AS head FROM c
    JOIN (SELECT repo, file, arg_max(content, file_id) AS content FROM source_files GROUP BY ALL) f USING (repo, file) WHERE c.end_line IS NOT NULL AND c.start_line >= 1""")
def component_heads(s, d):
    """FN-43: first lines of a component from the latest scan of its file."""
    f = table(s, d, "source_files").groupBy("repo", "file").agg(F.max_by("content", "file_id").alias("content"))
    c = components(s, d).filter("end_line IS NOT NULL AND start_line >= 1")
    return c.join(f, ["repo", "file"]).select("ord", T.lines_between(F.col("content"), F.col("start_line"), F.least("end_line", F.col("start_line") + 2)).alias("head"))


# ---------------------------------------------------------------- statistics

LINES = "CAST(sum(coalesce(greatest(end_line - start_line + 1, 0), 0)) AS BIGINT)"
LANG = C + f", l AS (SELECT language, count(*) FILTER (first) AS files, count(*) AS components, {LINES} AS lines FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ord) = 1 AS first FROM c) GROUP BY language)"


@query("WITH " + LANG + " SELECT * FROM l")
def stats_by_language(s, d):
    """AGG-01."""
    return stats.by_language(components(s, d))


@query("WITH " + C + " SELECT type, count(*) AS components FROM c GROUP BY type")
def stats_by_type(s, d):
    """AGG-02."""
    return stats.by_type(components(s, d))


PACKAGES = "SELECT DISTINCT unnest([repo, repo || '/' || string_split(file, '/')[1]]) AS package FROM source_files WHERE contains(file, '/')"


def packages(s, d) -> DataFrame:
    f = table(s, d, "source_files").filter(F.contains("file", F.lit("/")))
    return f.select(F.explode(F.array("repo", F.concat_ws("/", "repo", F.substring_index("file", "/", 1)))).alias("package")).distinct()


@query("WITH " + C + f""", p AS ({PACKAGES}), b AS (SELECT path, arg_max(package, length(package)) AS package FROM (SELECT DISTINCT path FROM c) JOIN p ON starts_with(path, package || '/') GROUP BY path)
    SELECT package, count(DISTINCT path) AS files, count(*) AS components, count(DISTINCT language) AS languages FROM c JOIN b USING (path) GROUP BY package""")
def stats_by_package(s, d):
    """AGG-03, JN-10: longest package that holds the file."""
    return stats.by_package(components(s, d), packages(s, d))


@query("WITH " + C + " SELECT count(DISTINCT language) AS languages, count(DISTINCT type) AS types, count(DISTINCT path) AS paths, count(DISTINCT repo) AS repos FROM c")
def stats_cardinalities(s, d):
    """AGG-04."""
    return stats.cardinalities(components(s, d))


@query("WITH " + C + f""" SELECT coalesce(language, '(all)') AS language, coalesce(type, '(all)') AS type, count(*) AS components, {LINES} AS lines, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM c), 1) AS share
    FROM c GROUP BY ROLLUP (language, type)""")
def stats_rollup_totals(s, d):
    """AGG-23, AGG-25."""
    return stats.with_totals(components(s, d))


@query("""WITH a AS (SELECT repo, count(*) AS n FROM components WHERE indexed_at < TIMESTAMP '2024-05-01' GROUP BY repo), b AS (SELECT repo, count(*) AS n FROM components WHERE indexed_at < TIMESTAMP '2024-09-01' AND type <> 'method' GROUP BY repo),
    j AS (SELECT repo, a.n AS x, b.n AS y, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after FROM a FULL JOIN b USING (repo))
    SELECT repo, before, after, CASE WHEN x IS NULL THEN 'added' WHEN y IS NULL THEN 'removed' ELSE 'common' END AS change, after - before AS absolute,
        CASE WHEN before = 0 AND after = 0 THEN 0 WHEN before = 0 THEN 100 ELSE round((after - before) * 100.0::DOUBLE / before, 2) END AS percent, CASE WHEN after - before > 10 THEN 'growing' WHEN after - before < -10 THEN 'shrinking' ELSE 'stable' END AS trend FROM j""")
def stats_compare(s, d):
    """JN-07, JN-08, SET-03, FN-27, FN-28: two states of the index."""
    c = table(s, d, "components")
    a = c.filter("indexed_at < timestamp_ntz'2024-05-01'").groupBy("repo").agg(F.count("*").alias("n"))
    b = c.filter("indexed_at < timestamp_ntz'2024-09-01' AND type <> 'method'").groupBy("repo").agg(F.count("*").alias("n"))
    return stats.compare(a, b, "repo", "n")


@query("WITH " + LANG + """, o AS (SELECT 'overview' AS category, 'all' AS subcategory, unnest(['files', 'components', 'lines']) AS metric, CAST(unnest([sum(files), sum(components), sum(lines)]) AS BIGINT) AS value FROM l)
    SELECT * FROM o UNION ALL SELECT 'language', language, unnest(['files', 'components', 'lines']), CAST(unnest([files, components, lines]) AS BIGINT) FROM l UNION ALL SELECT 'component', type, 'components', count(*) FROM c GROUP BY type
    UNION ALL SELECT 'package', replace(package, ',', ';'), unnest(['files', 'components', 'languages']), CAST(unnest([files, components, languages]) AS BIGINT) FROM (SELECT package, count(DISTINCT path) AS files, count(*) AS components, count(DISTINCT language) AS languages
        FROM c JOIN (SELECT path, arg_max(package, length(package)) AS package FROM (SELECT DISTINCT path FROM c) JOIN (""" + PACKAGES + """) p ON starts_with(path, package || '/') GROUP BY path) b USING (path) GROUP BY package)""")
def stats_export_long(s, d):
    """SNK-08."""
    c = components(s, d)
    return stats.export_long(c, stats.by_package(c, packages(s, d)))


@query("WITH " + LANG + " SELECT CAST(row_number() OVER (ORDER BY components DESC, language) AS BIGINT) AS line, '| ' || language || ' | ' || files || ' | ' || components || ' | ' || lines || ' |' AS text FROM l")
def stats_markdown(s, d):
    """SNK-09, SRT-07."""
    return stats.markdown_table(stats.by_language(components(s, d)))


@query("WITH " + C + f""", p AS ({PACKAGES}), b AS (SELECT path, arg_max(package, length(package)) AS package FROM (SELECT DISTINCT path FROM c) JOIN p ON starts_with(path, package || '/') GROUP BY path),
    g AS (SELECT package, count(DISTINCT path) AS files, count(*) AS components FROM c JOIN b USING (path) GROUP BY package)
    SELECT CAST(row_number() OVER (ORDER BY components DESC, package) AS BIGINT) AS line, '| ' || package || ' | ' || files || ' | ' || components || ' |' AS text FROM g""")
def stats_markdown_packages(s, d):
    """SNK-09, SRT-07: packages by components."""
    return stats.markdown_table(stats.by_package(components(s, d), packages(s, d)), "package", ["files", "components"])


@query("""WITH q AS (SELECT repo || '/' || id AS id, sha256(concat_ws(chr(1), coalesce(type, chr(2)), coalesce(name, chr(2)), coalesce(text, chr(2)))) AS h, indexed_at FROM components),
    o AS (SELECT id, min(h) AS h FROM q WHERE indexed_at < TIMESTAMP '2024-07-01' GROUP BY id), n AS (SELECT id, min(h) AS h FROM q WHERE indexed_at >= TIMESTAMP '2024-02-01' OR indexed_at IS NULL GROUP BY id)
    SELECT id, CASE WHEN o.h IS NULL THEN 'insert' WHEN n.h IS NULL THEN 'delete' WHEN o.h = n.h THEN 'keep' ELSE 'update' END AS action FROM o FULL JOIN n USING (id)""")
def linear_merge_plan(s, d):
    """SNK-02: what a full synchronisation does with every id."""
    return _merge(s, d).select("id", "action")


def _merge(s, d) -> DataFrame:
    c = table(s, d, "components").withColumn("id", F.concat_ws("/", "repo", "id"))
    return index.merge_plan(c.filter("indexed_at < timestamp_ntz'2024-07-01'"), c.filter("indexed_at >= timestamp_ntz'2024-02-01' OR indexed_at IS NULL"), "id", ["type", "name", "text"])


@query("""WITH q AS (SELECT repo || '/' || id AS id, sha256(concat_ws(chr(1), coalesce(type, chr(2)), coalesce(name, chr(2)), coalesce(text, chr(2)))) AS h, indexed_at FROM components),
    o AS (SELECT id, min(h) AS h FROM q WHERE indexed_at < TIMESTAMP '2024-07-01' GROUP BY id), n AS (SELECT id, min(h) AS h FROM q WHERE indexed_at >= TIMESTAMP '2024-02-01' OR indexed_at IS NULL GROUP BY id)
    SELECT CASE WHEN o.h IS NULL THEN 'insert' WHEN n.h IS NULL THEN 'delete' WHEN o.h = n.h THEN 'keep' ELSE 'update' END AS action, count(*) AS rows FROM o FULL JOIN n USING (id) GROUP BY 1""")
def merge_actions(s, d):
    """SNK-02: counters of the merge."""
    return _merge(s, d).groupBy("action").agg(F.count("*").alias("rows"))


@query("WITH " + C + """, gone AS (SELECT DISTINCT path FROM c WHERE contains(path, '/utils/')), up AS (SELECT path, ord FROM c WHERE language = 'go')
    SELECT ord, path FROM c WHERE path NOT IN (SELECT path FROM gone) AND path NOT IN (SELECT path FROM up) UNION ALL SELECT ord, path FROM up""")
def upsert_delete(s, d):
    """SNK-03, SNK-04, JN-14: rows of changed files replaced, rows of deleted files dropped, by path."""
    c = components(s, d).select("ord", "path", "language")
    t = c.select("ord", "path")
    return index.upsert_and_delete(t, c.filter("language = 'go'").select("ord", "path"), c.filter(F.contains("path", F.lit("/utils/"))).select("path"), "path")


# ---------------------------------------------------------------- change frequency

FREQ = CHANGES + ", f AS (SELECT path, count(DISTINCT hash) AS commits, max(committed_at) AS last_change, count(DISTINCT author) AS authors FROM changes GROUP BY path)"


@query("WITH " + FREQ + " SELECT * FROM f")
def change_frequency(s, d):
    """AGG-05, SRC-31."""
    return stats.change_frequency(stats.file_changes(table(s, d, "commits")))


GROUPED = "count(*) AS files, CAST(sum(commits) AS BIGINT) AS commits, round(sum(commits)::DOUBLE / count(*), 6) AS per_file, max(last_change) AS last_change"


@query("WITH " + FREQ + f" SELECT lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) AS grp, {GROUPED} FROM f GROUP BY 1")
def change_frequency_by_language(s, d):
    """AGG-06, AGG-07, JN-11: by extension."""
    return stats.frequency_by(stats.change_frequency(stats.file_changes(table(s, d, "commits"))), T.extension(F.col("path")))


@query("WITH " + FREQ + f", p AS ({PACKAGES}), b AS (SELECT path, arg_max(package, length(package)) AS package FROM f JOIN p ON starts_with(path, package || '/') GROUP BY path) SELECT package AS grp, {GROUPED} FROM f JOIN b USING (path) GROUP BY 1")
def change_frequency_by_package(s, d):
    """AGG-07, JN-12."""
    f = stats.change_frequency(stats.file_changes(table(s, d, "commits")))
    return stats.frequency_by(f.join(stats.packages_of(f.select("path"), packages(s, d)), "path"), F.col("package"))


DIRS = CHANGES + f""", r AS (SELECT * FROM changes WHERE committed_at >= TIMESTAMP '{NOW}' - INTERVAL 90 DAY AND committed_at <= TIMESTAMP '{NOW}'),
    u AS (SELECT unnest({PREFIXES.format('path')}) AS path, repo, hash, committed_at FROM r), h AS (SELECT path, repo, hash, max(committed_at) AS t FROM u GROUP BY ALL),
    fr AS (SELECT path, count(*) FILTER (t >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY) AS last_30, count(*) AS last_90, max(t) AS last_commit FROM h GROUP BY path)"""


def folder_frequency(s, d) -> DataFrame:
    return stats.directory_frequency(stats.file_changes(table(s, d, "commits")), F.expr(f"timestamp_ntz'{NOW}'"))


@query("WITH " + DIRS + " SELECT * FROM fr")
def directory_frequency(s, d):
    """AGG-08."""
    return folder_frequency(s, d)


@query("""SELECT DISTINCT repo, hash, CAST(coalesce(list_sum(list_transform(files, lambda f: f.additions)), 0) AS BIGINT) AS additions, CAST(coalesce(list_sum(list_transform(files, lambda f: f.deletions)), 0) AS BIGINT) AS deletions, CAST(coalesce(len(files), 0) AS BIGINT) AS files FROM commits""")
def commit_stats(s, d):
    """AGG-27."""
    return stats.commit_stats(table(s, d, "commits"))


# ---------------------------------------------------------------- graph


#: Files that change together, as weighted edges: the graph that the walking operators run on.
CO = CHANGES + """, p AS (SELECT DISTINCT repo, hash, path FROM changes), x AS (SELECT path AS src, lead(path) OVER (PARTITION BY repo, hash ORDER BY path) AS dst FROM p),
    edges AS (SELECT src, dst, sqrt(count(*)) AS weight FROM x WHERE dst IS NOT NULL GROUP BY ALL), nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges)"""


def change_edges(s, d) -> DataFrame:
    """Each file of a commit to the next of it by name, weighted by the root of the commits."""
    p = stats.file_changes(table(s, d, "commits")).select("repo", "hash", "path").distinct()
    x = p.select(F.col("path").alias("src"), F.lead("path").over(Window.partitionBy("repo", "hash").orderBy("path")).alias("dst"))
    return x.filter("dst IS NOT NULL").groupBy("src", "dst").agg(F.sqrt(F.count("*").cast("double")).alias("weight"))


@query("WITH " + CO + " SELECT src, dst, round(weight, 6) AS weight FROM edges")
def dependency_edges(s, d):
    """AGG-09, SET-02: weighted edges between files."""
    return change_edges(s, d).select("src", "dst", F.round("weight", 6).alias("weight"))


@query("WITH " + CO + " SELECT dst, count(DISTINCT src) AS incoming FROM edges GROUP BY dst")
def incoming_refs(s, d):
    """AGG-10."""
    return graph.incoming(change_edges(s, d))


PR_ROUNDS = 12
PR = CO + f""", n AS (SELECT count(*) AS n FROM nodes), w AS (SELECT src, sum(weight) AS total FROM edges GROUP BY src),
    sh AS (SELECT edges.src, dst, weight / total AS share FROM edges JOIN w ON w.src = edges.src UNION ALL SELECT node, node, 0 FROM nodes), dg AS (SELECT node, node NOT IN (SELECT src FROM edges) AS dangling FROM nodes),
    pr AS (WITH RECURSIVE r AS (SELECT 0 AS it, node, 1.0::DOUBLE / n AS rank FROM nodes, n
        UNION ALL SELECT it + 1, dst, (0.15 / n + 0.85 * (sum(rank * share) + max(lost) / n))::DOUBLE FROM (
            SELECT it, node, rank, sum(CASE WHEN dangling THEN rank ELSE 0 END) OVER () AS lost FROM r JOIN dg USING (node) WHERE it < {PR_ROUNDS}) x JOIN sh ON sh.src = x.node, n GROUP BY it, dst, n)
        SELECT node, rank FROM r WHERE it = {PR_ROUNDS})"""


@query("WITH " + PR + " SELECT node, round(rank, 7) AS rank FROM pr")
def pagerank(s, d):
    """GRF-01 with a fixed number of rounds."""
    e = cut(change_edges(s, d))
    return graph.pagerank(e, graph.graph_nodes(e), rounds=PR_ROUNDS, tolerance=0).select("node", F.round("rank", 7).alias("rank"))


@query()
def pagerank_converged(s, d):
    """GRF-01 until the change is below the operator's tolerance, in at most its 100 rounds."""
    e = cut(change_edges(s, d))
    return graph.pagerank(e, graph.graph_nodes(e)).select("node", F.round("rank", 7).alias("rank"))


@query("WITH " + PR + ", " + C + """, i AS (SELECT dst, count(DISTINCT src) AS incoming FROM edges GROUP BY dst), f AS (SELECT path, arg_min(name, ord) AS name FROM c WHERE name IS NOT NULL GROUP BY path),
    t AS (SELECT node, round(rank, 7) AS score FROM pr ORDER BY score DESC, node LIMIT 20) SELECT node AS file, score, coalesce(incoming, 0) AS incoming, name AS component FROM t LEFT JOIN i ON dst = node LEFT JOIN f ON path = node""")
def hot_paths(s, d):
    """JN-05, SRT-01, WIN-01: best ranked files with their references and first component."""
    e = cut(change_edges(s, d))
    ranks = graph.pagerank(e, graph.graph_nodes(e), rounds=PR_ROUNDS, tolerance=0)
    best = search.top(ranks.withColumnRenamed("rank", "score"), "node", 20, digits=7)
    first = components(s, d).filter("name IS NOT NULL").groupBy("path").agg(F.min_by("name", "ord").alias("component"))
    return best.join(graph.incoming(e), F.col("node") == F.col("dst"), "left").join(first, F.col("node") == F.col("path"), "left").select(F.col("node").alias("file"), "score", F.coalesce("incoming", F.lit(0)).alias("incoming"), "component")


@query("WITH " + CO + """, b AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
    cc AS (WITH RECURSIVE r AS (SELECT node, node AS c, 0 AS it FROM nodes UNION ALL
        SELECT node, min(c), it + 1 FROM (SELECT node, c, it FROM r WHERE it < 40 UNION ALL SELECT b.b, r.c, r.it FROM r JOIN b ON b.a = r.node WHERE it < 40) GROUP BY node, it) SELECT node, c FROM r WHERE it = 40)
    SELECT node, c AS component FROM cc""")
def connected_components(s, d):
    """GRF-02."""
    e = change_edges(s, d)
    return graph.connected_components(e, graph.graph_nodes(e))


@query("WITH " + CO + """, b AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
    cc AS (WITH RECURSIVE r AS (SELECT node, node AS c, 0 AS it FROM nodes UNION ALL
        SELECT node, min(c), it + 1 FROM (SELECT node, c, it FROM r WHERE it < 40 UNION ALL SELECT b.b, r.c, r.it FROM r JOIN b ON b.a = r.node WHERE it < 40) GROUP BY node, it) SELECT node, c FROM r WHERE it = 40)
    SELECT c AS component, count(*) AS size FROM cc GROUP BY c HAVING count(*) > 1""")
def subsystems(s, d):
    """GRF-02, FLT-13, SRT-02: components of several files."""
    e = change_edges(s, d)
    return graph.connected_components(e).groupBy("component").agg(F.count("*").alias("size")).filter("size > 1")


@query("WITH " + CO + """, st AS (SELECT src AS node FROM edges GROUP BY src ORDER BY count(*) DESC, src LIMIT 1),
    h AS (WITH RECURSIVE r AS (SELECT node, 0 AS hops FROM st UNION SELECT dst, hops + 1 FROM r JOIN edges ON src = node WHERE hops < 25) SELECT node, min(hops) AS hops FROM r GROUP BY node)
    SELECT node, CAST(hops AS BIGINT) AS hops FROM h""")
def shortest_path(s, d):
    """GRF-03: hops from the file with the most edges to every file it reaches."""
    e = cut(change_edges(s, d))
    start = e.groupBy("src").count().orderBy(F.desc("count"), "src").limit(1).select(F.col("src").alias("node"))
    return graph.hops_from(e, start).select("node", "hops")


@query("WITH " + CO + """, del AS (SELECT DISTINCT src AS path FROM edges WHERE contains(src, '/utils/')), ch AS (SELECT src, dst, weight FROM edges WHERE contains(src, '/core/'))
    SELECT src, dst, round(weight, 6) AS weight FROM edges WHERE src NOT IN (SELECT path FROM del) AND src NOT IN (SELECT src FROM ch) UNION ALL SELECT src, dst, round(weight * 2, 6) FROM ch""")
def incremental_graph(s, d):
    """GRF-04: sources under core are rebuilt with double weight, those under utils are deleted."""
    e = change_edges(s, d)
    changed = e.filter(F.contains("src", F.lit("/core/"))).withColumn("weight", F.col("weight") * 2)
    deleted = e.filter(F.contains("src", F.lit("/utils/"))).select(F.col("src").alias("path")).distinct()
    return graph.updated_edges(e, changed, deleted).select("src", "dst", F.round("weight", 6).alias("weight"))


# ---------------------------------------------------------------- callers and callees


@query("WITH " + CALLS + " SELECT callee_key, count(*) AS calls, count(DISTINCT file || ':' || caller) AS callers FROM calls GROUP BY callee_key")
def reverse_index(s, d):
    """JN-01."""
    return refs.calls(components(s, d)).groupBy("callee_key").agg(F.count("*").alias("calls"), F.countDistinct(F.concat_ws(":", "file", "caller")).alias("callers"))


NAMES = CALLS + """, ix AS (SELECT DISTINCT callee_key, unnest([n, string_split(n, '.')[-1], string_split(n, '.')[1]]) AS segment FROM (SELECT callee_key, regexp_replace(callee, '^new ', '') AS n FROM calls))"""


@query("WITH " + NAMES + " SELECT segment, callee_key FROM ix")
def name_index(s, d):
    """JN-02."""
    return refs.name_index(refs.calls(components(s, d)))


@query("WITH " + NAMES + """, t AS (SELECT DISTINCT name, path AS file FROM c WHERE name IS NOT NULL),
    ks AS (SELECT name, file, callee_key, min(way) AS way FROM (SELECT name, file, file || ':' || name AS callee_key, 0 AS way FROM t UNION ALL SELECT t.name, t.file, callee_key, 1 FROM t JOIN ix ON segment = name) GROUP BY ALL),
    h AS (SELECT ks.name, ks.file, calls.file AS caller_file, caller, min({'w': way, 'o': ord, 'p': pos, 'line': line, 'type': type}) AS f FROM ks JOIN calls USING (callee_key) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY name, file ORDER BY f.w, f.o, f.p) AS rank FROM h) SELECT name, file, CAST(rank AS BIGINT) AS rank, caller_file, caller, f.line AS line, f.type AS type FROM r WHERE rank <= 50""")
def callers_of(s, d):
    """JN-03, WIN-03: callers of every component."""
    c = cut(components(s, d))
    return refs.callers(refs.calls(c), c.filter("name IS NOT NULL").select("name", F.col("path").alias("file")))


@query("WITH " + NAMES + """, t AS (SELECT DISTINCT string_split(name, '.')[1] AS segment FROM c WHERE type = 'method'),
    h AS (SELECT segment, file, caller, min({'o': ord, 'p': pos, 'line': line}) AS f FROM t JOIN ix USING (segment) JOIN calls USING (callee_key) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY f.o, f.p) AS rank FROM h)
    SELECT segment AS class, CAST(rank AS BIGINT) AS rank, file, caller, f.line AS line FROM r WHERE rank <= 50""")
def class_callers(s, d):
    """JN-04: callers of every class that has methods."""
    c = cut(components(s, d))
    return refs.class_callers(refs.calls(c), c.filter("type = 'method'").select(F.substring_index("name", ".", 1).alias("name")))


@query("WITH " + CALLS + """, del AS (SELECT DISTINCT path FROM c WHERE contains(path, '/utils/')), ch AS (SELECT DISTINCT path FROM c WHERE contains(path, '/core/')), reb AS (SELECT * FROM calls WHERE file IN (SELECT path FROM ch)),
    kept AS (SELECT * FROM calls WHERE file NOT IN (SELECT path FROM del) AND file NOT IN (SELECT path FROM ch) AND (NOT contains(callee_key, ':') OR regexp_replace(callee_key, ':[^:]*$', '') NOT IN (SELECT path FROM del)))
    SELECT callee_key, file, caller, line FROM kept UNION ALL SELECT callee_key, file, caller, line FROM reb""")
def incremental_calls(s, d):
    """GRF-05."""
    c = cut(components(s, d))
    k = refs.calls(c)
    changed, deleted = (c.filter(F.contains("path", F.lit(x))).select("path").distinct() for x in ("/core/", "/utils/"))
    return refs.updated_calls(k, k.join(changed, F.col("file") == F.col("path"), "left_semi"), changed, deleted).select("callee_key", "file", "caller", "line")


@query("WITH " + C + """, a AS (SELECT DISTINCT string_split(name, '.')[-1] AS asked FROM c WHERE type = 'method'),
    h AS (SELECT asked, name, path, ord, CASE WHEN name = asked OR ends_with(name, '.' || asked) THEN 0 ELSE 1 END AS e FROM a JOIN c ON string_split(name, '.')[-1] = asked), r AS (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY e, ord) AS rn FROM h)
    SELECT asked, name, path FROM r WHERE rn = 1""")
def resolve_symbol(s, d):
    """JN-15: best component for every method name."""
    c = cut(components(s, d)).withColumn("asked", F.substring_index("name", ".", -1))
    asked = c.filter("type = 'method'").select("asked").distinct()
    hits = c.join(asked, "asked").select("asked", "name", "path", F.col("ord").alias("rank"))
    return refs.resolved(hits, "asked").select("asked", "name", "path")


# ---------------------------------------------------------------- maps


@query("WITH " + TREE + " SELECT * FROM nodes")
def tree_rollup(s, d):
    """AGG-11, AGG-12."""
    return tree.rolled_up(components(s, d))


@query("WITH " + TREE + " SELECT * FROM nodes WHERE depth <= 4")
def tree_pruned(s, d):
    """GRF-06."""
    return tree.pruned(tree.rolled_up(components(s, d)), 4)


@query("WITH " + TREE + f""", n AS (SELECT * FROM nodes WHERE depth <= 6), a AS (SELECT path, unnest({PREFIXES.format('path')}) AS above FROM n),
    o AS (SELECT a.path, bool_and(m.depth <= 2 OR m.components >= 5) AS seen FROM a JOIN n m ON m.path = a.above GROUP BY a.path) SELECT n.* FROM n LEFT JOIN o USING (path) WHERE coalesce(seen, true)""")
def tree_smart(s, d):
    """GRF-07."""
    return tree.smart_pruned(tree.rolled_up(components(s, d)), 6, 5)


@query("WITH " + C + """, e AS (SELECT regexp_replace(path, '/[^/]*$', '') AS folder, name, coalesce(type, 'unknown') AS type, row_number() OVER (PARTITION BY regexp_replace(path, '/[^/]*$', '') ORDER BY ord) AS rank FROM c WHERE exported AND name IS NOT NULL)
    SELECT folder, CAST(rank AS BIGINT) AS rank, name, type FROM e WHERE rank <= 5""")
def exports_per_folder(s, d):
    """WIN-02, PRJ-11."""
    return tree.exports_per_folder(components(s, d))


@query("WITH " + TREE + ", " + DIRS + " SELECT nodes.*, coalesce(last_30, 0) AS last_30, coalesce(last_90, 0) AS last_90, last_commit FROM nodes LEFT JOIN fr USING (path)")
def tree_with_frequency(s, d):
    """JN-06."""
    return tree.with_frequency(tree.rolled_up(components(s, d)), folder_frequency(s, d))


# ---------------------------------------------------------------- patterns of files


@query("WITH " + C + """, g AS (SELECT repo, file, count(signature) AS n, count(*) FILTER (regexp_matches(signature, '(?:\\)|=>)\\s*(?::|->)\\s*\\w+')) AS a FROM c WHERE type IN ('function', 'method') GROUP BY ALL),
    f AS (SELECT repo, file, arg_max(content, file_id) AS t FROM source_files GROUP BY ALL),
    k AS (SELECT repo, file, t, len(regexp_extract_all(t, '(?m)^import\\s')) AS esm, len(regexp_extract_all(t, 'require\\s*\\(')) AS cjs, len(regexp_extract_all(t, 'throw\\s+new\\s+\\w*Error')) AS e1,
        len(regexp_extract_all(t, 'Result<|\\{\\s*ok:\\s*(?:true|false)')) AS e2, len(regexp_extract_all(t, '\\)\\s*:\\s*\\([^)]*,\\s*error\\)|\\([^()]*,\\s*error\\)\\s*\\{')) AS e3 FROM f)
    SELECT repo, file, CAST(length(t) AS BIGINT) AS chars, CAST(len(string_split(t, chr(10))) AS BIGINT) AS lines, CASE WHEN esm > 0 AND cjs > 0 THEN 'mixed' WHEN esm > 0 THEN 'esm' WHEN cjs > 0 THEN 'cjs' ELSE 'unknown' END AS import_style, CAST(esm + cjs AS BIGINT) AS imports,
        CASE WHEN (e1 > 0)::INT + (e2 > 0)::INT + (e3 > 0)::INT > 1 THEN 'mixed' WHEN e1 > 0 THEN 'throw' WHEN e2 > 0 THEN 'result' WHEN e3 > 0 THEN 'error-return' ELSE 'unknown' END AS error_style,
        CASE WHEN coalesce(n, 0) = 0 THEN 'none' WHEN a / n >= 0.9 THEN 'full' WHEN a / n >= 0.5 THEN 'partial' WHEN a > 0 THEN 'minimal' ELSE 'none' END AS type_coverage FROM k LEFT JOIN g USING (repo, file)""")
def file_patterns(s, d):
    """SCH-10, FN-22, FN-23, FN-24."""
    return patterns.facts(table(s, d, "source_files"), components(s, d))


FACTS = "WITH f AS (SELECT repo, file, arg_max(content, file_id) AS t FROM source_files GROUP BY ALL), k AS (SELECT repo, lower(regexp_extract(file, '\\.([A-Za-z0-9]+)$', 1)) AS ext, file, len(string_split(t, chr(10))) AS lines FROM f)"


@query(FACTS + """, g AS (SELECT repo, ext, list_sort(list(lines)) AS l, avg(lines) AS m, min(lines) AS lo, max(lines) AS hi, count(*) AS n FROM k GROUP BY ALL)
    SELECT repo, ext, n AS files, CAST(floor(m + 0.5) AS BIGINT) AS mean, CAST(l[len(l) // 2 + 1] AS BIGINT) AS median, CAST(lo AS BIGINT) AS low, CAST(hi AS BIGINT) AS high FROM g""")
def size_comparison(s, d):
    """AGG-13: mean, upper median and range of the lines of like files."""
    return patterns.sizes(patterns.latest(table(s, d, "source_files")))


@query(FACTS.replace("len(string_split(t, chr(10))) AS lines", "CASE WHEN regexp_matches(t, '(?m)^import\\s') THEN CASE WHEN regexp_matches(t, 'require\\s*\\(') THEN 'mixed' ELSE 'esm' END WHEN regexp_matches(t, 'require\\s*\\(') THEN 'cjs' ELSE 'unknown' END AS style") + """,
    g AS (SELECT ext, style, count(*) AS n, min(repo || '/' || file) AS first FROM k GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY ext) AS total, row_number() OVER (PARTITION BY ext ORDER BY n DESC, first) AS rn FROM g)
    SELECT ext, style AS common, n AS files, CAST(floor(n * 100.0::DOUBLE / total + 0.5) AS BIGINT) AS percent FROM r WHERE rn = 1""")
def pattern_distribution(s, d):
    """AGG-15: most common style of the files of an extension, ties to the first seen."""
    return patterns.most_common(patterns.latest(table(s, d, "source_files")))


@query("""WITH f AS (SELECT DISTINCT repo, file FROM source_files), e AS (SELECT *, lower(regexp_extract(file, '\\.([A-Za-z0-9]+)$', 1)) AS ext, regexp_replace(file, '\\.[^./]*$', '') AS base, string_split(file, '/')[-1] AS name,
        CASE WHEN contains(file, '/') THEN regexp_replace(file, '/[^/]*$', '/') ELSE '' END AS dir FROM f),
    m AS (SELECT *, regexp_replace(name, '\\.[^./]*$', '') AS stem, CASE WHEN len(string_split(dir, '/')) > 2 THEN regexp_replace(dir, '[^/]*/$', '') ELSE '' END AS up FROM e WHERE NOT (CASE ext WHEN 'go' THEN ends_with(file, '_test.go')
        WHEN 'py' THEN starts_with(name, 'test_') OR ends_with(name, '_test.py') OR name = 'conftest.py' WHEN 'rs' THEN contains(file, '/tests/') OR ends_with(name, '_test.rs') ELSE contains(file, '.test.') OR contains(file, '.spec.') END)),
    k AS (SELECT repo, file, unnest(CASE ext WHEN 'py' THEN [dir || 'test_' || stem || '.py', dir || stem || '_test.py'] WHEN 'rs' THEN [up || 'tests/' || stem || '.rs', dir || stem || '_test.rs'] WHEN 'go' THEN [base || '_test.go'] ELSE [base || '.test.' || ext, base || '.spec.' || ext] END) AS test FROM m)
    SELECT repo, ext, count(*) AS files, count(*) FILTER ((repo, file) IN (SELECT (k.repo, k.file) FROM k JOIN f ON f.repo = k.repo AND f.file = k.test)) AS tested FROM m GROUP BY ALL""")
def test_coverage(s, d):
    """JN-13, AGG-14, FLT-11: source files with an existing test file."""
    return patterns.tested(table(s, d, "source_files").select("repo", "file").distinct())


@query(None)
def rule_matches(s, d):
    """AGG-28, SCH-15: counts of the pattern rules per file."""
    return patterns.rule_counts(patterns.latest(table(s, d, "source_files")))


# ---------------------------------------------------------------- sources


@query("""WITH d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, hash ORDER BY ingested_at) AS rn FROM commits) WHERE rn = 1), e AS (SELECT repo, hash, author.date AS date, unnest(files) AS f FROM d)
    SELECT repo, hash, date, f.path AS path, CASE WHEN f.status = 'renamed' AND f.previous_path IS NOT NULL THEN f.previous_path END AS previous, CAST(coalesce(f.additions, 0) AS BIGINT) AS additions, CAST(coalesce(f.deletions, 0) AS BIGINT) AS deletions FROM e""")
def git_log_parse(s, d):
    """SRC-29, FN-14 to FN-16, WIN-09: the log text of every repository, printed and read back."""
    return gitlog.parse_log(gitlog.printed(table(s, d, "commits")))


@query("""WITH f AS (SELECT file_id, string_split(regexp_replace(content, '\\r\\n?', chr(10), 'g'), chr(10)) AS ls FROM source_files WHERE ends_with(file, '.md')),
    l AS (SELECT file_id, unnest(ls) AS t, generate_subscripts(ls, 1) AS line FROM f), fe AS (SELECT *, sum((regexp_matches(t, '^ {0,3}(```|~~~)'))::INT) OVER (PARTITION BY file_id ORDER BY line) AS k FROM l),
    h AS (SELECT *, regexp_matches(t, '^#{1,6} +\\S') AND k % 2 = 0 AS head FROM fe), s AS (SELECT *, sum(head::INT) OVER (PARTITION BY file_id ORDER BY line) AS section FROM h),
    g AS (SELECT file_id, section, min(line) AS start_line, max(line) AS end_line, arg_min(t, line) AS t, count(*) FILTER (NOT head AND trim(t) <> '' AND (k % 2 = 1 OR regexp_matches(t, '^ {0,3}(```|~~~)') OR NOT regexp_matches(t, '^\\s*([-*+>|]|[0-9]+\\.)\\s?'))) AS body FROM s WHERE section > 0 GROUP BY ALL)
    SELECT file_id, CAST(start_line AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line, CAST(length(regexp_extract(t, '^#+', 0)) AS BIGINT) AS level, trim(regexp_replace(regexp_replace(t, '^#+ +', ''), '\\s*#*\\s*$', '')) AS title FROM g WHERE body > 0""")
def markdown_sections(s, d):
    """SRC-26, WIN-08: sections of Markdown files by running flags."""
    return markdown.sections(table(s, d, "source_files")).select("file_id", "start_line", "end_line", "level", "title")


@query(None)
def scan_components(s, d):
    """SRC-01 to SRC-25: components of every source file, errors as rows."""
    return scanner.scan(table(s, d, "source_files")).drop("snippet")


@query("""WITH f AS (SELECT file_id, file, content, string_split(file, '/') AS l, string_split(file, '/')[-1] AS n FROM source_files)
    SELECT file_id, file FROM f WHERE NOT list_has_any(l[1:len(l) - 1], ['node_modules', 'bower_components', 'vendor', 'third_party', 'dist', 'build', 'out', 'target', '.next', '.turbo', '.nuxt', 'mocks', 'testdata', '.git', '.svn', '.hg',
        '.vscode', '.idea', '.vs', '.fleet', '.cache', '.parcel-cache', '.vite', 'coverage', '.nyc_output', 'logs', 'tmp', 'temp', '__fixtures__', '__snapshots__', 'fixtures', 'analysis-reports', '.research', 'benchmarks', 'generated',
        '.terraform', '.serverless', 'cdk.out', 'public', 'static', '.claude', '.changeset'])
    AND NOT (n LIKE '%.pb.go' OR n LIKE '%.gen.go' OR n LIKE '%\\_gen.go' ESCAPE '\\' OR n LIKE '%.pb.gw.go' OR n LIKE 'mock\\_%.go' ESCAPE '\\' OR n LIKE '%.log' OR n LIKE '%.tmp' OR n LIKE '.env%' OR n LIKE '%.min.js' OR n LIKE '%.min.css'
        OR n LIKE '%.map' OR n LIKE '%.d.ts' OR n LIKE '%.wasm' OR n IN ('.eslintcache', 'package-lock.json', 'yarn.lock', 'pnpm-lock.yaml', 'Cargo.lock', 'Gemfile.lock', '.DS_Store', 'Thumbs.db'))
    AND regexp_matches(file, '\\.(ts|tsx|js|jsx|mjs|cjs|go|py|rs|md|mdx|markdown)$') AND regexp_matches(content, '\\S')""")
def scanned_files(s, d):
    """SRC-02, SRC-03, SRC-06, FLT-10: files that a scan takes, by path before content."""
    return scanner.eligible(table(s, d, "source_files")).select("file_id", "file")


# ---------------------------------------------------------------- requests and streams


def requests(s, d) -> DataFrame:
    return table(s, d, "events").select("event_type", F.col("value").alias("duration"), (F.col("event_type") == "error").alias("failed"))


METRICS = "count(*) AS total, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type <> 'error') AS success, CAST(floor(avg(value) + 0.5) AS BIGINT) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events"


@query("SELECT " + METRICS)
def request_metrics(s, d):
    """AGG-16."""
    return stats.request_metrics(requests(s, d))


@query("SELECT event_type, " + METRICS + " GROUP BY event_type")
def request_metrics_by_tool(s, d):
    """AGG-16 by tool."""
    return stats.request_metrics(requests(s, d), "event_type")


@query("SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000")
def last_n_buffer(s, d):
    """WIN-05, WIN-06."""
    return stats.last_n(table(s, d, "events"), 1000, F.col("ts"), F.col("event_id")).select("event_id", "user_id", "event_type")


@query("""WITH g AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) > INTERVAL 6 HOUR, true) AS new FROM events), b AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS batch FROM g)
    SELECT user_id AS key, event_type AS path, min(ts) AS started, arg_max(CASE WHEN value > 100 THEN 'update' ELSE 'delete' END, (ts, event_id)) AS kind, count(*) AS events FROM b GROUP BY user_id, event_type, batch""")
def debounce_batches(s, d):
    """STM-01, STM-02."""
    e = table(s, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("path"), "ts", F.col("event_id").alias("seq"), F.when(F.col("value") > 100, "update").otherwise("delete").alias("kind"))
    return stats.debounced(e, "6 hours")


@query(None)
def token_bucket(s, d):
    """STM-09: requests allowed per key by a bucket of 5 that refills one token every six hours."""
    e = table(s, d, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"))
    return folds.rate_limited(e, capacity=5.0, per_second=1 / 21600)


@query("""WITH e AS (SELECT user_id AS id, min(CASE WHEN event_type = 'view' THEN ts END) AS started, max(CASE WHEN event_type <> 'view' THEN ts END) AS ended FROM events GROUP BY user_id) SELECT id, started, ended FROM e WHERE started IS NOT NULL AND ended IS NOT NULL""")
def paired_requests(s, d):
    """STM-08."""
    e = table(s, d, "events").select(F.col("user_id").alias("id"), F.when(F.col("event_type") == "view", "started").otherwise("ended").alias("phase"), "ts")
    return stats.paired_requests(e)


@query("""WITH r AS (SELECT user_id, event_id, CAST(floor((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) / 10) AS BIGINT) AS chunk FROM events) SELECT user_id, chunk, count(*) AS rows, CAST(min(event_id) AS BIGINT) AS low FROM r GROUP BY ALL""")
def chunked(s, d):
    """SRT-10: rows of a key in chunks of ten."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    r = table(s, d, "events").select("user_id", "event_id", F.floor((F.row_number().over(w) - 1) / 10).cast("bigint").alias("chunk"))
    return r.groupBy("user_id", "chunk").agg(F.count("*").alias("rows"), F.min("event_id").alias("low"))


# ---------------------------------------------------------------- sizes, insights, peers


@query(f"WITH f AS (SELECT repo || '/' || file AS path, arg_max(size_bytes, file_id) AS s FROM source_files GROUP BY repo, file), u AS (SELECT unnest({PREFIXES.format('path')}) AS path, coalesce(s, 0) AS s FROM f) SELECT path, CAST(sum(s) AS BIGINT) AS bytes, count(*) AS files FROM u GROUP BY path")
def folder_sizes(s, d):
    """AGG-29."""
    f = table(s, d, "source_files").groupBy("repo", "file").agg(F.max_by("size_bytes", "file_id").alias("size_bytes"))
    return stats.folder_sizes(f.select(F.concat_ws("/", "repo", "file").alias("path"), "size_bytes"))


@query(None)
def scan_errors(s, d):
    """AGG-26."""
    return stats.errors_by_phase(scanner.scan(table(s, d, "source_files")))


INSIGHTS = ["async", "cache", "error", "merge", "retry", "stream", "test", "timeout"]


@query(f"""WITH t AS (SELECT unnest({INSIGHTS}) AS term), h AS (SELECT term, source, min(doc_id) AS first, count(*) AS n FROM documents JOIN t ON contains(lower(text), term) GROUP BY ALL),
    r AS (SELECT term, source, sum(n) OVER (PARTITION BY term) AS hits, row_number() OVER (PARTITION BY term ORDER BY first) AS rank FROM h) SELECT term, CAST(hits AS BIGINT) AS hits, CAST(rank AS BIGINT) AS rank, source FROM r WHERE rank <= 10""")
def term_insights(s, d):
    """AGG-20, SET-04, SRT-06."""
    return stats.term_insights(table(s, d, "documents"), INSIGHTS)


@query("SELECT (SELECT count(*) FROM components) AS documents, count(vector) AS vectors, CAST(max(len(vector)) AS BIGINT) AS dimension, count(DISTINCT model) AS models FROM component_vectors")
def store_stats(s, d):
    """AGG-24."""
    return stats.store_stats(table(s, d, "components"), table(s, d, "component_vectors"))


@query("WITH " + C + " SELECT path, count(*) AS rows, arg_min(name, ord) AS first, arg_max(name, ord) AS last FROM c GROUP BY path")
def rows_by_path(s, d):
    """JN-09."""
    return stats.by_path(components(s, d))


PEERS = """p AS (SELECT repo, file, lead(file) OVER w AS a, lead(file, 2) OVER w AS b, lag(file) OVER w AS c FROM f WINDOW w AS (PARTITION BY repo, lower(regexp_extract(file, '\\.([A-Za-z0-9]+)$', 1)) ORDER BY file)),
    q AS (SELECT repo, file, unnest([a, b, c]) AS peer FROM p)"""


@query(ORACLES["file_patterns"].replace("SELECT repo, file, CAST(length(t)", ", facts AS (SELECT repo, file, CAST(length(t)", 1).replace("FROM k LEFT JOIN g USING (repo, file)", "FROM k LEFT JOIN g USING (repo, file)), " + PEERS + """
    SELECT o.repo, o.file, o.lines, count(*) AS peers, CAST(floor(avg(x.lines) + 0.5) AS BIGINT) AS mean, count(*) FILTER (o.import_style = x.import_style) AS same_imports, count(*) FILTER (o.error_style = x.error_style) AS same_errors,
        CASE WHEN (o.lines - floor(avg(x.lines) + 0.5)) / nullif(floor(avg(x.lines) + 0.5), 0) > 0.2 THEN 'larger' WHEN (o.lines - floor(avg(x.lines) + 0.5)) / nullif(floor(avg(x.lines) + 0.5), 0) < -0.2 THEN 'smaller' ELSE 'similar' END AS size
    FROM facts o JOIN q ON q.repo = o.repo AND q.file = o.file JOIN facts x ON x.repo = q.repo AND x.file = q.peer GROUP BY o.repo, o.file, o.lines""", 1).replace("FROM f)\n    , facts", "FROM f), facts"))
def pattern_comparison(s, d):
    """SCH-09, AGG-13: every file beside its neighbours of the same kind."""
    f = cut(patterns.facts(table(s, d, "source_files"), components(s, d)))
    w = Window.partitionBy("repo", T.extension(F.col("file"))).orderBy("file")
    p = f.select("repo", "file", F.array(F.lead("file").over(w), F.lead("file", 2).over(w), F.lag("file").over(w)).alias("peers"))
    return patterns.compared(f, p.select("repo", "file", F.explode("peers").alias("peer")).filter("peer IS NOT NULL"))
