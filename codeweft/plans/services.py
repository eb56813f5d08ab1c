"""Queries of index reads, map texts, git log options and formats, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweft.functions import text as T
from codeweft.operators import graph, lookup, patterns, refs, search, stats, tree
from codeweft.operators.stats import delivered_once
from codeweft.plans.catalogue import C, CALLS, LANG, NOW, TREE, components, query, token_bucket
from codeweft.session import cut, table
from codeweft.sources import gitlog

PATHS = "list_transform(range(1, len(string_split(path, '/')) + 1), lambda k: array_to_string(string_split(path, '/')[1:k], '/'))"


def indexed(s, d) -> DataFrame:
    return components(s, d).withColumn("id", F.concat_ws("/", "repo", "id"))


# ---------------------------------------------------------------- index


@query("WITH " + C + " SELECT repo || '/' || id AS id, path, type, 1.0::DOUBLE AS score FROM c")
def index_scan(s, d):
    """SRC-27."""
    return lookup.scanned(indexed(s, d)).select("id", "path", "type", "score")


@query("WITH " + C + """, a AS (SELECT DISTINCT unnest([repo || '/' || id, repo || '/' || id || '?']) AS id FROM components WHERE ord % 20 = 0)
    SELECT a.id, path, name FROM a LEFT JOIN (SELECT repo || '/' || id AS id, path, name FROM c) USING (id)""")
def index_lookup(s, d):
    """SRC-28: the ids of every twentieth row and as many that are not stored."""
    asked = table(s, d, "components").filter("ord % 20 = 0").select(F.explode(F.array(F.concat_ws("/", "repo", "id"), F.concat(F.concat_ws("/", "repo", "id"), F.lit("?")))).alias("id"))
    return lookup.by_id(indexed(s, d).select("id", "path", "name"), asked)


@query("WITH " + C + " SELECT ord, path FROM c WHERE language = 'go' AND exported AND type = 'function'")
def metadata_filter(s, d):
    """FLT-05."""
    return lookup.by_metadata(components(s, d), {"language": "go", "exported": True, "type": "function"}).select("ord", "path")


@query("WITH " + C + " SELECT ord, path FROM c WHERE ends_with(path, '.ts') OR ends_with(path, '_key.py') OR ends_with(path, '.rs')")
def file_type_filter(s, d):
    """FLT-06."""
    return lookup.of_file_types(components(s, d), [".ts", "_key.py", ".rs"]).select("ord", "path")


@query(None)
def similar_same_kind(s, d):
    """FLT-08, SCH-05: of the rows nearest to every twentieth vector those in other files of the same extension."""
    v = table(s, d, "component_vectors").filter("vector IS NOT NULL AND aggregate(vector, 0D, (a, x) -> a + abs(x)) > 0")
    near = search.nearest_each(v, "vec_id", "vector", v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("vector").alias("q")), 30)
    files = v.select("vec_id", "id").join(components(s, d).groupBy("id").agg(F.min("path").alias("path")), "id").drop("id")
    hits = near.join(files, "vec_id").join(files.select(F.col("vec_id").alias("query"), F.col("path").alias("asked")), "query")
    return lookup.same_kind(hits, 10).select("query", "rank", "vec_id", "path")


@query("SELECT event_id AS id, value AS score, coalesce(CAST(try_cast(json_extract(try_cast(props AS JSON), '$.k') AS BIGINT) AS VARCHAR), '') AS k FROM events")
def hit_projection(s, d):
    """PRJ-07: the stored properties of every event as metadata."""
    h = lookup.hits_with_metadata(table(s, d, "events").withColumnRenamed("value", "score"), "event_id", "props", "map<string,string>")
    return h.select("id", "score", F.coalesce(F.try_element_at("metadata", F.lit("k")), F.lit("")).alias("k"))


@query("WITH " + C + " SELECT ord, path, coalesce(type, '') AS type, coalesce(name, '') AS name, CAST(coalesce(start_line, 0) AS BIGINT) AS start_line, coalesce(exported, false) AS exported FROM c")
def hit_views(s, d):
    """PRJ-09."""
    return lookup.views(components(s, d))


@query("WITH " + C + """ SELECT ord, CASE WHEN contains(lower(coalesce(docstring, '')), lower(coalesce(name, ''))) THEN 'name in the title' WHEN type IN ('function', 'method') THEN 'similar function' WHEN type = 'class' THEN 'similar class'
    WHEN type IN ('interface', 'type') THEN 'similar type' ELSE 'related' END AS reason FROM c""")
def relevance_reasons(s, d):
    """PRJ-10: every component against its documentation."""
    return components(s, d).select("ord", lookup.reason(F.coalesce("docstring", F.lit("")), F.col("name"), F.col("type")).alias("reason"))


@query("WITH " + C + " SELECT ord, concat_ws(chr(10), CASE WHEN coalesce(name, '') <> '' THEN type || ': ' || name END, signature, nullif(text, '')) AS document FROM c")
def documents_with_signature(s, d):
    """PRJ-03."""
    c = components(s, d)
    return c.select("ord", F.concat_ws("\n", F.when(F.coalesce("name", F.lit("")) != "", F.concat("type", F.lit(": "), "name")), "signature", F.nullif("text", F.lit(""))).alias("document"))


@query("WITH " + C + """, a AS (SELECT DISTINCT string_split(name, '.')[-1] AS asked FROM c WHERE type = 'method'), h AS (SELECT asked, name, path, signature, row_number() OVER (PARTITION BY asked ORDER BY ord) AS rank FROM a JOIN c ON string_split(name, '.')[-1] = asked),
    r AS (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY CASE WHEN name = asked OR contains(path, asked) OR contains(coalesce(signature, ''), asked) THEN 0 ELSE 1 END, rank) AS rn FROM h WHERE rank <= 10) SELECT asked, name, path FROM r WHERE rn = 1""")
def resolve_symbol_service(s, d):
    """JN-16."""
    c = cut(components(s, d)).withColumn("asked", F.substring_index("name", ".", -1))
    hits = c.join(c.filter("type = 'method'").select("asked").distinct(), "asked")
    hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("asked").orderBy("ord")))
    return refs.resolved_by_service(hits.select("asked", "name", "path", "signature", "rank"), "asked").select("asked", "name", "path")


@query("WITH " + CALLS + """, f AS (SELECT file, line, min(callee) AS callee FROM calls GROUP BY ALL) SELECT file, line, callee FROM f WHERE (file, line) NOT IN (SELECT (path, CAST(start_line + 1 AS BIGINT)) FROM c WHERE start_line IS NOT NULL)""")
def unlisted_usages(s, d):
    """SET-05: calls at lines that are not the first of a component's body."""
    c = cut(components(s, d))
    return lookup.unlisted(refs.calls(c).select("file", "line", "callee"), c.filter("start_line IS NOT NULL").select(F.col("path").alias("file"), (F.col("start_line") + 1).cast("bigint").alias("line"))).select("file", "line", "callee")


@query("""WITH f AS (SELECT DISTINCT repo, file FROM source_files), i AS (SELECT DISTINCT repo, file FROM components) SELECT f.repo, count(*) AS files, count(i.file) AS indexed, round(count(i.file) * 100 / count(*), 6) AS percent FROM f LEFT JOIN i ON i.repo = f.repo AND i.file = f.file GROUP BY f.repo""")
def index_coverage(s, d):
    """AGG-19."""
    return lookup.coverage(table(s, d, "components"), table(s, d, "source_files"))


@query("""WITH f AS (SELECT DISTINCT repo, file, string_split(file, '/')[-1] AS name, lower(regexp_extract(file, '\\.([A-Za-z0-9]+)$', 1)) AS ext, CASE WHEN contains(file, '/') THEN regexp_replace(file, '/[^/]*$', '') ELSE '.' END AS dir FROM source_files),
    g AS (SELECT *, regexp_replace(name, '\\.[^.]*$', '') AS stem, CASE ext WHEN 'go' THEN ends_with(file, '_test.go') WHEN 'py' THEN starts_with(name, 'test_') OR ends_with(name, '_test.py') OR name = 'conftest.py'
        WHEN 'rs' THEN contains(file, '/tests/') OR ends_with(name, '_test.rs') ELSE contains(file, '.test.') OR contains(file, '.spec.') END AS test FROM f),
    j AS (SELECT a.repo, a.file, b.file AS test_file, row_number() OVER (PARTITION BY a.repo, a.file ORDER BY (a.dir <> b.dir)::INT, b.file) AS rank FROM g a JOIN g b ON a.repo = b.repo AND NOT a.test AND b.test AND a.stem = regexp_replace(b.stem, '^test_|_test$|\\.(?:test|spec)$', '', 'g'))
    SELECT repo, file, CAST(rank AS BIGINT) AS rank, test_file FROM j WHERE rank <= 5""")
def related_tests(s, d):
    """SCH-07."""
    return lookup.related_tests(table(s, d, "source_files"))


@query("SELECT model, count(*) AS rows FROM component_vectors WHERE model IS DISTINCT FROM 'mini-64' GROUP BY model")
def model_mismatch(s, d):
    """SCH-13."""
    return lookup.other_models(table(s, d, "component_vectors"), "mini-64")


# ---------------------------------------------------------------- calls


CALLEES = "WITH " + C + r""", k AS (SELECT ord, repo, file, path, imports, unnest(callees) AS e, generate_subscripts(callees, 1) - 1 AS pos FROM c), n AS (SELECT *, string_split(regexp_replace(e.name, '^new ', ''), '.')[-1] AS name FROM k WHERE e.name IS NOT NULL),
    defs AS (SELECT DISTINCT repo, string_split(name, '.')[-1] AS name, path AS dst, file AS there FROM c WHERE name IS NOT NULL AND type <> 'documentation'),
    o AS (SELECT ord, pos, dst, CASE WHEN there = n.file THEN 0 WHEN coalesce(len(list_filter(imports, lambda i: ends_with('/' || regexp_replace(regexp_replace(there, '\.[^./]*$', ''), '/(index|__init__|mod)$', ''),
        '/' || regexp_replace(regexp_replace(i, '^(\.{1,2}/)+|^@[^/]*/|\.(js|ts|mjs|cjs)$', '', 'g'), '[.:]+', '/', 'g')))) > 0, false) THEN 1 ELSE 2 END AS w FROM n JOIN defs USING (repo, name) WHERE e.file IS NULL),
    b AS (SELECT ord, pos, min({'w': w, 'dst': dst}) AS m, count(*) AS c FROM o GROUP BY ALL),
    resolved AS (SELECT n.ord, CAST(n.pos AS BIGINT) AS pos, path AS src, e.name AS callee, CASE WHEN e.file = n.file THEN repo || '/' || e.file WHEN e.file IS NOT NULL THEN repo || '/' || regexp_replace(regexp_replace(regexp_replace(e.file, '(^|/)dist/', '\1src/'), '\.d\.ts$', '.ts'), '\.js$', '.ts') WHEN b.m.w < 2 OR b.c = 1 THEN b.m.dst END AS dst,
        CASE WHEN e.file IS NOT NULL THEN 'stated' WHEN b.m.w = 0 THEN 'own file' WHEN b.m.w = 1 THEN 'import' WHEN b.c = 1 THEN 'only file' END AS way FROM n LEFT JOIN b ON b.ord = n.ord AND b.pos = n.pos AND e.file IS NULL)"""


@query(CALLEES + " SELECT * FROM resolved")
def resolved_callees(s, d):
    """SRC-10, JN-01: the file of every callee as far as it can be told."""
    return refs.resolved_callees(components(s, d)).select("ord", F.col("pos").cast("bigint").alias("pos"), "src", "callee", "dst", "way")


@query(CALLEES + " SELECT src, dst, round(sqrt(count(*)), 6) AS weight FROM resolved WHERE src <> dst GROUP BY src, dst")
def call_dependency_edges(s, d):
    """AGG-09: call edges between files, callees told by name and import."""
    e = graph.weighted(refs.resolved_callees(components(s, d)).filter("dst IS NOT NULL").select("src", "dst"))
    return e.select("src", "dst", F.round("weight", 6).alias("weight"))


@query(None)
def call_graph(s, d):
    """AGG-09, GRF-01: weighted call edges between files, callees told by name and import, with the rank of both ends."""
    e = cut(graph.weighted(refs.resolved_callees(components(s, d)).filter("dst IS NOT NULL").select("src", "dst")))
    r = cut(graph.pagerank(e, graph.graph_nodes(e)))
    return e.join(r.select(F.col("node").alias("src"), F.round("rank", 7).alias("src_rank")), "src").join(r.select(F.col("node").alias("dst"), F.round("rank", 7).alias("dst_rank")), "dst")


@query(None)
def pattern_styles(s, d):
    """FN-25: styles of every file by rules and expressions together."""
    g = components(s, d).filter(F.col("type").isin("function", "method")).groupBy("repo", "file").agg(F.count("signature").alias("n"), F.count_if(T.annotated(F.col("signature"))).alias("annotated"))
    return patterns.styled(patterns.latest(table(s, d, "source_files")), g)


# ---------------------------------------------------------------- maps

LINES = TREE + f""", kids AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY name DESC) = 1 AS last FROM nodes), above AS (SELECT path, unnest({PATHS}) AS above FROM kids),
    f AS (SELECT a.path, list(CASE WHEN k.last THEN '   ' ELSE '│  ' END ORDER BY k.depth) AS bars, arg_max(k.last, k.depth) AS last FROM above a JOIN kids k ON k.path = a.above WHERE k.depth > 1 GROUP BY a.path),
    lines AS (SELECT k.path, replace(k.path, '/', chr(1)) AS sort, k.depth, CASE WHEN f.bars IS NULL THEN k.name || '/  ' || format('{{:,}}', components) || ' components'
        ELSE array_to_string(f.bars[1:len(f.bars) - 1], '') || CASE WHEN f.last THEN '└─ ' ELSE '├─ ' END || k.name || '/  ' || format('{{:,}}', components) END AS text FROM kids k LEFT JOIN f USING (path))"""


@query("WITH " + LINES + " SELECT path, sort, text FROM lines")
def map_text(s, d):
    """GRF-08, SRT-03."""
    return tree.rendered(tree.rolled_up(components(s, d)))


@query("WITH " + LINES.replace("FROM nodes), above", "FROM nodes WHERE depth <= 5), above") + """, t AS (SELECT depth, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM lines), g AS (SELECT depth, sum(length(t) + 1) AS chars, sum(len(string_split(t, ' '))) AS words FROM t GROUP BY depth),
    e AS (SELECT depth, CAST(greatest(ceil((sum(chars) OVER (ORDER BY depth) - 1) / 4.5), ceil(sum(words) OVER (ORDER BY depth) * 1.25)) AS BIGINT) AS tokens FROM g)
    SELECT depth, tokens, depth = coalesce(max(CASE WHEN tokens <= 4000 THEN depth END) OVER (), 1) AS chosen FROM e""")
def map_depth(s, d):
    """GRF-09."""
    return tree.depth_for_budget(tree.rolled_up(components(s, d)), 4000)


# ---------------------------------------------------------------- git log

FIRST = "WITH d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, hash ORDER BY ingested_at) AS rn FROM commits) WHERE rn = 1)"


@query(FIRST + """ SELECT repo, hash, nullif(short_hash, '') AS short_hash, nullif(author.name, '') AS author_name, nullif(author.email, '') AS author_email, nullif(author.date, '') AS author_date, subject, CASE WHEN coalesce(body, '') = '' THEN subject ELSE subject || chr(10) || chr(10) || body END AS message,
    CAST(coalesce(list_sum(list_transform(files, lambda f: coalesce(f.additions, 0))), 0) AS BIGINT) AS additions, CAST(coalesce(list_sum(list_transform(files, lambda f: coalesce(f.deletions, 0))), 0) AS BIGINT) AS deletions, CAST(coalesce(len(files), 0) AS BIGINT) AS files FROM d""")
def commit_records(s, d):
    """FN-15: every commit printed as a record and read back; absent fields are empty there."""
    r = gitlog.parse_records(gitlog.records(table(s, d, "commits"))).drop("issue_refs", "pr_refs", "parents")
    return r.select(*[F.nullif(c, F.lit("")).alias(c) if c in ("short_hash", "author_name", "author_email", "author_date") else c for c in r.columns])


@query(FIRST + f""" SELECT repo, hash FROM d WHERE committed_at >= TIMESTAMP '2024-01-01' AND committed_at <= TIMESTAMP '{NOW}' AND contains(concat_ws(' ', author.name, author.email), 'an')
    AND len(list_filter(files, lambda f: starts_with(f.path, 'lib/'))) > 0 AND NOT coalesce(starts_with(subject, 'Merge '), false)""")
def log_options(s, d):
    """SRC-29: a log by dates, author, folder and without merges."""
    c = gitlog.selected(table(s, d, "commits"), "2024-01-01 00:00:00", NOW, "an", "lib", merges=False)
    return delivered_once(c.select("repo", "hash", "ingested_at", "committed_at")).select("repo", "hash")


@query(FIRST + """, l AS (SELECT repo || '/' || hash AS file, hash, author.name AS author, committed_at, string_split(subject || CASE WHEN coalesce(body, '') = '' THEN '' ELSE chr(10) || body END, chr(10)) AS ls FROM d WHERE length(hash) = 40)
    SELECT file, CAST(unnest(range(1, len(ls) + 1)) AS BIGINT) AS line, hash, coalesce(author, '') AS author, CAST(coalesce(epoch_us(committed_at) // 1000000, 0) AS BIGINT) AS at, unnest(ls) AS content FROM l""")
def blame_lines(s, d):
    """FN-17, SRC-30: messages of all commits printed as blame and read back."""
    b = gitlog.parse_blame(gitlog.blamed(table(s, d, "commits").filter("length(hash) = 40")))
    return b.select("file", "line", "hash", F.coalesce("author", F.lit("")).alias("author"), F.unix_seconds("time").alias("at"), "content")


@query(r"""SELECT repo, CASE WHEN starts_with(remote, 'git@') THEN lower(regexp_replace(regexp_replace(regexp_replace(remote, '^git@', ''), '\.git$', ''), '^[^:]*:', ''))
    ELSE lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(remote, '^(?:https?://|ssh://git@)', ''), '/$', ''), '\.git$', ''), '^[^/]*/(.)', '\1')) END AS remote, branch, head, coalesce(dirty, false) AS dirty FROM repositories""")
def repository_info(s, d):
    """SRC-30."""
    return lookup.repositories(table(s, d, "repositories"))


# ---------------------------------------------------------------- formats and estimates


@query("WITH " + C + """, l AS (SELECT *, concat_ws(' ', type || ':', name, '(' || path || coalesce(':' || start_line, '') || ')') AS h, string_split(snippet, chr(10)) AS ls FROM c)
    SELECT ord, h AS minimal, concat_ws(chr(10), h, '   ' || signature) AS signature,
        concat_ws(chr(10), h, '   ' || replace(CASE WHEN len(ls) <= 10 THEN snippet ELSE array_to_string(ls[1:10], chr(10)) || chr(10) || '// ... ' || (len(ls) - 10) || ' more lines' END, chr(10), chr(10) || '   '),
            CASE WHEN len(imports) > 0 THEN '   Imports: ' || array_to_string(imports[1:5], ', ') || CASE WHEN len(imports) > 5 THEN ' ...' ELSE '' END END) AS "full" FROM l""")
def formatted_results(s, d):
    """SCH-14: every component in three levels of detail."""
    return lookup.formatted(components(s, d), "ord")


@query("WITH " + LANG + """ SELECT language, '{"components":' || components || ',"files":' || files || ',"language":"' || language || '","lines":' || lines || '}' AS json FROM l""")
def stats_json(s, d):
    """SNK-07."""
    return stats.to_json_rows(stats.by_language(components(s, d)), "language")


@query("""SELECT repo, CAST(greatest(ceil(length(j) / 4.5), ceil(len(string_split(j, ' ')) * 1.25)) AS BIGINT) AS tokens FROM (SELECT repo, '{"repo":"' || repo || '","branch":"' || coalesce(branch, '') || '","dirty":' || CASE WHEN coalesce(dirty, false) THEN 'true' ELSE 'false' END || '}' AS j FROM repositories)""")
def json_tokens(s, d):
    """FN-03: tokens of every repository as a JSON object."""
    r = table(s, d, "repositories")
    return r.select("repo", T.estimate_tokens(F.to_json(F.struct("repo", F.coalesce("branch", F.lit("")).alias("branch"), F.coalesce("dirty", F.lit(False)).alias("dirty")))).alias("tokens"))


@query("WITH " + C + " SELECT repo, CAST(ceil(sum(length(coalesce(text, ''))) / 4) AS BIGINT) AS tokens FROM c GROUP BY repo")
def character_tokens(s, d):
    """FN-04: a fourth of all characters of a repository's components, rounded up."""
    return components(s, d).groupBy("repo").agg(F.ceil(F.sum(F.length(F.coalesce("text", F.lit("")))) / 4).cast("bigint").alias("tokens"))


@query("""SELECT repo, lower(regexp_replace(repo, '[^a-zA-Z0-9-]', '-', 'g')) || CASE WHEN branch IN ('main', 'master') THEN '-code' ELSE '-' || regexp_replace(coalesce(branch, ''), '[^a-zA-Z0-9-]', '-', 'g') END AS name FROM repositories""")
def table_names(s, d):
    """FN-11: a table name from the store's project and kind."""
    clean = lambda c: F.regexp_replace(c, "[^a-zA-Z0-9-]", "-")
    r = table(s, d, "repositories")
    return r.select("repo", F.concat(F.lower(clean("repo")), F.when(F.col("branch").isin("main", "master"), "-code").otherwise(F.concat(F.lit("-"), clean(F.coalesce("branch", F.lit("")))))).alias("name"))


@query("""SELECT event_id, CASE WHEN v < 1000 THEN v || 'ms' WHEN v < 60000 THEN format('{:.2f}', v / 1000) || 's' ELSE v // 60000 || 'm ' || (v // 1000) % 60 || 's' END AS duration, format('{:,}', v) AS number,
    CASE WHEN h < 1 THEN 'just now' WHEN h < 60 THEN h || ' minute' || CASE WHEN h = 1 THEN '' ELSE 's' END || ' ago' WHEN h < 1440 THEN h // 60 || ' hour' || CASE WHEN h // 60 = 1 THEN '' ELSE 's' END || ' ago'
        WHEN h < 10080 THEN h // 1440 || ' day' || CASE WHEN h // 1440 = 1 THEN '' ELSE 's' END || ' ago' ELSE strftime(ts, '%Y-%m-%d') END AS since
    FROM (SELECT event_id, ts, CAST(floor(value * 1000) AS BIGINT) AS v, CAST(floor((epoch_us(TIMESTAMP '2024-01-08') - epoch_us(ts)) / 60000000) AS BIGINT) AS h FROM events)""")
def formats(s, d):
    """FN-36: durations, numbers and ages of every event."""
    e = table(s, d, "events").select("event_id", "ts", F.floor(F.col("value") * 1000).cast("bigint").alias("v"))
    return e.select("event_id", T.human_duration(F.col("v")).alias("duration"), F.format_number("v", 0).alias("number"), T.human_age(F.col("ts"), F.lit("2024-01-08 00:00:00").cast("timestamp")).alias("since"))


@query("""WITH RECURSIVE e AS (SELECT user_id AS key, event_id AS seq, epoch_us(ts) / 1000000.0::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    r AS (SELECT key, seq, t, n, 5.0::DOUBLE AS have FROM e WHERE n = 1 UNION ALL SELECT e.key, e.seq, e.t, e.n, least(5.0::DOUBLE, (CASE WHEN r.have >= 1 THEN r.have - 1 ELSE r.have END) + greatest(0.0::DOUBLE, e.t - r.t) * (1 / 21600.0::DOUBLE)) FROM r JOIN e ON e.key = r.key AND e.n = r.n + 1)
    SELECT key, seq, have >= 1 AS allowed, round(CASE WHEN have >= 1 THEN have - 1 ELSE have END, 6) AS tokens FROM r""")
def token_bucket_rounded(s, d):
    """STM-09: token_bucket with the tokens left rounded, so that SQL can be compared."""
    return token_bucket(s, d).select("key", "seq", "allowed", F.round("left", 6).alias("tokens"))


@query(None)
def rate_status(s, d):
    """AGG-30: tokens left and capacity of every key after its last request."""
    return token_bucket(s, d).groupBy("key").agg(F.max_by("left", "seq").alias("available")).withColumn("capacity", F.lit(5.0))

