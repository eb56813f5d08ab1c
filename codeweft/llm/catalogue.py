"""Queries pN_... and the SQL of those that DuckDB can run on whole tables."""

from __future__ import annotations

from codeweft.llm import chunks, docpairs, handwritten, leaks, neighbours, persons, spans, syntax, tokenize
from codeweft.session import table

QUERIES = {
    "p1_found": lambda s, d: handwritten.found(table(s, d, "source_files"), table(s, d, "upstream_files")),
    "p1_verdicts": lambda s, d: handwritten.judged(table(s, d, "source_files"), table(s, d, "upstream_files")),
    "p1_held_out": lambda s, d: handwritten.held_out(table(s, d, "source_files"), table(s, d, "upstream_files")),
    "p2_found": lambda s, d: syntax.found(table(s, d, "source_files")),
    "p2_errors": lambda s, d: syntax.syntax_errors(table(s, d, "source_files")),
    "p2_rates": lambda s, d: syntax.rates(table(s, d, "source_files")),
    "p3_found": lambda s, d: neighbours.found(table(s, d, "component_vectors")),
    "p3_neighbours": lambda s, d: neighbours.neighbours(table(s, d, "component_vectors")),
    "p4_found": lambda s, d: persons.found(table(s, d, "git_persons"), table(s, d, "nicknames")),
    "p4_entities": lambda s, d: persons.entities(table(s, d, "git_persons"), table(s, d, "nicknames")),
    "p5_found": lambda s, d: docpairs.found(table(s, d, "source_files")),
    "p5_pairs": lambda s, d: docpairs.pairs(table(s, d, "source_files")),
    "p6_found": lambda s, d: chunks.found(table(s, d, "components")),
    "p6_pieces": lambda s, d: chunks.pieces(table(s, d, "components")),
    "p7_ids": lambda s, d: tokenize.token_ids(table(s, d, "documents")),
    "p8_found": lambda s, d: leaks.found(table(s, d, "documents"), table(s, d, "eval_items")),
    "p8_leaks": lambda s, d: leaks.leaks(table(s, d, "documents"), table(s, d, "eval_items")),
    "p9_found": lambda s, d: spans.found(table(s, d, "documents")),
    "p9_coverage": lambda s, d: spans.coverage(table(s, d, "documents")),
    "p9_clusters": lambda s, d: spans.clusters(table(s, d, "documents")),
}

ORACLES = {
    "p6_found": """
        SELECT ord, 'snippet' AS field FROM components WHERE length(snippet) > 1600
        UNION ALL SELECT ord, 'text' AS field FROM components WHERE length(text) > 1600""",
    "p8_found": """
        WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
        e AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items),
        dw AS (SELECT doc_id, array_to_string(w[i : i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
        ew AS (SELECT item_id, array_to_string(w[i : i + 19], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 18)) AS i FROM e))
        SELECT DISTINCT doc_id, item_id FROM dw JOIN ew USING (g)""",
    "p9_found": """
        WITH w AS (
            SELECT doc_id, hash(substring(text, i::INT, 200)) AS h
            FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200)
        ), shared AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) < max(doc_id))
        SELECT DISTINCT doc_id FROM w WHERE h IN (SELECT h FROM shared)""",
    "p9_coverage": """
        WITH w AS (
            SELECT doc_id, i, hash(substring(text, i::INT, 200)) AS h
            FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200)
        ), shared AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) < max(doc_id)),
        s AS (SELECT DISTINCT doc_id, i FROM w WHERE h IN (SELECT h FROM shared)),
        g AS (SELECT doc_id, least(200, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 200)) AS n FROM s)
        SELECT g.doc_id, CAST(length(any_value(text)) AS BIGINT) AS n_chars, CAST(sum(n) AS BIGINT) AS shared_chars,
               CAST(sum(n) AS DOUBLE) / length(any_value(text)) AS share
        FROM g JOIN documents USING (doc_id) GROUP BY g.doc_id""",
}
