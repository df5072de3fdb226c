"""SQL counterparts, for DuckDB, of those queries that SQL can express."""

from __future__ import annotations

from tidemark.llm.secrets import RULES

ORACLES: dict[str, str] = {}


def _spans(number: int) -> str:
    """Positions are sums over the gaps and matches before; the pattern's case sets are spelt out."""
    rule = RULES[number]
    pattern = rule.pattern.replace("(?i:", "(?:").replace("'", "''")
    if rule.kind == "assign":
        for word in ("password", "passwd", "secret", "token", "api_?key"):
            pattern = pattern.replace(
                word, "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
            )
    pattern = pattern.replace(r"\x20", " ")
    return f"""
    SELECT id, unnest(list_transform(
        list_filter(range(1, len(whole) + 1), lambda i: length(value[i]) >= {rule.at_least}),
        lambda i: {{'start': list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda w: length(w))), 0),
              'kind': {number}, 'size': length(whole[i]), 'name': '{rule.kind}'}})) AS span
    FROM (SELECT id, regexp_extract_all(text, '{pattern}') AS whole,
                 regexp_extract_all(text, '{pattern}', {rule.group}) AS value,
                 string_split_regex(text, '{pattern}') AS gaps FROM d)"""


ORACLES["op6_secrets"] = f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
s AS ({" UNION ALL ".join(_spans(number) for number in range(len(RULES)))}),
p AS (SELECT id, span.kind AS kind, span.start AS start,
             concat(span.name, ':', CAST(span.start AS BIGINT), ':', CAST(span.start + span.size AS BIGINT)) AS listed FROM s)
SELECT d.doc_id,
       count(*) FILTER (p.kind = 0) AS n_assign,
       count(*) FILTER (p.kind = 1) AS n_access,
       count(*) FILTER (p.kind = 2) AS n_hex,
       sha256(coalesce(string_agg(p.listed, ',' ORDER BY p.start, p.kind) FILTER (p.kind < 3), '')) AS base_sha256,
       coalesce(string_agg(p.listed, ',' ORDER BY p.start, p.kind), '') AS spans
FROM d LEFT JOIN p USING (id) GROUP BY d.id, d.doc_id
"""

#: Letters A-Z only, as the contract has it.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op10_near_duplicates"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
        ELSE [array_to_string(words[i:i + 3], ' ') FOR i IN range(1, len(words) - 2)] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
          GROUP BY x.doc_id, y.doc_id
          HAVING 100 * count(*) >= 80 * ((SELECT n FROM n WHERE doc_id = x.doc_id) + (SELECT n FROM n WHERE doc_id = y.doc_id) - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

ORACLES["op4_near_vectors"] = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT vec_id, label, e FROM v WHERE label IS NOT NULL AND e IS NOT NULL
       AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM ok x JOIN ok y ON x.label = y.label AND x.vec_id <> y.vec_id
          AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)
"""

#: Usable vectors as whole numbers; list positions start at 1.
_SCALED = """
SELECT {columns}, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor({scale} * x)) AS e FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""

ORACLES["op11_hard_negatives"] = f"""
WITH v AS ({_SCALED.format(columns="vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label", scale=256)}
           AND label IS NOT NULL),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10
"""


def _assigned(name: str, centroids: str) -> str:
    """Nearest centroid of each vector, smaller numbers first."""
    square = "CAST(list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
    return f"""{name} AS MATERIALIZED (
        SELECT vec_id, min({{'d': {square}, 'c': c.c}}) AS best FROM v CROSS JOIN {centroids} c GROUP BY vec_id)"""


def _means(name: str, centroids: str, assigned: str) -> str:
    """Floors of the means; the other centroids stay."""
    return f"""{name} AS MATERIALIZED (
        SELECT c.c, coalesce(m.e, c.e) AS e FROM {centroids} c LEFT JOIN (
            SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS e FROM (
                SELECT best.c AS c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (
                    SELECT best, unnest(v.e) AS x, generate_subscripts(v.e, 1) AS i FROM {assigned} JOIN v USING (vec_id)) GROUP BY 1, 2)
            GROUP BY c) m USING (c))"""


ORACLES["op12_centroids"] = f"""
WITH v AS MATERIALIZED ({_SCALED.format(columns="vec_id", scale=64)} AND len(embedding) = 64),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS INTEGER) AS c, e
    FROM v ORDER BY sha256('1:' || vec_id) LIMIT 16),
{_assigned("a0", "c0")}, {_means("c1", "c0", "a0")},
{_assigned("a1", "c1")}, {_means("c2", "c1", "a1")},
{_assigned("a2", "c2")}, {_means("c3", "c2", "a2")},
{_assigned("a3", "c3")}
SELECT vec_id, best.c AS cluster, best.d AS distance,
       CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(list_transform(c3.e, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM a3 JOIN c3 ON c3.c = best.c
"""
