"""SQL for DuckDB that gives the rows of those queries that SQL can express."""

from __future__ import annotations

from tidemark.llm import quality_rules as rules


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_CLOSERS = " || ".join([_text("".join(c for c in rules.CLOSERS if c not in "\t\r")), "chr(9)", "chr(13)"])
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

QUALITY_RULES = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, [w FOR w IN regexp_split_to_array(t, {_text(rules.SPACE)}) IF w <> ''] AS w, string_split(t, chr(10)) AS lines FROM t),
g AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w),
d AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM d, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS "at" FROM w),
e AS (SELECT *, right(rtrim(line, {_CLOSERS}), 1) AS last, length(line) - length(replace(line, ' ', '')) AS gaps FROM l),
k AS (SELECT doc_id, line, "at" FROM e WHERE NOT regexp_matches(line, {_text(rules.NOT_SPACE)})
  OR (((last <> '' AND contains({_text(rules.TERMINALS)}, last)) OR regexp_matches(line, {_text(rules.SENTENCE)})) AND len(regexp_extract_all(line, {_text(rules.MARKS)})) * 4 <= gaps + 1
    AND NOT (gaps < {rules.MENU_WORDS} AND regexp_matches(trim(line), {_text(rules.NAVIGATION)})) AND NOT regexp_matches(line, {_text(rules.BOILERPLATE)}))),
c AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY "at") AS clean FROM k GROUP BY doc_id),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum([length(x) FOR x IN w]), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(t, {_text(rules.SYMBOLS)}))::BIGINT AS n_symbols,
  (len([x FOR x IN lines IF regexp_matches(x, {_text(rules.NOT_SPACE)})]) - len(list_distinct([x FOR x IN lines IF regexp_matches(x, {_text(rules.NOT_SPACE)})])))::BIGINT AS n_dup_lines,
  coalesce(r.n, 0)::BIGINT AS n_repeat_words, length(regexp_replace(coalesce(clean, ''), {_text(rules.SPACE)}, '', 'g')) AS stay
  FROM w LEFT JOIN r USING (doc_id) LEFT JOIN c USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, CASE WHEN word_chars = 0 THEN 0 ELSE 1 - stay / word_chars END::DOUBLE AS lost FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND lost <= 0.5 AS kept, round(lost, 6) AS lost FROM f
"""

DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
i AS (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS a FROM b WHERE len(w) > 0),
v AS (SELECT DISTINCT item_id, n, list_aggregate(w[a:a + n - 1], 'string_agg', ' ') AS x FROM i),
s AS (SELECT DISTINCT n FROM v),
p AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS a FROM d, s),
h AS (SELECT doc_id, item_id, p.n, a FROM p JOIN v ON p.n = v.n AND list_aggregate(w[a:a + p.n - 1], 'string_agg', ' ') = v.x),
c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(a, a + n)) AS k FROM h) GROUP BY doc_id),
j AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS x FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(x, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN j USING (doc_id)
"""

_FINITE = "embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0"


def _round(n: int) -> str:
    """Vectors at their nearest centroids of round n, and the centroids of the next round."""
    return f"""
n{n} AS (SELECT vec_id, c, d FROM (SELECT vec_id, c, list_sum([(k.v[i] - c{n}.v[i]) * (k.v[i] - c{n}.v[i]) FOR i IN range(1, 65)])::BIGINT AS d FROM k, c{n}) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1),
m{n} AS (SELECT c, list(m ORDER BY i) AS v FROM (SELECT c, i, floor(sum(x) / count(*))::BIGINT AS m FROM (SELECT c, unnest(range(1, 65)) AS i, unnest(v) AS x FROM n{n} JOIN k USING (vec_id)) GROUP BY c, i) GROUP BY c),
c{n + 1} AS (SELECT c, coalesce(m{n}.v, c{n}.v) AS v FROM c{n} LEFT JOIN m{n} USING (c)),"""


CENTROIDS = f"""
WITH k AS (SELECT vec_id, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings WHERE len(embedding) = 64 AND {_FINITE}),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, v FROM k QUALIFY c < 16),{"".join(map(_round, range(4)))}
s AS (SELECT c, sum(d)::BIGINT AS cluster_inertia FROM n3 GROUP BY c)
SELECT vec_id, c::INT AS cluster, d AS distance, cluster_inertia, (SELECT sum(d)::BIGINT FROM n3) AS inertia, sha256(array_to_string(v, ',')) AS centroid_sha256
FROM n3 JOIN s USING (c) JOIN c3 USING (c)
"""

TOP_PRODUCTS = f"""
WITH k AS (SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings WHERE {_FINITE}),
p AS (SELECT q.vec_id AS query_id, o.vec_id, list_inner_product(q.v, o.v)::BIGINT AS score FROM k q JOIN k o ON q.vec_id % 50 = 0 AND o.vec_id <> q.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM p QUALIFY rank <= 5
"""
