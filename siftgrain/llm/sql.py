"""SQL of the queries that SQL can state."""

_TERMS = r"""
WITH u AS (SELECT id, min(retrieval_text) AS t FROM retrieval_units WHERE id IS NOT NULL GROUP BY id),
f AS (
  SELECT id AS unit_id, lower(run) AS term, count(*)::INT AS tf
  FROM (SELECT id, unnest(regexp_extract_all(t, '[\p{L}\p{N}]+')) AS run FROM u)
  WHERE regexp_matches(run, '^\p{L}') AND length(run) >= 5 GROUP BY ALL),
g AS (SELECT term, count(*) AS df, ln(sum(tf)) - sum(tf * ln(tf)) / sum(tf) AS entropy FROM f GROUP BY term),
s AS (SELECT unit_id, f.term, tf, df, round(ln(1 + tf) * (1 - entropy / ln((SELECT count(*) FROM u))), 6) AS score FROM f JOIN g USING (term))
"""

SQL = {
    "p3_found": """
SELECT DISTINCT u.id AS unit_id FROM retrieval_units u LEFT JOIN split_limits l ON u.analyzer_id = l.analyzer_id
WHERE strlen(u.retrieval_text) > coalesce(l.max_bytes, (SELECT max_bytes FROM split_limits WHERE analyzer_id = 'default'))
""",
    "p4_found": _TERMS + "SELECT unit_id, term FROM s WHERE tf >= 3 AND df BETWEEN 2 AND 4",
    "p4_scores": _TERMS + "SELECT unit_id, term, tf, df, score FROM s",
}
