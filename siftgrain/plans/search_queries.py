"""Search, paths and text queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftgrain.functions import paths as P
from siftgrain.operators import index as I
from siftgrain.operators import lexical as L
from siftgrain.plans.base import BASE, KIND, index_of, latest, occurrences, units

TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
#: (name, expression, SQL condition, positive terms)
EXPRESSIONS = [
    ("search_or", "journal registry voucher", "has(0) OR has(1) OR has(2)", ["journal", "registry", "voucher"]),
    ("search_and", "journal AND voucher AND limit", "has(0) AND has(1) AND has(2)", ["journal", "voucher", "limit"]),
    ("search_not", "journal AND NOT voucher", "has(0) AND NOT list_contains(tokens, 'voucher')", ["journal"]),
    ("search_phrase", '"checksum mismatch" OR ledger_entry', "phrase('checksum mismatch') OR phrase('ledger entry')", ["checksum", "mismatch", "ledger", "entry"]),
    ("search_nested", "(journal OR ledger) AND (voucher OR NOT limit)", "(has(0) OR has(1)) AND (has(2) OR NOT list_contains(tokens, 'limit'))", ["journal", "ledger", "voucher"]),
]


def _scored_sql(condition: str, terms: list[str]) -> str:
    for i, t in enumerate(terms):
        condition = condition.replace(f"has({i})", f"list_contains(tokens, '{t}')")
    import re

    condition = re.sub(r"phrase\('([^']*)'\)", r"contains(' ' || array_to_string(tokens, ' ') || ' ', ' \1 ')", condition)
    tf = ", ".join(f"len(list_filter(tokens, lambda x: x = '{t}')) AS tf_{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (tf_{i} > 0) AS df_{i}" for i in range(len(terms)))
    score = " + ".join(f"CASE WHEN tf_{i} > 0 THEN greatest(ln((n - df_{i} + 0.5) / (df_{i} + 0.5)), 1e-6) * tf_{i} * 2.2 / (tf_{i} + 1.2 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END" for i in range(len(terms)))
    return f"""{BASE},
t AS (SELECT *, {TOKENS} AS tokens FROM units),
c AS (SELECT *, len(tokens) AS dl, {tf}, ({condition}) AS matches FROM t),
st AS (SELECT repository_id AS r, count(*) AS n, avg(dl) AS avgdl, {df} FROM c GROUP BY 1),
hits AS (SELECT unit_id, repository_id, path, text, freshness_state, round({score}, 6) AS score FROM c JOIN st ON repository_id IS NOT DISTINCT FROM r WHERE matches)
"""


QUERIES, SQL = {}, {}
# builds the index, which the searches after it read
QUERIES["search_index"] = lambda spark, sf: spark.read.parquet(f"{index_of(spark, sf)}/stats").select("repository_id", F.col("n").alias("n_units"), F.round("avgdl", 6).alias("mean_tokens"))
SQL["search_index"] = f"{BASE} SELECT repository_id, count(*) AS n_units, round(avg(len({TOKENS})), 6) AS mean_tokens FROM units GROUP BY 1"
for _name, _expression, _condition, _terms in EXPRESSIONS:
    QUERIES[_name] = lambda spark, sf, e=_expression: I.score_units(spark, index_of(spark, sf), e).select("unit_id", "repository_id", "path", "score")
    SQL[_name] = _scored_sql(_condition, _terms) + "SELECT unit_id, repository_id, path, score FROM hits"

_OR = EXPRESSIONS[0]
QUERIES |= {
    "search_top_scoped": lambda spark, sf: I.score_units(spark, index_of(spark, sf), _OR[1]).where(P.in_scope(F.col("path"), prefix="services")).orderBy(F.desc("score"), "unit_id").limit(10).select("unit_id", "path", "score"),
    "search_collapse": lambda spark, sf: L.collapse(I.score_units(spark, index_of(spark, sf), _OR[1])).withColumn("also_in", F.array_join("also_in", ",")),
    "rrf_merge_repos": lambda spark, sf: L.merge_repositories(I.score_units(spark, index_of(spark, sf), _OR[1])).select("unit_id", "repository_id", "place", "rrf_score"),
    "term_diagnostics": lambda spark, sf: L.term_diagnostics(units(spark, sf), ["journal", "zzznothing", "voucher", "limit"]),
    "postings": lambda spark, sf: L.postings(units(spark, sf)),
    "corpus_stats": lambda spark, sf: L.corpus_stats(units(spark, sf)),
    "focused_snippet": lambda spark, sf: units(spark, sf).where(F.col("text").contains("checksum mismatch")).select("unit_id", L.focused_snippet(F.col("text"), ["checksum", "mismatch"]).alias("snippet")),
    "grep_literal": lambda spark, sf: L.grep(units(spark, sf), "TODO remove"),
    "grep_regex": lambda spark, sf: L.grep(units(spark, sf), r"(?:raise|throw) [A-Za-z ]+Error", regex=True),
    "file_window": lambda spark, sf: units(spark, sf).select("unit_id", L.line_window(F.col("text"), 2, 3).alias("window_text")),
    "chunk_lines": lambda spark, sf: units(spark, sf).select("unit_id", F.inline(L.pack_lines(F.col("text"), 500))).select("unit_id", "first", "n", "size"),
    "path_scope_exact": lambda spark, sf: latest(spark, sf).where(P.in_scope(F.col("path"), exact="apps/batch-load-18/docs/request_volume_pack.toml")).select("repository_id", "path"),
    "path_scope_prefix": lambda spark, sf: latest(spark, sf).where(P.in_scope(F.col("path"), prefix="tools/")).select("repository_id", "path"),
    "path_scope_glob": lambda spark, sf: latest(spark, sf).where(P.in_scope(F.col("path"), glob="libs/*/core/*.?s")).select("repository_id", "path"),
    "path_suffix_lookup": lambda spark, sf: latest(spark, sf).where(P.ends_with_path(F.col("path"), "beacon.yaml")).select("repository_id", "path"),
    "source_type_label": lambda spark, sf: latest(spark, sf).select("path", P.source_type(F.col("path")).alias("source_type")).withColumns({"authority": P.authority(F.col("source_type")), "label": P.search_label(F.col("source_type"))}).groupBy("source_type", "authority", "label").agg(F.count("*").alias("n")),
    "security_forbidden": lambda spark, sf: latest(spark, sf).groupBy(P.is_forbidden(F.col("path")).alias("forbidden")).agg(F.count("*").alias("n")),
    "discovery_priority": lambda spark, sf: latest(spark, sf).groupBy(P.priority(F.col("path"), ["**/vendor/*/README.md"], ["**/vendor/**", "**/node_modules/**"], ["**/test/*"], ["*/*/src/**"]).alias("priority")).agg(F.count("*").alias("n")),
    "language_from_path": lambda spark, sf: occurrences(spark, sf, "path", "language").groupBy(P.language_of(F.col("path")).alias("by_path"), F.lower(F.trim("language")).alias("claimed")).agg(F.count("*").alias("n")),
    "repo_map_tree": lambda spark, sf: (
        latest(spark, sf, "size_bytes").where("existence_state <> 'deleted'").select("repository_id", "size_bytes", F.split("path", "/").alias("p"))
        .select("repository_id", "size_bytes", F.explode(F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(F.col("p"), 1, n), "/").alias("directory")))).alias("d"))
        .groupBy("repository_id", "d.depth", "d.directory").agg(F.count("*").alias("n_files"), F.sum("size_bytes").alias("n_bytes"))
    ),
}

_FOLDED = "regexp_extract_all(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[\\p{L}\\p{N}]+')"
QUERIES["search_folded"] = lambda spark, sf: I.score_units(spark, index_of(spark, sf), "límite OR Zähler OR vérification").select("unit_id", "repository_id", "path", "score")
SQL["search_folded"] = _scored_sql("has(0) OR has(1) OR has(2)", ["limite", "zahler", "verification"]).replace(TOKENS, _FOLDED) + "SELECT unit_id, repository_id, path, score FROM hits"

SQL |= {
    "search_top_scoped": _scored_sql(_OR[2], _OR[3]) + "SELECT unit_id, path, score FROM hits WHERE path = 'services' OR starts_with(path, 'services/') ORDER BY score DESC, unit_id LIMIT 10",
    "search_collapse": _scored_sql(_OR[2], _OR[3]) + """,
r AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY score DESC, unit_id) AS place FROM hits)
SELECT arg_min(unit_id, place) AS unit_id, max(score) AS score, coalesce(array_to_string(list_sort(list(unit_id) FILTER (place > 1 AND place <= 65)), ','), '') AS also_in, greatest(count(*) - 65, 0) AS n_omitted FROM r GROUP BY text""",
    "rrf_merge_repos": _scored_sql(_OR[2], _OR[3]) + "SELECT unit_id, repository_id, row_number() OVER w AS place, round(1 / (60 + row_number() OVER w), 9) AS rrf_score FROM hits WINDOW w AS (PARTITION BY repository_id ORDER BY score DESC, unit_id) QUALIFY place <= 20",
    "term_diagnostics": f"{BASE}, t AS (SELECT {TOKENS} AS tokens FROM units) SELECT term, (SELECT count(*) FROM t WHERE list_contains(tokens, term)) AS n_units FROM (SELECT unnest(['journal', 'zzznothing', 'voucher', 'limit']) AS term)",
    "postings": f"{BASE}, t AS (SELECT unit_id, unnest({TOKENS}) AS term, generate_subscripts({TOKENS}, 1) - 1 AS position FROM units) SELECT term, unit_id, count(*) AS tf, min(position) AS first_position FROM t GROUP BY ALL",
    "corpus_stats": f"{BASE} SELECT repository_id, count(*) AS n_units, sum(len({TOKENS}))::BIGINT AS n_tokens FROM units GROUP BY 1",
    "focused_snippet": BASE + r""", l AS (SELECT unit_id, string_split(text, chr(10)) AS rows FROM units WHERE contains(text, 'checksum mismatch')),
s AS (SELECT unit_id, rows, unnest(rows) AS line, generate_subscripts(rows, 1) - 1 AS pos FROM l),
b AS (SELECT unit_id, any_value(rows) AS rows, arg_max(pos, n * 1000000 - pos) AS best FROM (SELECT *, list_contains(regexp_extract_all(lower(line), '[\p{L}\p{N}]+'), 'checksum')::INT + list_contains(regexp_extract_all(lower(line), '[\p{L}\p{N}]+'), 'mismatch')::INT AS n FROM s) GROUP BY unit_id)
SELECT unit_id, substr(array_to_string(rows[greatest(best - 1, 0) + 1 : best + 2], chr(10)), 1, 240) AS snippet FROM b""",
    "grep_literal": BASE + ", l AS (SELECT unit_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM units) SELECT unit_id, line_no, strlen(split_part(line, 'TODO remove', 1)) + 1 AS byte_column, line FROM l WHERE contains(line, 'TODO remove')",
    "grep_regex": BASE + r", l AS (SELECT unit_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM units) SELECT unit_id, line_no, strlen(regexp_extract(line, '^(.*?)(?:raise|throw) [A-Za-z ]+Error', 1)) + 1 AS byte_column, line FROM l WHERE regexp_matches(line, '(?:raise|throw) [A-Za-z ]+Error')",
    "file_window": BASE + "SELECT unit_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS window_text FROM units",
    "chunk_lines": BASE.replace("WITH occ", "WITH RECURSIVE occ", 1) + """, l AS (SELECT unit_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM units), s AS (SELECT unit_id, k, (strlen(line) + 1)::INT AS s FROM l),
f AS (SELECT unit_id, k, k AS first, s AS size FROM s WHERE k = 0 UNION ALL SELECT s.unit_id, s.k, CASE WHEN size + s.s <= 500 THEN first ELSE s.k END, CASE WHEN size + s.s <= 500 THEN size + s.s ELSE s.s END FROM f JOIN s ON s.unit_id = f.unit_id AND s.k = f.k + 1)
SELECT unit_id, first::INT AS first, count(*)::INT AS n, max(size) AS size FROM f GROUP BY 1, 2""",
    "path_scope_exact": BASE + "SELECT repository_id, path FROM newest WHERE path = 'apps/batch-load-18/docs/request_volume_pack.toml'",
    "path_scope_prefix": BASE + "SELECT repository_id, path FROM newest WHERE path = 'tools' OR starts_with(path, 'tools/')",
    "path_scope_glob": BASE + "SELECT repository_id, path FROM newest WHERE path GLOB 'libs/*/core/*.?s' OR regexp_matches(path, '^libs/.*/core/.*\\..s$')",
    "path_suffix_lookup": BASE + "SELECT repository_id, path FROM newest WHERE path = 'beacon.yaml' OR ends_with(path, '/beacon.yaml')",
    "source_type_label": BASE + f""", s AS (SELECT {KIND} AS source_type FROM newest)
SELECT source_type, CASE source_type WHEN 'SOURCE_CODE' THEN 'IMPLEMENTATION' WHEN 'CONFIGURATION' THEN 'CONFIGURED' WHEN 'TEST' THEN 'TEST_EXPECTATION' WHEN 'KNOWLEDGE' THEN 'PROJECT_KNOWLEDGE' ELSE 'DOC' END AS authority,
  CASE source_type WHEN 'SOURCE_CODE' THEN 'code' WHEN 'CONFIGURATION' THEN 'config' ELSE lower(source_type) END AS label, count(*) AS n FROM s GROUP BY 1""",
    "security_forbidden": BASE + r"SELECT regexp_matches(path, '(^|/)\.(git|ssh|gnupg)(/|$)') OR regexp_matches(lower(path), '\.(pem|key|p12|jks)$|(^|/)\.env(\.[^/]*)?$') AS forbidden, count(*) AS n FROM newest GROUP BY 1",
    "discovery_priority": BASE + r"""SELECT CASE WHEN regexp_matches(path, '^(.*/)?vendor/.*$|^(.*/)?node_modules/.*$') AND NOT regexp_matches(path, '^(.*/)?vendor/[^/]*/README\.md$') THEN 'ignored'
  WHEN regexp_matches(path, '^[^/]*/[^/]*/src/.*$') THEN 'high' WHEN regexp_matches(path, '^(.*/)?test/[^/]*$') THEN 'low' ELSE 'normal' END AS priority, count(*) AS n FROM newest GROUP BY 1""",
    "language_from_path": BASE + """, m AS (SELECT * FROM (VALUES ('py','python'),('java','java'),('js','javascript'),('ts','typescript'),('go','go'),('rs','rust'),('json','json'),('yaml','yaml'),('yml','yaml'),('toml','toml'),('md','markdown')) v(e, l))
SELECT l AS by_path, lower(trim(language)) AS claimed, count(*) AS n FROM occ LEFT JOIN m ON e = lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) GROUP BY ALL""",
    "repo_map_tree": BASE + """, p AS (SELECT repository_id, size_bytes, string_split(path, '/') AS p FROM newest WHERE existence_state <> 'deleted'),
d AS (SELECT repository_id, size_bytes, p, unnest(generate_series(1, len(p) - 1)) AS depth FROM p)
SELECT repository_id, depth, array_to_string(p[1:depth], '/') AS directory, count(*) AS n_files, sum(size_bytes)::BIGINT AS n_bytes FROM d GROUP BY ALL""",
}
