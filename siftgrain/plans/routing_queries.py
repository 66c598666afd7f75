"""Questions: their types, terms and hints, what their answers require, and how searches widen; with SQL whose values are stated anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftgrain.functions.paths import source_type
from siftgrain.operators import evidence as E
from siftgrain.operators import routing as R
from siftgrain.plans.base import BASE, KIND, units
from siftgrain.sources.tables import read_table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """``question_id, question``: the held-out items, and one question per citation, worded by its kind."""
    items = read_table(spark, sf, "eval_items", "item_id", "item_text").select(F.concat(F.lit("item:"), "item_id").alias("question_id"), F.col("item_text").alias("question"))
    c = read_table(spark, sf, "spec_citations", "run_id", "ordinal", "citation_kind", "cited_path", "cited_symbol").dropDuplicates(["run_id", "ordinal"])
    path, symbol = F.coalesce("cited_path", F.lit("")), F.coalesce("cited_symbol", F.lit("x"))
    text = (
        F.when(F.col("citation_kind") == "EXISTING_REF", F.concat(F.lit("Show me the file "), path)).when(F.col("citation_kind") == "TARGET_MODIFY", F.concat(F.lit("What would break if "), path, F.lit(" changed?")))
        .when(F.col("citation_kind") == "TARGET_CREATE_SYMBOL", symbol).when(F.col("citation_kind") == "TARGET_CREATE_FILE", F.concat(F.lit("How is "), path, F.lit(" tested?")))
        .when(F.col("citation_kind") == "ALLOW_GLOB", F.concat(F.lit("Explain the setting of "), path)).otherwise("which services use this dependency, and who calls it?")
    )
    return items.union(c.select(F.concat_ws("#", "run_id", "ordinal"), text))


_QUESTIONS = r"""WITH questions AS (SELECT 'item:' || item_id AS question_id, item_text AS question FROM eval_items UNION ALL
  SELECT run_id || '#' || ordinal, CASE any_value(citation_kind) WHEN 'EXISTING_REF' THEN 'Show me the file ' || coalesce(any_value(cited_path), '') WHEN 'TARGET_MODIFY' THEN 'What would break if ' || coalesce(any_value(cited_path), '') || ' changed?'
    WHEN 'TARGET_CREATE_SYMBOL' THEN coalesce(any_value(cited_symbol), 'x') WHEN 'TARGET_CREATE_FILE' THEN 'How is ' || coalesce(any_value(cited_path), '') || ' tested?' WHEN 'ALLOW_GLOB' THEN 'Explain the setting of ' || coalesce(any_value(cited_path), '')
    ELSE 'which services use this dependency, and who calls it?' END FROM spec_citations GROUP BY run_id, ordinal),
ws AS (SELECT *, lower(question) AS low, list_filter(string_split_regex(question, '\s+'), lambda w: w <> '') AS words FROM questions),
hints AS (SELECT *, list_distinct(list_filter(list_transform(words, lambda w: regexp_replace(w, '^["''`,?:;\[\]]+|["''`,?:;\[\]]+$', '', 'g')), lambda w: NOT contains(w, '://') AND (regexp_matches(lower(w), '\.(rs|java|py|go|ts|tsx|js|jsx|c|cpp|h|md|yml|yaml|toml|json|properties|xml|ini|sql|sh)$')
    OR (contains(w, '/') AND NOT starts_with(w, '/') AND NOT contains(w, '('))))) AS path_hints,
  list_filter(list_transform(words, lambda w: regexp_replace(w, '^["''`,?().]+|["''`,?().]+$', '', 'g')), lambda w: regexp_matches(w, '^[A-Za-z_][A-Za-z0-9_.]*$') AND length(w) <= 128 AND (regexp_matches(w, '[A-Z]') AND regexp_matches(w, '[a-z]') OR regexp_matches(w, '[_.0-9]'))) AS names FROM ws),
sym AS (SELECT *, (SELECT arg_max(x.w, x.n * 100000 + x.i) FROM (SELECT unnest(list_transform(names, lambda w, i: {'w': w, 'n': length(w), 'i': i})) AS x)) AS symbol_hint FROM hints),
hit AS (SELECT *, list_filter([
  CASE WHEN len(path_hints) = 1 AND len(list_filter(words, lambda w: NOT (regexp_replace(w, '^["''`,?:;]+|["''`,?:;]+$', '', 'g') = path_hints[1] OR lower(regexp_replace(w, '^["''`,?:;]+|["''`,?:;]+$', '', 'g')) IN ('where', 'is', 'the', 'file', 'path', 'find', 'locate', 'show', 'me', 'open', 'to')))) = 0 THEN 'EXACT_LOOKUP' END,
  CASE WHEN regexp_matches(low, 'where is|where''s |definition of|defined in|declared in|locate the definition|^find the definition|^show me the definition') THEN 'DEFINITION' END,
  CASE WHEN regexp_matches(low, 'caller|callee|who calls|what calls|usages of|usage of|references to|all references') THEN 'SYMBOL_NAVIGATION' END,
  CASE WHEN regexp_matches(low, 'configured|configuration|config value|setting|port is|database url|environment variable|env var|\.yml|\.yaml|\.toml|\.properties|timeout value') THEN 'CONFIGURATION' END,
  CASE WHEN regexp_matches(low, 'why does|why is|fails|failing|failure|root cause|unexpected|broken|debug|error when|exception when|not working') THEN 'DEBUGGING' END,
  CASE WHEN regexp_matches(low, 'impact|what would break|break if|affected by changing|ripple|blast radius|who uses this|downstream effects') THEN 'IMPACT' END,
  CASE WHEN regexp_matches(low, 'depends on|depend on|depending on|dependency|which services use|which repos use|package depend|library depend|transitive') THEN 'DEPENDENCY' END,
  CASE WHEN regexp_matches(low, 'cross-repo|cross repo|across repositories|across repos|other repositories') THEN 'CROSS_REPO' END,
  CASE WHEN regexp_matches(low, 'test suite|tests cover|test cover|what scenarios|unit test|integration test|verify in tests|tested') THEN 'TEST_BEHAVIOR' END,
  CASE WHEN regexp_matches(low, 'runbook|documented|documentation say|docs say|knowledge|project notes|architecture doc|adr|design doc') THEN 'KNOWLEDGE' END,
  CASE WHEN regexp_matches(low, 'how does|how is|explain|walk me through|architecture|overview of|behavior of|behaves|flow of|works') THEN 'ARCHITECTURE' END], lambda x: x IS NOT NULL) AS hits FROM sym),
typed AS (SELECT *, CASE WHEN len(hits) > 0 THEN hits[1] WHEN len(path_hints) = 0 AND len(words) <= 3 AND symbol_hint IS NOT NULL THEN 'DEFINITION' ELSE 'GENERIC_SEARCH' END AS query_type,
  CASE WHEN len(hits) = 0 THEN CASE WHEN len(path_hints) = 0 AND len(words) <= 3 AND symbol_hint IS NOT NULL THEN 'Medium' ELSE 'Low' END WHEN hits[1] = 'ARCHITECTURE' OR len(hits) > 1 THEN 'Medium' ELSE 'High' END AS confidence FROM hit)
"""


@query(_QUESTIONS + "SELECT question_id, query_type, confidence, array_to_string(hits[2:], ',') AS competing FROM typed")
def intent_classify(spark, sf):
    return R.classify(questions(spark, sf), "question").select("question_id", "query_type", "confidence", F.array_join("competing", ",").alias("competing"))


@query(_QUESTIONS + r""", k AS (SELECT *, list_position(list_transform(list_filter(string_split_regex(low, '\s+'), lambda w: w <> ''), lambda w: w IN ('setting', 'variable')), true) AS pos, list_filter(string_split_regex(low, '\s+'), lambda w: w <> '') AS lows FROM typed)
SELECT question_id, array_to_string(path_hints, '|') AS path_hints, coalesce(symbol_hint, '-') AS symbol_hint,
  coalesce(CASE WHEN pos > 0 THEN regexp_replace(words[pos + CASE WHEN lows[pos + 1] = 'of' THEN 2 ELSE 1 END], '^\?+|\?+$', '', 'g') END, '-') AS config_key FROM k""")
def question_hints(spark, sf):
    """Paths, symbol and configuration key that questions name."""
    got = R.classify(questions(spark, sf), "question")
    return got.select("question_id", F.array_join("path_hints", "|").alias("path_hints"), F.coalesce("symbol_hint", F.lit("-")).alias("symbol_hint"), F.coalesce("config_key", F.lit("-")).alias("config_key"))


@query(_QUESTIONS + r""", t AS (SELECT question_id, list_distinct(list_filter(list_transform(string_split_regex(low, '[\s,?.!;:]+'), lambda w: regexp_replace(w, '^["''`()]+|["''`()]+$', '', 'g')), lambda w: strlen(w) >= 2 AND w NOT IN ('the', 'a', 'an', 'is', 'are', 'was', 'were', 'of', 'in', 'on', 'for', 'to', 'and', 'or', 'how',
  'does', 'do', 'what', 'where', 'which', 'who', 'show', 'me', 'find', 'tell', 'about', 'with', 'at', 'from', 'by', 'it', 'this', 'that', 'there', 'their'))) AS bag, list_transform(string_split_regex(low, '[\s,?.!;:]+'), lambda w: regexp_replace(w, '^["''`()]+|["''`()]+$', '', 'g')) AS seq FROM typed),
u AS (SELECT question_id, w, list_position(seq, w) AS pos FROM (SELECT question_id, seq, unnest(bag) AS w FROM t)),
o AS (SELECT question_id, w, row_number() OVER (PARTITION BY question_id ORDER BY -(CASE WHEN regexp_matches(w, '[_.0-9]|[a-z][A-Z]') THEN 2 ELSE 0 END + CASE WHEN length(w) >= 9 THEN 1 ELSE 0 END), pos) AS k FROM u)
SELECT t.question_id, coalesce(string_agg(w, ' ' ORDER BY k) FILTER (k <= 24), '') AS terms FROM t LEFT JOIN o USING (question_id) GROUP BY 1""")
def question_terms(spark, sf):
    got = R.classify(questions(spark, sf), "question")
    return got.select("question_id", F.array_join(R.prioritized(F.col("terms")), " ").alias("terms"))


@query("""SELECT query_type, origin, match::DOUBLE AS match FROM (VALUES
('EXACT_LOOKUP','fts',0.5),('EXACT_LOOKUP','path',1.0),('EXACT_LOOKUP','symbol',1.0),('EXACT_LOOKUP','structural',0.7),('EXACT_LOOKUP','relationship',0.3),('EXACT_LOOKUP','knowledge',0.1),
('DEFINITION','fts',0.5),('DEFINITION','path',1.0),('DEFINITION','symbol',1.0),('DEFINITION','structural',0.7),('DEFINITION','relationship',0.3),('DEFINITION','knowledge',0.1),
('SYMBOL_NAVIGATION','fts',0.5),('SYMBOL_NAVIGATION','path',0.4),('SYMBOL_NAVIGATION','symbol',1.0),('SYMBOL_NAVIGATION','structural',0.6),('SYMBOL_NAVIGATION','relationship',0.9),('SYMBOL_NAVIGATION','knowledge',0.1),
('CONFIGURATION','fts',0.8),('CONFIGURATION','path',1.0),('CONFIGURATION','symbol',0.3),('CONFIGURATION','structural',0.3),('CONFIGURATION','relationship',0.2),('CONFIGURATION','knowledge',0.5),
('ARCHITECTURE','fts',0.7),('ARCHITECTURE','path',0.4),('ARCHITECTURE','symbol',0.6),('ARCHITECTURE','structural',0.9),('ARCHITECTURE','relationship',0.7),('ARCHITECTURE','knowledge',0.9),
('DEBUGGING','fts',0.8),('DEBUGGING','path',0.4),('DEBUGGING','symbol',0.6),('DEBUGGING','structural',0.7),('DEBUGGING','relationship',0.6),('DEBUGGING','knowledge',0.6),
('IMPACT','fts',0.5),('IMPACT','path',0.4),('IMPACT','symbol',0.9),('IMPACT','structural',0.7),('IMPACT','relationship',1.0),('IMPACT','knowledge',0.2),
('DEPENDENCY','fts',0.6),('DEPENDENCY','path',0.4),('DEPENDENCY','symbol',0.6),('DEPENDENCY','structural',0.5),('DEPENDENCY','relationship',1.0),('DEPENDENCY','knowledge',0.4),
('CROSS_REPO','fts',0.6),('CROSS_REPO','path',0.4),('CROSS_REPO','symbol',0.6),('CROSS_REPO','structural',0.5),('CROSS_REPO','relationship',1.0),('CROSS_REPO','knowledge',0.4),
('TEST_BEHAVIOR','fts',0.8),('TEST_BEHAVIOR','path',0.5),('TEST_BEHAVIOR','symbol',0.6),('TEST_BEHAVIOR','structural',0.5),('TEST_BEHAVIOR','relationship',0.4),('TEST_BEHAVIOR','knowledge',0.5),
('KNOWLEDGE','fts',0.7),('KNOWLEDGE','path',0.4),('KNOWLEDGE','symbol',0.3),('KNOWLEDGE','structural',0.2),('KNOWLEDGE','relationship',0.2),('KNOWLEDGE','knowledge',1.0),
('GENERIC_SEARCH','fts',1.0),('GENERIC_SEARCH','path',0.8),('GENERIC_SEARCH','symbol',0.8),('GENERIC_SEARCH','structural',0.6),('GENERIC_SEARCH','relationship',0.5),('GENERIC_SEARCH','knowledge',0.6)) v(query_type, origin, match)""")
def origin_intents(spark, sf):
    """How well each origin of evidence fits each type of question."""
    rows = [(k, o) for k in R.ORIGIN_INTENT for o in R.ORIGINS]
    return spark.createDataFrame(rows, "query_type string, origin string").withColumn("match", R.origin_intent(F.col("query_type"), F.col("origin")))


@query("""SELECT * FROM (VALUES ('DEFINITION','definition',true,'SOURCE_CODE'),('DEFINITION','definition',true,'GENERATED_SOURCE'),('DEFINITION','symbol_occurrence',false,'SOURCE_CODE'),('DEFINITION','implementation_span',false,'SOURCE_CODE'),
('EXACT_LOOKUP','file_content',true,'SOURCE_CODE'),('EXACT_LOOKUP','file_content',true,'CONFIGURATION'),('EXACT_LOOKUP','file_content',true,'DOCUMENTATION'),('EXACT_LOOKUP','file_content',true,'KNOWLEDGE'),('EXACT_LOOKUP','file_content',true,'TEST'),('EXACT_LOOKUP','structural_outline',false,'SOURCE_CODE'),
('SYMBOL_NAVIGATION','symbol_occurrence',true,'SOURCE_CODE'),('SYMBOL_NAVIGATION','call_relationship',false,'RELATIONSHIP'),('SYMBOL_NAVIGATION','import',false,'SOURCE_CODE'),
('CONFIGURATION','config_value',true,'CONFIGURATION'),('CONFIGURATION','config_schema',false,'SOURCE_CODE'),('CONFIGURATION','config_schema',false,'DOCUMENTATION'),('CONFIGURATION','knowledge_note',false,'KNOWLEDGE'),
('ARCHITECTURE','implementation',true,'SOURCE_CODE'),('ARCHITECTURE','knowledge_architecture',false,'KNOWLEDGE'),('ARCHITECTURE','test_expectation',false,'TEST'),('ARCHITECTURE','configuration',false,'CONFIGURATION'),('ARCHITECTURE','caller_chain',false,'RELATIONSHIP'),
('DEBUGGING','implementation',true,'SOURCE_CODE'),('DEBUGGING','test_expectation',false,'TEST'),('DEBUGGING','error_handling_span',false,'SOURCE_CODE'),('DEBUGGING','configuration',false,'CONFIGURATION'),('DEBUGGING','knowledge_note',false,'KNOWLEDGE'),('DEBUGGING','dependency_chain',false,'RELATIONSHIP'),
('IMPACT','definition',true,'SOURCE_CODE'),('IMPACT','definition',true,'GENERATED_SOURCE'),('IMPACT','callers',false,'RELATIONSHIP'),('IMPACT','callers',false,'SOURCE_CODE'),('IMPACT','dependents',false,'RELATIONSHIP'),('IMPACT','test_coverage',false,'TEST'),
('DEPENDENCY','dependency_declaration',true,'CONFIGURATION'),('DEPENDENCY','dependency_declaration',true,'SOURCE_CODE'),('DEPENDENCY','dependency_declaration',true,'RELATIONSHIP'),('DEPENDENCY','transitive_dependency',false,'RELATIONSHIP'),('DEPENDENCY','build_config',false,'CONFIGURATION'),
('CROSS_REPO','dependency_declaration',true,'CONFIGURATION'),('CROSS_REPO','dependency_declaration',true,'SOURCE_CODE'),('CROSS_REPO','dependency_declaration',true,'RELATIONSHIP'),('CROSS_REPO','transitive_dependency',false,'RELATIONSHIP'),('CROSS_REPO','build_config',false,'CONFIGURATION'),
('KNOWLEDGE','knowledge_content',true,'KNOWLEDGE'),('KNOWLEDGE','knowledge_content',true,'DOCUMENTATION'),('KNOWLEDGE','related_source',false,'SOURCE_CODE'),('KNOWLEDGE','related_config',false,'CONFIGURATION'),
('TEST_BEHAVIOR','test_content',true,'TEST'),('TEST_BEHAVIOR','subject_implementation',false,'SOURCE_CODE'),('TEST_BEHAVIOR','test_fixture',false,'TEST'),('TEST_BEHAVIOR','test_fixture',false,'CONFIGURATION'),
('GENERIC_SEARCH','any',false,'SOURCE_CODE'),('GENERIC_SEARCH','any',false,'TEST'),('GENERIC_SEARCH','any',false,'CONFIGURATION'),('GENERIC_SEARCH','any',false,'KNOWLEDGE')) v(query_type, requirement, required, source_type)""")
def contract_requirements(spark, sf):
    """What evidence each type of question requires and prefers."""
    return R.requirements(spark).drop("min_count")


_TYPES = ["DEFINITION", "EXACT_LOOKUP", "SYMBOL_NAVIGATION", "CONFIGURATION", "ARCHITECTURE", "DEBUGGING", "IMPACT", "DEPENDENCY", "CROSS_REPO", "KNOWLEDGE", "TEST_BEHAVIOR", "GENERIC_SEARCH"]
_EVIDENCE = BASE + f""", ev AS (SELECT repository_id AS query_id, unit_id, path, text, freshness_state, {KIND} AS source_type, {_TYPES}[length(repository_id || path) % 12 + 1] AS query_type FROM units)
"""


def _evidence(spark, sf) -> DataFrame:
    """Served units as evidence of one question per repository, its type by the length of id and path, so that all twelve occur."""
    kind = F.element_at(F.array(*map(F.lit, _TYPES)), F.pmod(F.length(F.concat("repository_id", "path")), F.lit(12)) + 1)
    return units(spark, sf).select(F.col("repository_id").alias("query_id"), "unit_id", "path", "text", "freshness_state", source_type(F.col("path")).alias("source_type"), kind.alias("query_type"))


@query(_EVIDENCE + """, need AS (""" + SQL["contract_requirements"] + """),
asked AS (SELECT DISTINCT query_id, query_type FROM ev), j AS (SELECT a.query_id, a.query_type, requirement, required, (SELECT count(*) FROM ev e WHERE e.query_id = a.query_id AND e.query_type = a.query_type AND e.source_type = n.source_type) AS n FROM asked a JOIN need n USING (query_type))
SELECT query_id, query_type, requirement, required, sum(n)::BIGINT AS n, sum(n) >= 1 AS satisfied FROM j GROUP BY ALL""")
def requirement_counts(spark, sf):
    """How much evidence each requirement of each question has, and whether that is enough."""
    return R.satisfaction(_evidence(spark, sf).select("query_id", "query_type", "source_type"), R.requirements(spark))


@query(_EVIDENCE + r""", t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY length(text) DESC, unit_id) AS k FROM ev QUALIFY k <= 5),
w AS (SELECT query_id, k, unnest(list_transform(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')[1:6], lambda w: lower(regexp_replace(w, '[^A-Za-z0-9_]', '', 'g')))) AS word, generate_subscripts(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')[1:6], 1) AS i FROM t),
d AS (SELECT query_id, word, min(k * 100 + i) AS pos FROM w WHERE length(word) >= 4 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS p FROM d)
SELECT t.query_id, coalesce((SELECT string_agg(word, ' ' ORDER BY p) FROM r WHERE r.query_id = t.query_id AND p <= 4), '') AS terms FROM (SELECT DISTINCT query_id FROM t) t""")
def broader_terms(spark, sf):
    """Words to widen each repository's search with, from its five longest units."""
    rows = _evidence(spark, sf).select("query_id", "unit_id", F.col("text").alias("snippet"), (-F.length("text")).alias("size"))
    return R.broader_terms(rows, ["query_id"], ["size", "unit_id"]).select("query_id", F.array_join("terms", " ").alias("terms"))


@query(_EVIDENCE + """, s AS (SELECT query_id, query_type, bool_or(freshness_state <> 'CURRENT') AS stale, bool_or(source_type = 'SOURCE_CODE') AS entities FROM ev GROUP BY 1, 2),
f AS (SELECT * FROM (VALUES ('DEFINITION', ['broader','verify']), ('EXACT_LOOKUP', ['broader','verify']), ('SYMBOL_NAVIGATION', ['graph','broader']), ('CONFIGURATION', ['broader','knowledge','verify']), ('ARCHITECTURE', ['graph','knowledge','broader','verify']),
 ('DEBUGGING', ['verify','graph','knowledge','broader']), ('IMPACT', ['graph','broader']), ('DEPENDENCY', ['graph','broader']), ('CROSS_REPO', ['graph','broader']), ('KNOWLEDGE', ['knowledge','broader']), ('TEST_BEHAVIOR', ['broader','verify']), ('GENERIC_SEARCH', ['broader','knowledge'])) v(query_type, ways)),
u AS (SELECT unnest([[]::VARCHAR[], ['verify'], ['graph', 'broader']]) AS used)
SELECT query_id, query_type, array_to_string(used, ',') AS used, coalesce(CASE WHEN query_type IN ('DEFINITION', 'EXACT_LOOKUP', 'CONFIGURATION', 'DEBUGGING') AND stale AND NOT list_contains(used, 'verify') THEN 'verify'
  ELSE list_filter(ways, lambda w: NOT list_contains(used, w) AND (w <> 'graph' OR entities) AND (w <> 'verify' OR stale))[1] END, 'none') AS next_way FROM s JOIN f USING (query_type) CROSS JOIN u""")
def fallback_selection(spark, sf):
    """How each question's search widens next, having used nothing, verification, or graph and broader terms."""
    seen = _evidence(spark, sf).groupBy("query_id", "query_type").agg(F.max(F.col("freshness_state") != "CURRENT").alias("stale"), F.max(F.col("source_type") == "SOURCE_CODE").alias("entities"))
    tried = seen.withColumn("used", F.explode(F.array(F.array().cast("array<string>"), F.array(F.lit("verify")), F.array(F.lit("graph"), F.lit("broader")))))
    way = R.next_fallback(F.col("query_type"), F.col("used"), F.col("stale"), F.col("entities"), F.col("stale"))
    return tried.withColumn("next_way", F.coalesce(way, F.lit("none"))).select("query_id", "query_type", F.array_join("used", ",").alias("used"), "next_way")


_WEIGHTS = "[" + ",".join(f"('{k}',{list(map(float, w))})" for k, w in {
    "EXACT_LOOKUP": (1.5, 3, 2, 0.5, 2, 0.5, 0, 0, 0), "DEFINITION": (1.5, 3, 2, 0.5, 2, 0.5, 0, 0, 0), "SYMBOL_NAVIGATION": (1, 2.5, 2, 0.5, 1, 0.5, 2.5, 0, 0), "CONFIGURATION": (1.5, 0.5, 2, 0.5, 2, 0, 0, 1.5, 0),
    "ARCHITECTURE": (1.5, 1, 2, 0.5, 1, 1.5, 1, 2, 1), "DEBUGGING": (1.5, 1, 2, 0.5, 1.5, 1, 1, 1.5, 2), "IMPACT": (1, 2, 2, 0.5, 1, 1, 2.5, 0, 1.5), "DEPENDENCY": (1, 1, 2, 1, 1, 0.5, 3, 0.5, 0), "CROSS_REPO": (1, 1, 2, 1, 1, 0.5, 3, 0.5, 0),
    "TEST_BEHAVIOR": (1.5, 1, 2, 0.5, 1, 0.5, 0.5, 0.5, 3), "KNOWLEDGE": (1.5, 0.5, 2, 0.5, 1, 0, 0, 3, 0), "GENERIC_SEARCH": (2.5, 1, 1, 0.5, 1, 0.5, 0.5, 0.5, 0.5)}.items()) + "]"


@query(_EVIDENCE + f""", wt AS (SELECT * FROM (VALUES {_WEIGHTS[1:-1]}) v(query_type, w)), oi AS ({SQL["origin_intents"]}),
s AS (SELECT ev.*, CASE WHEN contains(path, 'journal') THEN 'path' WHEN contains(text, 'def ') OR contains(text, 'func ') THEN 'symbol' WHEN source_type = 'KNOWLEDGE' THEN 'knowledge' ELSE 'fts' END AS origin, greatest(len(string_split(lower(text), 'journal')) - 1, 0) AS tf FROM ev),
g AS (SELECT unit_id, s.query_type, s.origin, [tf / (tf + 3.0), CASE WHEN s.origin = 'symbol' THEN 0.9 END, match, 0.8, CASE freshness_state WHEN 'CURRENT' THEN 1.0 WHEN 'STALE' THEN 0.4 WHEN 'UNKNOWN' THEN 0.3 WHEN 'PENDING_REFRESH' THEN 0.75 ELSE 0 END, NULL, NULL,
  CASE source_type WHEN 'KNOWLEDGE' THEN 1.0 WHEN 'DOCUMENTATION' THEN 0.7 END, CASE source_type WHEN 'TEST' THEN 1.0 END]::DOUBLE[] AS v FROM s JOIN oi ON oi.query_type = s.query_type AND oi.origin = s.origin)
SELECT unit_id, query_type, origin, round(list_sum(list_transform(v, lambda x, i: coalesce(x, 0) * w[i])) / list_sum(w), 6) AS score FROM g JOIN wt USING (query_type)""")
def rank_nine_signals(spark, sf):
    """Every served unit scored by all nine signals under its question's weights, origin fitted to the type."""
    ev = _evidence(spark, sf)
    origin = F.when(F.col("path").contains("journal"), "path").when(F.col("text").contains("def ") | F.col("text").contains("func "), "symbol").when(F.col("source_type") == "KNOWLEDGE", "knowledge").otherwise("fts")
    tf = F.greatest(F.size(F.split(F.lower("text"), "journal")) - 1, F.lit(0))
    seen = ev.withColumn("origin", origin)
    values = {
        "lexical": E.saturate(tf.cast("double")), "symbol": F.when(F.col("origin") == "symbol", 0.9), "intent": R.origin_intent(F.col("query_type"), F.col("origin")), "repo": F.lit(0.8), "freshness": E.freshness_score(F.col("freshness_state")),
        "knowledge": F.when(F.col("source_type") == "KNOWLEDGE", 1.0).when(F.col("source_type") == "DOCUMENTATION", 0.7), "test": F.when(F.col("source_type") == "TEST", 1.0),
    }
    return seen.select("unit_id", "query_type", "origin", E.typed_score(F.col("query_type"), values).alias("score"))
