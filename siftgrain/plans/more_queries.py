"""Further queries: verification, roll-ups, caches, modules, hints, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftgrain.functions.keys import norm_id
from siftgrain.functions.paths import source_type
from siftgrain.operators import evidence as E
from siftgrain.operators import versions as V
from siftgrain.plans.base import BASE, KIND, folded, latest, occurrences, units
from siftgrain.sources.tables import read_table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Limits of the answer modes: milliseconds, candidates, graph depth, graph nodes, context tokens (fixed values).
MODES = {"FAST": (300, 50, 1, 25, 4096), "NORMAL": (3000, 500, 3, 200, 16384), "DEEP": (30000, 5000, 8, 2000, 65536)}


@query("SELECT * FROM (VALUES ('FAST', 300, 50, 1, 25, 4096), ('NORMAL', 3000, 500, 3, 200, 16384), ('DEEP', 30000, 5000, 8, 2000, 65536)) v(mode, deadline_ms, candidates, graph_depth, graph_nodes, context_tokens)")
def mode_budgets(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in MODES.items()], "mode string, deadline_ms int, candidates int, graph_depth int, graph_nodes int, context_tokens int")


@query(BASE + """, h AS (SELECT DISTINCT repository_id, regexp_extract(cited_path, '([^/]+)$', 1) AS hint FROM spec_citations WHERE cited_path IS NOT NULL AND citation_kind <> 'ALLOW_GLOB'),
f AS (SELECT repository_id, path, regexp_extract(path, '([^/]+)$', 1) AS hint FROM newest)
SELECT h.repository_id, hint, CASE count(path) WHEN 0 THEN 'missing' WHEN 1 THEN 'unique' ELSE 'ambiguous' END AS resolution, CASE count(path) WHEN 1 THEN min(path) END AS path FROM h LEFT JOIN f USING (repository_id, hint) GROUP BY 1, 2""")
def path_hints(spark, sf):
    """A file name a question mentions: the one path it can mean, or that there are several or none."""
    name = lambda c: F.regexp_extract(c, "([^/]+)$", 1)
    hints = read_table(spark, sf, "spec_citations", "repository_id", "citation_kind", "cited_path").where("cited_path IS NOT NULL AND citation_kind <> 'ALLOW_GLOB'").select("repository_id", name(F.col("cited_path")).alias("hint")).distinct()
    files = latest(spark, sf).select("repository_id", "path", name(F.col("path")).alias("hint"))
    grouped = hints.join(files, ["repository_id", "hint"], "left").groupBy("repository_id", "hint").agg(F.count("path").alias("n"), F.min("path").alias("first"))
    return grouped.select("repository_id", "hint", F.when(F.col("n") == 0, "missing").when(F.col("n") == 1, "unique").otherwise("ambiguous").alias("resolution"), F.when(F.col("n") == 1, F.col("first")).alias("path"))


_FACT = r"keeps (\d+) entries per (\w+)"


@query(BASE + rf""", l AS (SELECT unit_id, repository_id, path, unnest(string_split(text, chr(10))) AS line FROM units),
k AS (SELECT DISTINCT repository_id, regexp_matches(lower(path), '(^|/)knowledge/') AS known, regexp_extract(line, '{_FACT}', 2) AS fact, regexp_extract(line, '{_FACT}', 1) AS value, path FROM l WHERE regexp_matches(line, '{_FACT}'))
SELECT a.repository_id, a.fact, a.path AS knowledge_path, count(DISTINCT b.path) AS n_conflicts FROM k a JOIN k b ON a.repository_id = b.repository_id AND a.fact = b.fact AND a.known AND NOT b.known AND a.value <> b.value GROUP BY 1, 2, 3""")
def knowledge_contradictions(spark, sf):
    """What knowledge notes say against other files of the repository: equal key, different value; the pairs are counted per note, never listed."""
    lines = units(spark, sf).select("repository_id", "path", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike(_FACT))
    facts = lines.select("repository_id", "path", (source_type(F.col("path")) == "KNOWLEDGE").alias("known"), F.regexp_extract("line", _FACT, 2).alias("fact"), F.regexp_extract("line", _FACT, 1).alias("value")).distinct()
    said = facts.where("known").select("repository_id", "fact", F.col("value").alias("said"), F.col("path").alias("knowledge_path"))
    return said.join(facts.where("NOT known"), ["repository_id", "fact"]).where("said <> value").groupBy("repository_id", "fact", "knowledge_path").agg(F.count_distinct("path").alias("n_conflicts"))


_KIND = KIND
_TRIMMED = r"regexp_replace({0}, '^[ \t\r\f]+|[ \t\r\f]+$', '', 'g')"
_PAIR = r"regexp_extract(line, '(?s)^([^=:]*)[=:](.*)$', {0})"
_STATED = rf"""stated AS (SELECT DISTINCT id, repository_id, path, kind, freshness_state, key, value FROM (
  SELECT *, {_TRIMMED.format(_PAIR.format(1))} AS key, regexp_replace({_TRIMMED.format(_PAIR.format(2))}, '^["'',]+|["'',]+$', '', 'g') AS value FROM lines WHERE regexp_matches(line, '[=:]'))
  WHERE key <> '' AND value <> '' AND NOT (contains(key, ' ') AND regexp_matches(key, '[^ \t]+([ \t]+[^ \t]+){{3}}')))"""


@query(BASE + rf""", lines AS (SELECT n.id, n.repository_id, n.path, {_KIND.replace("path", "n.path")} AS kind, n.freshness_state, unnest(string_split(c.content, chr(10))) AS line
  FROM newest n JOIN (SELECT file_occurrence_id, any_value(content) AS content FROM file_contents GROUP BY 1) c ON c.file_occurrence_id = n.id WHERE n.existence_state = 'present'),
{_STATED},
g AS (SELECT lower(key) AS key, path, id, list(DISTINCT value ORDER BY value) AS held FROM stated WHERE kind = 'CONFIGURATION' AND freshness_state = 'CURRENT' GROUP BY ALL),
w AS (SELECT *, lag(id) OVER k AS before_id, lag(path) OVER k AS before_path, lag(held) OVER k AS before_held FROM g WINDOW k AS (PARTITION BY key ORDER BY path, id))
SELECT key, before_id, id, before_path, path FROM w WHERE before_path <> path AND before_held <> held""")
def conflicting_config(spark, sf):
    """Keys that CURRENT configuration files next to each other give different values, over whole texts and all repositories."""
    texts = read_table(spark, sf, "file_contents", "file_occurrence_id", "content").withColumnRenamed("file_occurrence_id", "id").dropDuplicates(["id"])
    files = latest(spark, sf).where("existence_state = 'present' AND freshness_state = 'CURRENT'").where(source_type(F.col("path")) == "CONFIGURATION").select("id", "path")
    return E.conflicting_values(E.stated_values(files.join(texts, "id"), "content"))


@query(BASE + rf""", lines AS (SELECT unit_id AS id, repository_id, path, {_KIND} AS kind, freshness_state, unnest(string_split(text, chr(10))) AS line FROM units),
{_STATED}
SELECT a.repository_id, a.key, a.path AS said_path, count(DISTINCT b.path) AS n_conflicts FROM stated a JOIN stated b ON a.repository_id = b.repository_id AND a.key = b.key AND a.value <> b.value
WHERE a.kind IN ('KNOWLEDGE', 'DOCUMENTATION') AND b.kind IN ('SOURCE_CODE', 'CONFIGURATION') AND b.freshness_state = 'CURRENT' AND NOT starts_with(a.path, regexp_replace(regexp_replace(b.path, '/+$', ''), '(\.md)+$', '')) GROUP BY 1, 2, 3""")
def knowledge_conflicts(spark, sf):
    """Any key and value of knowledge notes and documentation against CURRENT source and configuration of the repository."""
    stated = E.stated_values(units(spark, sf).select("repository_id", "path", source_type(F.col("path")).alias("kind"), "freshness_state", "text"), "text")
    said = stated.where("kind IN ('KNOWLEDGE', 'DOCUMENTATION')").select("repository_id", "path", "key", "value").distinct()
    held = stated.where("kind IN ('SOURCE_CODE', 'CONFIGURATION') AND freshness_state = 'CURRENT'").select("repository_id", "path", "key", "value").distinct()
    return E.denied_statements(said, held)


@query(BASE + "SELECT unit_id, occurrence_id FROM units u WHERE freshness_state = 'STALE' AND NOT EXISTS (SELECT 1 FROM newest n WHERE n.id = u.occurrence_id)")
def superseded_stale(spark, sf):
    """Stale units of versions that a newer one has replaced."""
    stale = units(spark, sf).where("freshness_state = 'STALE'").select("unit_id", "occurrence_id")
    return stale.join(latest(spark, sf).select(F.col("id").alias("occurrence_id")), "occurrence_id", "left_anti").select("unit_id", "occurrence_id")


_SQUEEZE = r"trim(regexp_replace({0}, '[ \t\r\n]+', ' ', 'g'))"


@query(BASE + f""", c AS (SELECT file_occurrence_id AS id, {_SQUEEZE.format("any_value(content)")} AS live FROM file_contents GROUP BY 1),
l AS (SELECT unit_id, occurrence_id, {_SQUEEZE.format("regexp_extract(text, '[^\\n]{12,}')")} AS line FROM units)
SELECT CASE WHEN line = '' THEN 'no_line' WHEN live IS NULL THEN 'no_source' WHEN contains(live, line) THEN 'verified' ELSE 'changed' END AS state, count(*) AS n FROM l LEFT JOIN c ON id = occurrence_id GROUP BY 1""")
def source_verification(spark, sf):
    """Whether a unit's first distinctive line still stands in its file, white space apart."""
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"[ \t\r\n]+", " "))
    live = read_table(spark, sf, "file_contents", "file_occurrence_id", "content").groupBy(F.col("file_occurrence_id").alias("occurrence_id")).agg(squeeze(F.first("content")).alias("live"))
    lines = units(spark, sf).select("occurrence_id", squeeze(F.regexp_extract("text", r"[^\n]{12,}", 0)).alias("line"))
    state = F.when(F.col("line") == "", "no_line").when(F.col("live").isNull(), "no_source").when(F.col("live").contains(F.col("line")), "verified").otherwise("changed")
    return lines.join(live, "occurrence_id", "left").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query(BASE + """, v AS (SELECT repository_id, CASE WHEN occurrence_id IS NULL THEN 'MISSING_PROVENANCE' WHEN freshness_state = 'INVALID' THEN 'INVALID_SOURCE' WHEN start_line >= end_line THEN 'BAD_SPAN' WHEN freshness_state <> 'CURRENT' OR freshness_state IS NULL THEN 'FRESHNESS' ELSE 'counts' END AS verdict FROM un),
s AS (SELECT repository_id, avg((verdict = 'counts')::INT) AS share, count(*) FILTER (verdict <> 'counts') AS n_dropped FROM v GROUP BY 1)
SELECT repository_id, n_dropped, CASE WHEN share >= 0.9 THEN 'HIGH' WHEN share >= 0.5 THEN 'MEDIUM' WHEN share > 0 THEN 'LOW' ELSE 'NONE' END AS confidence FROM s""")
def result_rollup(spark, sf):
    """Per repository what its evidence comes to: how much is dropped, and the confidence of the rest."""
    u = folded(read_table(spark, sf, "retrieval_units", "id", "repository_id", "file_occurrence_id", "freshness_state", "start_line", "end_line"), "id")
    verdict = E.verdict(norm_id(F.col("file_occurrence_id")), F.col("freshness_state"), F.col("start_line"), F.col("end_line"), F.lit("SYMBOL_RESOLVED"), F.lit(0.9), current_only=True)
    counts = F.when(F.col("verdict") == "counts", 1)
    grouped = u.withColumn("verdict", verdict).groupBy("repository_id").agg((F.count(counts) / F.count("*")).alias("share"), (F.count("*") - F.count(counts)).alias("n_dropped"))
    level = F.when(F.col("share") >= 0.9, "HIGH").when(F.col("share") >= 0.5, "MEDIUM").when(F.col("share") > 0, "LOW").otherwise("NONE")
    return grouped.select("repository_id", "n_dropped", level.alias("confidence"))


_PARTS_OF = ", ".join(f"sum(('0x' || substr(h, {1 + 15 * i}, 15))::BIGINT)::VARCHAR" for i in range(4))


@query(f"SELECT run_id, sha256(concat_ws(',', count(*)::VARCHAR, {_PARTS_OF})) AS fingerprint FROM (SELECT run_id, sha256(line) AS h FROM (SELECT DISTINCT run_id, citation_kind || chr(9) || coalesce(cited_path, '') || chr(10) AS line FROM spec_citations)) GROUP BY 1")
def citation_fingerprint(spark, sf):
    """A fingerprint of each run's citations, whatever their order."""
    line = F.concat("citation_kind", F.lit("\t"), F.coalesce("cited_path", F.lit("")), F.lit("\n"))
    return V.fingerprint(read_table(spark, sf, "spec_citations", "run_id", "citation_kind", "cited_path").select("run_id", line.alias("line")), ["run_id"]).select("run_id", "fingerprint")


@query(BASE + """, cache AS (SELECT DISTINCT repository_id, path, content_hash, language FROM occ WHERE received_at < TIMESTAMP '2025-09-01')
SELECT id, repository_id, path FROM newest n WHERE existence_state = 'present' AND NOT EXISTS (SELECT 1 FROM cache c WHERE c.repository_id = n.repository_id AND c.path = n.path AND c.content_hash = n.content_hash AND c.language = n.language)""")
def analysis_cache_misses(spark, sf):
    """The files whose analysis is not in the cache under the same path, content and language."""
    keys = ["repository_id", "path", "content_hash", "language"]
    cache = occurrences(spark, sf, *keys, "received_at").where(F.col("received_at") < F.lit("2025-09-01").cast("timestamp_ntz")).select(*keys).distinct()
    return latest(spark, sf, "content_hash", "language").where("existence_state = 'present'").join(cache, keys, "left_anti").select("id", "repository_id", "path")


@query(BASE + """, m AS (SELECT DISTINCT repository_id, module_root FROM source_manifests),
p AS (SELECT id, repository_id, path, unnest(generate_series(1, len(string_split(path, '/')) - 1)) AS n FROM newest),
j AS (SELECT p.id, p.n, m.module_root FROM p JOIN m ON m.repository_id = p.repository_id AND m.module_root = array_to_string(string_split(path, '/')[1:n], '/'))
SELECT newest.id, path, arg_max(module_root, n) AS module_root FROM newest LEFT JOIN j ON j.id = newest.id GROUP BY 1, 2""")
def owning_module(spark, sf):
    """The innermost module a file lies in: an equi-join on the path's prefixes, then the longest."""
    modules = read_table(spark, sf, "source_manifests", "repository_id", "module_root").distinct()
    files = latest(spark, sf).select("id", "repository_id", "path")
    parts = F.split("path", "/")
    prefixes = files.select("id", "repository_id", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("module_root"))
    inside = prefixes.join(modules, ["repository_id", "module_root"]).groupBy("id").agg(F.max_by("module_root", F.length("module_root")).alias("module_root"))
    return files.join(inside, "id", "left").select("id", "path", "module_root")


@query(BASE + "SELECT occurrence_id, coalesce(min(start_line), -1) AS first_line, coalesce(max(end_line), -1) AS last_line, count(*) AS n_units FROM un WHERE occurrence_id IS NOT NULL GROUP BY 1")
def unit_span_bounds(spark, sf):
    u = folded(read_table(spark, sf, "retrieval_units", "id", "file_occurrence_id", "start_line", "end_line"), "id").withColumn("occurrence_id", norm_id(F.col("file_occurrence_id")))
    return u.where("occurrence_id IS NOT NULL").groupBy("occurrence_id").agg(F.coalesce(F.min("start_line"), F.lit(-1)).alias("first_line"), F.coalesce(F.max("end_line"), F.lit(-1)).alias("last_line"), F.count("*").alias("n_units"))


@query(BASE + "SELECT sha256(text) AS body, count(*) AS n_units, min(unit_id) AS first_unit, array_to_string(list_sort(list(DISTINCT path))[1:64], ',') AS paths FROM units GROUP BY 1 HAVING count(*) > 1")
def shared_bodies(spark, sf):
    """Texts that several units share, with the first 64 of their paths; the distinct paths of a text are collected from map-side sets."""
    grouped = units(spark, sf).groupBy(F.sha2("text", 256).alias("body"), "path").agg(F.count("*").alias("n"), F.min("unit_id").alias("u"))
    place = F.row_number().over(W.partitionBy("body").orderBy("path"))
    ranked = grouped.withColumn("k", place)
    return ranked.groupBy("body").agg(F.sum("n").alias("n_units"), F.min("u").alias("first_unit"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("k") <= 64, F.col("path")))), ",").alias("paths")).where("n_units > 1")


@query("""WITH e AS (SELECT o_custkey AS s, l_suppkey AS t, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT s, t, n FROM e QUALIFY row_number() OVER (PARTITION BY s ORDER BY n DESC, t) <= 3""")
def top_edges_per_node(spark, sf):
    """The three heaviest edges of each node."""
    o, li = read_table(spark, sf, "orders", "o_orderkey", "o_custkey"), read_table(spark, sf, "lineitem", "l_orderkey", "l_suppkey")
    edges = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("s"), F.col("l_suppkey").alias("t")).agg(F.count("*").alias("n"))
    return edges.withColumn("k", F.row_number().over(W.partitionBy("s").orderBy(F.desc("n"), "t"))).where("k <= 3").select("s", "t", "n")


@query("""SELECT c.c_custkey, n.n_name, r.r_name, count(o_orderkey) AS n_orders, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer c LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN nation n ON n_nationkey = c_nationkey LEFT JOIN region r ON r_regionkey = n_regionkey GROUP BY 1, 2, 3""")
def left_join_counts(spark, sf):
    """Counts and sums over left joins, the dimension tables left to Catalyst's size check."""
    c, o = read_table(spark, sf, "customer", "c_custkey", "c_nationkey"), read_table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    n, r = read_table(spark, sf, "nation", "n_nationkey", "n_name", "n_regionkey"), read_table(spark, sf, "region", "r_regionkey", "r_name")
    sums = o.groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.sum("o_totalprice").alias("total"))
    joined = c.join(sums, F.col("c_custkey") == F.col("o_custkey"), "left").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return joined.select("c_custkey", "n_name", "r_name", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), F.round(F.coalesce("total", F.lit(0.0)), 2).alias("total"))
