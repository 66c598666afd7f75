"""Queries over versions, graphs, evidence, code, JSON, telemetry and events, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftgrain.functions.keys import norm_hash, norm_id, norm_path
from siftgrain.functions.paths import source_type
from siftgrain.operators import code as C
from siftgrain.operators import evidence as E
from siftgrain.operators import graph as G
from siftgrain.operators import jsonops as J
from siftgrain.operators import versions as V
from siftgrain.plans.base import BASE, KIND, folded, latest, occurrences, units
from siftgrain.sources.discovery import masked, masked_count
from siftgrain.sources.tables import read_table
from siftgrain.streaming import changefeed as S

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- versions -------------------------------------------------------------


@query(BASE + "SELECT repository_id, path, id, occurrence_seq, existence_state FROM newest")
def latest_occurrence(spark: SparkSession, sf: str) -> DataFrame:
    return latest(spark, sf).select("repository_id", "path", "id", "occurrence_seq", "existence_state")


@query(BASE + """SELECT repository_id, count(*) FILTER (freshness_state = 'CURRENT') AS n_current, count(*) FILTER (freshness_state = 'STALE') AS n_stale,
count(*) FILTER (freshness_state = 'INVALID') AS n_invalid, count(*) FILTER (freshness_state = 'UNKNOWN') AS n_unknown, count(*) FILTER (freshness_state = 'PENDING_REFRESH') AS n_pending
FROM newest WHERE existence_state = 'present' GROUP BY 1""")
def freshness_totals(spark, sf):
    names = {"CURRENT": "n_current", "STALE": "n_stale", "INVALID": "n_invalid", "UNKNOWN": "n_unknown", "PENDING_REFRESH": "n_pending"}
    return latest(spark, sf).where("existence_state = 'present'").groupBy("repository_id").agg(*[F.count(F.when(F.col("freshness_state") == k, 1)).alias(v) for k, v in names.items()])


@query(BASE + """SELECT r.id AS repository_id, r.display_name, count(o.id) AS n_versions, count(DISTINCT o.path) AS n_paths, count(DISTINCT CASE WHEN existence_state = 'present' THEN path END) AS n_present_paths,
count(CASE WHEN existence_state = 'deleted' THEN 1 END) AS n_deletions, coalesce(max(occurrence_seq), -1) AS last_seq FROM repositories r LEFT JOIN occ o ON o.repository_id = r.id GROUP BY ALL""")
def repository_stats(spark, sf):
    repos = read_table(spark, sf, "repositories", "id", "display_name").select(F.col("id").alias("repository_id"), "display_name")
    o = occurrences(spark, sf, "repository_id", "path", "existence_state", "occurrence_seq")
    return repos.join(o, "repository_id", "left").groupBy("repository_id", "display_name").agg(
        F.count("id").alias("n_versions"), F.count_distinct("path").alias("n_paths"), F.count_distinct(F.when(F.col("existence_state") == "present", F.col("path"))).alias("n_present_paths"),
        F.count(F.when(F.col("existence_state") == "deleted", 1)).alias("n_deletions"), F.coalesce(F.max("occurrence_seq"), F.lit(-1)).alias("last_seq"),
    )


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in ("repositories", "source_revisions", "file_occurrences", "retrieval_units", "spec_citations")) + ")")
def table_counts(spark, sf):
    from functools import reduce

    tables = ("repositories", "source_revisions", "file_occurrences", "retrieval_units", "spec_citations")
    return reduce(DataFrame.union, [read_table(spark, sf, t).agg(F.lit(t).alias("table_name"), F.count("*").alias("n_rows")).select("table_name", "n_rows") for t in tables])


_NORM_PATH = r"regexp_replace(regexp_replace(replace(repo_relative, '\', '/'), '/(\./)+|/{2,}(\./|/)*', '/', 'g'), '^(\./|/)+', '')"
_NORM_HASH = "coalesce(regexp_replace(lower(trim(content_hash)), '^[a-z0-9_-]+[:=]', ''), '')"


_PARTS_OF = ", ".join(f"sum(('0x' || substr(h, {1 + 15 * i}, 15))::BIGINT)::VARCHAR" for i in range(4))


@query(f"""SELECT manifest_id, sha256(concat_ws(',', count(*)::VARCHAR, {_PARTS_OF})) AS manifest_hash, count(*) AS n_entries
FROM (SELECT manifest_id, sha256(line) AS h FROM (SELECT DISTINCT manifest_id, {_NORM_PATH} || chr(9) || {_NORM_HASH} || chr(10) AS line FROM manifest_entries)) GROUP BY 1""")
def file_manifest_hash(spark, sf):
    entries = read_table(spark, sf, "manifest_entries", "manifest_id", "repo_relative", "content_hash").select("manifest_id", norm_path(F.col("repo_relative")).alias("path"), norm_hash(F.col("content_hash")).alias("hash"))
    return V.manifest_hash(entries, ["manifest_id"], "path", "hash")


def _two_states(spark, sf):
    cols = ("repository_id", "path", "content_hash", "occurrence_seq", "existence_state", "received_at")
    rows = occurrences(spark, sf, *cols)
    present = lambda df: V.latest_per(df.select("repository_id", "path", "content_hash", "occurrence_seq", "existence_state"), ["repository_id", "path"], "occurrence_seq").where("existence_state = 'present'")
    return present(rows.where(F.col("received_at") < F.lit("2025-09-01").cast("timestamp_ntz"))), present(rows)


_STATES = BASE + """,
b AS (SELECT repository_id, path, content_hash FROM (SELECT * FROM occ WHERE received_at < TIMESTAMP '2025-09-01' QUALIFY row_number() OVER (PARTITION BY repository_id, path ORDER BY occurrence_seq DESC) = 1) WHERE existence_state = 'present'),
a AS (SELECT repository_id, path, content_hash FROM newest WHERE existence_state = 'present'),
d AS (SELECT repository_id, path, b.content_hash AS was, a.content_hash AS now, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed' WHEN b.content_hash IS NOT DISTINCT FROM a.content_hash THEN 'same' ELSE 'changed' END AS change
  FROM b FULL JOIN a USING (repository_id, path))
"""


@query(_STATES + "SELECT repository_id, path, change FROM d")
def change_set_diff(spark, sf):
    before, after = _two_states(spark, sf)
    return V.diff(before, after, ["repository_id", "path"], "content_hash")


@query(_STATES + """, r AS (SELECT *, row_number() OVER (PARTITION BY repository_id, content_hash ORDER BY path) AS k FROM b ANTI JOIN a USING (repository_id, path)),
n AS (SELECT *, row_number() OVER (PARTITION BY repository_id, content_hash ORDER BY path) AS k FROM a ANTI JOIN b USING (repository_id, path))
SELECT repository_id, r.path AS old_path, n.path AS new_path FROM r JOIN n USING (repository_id, content_hash, k)""")
def rename_pairs(spark, sf):
    before, after = _two_states(spark, sf)
    keys = ["repository_id", "path"]
    return V.rename_pairs(V.delete_where(before, after, keys), V.delete_where(after, before, keys), ["repository_id"])


@query(_STATES + "SELECT repository_id, path FROM b INTERSECT SELECT repository_id, path FROM a")
def active_in_both(spark, sf):
    before, after = _two_states(spark, sf)
    return before.select("repository_id", "path").intersect(after.select("repository_id", "path"))


@query(_STATES + "SELECT repository_id, path FROM b EXCEPT SELECT repository_id, path FROM a")
def retire_set(spark, sf):
    before, after = _two_states(spark, sf)
    return before.select("repository_id", "path").subtract(after.select("repository_id", "path"))


@query(BASE + """, ch AS (SELECT id FROM occ WHERE freshness_state = 'INVALID'),
cited AS (SELECT DISTINCT run_id || '#' || ordinal AS entity_id, o.id AS cause_id FROM spec_citations c JOIN occ o ON o.repository_id = c.repository_id AND o.path = c.cited_path JOIN ch ON ch.id = o.id)
SELECT 'unit' AS kind, un.id AS entity_id, occurrence_id AS cause_id FROM un JOIN ch ON ch.id = occurrence_id UNION ALL SELECT 'citation', entity_id, cause_id FROM cited""")
def invalidate_cascade(spark, sf):
    o = occurrences(spark, sf, "repository_id", "path", "freshness_state")
    u = folded(read_table(spark, sf, "retrieval_units", "id", "file_occurrence_id"), "id").select(F.col("id").alias("entity_id"), norm_id(F.col("file_occurrence_id")).alias("occurrence_id"))
    c = read_table(spark, sf, "spec_citations", "run_id", "ordinal", "repository_id", "cited_path").where("cited_path IS NOT NULL").select(F.concat_ws("#", "run_id", "ordinal").alias("entity_id"), "repository_id", F.col("cited_path").alias("path")).distinct()
    cited = c.join(o.select(F.col("id").alias("occurrence_id"), "repository_id", "path"), ["repository_id", "path"]).select("entity_id", "occurrence_id")
    return V.invalidate(o.where("freshness_state = 'INVALID'").select("id"), {"unit": u, "citation": cited}, "occurrence_id")


@query(BASE + """SELECT id, repository_id, path FROM occ WHERE existence_state = 'deleted' AND received_at < TIMESTAMP '2026-01-01'
AND NOT EXISTS (SELECT 1 FROM un WHERE occurrence_id = occ.id) AND id NOT IN (SELECT id FROM newest WHERE existence_state = 'deleted' AND freshness_state = 'CURRENT')""")
def retention_prune(spark, sf):
    o = occurrences(spark, sf, "repository_id", "path", "existence_state", "received_at")
    u = read_table(spark, sf, "retrieval_units", "file_occurrence_id").select(norm_id(F.col("file_occurrence_id")).alias("id"))
    kept = latest(spark, sf).where("existence_state = 'deleted' AND freshness_state = 'CURRENT'").select("id")
    old = (F.col("existence_state") == "deleted") & (F.col("received_at") < F.lit("2026-01-01").cast("timestamp_ntz"))
    return V.prune(o, old, [u, kept], "id").select("id", "repository_id", "path")


@query(BASE + """, s AS (SELECT freshness_state AS after, lag(freshness_state) OVER (PARTITION BY repository_id, path ORDER BY occurrence_seq) AS before FROM occ)
SELECT before, after, before = after OR (before = 'CURRENT') OR (before = 'STALE') OR (before = 'UNKNOWN') OR (before = 'INVALID' AND after IN ('PENDING_REFRESH', 'UNKNOWN')) OR (before = 'PENDING_REFRESH' AND after IN ('CURRENT', 'INVALID')) AS legal, count(*) AS n
FROM s WHERE before IS NOT NULL GROUP BY ALL""")
def transition_legality(spark, sf):
    from pyspark.sql import Window as W

    o = occurrences(spark, sf, "repository_id", "path", "occurrence_seq", "freshness_state")
    steps = o.select(F.lag("freshness_state").over(W.partitionBy("repository_id", "path").orderBy("occurrence_seq")).alias("before"), F.col("freshness_state").alias("after")).where("before IS NOT NULL")
    return steps.groupBy("before", "after", V.may_follow(F.col("before"), F.col("after")).alias("legal")).agg(F.count("*").alias("n"))


@query(BASE + "SELECT repository_id, path, freshness_state AS reason FROM newest WHERE existence_state = 'present' AND freshness_state IN ('STALE', 'UNKNOWN', 'INVALID', 'PENDING_REFRESH')")
def offline_refresh_plan(spark, sf):
    return latest(spark, sf).where("existence_state = 'present' AND freshness_state IN ('STALE', 'UNKNOWN', 'INVALID', 'PENDING_REFRESH')").select("repository_id", "path", F.col("freshness_state").alias("reason"))


@query(BASE + """, c AS (SELECT file_occurrence_id AS id, sha256(any_value(content)) AS disk FROM file_contents GROUP BY 1),
i AS (SELECT id, existence_state, regexp_replace(lower(trim(content_hash)), '^[a-z0-9_-]+[:=]', '') AS hash FROM occ)
SELECT CASE WHEN i.id IS NULL THEN 'unindexed' WHEN c.id IS NULL AND existence_state = 'deleted' THEN 'deleted' WHEN c.id IS NULL THEN 'vanished' WHEN disk = hash THEN 'same' ELSE 'changed' END AS state, count(*) AS n FROM c FULL JOIN i USING (id) GROUP BY 1""")
def disk_against_index(spark, sf):
    disk = read_table(spark, sf, "file_contents", "file_occurrence_id", "content").groupBy(F.col("file_occurrence_id").alias("id")).agg(F.first(F.sha2("content", 256)).alias("disk"), F.lit(1).alias("on_disk"))
    index = occurrences(spark, sf, "content_hash", "existence_state").select("id", "existence_state", norm_hash(F.col("content_hash")).alias("hash"), F.lit(1).alias("in_index"))
    state = F.when(F.col("in_index").isNull(), "unindexed").when(F.col("on_disk").isNull() & (F.col("existence_state") == "deleted"), "deleted").when(F.col("on_disk").isNull(), "vanished").when(F.col("disk") == F.col("hash"), "same").otherwise("changed")
    return disk.join(index, "id", "full_outer").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("""SELECT 'enum:existence_state' AS rule, count(*) FILTER (existence_state NOT IN ('present', 'deleted')) AS n FROM file_occurrences
UNION ALL SELECT 'enum:freshness_state', count(*) FILTER (freshness_state NOT IN ('CURRENT', 'STALE', 'INVALID', 'UNKNOWN', 'PENDING_REFRESH')) FROM file_occurrences
UNION ALL SELECT 'not_null:path', count(*) FILTER (path IS NULL) FROM file_occurrences UNION ALL SELECT 'not_null:source_revision_id', count(*) FILTER (source_revision_id IS NULL) FROM file_occurrences
UNION ALL SELECT 'unique:id', coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM file_occurrences GROUP BY id)""")
def constraint_violations(spark, sf):
    rows = read_table(spark, sf, "file_occurrences", "id", "path", "existence_state", "freshness_state", "source_revision_id")
    return V.violations(rows, ["id"], {"existence_state": ["present", "deleted"], "freshness_state": list(V.TRANSITIONS)}, ["path", "source_revision_id"])


@query("""WITH b AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_totalprice AS p FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'),
c AS (SELECT o_orderkey AS k, 'U' AS s, o_totalprice AS p FROM orders WHERE o_orderstatus = 'P') SELECT * FROM c UNION ALL SELECT * FROM b WHERE k NOT IN (SELECT k FROM c)""")
def upsert_orders(spark, sf):
    o = read_table(spark, sf, "orders", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    base = o.where(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")).select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("p"))
    return V.upsert(base, o.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("k"), F.lit("U").alias("s"), F.col("o_totalprice").alias("p")), ["k"])


@query("""SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderstatus = 'F' OR (o_orderstatus <> 'F' AND o_totalprice > 150000)""")
def insert_or_ignore_orders(spark, sf):
    o = read_table(spark, sf, "orders", "o_orderkey", "o_orderstatus", "o_totalprice")
    return V.insert_or_ignore(o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s")), o.where("o_totalprice > 150000").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s")), ["k"])


# --- graph ----------------------------------------------------------------


def _edges(spark, sf):
    cited = read_table(spark, sf, "spec_citations", "run_id", "ordinal", "repository_id", "dependency_repository_id").where("dependency_repository_id IS NOT NULL AND repository_id <> dependency_repository_id")
    key = F.concat_ws("#", "run_id", "ordinal")
    return cited.groupBy(F.col("repository_id").alias("source"), F.col("dependency_repository_id").alias("target")).agg(F.min(key).alias("edge_id"), F.count_distinct(key).alias("n")).select(
        "source", "target", "edge_id", F.round(F.col("n") / (F.col("n") + 1.0), 6).alias("confidence"), (F.col("n") > 1).alias("resolved")
    )


_EDGES = """WITH RECURSIVE e AS (
  SELECT repository_id AS source, dependency_repository_id AS target, min(run_id || '#' || ordinal) AS edge_id, round(count(DISTINCT run_id || '#' || ordinal) / (count(DISTINCT run_id || '#' || ordinal) + 1.0), 6) AS confidence,
         count(DISTINCT run_id || '#' || ordinal) > 1 AS resolved
  FROM spec_citations WHERE dependency_repository_id IS NOT NULL AND repository_id <> dependency_repository_id GROUP BY 1, 2),
seed AS (SELECT min(target) AS node FROM e)
"""


def _seed(spark, sf):
    return _edges(spark, sf).agg(F.min("target").alias("node"))


@query(_EDGES + "SELECT * FROM e")
def dependency_edges(spark, sf):
    return _edges(spark, sf)


@query(_EDGES + "SELECT * FROM e WHERE source IN (SELECT node FROM seed) OR target IN (SELECT node FROM seed)")
def edges_touching(spark, sf):
    return G.touching(_edges(spark, sf), _seed(spark, sf))


@query(_EDGES + ", r AS (SELECT node, 0 AS depth FROM seed UNION SELECT source, depth + 1 FROM r JOIN e ON target = node WHERE depth < 4) SELECT node, min(depth) AS depth FROM r GROUP BY 1")
def traverse_dependents(spark, sf):
    reversed_edges = _edges(spark, sf).select(F.col("target").alias("source"), F.col("source").alias("target"))
    return G.reach(reversed_edges, _seed(spark, sf), 4)


@query(_EDGES + ", r AS (SELECT node, 0 AS depth FROM seed UNION SELECT target, depth + 1 FROM r JOIN e ON source = node WHERE depth < 4) SELECT node, min(depth) AS depth FROM r GROUP BY 1")
def traverse_dependencies(spark, sf):
    return G.reach(_edges(spark, sf), _seed(spark, sf), 4)


@query(_EDGES + ", u AS (SELECT source, target FROM e UNION SELECT target, source FROM e), r AS (SELECT node, 0 AS depth FROM seed UNION SELECT target, depth + 1 FROM r JOIN u ON source = node WHERE depth < 2) SELECT node, min(depth) AS depth FROM r GROUP BY 1")
def neighbourhood(spark, sf):
    return G.reach(_edges(spark, sf), _seed(spark, sf), 2, directed=False)


@query(_EDGES + """, r AS (
  SELECT node, 0 AS depth, []::VARCHAR[] AS path, 1.0::DOUBLE AS min_confidence, true AS ok, [node] AS seen FROM seed
  UNION ALL SELECT e.source, depth + 1, list_append(path, edge_id), least(min_confidence, confidence), ok AND resolved, list_append(seen, e.source) FROM r JOIN e ON e.target = node WHERE depth < 3 AND NOT list_contains(seen, e.source)),
k AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY depth, path) AS place FROM r)
SELECT node, depth, array_to_string(path, ',') AS path, min_confidence, CASE WHEN NOT ok THEN 'POSSIBLE_INFERRED' WHEN depth = 1 THEN 'DIRECT_RESOLVED' ELSE 'INDIRECT_RESOLVED' END AS level FROM k WHERE place = 1 AND depth > 0""")
def impact_levels(spark, sf):
    return G.impact(_edges(spark, sf), _seed(spark, sf), 3).withColumn("path", F.array_join("path", ","))


@query(_EDGES + ", r AS (SELECT source, target FROM e UNION SELECT r.source, e.target FROM r JOIN e ON r.target = e.source) SELECT source, target FROM r")
def reachability_closure(spark, sf):
    return G.closure(_edges(spark, sf))


_PARTS = _EDGES + """, r AS (SELECT source, target FROM e UNION SELECT r.source, e.target FROM r JOIN e ON r.target = e.source),
nodes AS (SELECT source AS node FROM e UNION SELECT target FROM e),
part AS (SELECT node, least(node, coalesce(min(a.target), node)) AS component FROM nodes LEFT JOIN (SELECT a.source, a.target FROM r a JOIN r b ON a.source = b.target AND a.target = b.source) a ON a.source = node GROUP BY node)
"""


@query(_PARTS + "SELECT node, component FROM part")
def scc_components(spark, sf):
    return G.components(_edges(spark, sf))


@query(_PARTS + """, between_ AS (SELECT DISTINCT x.component AS c, y.component AS p FROM e JOIN part x ON x.node = source JOIN part y ON y.node = target WHERE x.component <> y.component),
w AS (SELECT DISTINCT component AS c, 1 AS wave FROM part UNION SELECT b.c, wave + 1 FROM w JOIN between_ b ON b.p = w.c)
SELECT node, component, max(wave) AS wave FROM part JOIN w ON c = component GROUP BY ALL""")
def wave_layers(spark, sf):
    return G.waves(_edges(spark, sf))


# --- evidence -------------------------------------------------------------



@query("""WITH w AS (SELECT * FROM (VALUES ('EXACT_LOOKUP', 1.5, 3, 2, 0.5, 2, 0.5, 0, 0, 0),
('DEFINITION', 1.5, 3, 2, 0.5, 2, 0.5, 0, 0, 0),
('SYMBOL_NAVIGATION', 1, 2.5, 2, 0.5, 1, 0.5, 2.5, 0, 0),
('CONFIGURATION', 1.5, 0.5, 2, 0.5, 2, 0, 0, 1.5, 0),
('ARCHITECTURE', 1.5, 1, 2, 0.5, 1, 1.5, 1, 2, 1),
('DEBUGGING', 1.5, 1, 2, 0.5, 1.5, 1, 1, 1.5, 2),
('IMPACT', 1, 2, 2, 0.5, 1, 1, 2.5, 0, 1.5),
('DEPENDENCY', 1, 1, 2, 1, 1, 0.5, 3, 0.5, 0),
('CROSS_REPO', 1, 1, 2, 1, 1, 0.5, 3, 0.5, 0),
('TEST_BEHAVIOR', 1.5, 1, 2, 0.5, 1, 0.5, 0.5, 0.5, 3),
('KNOWLEDGE', 1.5, 0.5, 2, 0.5, 1, 0, 0, 3, 0),
('GENERIC_SEARCH', 2.5, 1, 1, 0.5, 1, 0.5, 0.5, 0.5, 0.5)) v(query_type, lexical, symbol, intent, repo, freshness, structural, relationship, knowledge, test))
SELECT query_type, signal, weight::DOUBLE AS weight FROM (UNPIVOT w ON lexical, symbol, intent, repo, freshness, structural, relationship, knowledge, test INTO NAME signal VALUE weight)""")
def ranking_weights(spark, sf):
    return spark.createDataFrame([(k, s, float(w)) for k, ws in E.WEIGHTS.items() for s, w in zip(E.SIGNALS, ws)], "query_type string, signal string, weight double")


def _candidates(spark, sf):
    u = units(spark, sf)
    fts = u.where(F.lower("text").contains("journal")).select("unit_id", "occurrence_id", F.lit("fts").alias("retriever"), F.round(F.least(F.size(F.split(F.lower("text"), "journal")) - 1, F.lit(9)) / 10.0, 6).alias("confidence"))
    path = u.where(F.lower("path").contains("journal")).select("unit_id", "occurrence_id", F.lit("path").alias("retriever"), F.lit(0.9).alias("confidence"))
    c = fts.union(path)
    return c.select(
        F.col("occurrence_id").alias("fusion_key"), F.concat_ws(":", "retriever", "unit_id").alias("candidate_id"), "retriever", "confidence",
        F.when(F.col("retriever") == "fts", F.col("confidence")).alias("lexical"), F.when(F.col("retriever") == "path", F.lit(1.0)).alias("symbol"), F.lit(None).cast("double").alias("structural"),
    )


_CANDIDATES = BASE + """, c0 AS (
  SELECT unit_id, occurrence_id, 'fts' AS retriever, round(least(len(string_split(lower(text), 'journal')) - 1, 9) / 10.0, 6) AS confidence FROM units WHERE contains(lower(text), 'journal')
  UNION ALL SELECT unit_id, occurrence_id, 'path', 0.9 FROM units WHERE contains(lower(path), 'journal')),
c AS (SELECT occurrence_id AS fusion_key, retriever || ':' || unit_id AS candidate_id, retriever, confidence::DOUBLE AS confidence, CASE WHEN retriever = 'fts' THEN confidence::DOUBLE END AS lexical, CASE WHEN retriever = 'path' THEN 1.0::DOUBLE END AS symbol FROM c0),
fused AS (SELECT fusion_key, (list(candidate_id ORDER BY confidence DESC, candidate_id))[1] AS candidate_id, list_sort(list_distinct(list(retriever))) AS retrievers, max(lexical) AS lexical, max(symbol) AS symbol, NULL::DOUBLE AS structural,
  round(least(greatest(0.85 * max(confidence) + 0.05 * least(count(DISTINCT retriever), 3), 0), 0.99), 6) AS confidence FROM c GROUP BY 1)
"""


@query(_CANDIDATES + "SELECT fusion_key, candidate_id, array_to_string(retrievers, ',') AS retrievers, coalesce(lexical, -1) AS lexical, coalesce(symbol, -1) AS symbol, confidence FROM fused")
def fuse_candidates(spark, sf):
    # lists as text and -1 for no signal, so that the result is plain columns
    fused = E.fuse(_candidates(spark, sf))
    return fused.select("fusion_key", "candidate_id", F.array_join("retrievers", ",").alias("retrievers"), *[F.coalesce(c, F.lit(-1.0)).alias(c) for c in ("lexical", "symbol")], "confidence")


def _ranked(spark, sf):
    fused = E.fuse(_candidates(spark, sf)).join(occurrences(spark, sf, "repository_id", "path", "freshness_state").withColumnRenamed("id", "fusion_key"), "fusion_key")
    kind = source_type(F.col("path"))
    score = E.rank_score("CONFIGURATION", {"lexical": F.col("lexical"), "symbol": F.col("symbol"), "repo": F.lit(0.8), "freshness": E.freshness_score(F.col("freshness_state")), "knowledge": F.when(kind == "KNOWLEDGE", 1.0).when(kind == "DOCUMENTATION", 0.7)})
    return fused.select("fusion_key", "repository_id", "path", "freshness_state", "confidence", score.alias("score"))


_RANKED = _CANDIDATES + f""", kinds AS (SELECT *, {KIND} AS k FROM fused JOIN occ ON occ.id = fusion_key),
ranked AS (SELECT fusion_key, repository_id, path, freshness_state, confidence, round((1.5 * coalesce(lexical, 0) + 0.5 * coalesce(symbol, 0) + 0.5 * 0.8 + 2 * CASE freshness_state WHEN 'CURRENT' THEN 1.0 WHEN 'STALE' THEN 0.4 WHEN 'UNKNOWN' THEN 0.3 WHEN 'PENDING_REFRESH' THEN 0.75 ELSE 0 END
  + 1.5 * CASE k WHEN 'KNOWLEDGE' THEN 1.0 WHEN 'DOCUMENTATION' THEN 0.7 ELSE 0 END) / 8.0, 6) AS score FROM kinds)
"""


@query(_RANKED + "SELECT * FROM ranked")
def rank_signals(spark, sf):
    return _ranked(spark, sf)


@query(_RANKED + "SELECT * FROM (SELECT *, CASE WHEN score >= greatest(0.65 * max(score) OVER w, 0.20) THEN 'primary' WHEN score >= greatest(0.35 * max(score) OVER w, 0.15) THEN 'secondary' END AS tier FROM ranked WINDOW w AS (PARTITION BY repository_id)) WHERE tier IS NOT NULL")
def score_floors(spark, sf):
    return E.floors(_ranked(spark, sf), ["repository_id"])


@query(_RANKED.replace("WITH occ", "WITH RECURSIVE occ", 1) + """, i AS (SELECT r.repository_id, fusion_key AS id, o.size_bytes AS s, row_number() OVER (PARTITION BY r.repository_id ORDER BY score DESC, r.path, fusion_key) AS k FROM ranked r JOIN occ o ON o.id = fusion_key),
f AS (SELECT repository_id, k, id, CASE WHEN s <= 16384 THEN s ELSE 0 END AS used, s <= 16384 AS took FROM i WHERE k = 1
  UNION ALL SELECT i.repository_id, i.k, i.id, used + CASE WHEN used + s <= 16384 THEN s ELSE 0 END, used + s <= 16384 FROM f JOIN i ON i.repository_id = f.repository_id AND i.k = f.k + 1)
SELECT repository_id, id FROM f WHERE took""")
def context_budget(spark, sf):
    items = _ranked(spark, sf).join(occurrences(spark, sf, "size_bytes").withColumnRenamed("id", "fusion_key"), "fusion_key").withColumn("neg", -F.col("score"))
    return E.within_budget(items.withColumn("id", F.col("fusion_key")), ["repository_id"], "size_bytes", 16384, ["neg", "path", "id"])


@query(BASE + """, v AS (SELECT CASE WHEN occurrence_id IS NULL THEN 'MISSING_PROVENANCE' WHEN freshness_state = 'INVALID' THEN 'INVALID_SOURCE' WHEN start_line >= end_line THEN 'BAD_SPAN' WHEN freshness_state <> 'CURRENT' OR freshness_state IS NULL THEN 'FRESHNESS' ELSE 'counts' END AS verdict FROM un)
SELECT verdict, count(*) AS n FROM v GROUP BY 1""")
def validate_evidence(spark, sf):
    u = folded(read_table(spark, sf, "retrieval_units", "id", "file_occurrence_id", "freshness_state", "start_line", "end_line"), "id")
    said = E.verdict(norm_id(F.col("file_occurrence_id")), F.col("freshness_state"), F.col("start_line"), F.col("end_line"), F.lit("SYMBOL_RESOLVED"), F.lit(0.9), current_only=True)
    return u.groupBy(said.alias("verdict")).agg(F.count("*").alias("n"))


@query(BASE + """, w AS (SELECT id, repository_id, path, occurrence_seq, content_hash, lag(id) OVER k AS before_id, lag(content_hash) OVER k AS before_hash FROM occ WHERE path LIKE '%.yaml' OR path LIKE '%.toml' WINDOW k AS (PARTITION BY repository_id, path ORDER BY occurrence_seq))
SELECT repository_id, path, before_id, id FROM w WHERE before_id IS NOT NULL AND before_hash <> content_hash""")
def contradiction_config(spark, sf):
    rows = occurrences(spark, sf, "repository_id", "path", "occurrence_seq", "content_hash").where("path LIKE '%.yaml' OR path LIKE '%.toml'")
    return E.adjacent_conflicts(rows, ["repository_id", "path"], "content_hash", ["occurrence_seq"])


_CLAIMS = """, claims AS (SELECT run_id AS claim_id, list_distinct(list(o.id)) AS ids, count(*) FILTER (o.id IS NULL) AS n_missing, bool_or(o.freshness_state = 'INVALID') AS bad, bool_or(o.freshness_state <> 'CURRENT') AS stale
  FROM (SELECT DISTINCT run_id, repository_id, cited_path FROM spec_citations WHERE citation_kind IN ('EXISTING_REF', 'TARGET_MODIFY') AND cited_path IS NOT NULL) c LEFT JOIN newest o ON o.repository_id = c.repository_id AND o.path = c.cited_path GROUP BY 1)"""


@query(BASE + _CLAIMS + "SELECT claim_id, CASE WHEN n_missing > 0 OR coalesce(bad, false) THEN 'REJECTED' WHEN coalesce(stale, false) THEN 'WITH_DISCLOSURE' ELSE 'SUPPORTED' END AS status FROM claims")
def claim_verify(spark, sf):
    cited = read_table(spark, sf, "spec_citations", "run_id", "citation_kind", "repository_id", "cited_path").where("citation_kind IN ('EXISTING_REF', 'TARGET_MODIFY') AND cited_path IS NOT NULL").select("run_id", "repository_id", F.col("cited_path").alias("path")).distinct()
    files = latest(spark, sf).select("repository_id", "path", "id", "freshness_state")
    claims = cited.join(files.select("repository_id", "path", "id"), ["repository_id", "path"], "left").groupBy(F.col("run_id").alias("claim_id")).agg(F.collect_set(F.coalesce("id", F.lit("-"))).alias("evidence_ids"))
    return E.verify_claims(claims, files.select("id", "freshness_state"))


@query(BASE + """, c AS (SELECT DISTINCT run_id || '#' || ordinal AS citation, citation_kind, repository_id, cited_path FROM spec_citations)
SELECT citation, citation_kind, CASE WHEN cited_path IS NULL THEN 'NO_PATH' WHEN citation_kind = 'ALLOW_GLOB' THEN 'GLOB' WHEN o.id IS NULL AND citation_kind LIKE 'TARGET_CREATE%' THEN 'PRE_CREATE_ABSENT_OK' WHEN o.id IS NULL THEN 'MISSING_ERROR' WHEN o.existence_state = 'deleted' THEN 'DELETED' ELSE 'FILE_ONLY_VERIFIED' END AS tier
FROM c LEFT JOIN newest o ON o.repository_id = c.repository_id AND o.path = c.cited_path""")
def citation_tiers(spark, sf):
    c = read_table(spark, sf, "spec_citations", "run_id", "ordinal", "citation_kind", "repository_id", "cited_path").select(F.concat_ws("#", "run_id", "ordinal").alias("citation"), "citation_kind", "repository_id", F.col("cited_path").alias("path")).distinct()
    files = latest(spark, sf).select("repository_id", "path", F.col("existence_state").alias("state"))
    tier = (
        F.when(F.col("path").isNull(), "NO_PATH").when(F.col("citation_kind") == "ALLOW_GLOB", "GLOB").when(F.col("state").isNull() & F.col("citation_kind").startswith("TARGET_CREATE"), "PRE_CREATE_ABSENT_OK")
        .when(F.col("state").isNull(), "MISSING_ERROR").when(F.col("state") == "deleted", "DELETED").otherwise("FILE_ONLY_VERIFIED")
    )
    return c.join(files, ["repository_id", "path"], "left").select("citation", "citation_kind", tier.alias("tier"))


_DIR = "regexp_replace({0}, '/?[^/]*$', '')"


@query(BASE + f""", w AS (SELECT DISTINCT run_id || '#' || ordinal AS id, c.repository_id AS r, {_DIR.format("cited_path")} AS d, regexp_extract(cited_path, '([^/]*)$', 1) AS asked FROM spec_citations c WHERE cited_path IS NOT NULL AND citation_kind = 'EXISTING_REF'
  AND NOT EXISTS (SELECT 1 FROM newest o WHERE o.repository_id = c.repository_id AND o.path = c.cited_path)),
k AS (SELECT DISTINCT repository_id AS r, {_DIR.format("path")} AS d, regexp_extract(path, '([^/]*)$', 1) AS name FROM newest)
SELECT id, name, levenshtein(asked, name) AS distance FROM w JOIN k USING (r, d) QUALIFY row_number() OVER (PARTITION BY id ORDER BY levenshtein(asked, name), name) <= 5""")
def nearest_names(spark, sf):
    c = read_table(spark, sf, "spec_citations", "run_id", "ordinal", "citation_kind", "repository_id", "cited_path").where("citation_kind = 'EXISTING_REF' AND cited_path IS NOT NULL")
    files = latest(spark, sf).select("repository_id", "path")
    wanted = c.select(F.concat_ws("#", "run_id", "ordinal").alias("id"), "repository_id", F.col("cited_path").alias("path")).distinct().join(files, ["repository_id", "path"], "left_anti")
    parts = lambda df: df.withColumn("directory", C.directory(F.col("path"))).withColumn("name", F.regexp_extract("path", "([^/]*)$", 1))
    return C.nearest_names(parts(wanted), parts(files))


# --- code and JSON --------------------------------------------------------


def _files(spark, sf):
    contents = read_table(spark, sf, "file_contents", "file_occurrence_id", "content").withColumnRenamed("file_occurrence_id", "id").dropDuplicates(["id"])
    return latest(spark, sf).select("id", "repository_id", "path").join(contents, "id")


_LINES = BASE + r""", f AS (SELECT n.repository_id, n.path, lower(regexp_extract(n.path, '\.([A-Za-z0-9]+)$', 1)) AS e, any_value(content) AS content FROM newest n JOIN file_contents c ON c.file_occurrence_id = n.id GROUP BY ALL),
l AS (SELECT repository_id, path, e, unnest(regexp_split_to_array(content, '\r\n|\r|\n')) AS line, generate_subscripts(regexp_split_to_array(content, '\r\n|\r|\n'), 1) AS line_no FROM f)
"""
_LANGS = {"py": "python", "java": "java", "go": "go", "js": "javascript", "ts": "typescript", "rs": "rust"}
_CASE = lambda patterns, group: "CASE e " + " ".join(f"WHEN '{e}' THEN regexp_extract(line, '{patterns[lang]}', {group})" for e, lang in _LANGS.items()) + " END"
_NAMES = "CASE e " + " ".join(f"WHEN '{e}' THEN '{lang}'" for e, lang in _LANGS.items()) + " END"
_IMPORTS_SQL = {k: v.replace("'", "''") for k, v in C.IMPORTS.items()}


@query(_LINES + f"SELECT repository_id, path, {_NAMES} AS language, lower({_CASE(C.DEFINITIONS, 1)}) AS kind, {_CASE(C.DEFINITIONS, 2)} AS name, line_no FROM l WHERE {_CASE(C.DEFINITIONS, 2)} <> ''")
def symbols(spark, sf):
    return C.symbols(_files(spark, sf))


@query(_LINES + f"SELECT DISTINCT repository_id, path, {_NAMES} AS language, {_CASE(_IMPORTS_SQL, 1)} AS specifier FROM l WHERE {_CASE(_IMPORTS_SQL, 1)} <> ''")
def import_lines(spark, sf):
    return C.imports(_files(spark, sf))


_JOINED = "concat_ws('/', d, regexp_replace(s, '^\\./', ''))"
_DOTTED = "replace(s, '.', '/')"


@query(_LINES + f""", im AS (SELECT DISTINCT repository_id, path, {_NAMES} AS language, {_CASE(_IMPORTS_SQL, 1)} AS s, regexp_replace(path, '/?[^/]*$', '') AS d FROM l WHERE {_CASE(_IMPORTS_SQL, 1)} <> ''),
ca AS (SELECT repository_id, path, s, CASE WHEN language IN ('javascript', 'typescript') THEN list_concat([{_JOINED}], list_transform(['.ts', '.js', '/index.ts', '/index.js'], lambda x: regexp_replace({_JOINED}, '\\.js$', '') || x))
  WHEN language = 'python' THEN [concat_ws('/', d, {_DOTTED} || '.py'), concat_ws('/', d, {_DOTTED} || '/__init__.py'), 'src/' || {_DOTTED} || '.py']
  WHEN language = 'java' THEN ['src/main/java/' || {_DOTTED} || '.java', 'src/main/java/' || {_DOTTED} || '.kt', 'src/test/java/' || {_DOTTED} || '.java', 'src/test/java/' || {_DOTTED} || '.kt', 'src/' || {_DOTTED} || '.java', 'src/' || {_DOTTED} || '.kt', {_DOTTED} || '.java', {_DOTTED} || '.kt']
  WHEN language = 'rust' THEN [concat_ws('/', d, regexp_replace(regexp_replace(s, '^crate::', ''), '::.*', '') || '.rs')] ELSE [] END AS c FROM im),
ex AS (SELECT repository_id, path, s, unnest(c) AS candidate, generate_subscripts(c, 1) AS pos FROM ca), hi AS (SELECT ex.*, n.path AS known FROM ex JOIN newest n ON n.repository_id = ex.repository_id AND n.path = candidate),
be AS (SELECT repository_id, path, s, arg_min(known, pos) AS target FROM hi GROUP BY 1, 2, 3)
SELECT im.repository_id, im.path, im.s AS specifier, coalesce(target, 'logical:' || im.s) AS target FROM (SELECT DISTINCT repository_id, path, s FROM im) im LEFT JOIN be USING (repository_id, path, s)""")
def resolved_imports(spark, sf):
    files = _files(spark, sf)
    return C.resolve_imports(C.imports(files), latest(spark, sf).select("repository_id", "path"))


@query(_LINES + r"SELECT repository_id, path, length(regexp_extract(line, '^(#+)', 1)) AS level, trim(regexp_extract(line, '^#+ +(.*)$', 1)) AS title, line_no FROM l WHERE e = 'md' AND regexp_matches(line, '^#{1,6} +\S')")
def heading_outline(spark, sf):
    return C.headings(_files(spark, sf))


@query(_LINES + f""", s AS (SELECT repository_id, path, {_NAMES} AS language, lower({_CASE(C.DEFINITIONS, 1)}) AS kind, {_CASE(C.DEFINITIONS, 2)} AS name, line_no FROM l),
h AS (SELECT * FROM s WHERE contains(name, 'LocalJournal'))
SELECT * FROM h WHERE (name = 'LocalJournal') = (SELECT bool_or(name = 'LocalJournal') FROM h) ORDER BY length(name), path, line_no, repository_id LIMIT 50""")
def symbol_lookup(spark, sf):
    return C.find_symbol(C.symbols(_files(spark, sf)), "LocalJournal")


def _json_files(spark, sf):
    return _files(spark, sf).where(F.lower("path").endswith(".json")).select("id", "content")


_JSON = BASE.replace("WITH occ", "WITH RECURSIVE occ", 1) + r""", jf AS (SELECT n.id, ltrim(any_value(content), chr(65279)) AS t FROM newest n JOIN file_contents c ON c.file_occurrence_id = n.id WHERE lower(n.path) LIKE '%.json' GROUP BY 1),
jv AS (SELECT id, t::JSON AS j FROM jf WHERE json_valid(t)),
jt AS (SELECT id, '' AS pointer, j AS v FROM jv
  UNION ALL SELECT id, pointer || '/' || k, v FROM (SELECT id, pointer, unnest(CASE json_type(v) WHEN 'OBJECT' THEN list_transform(json_keys(v), lambda k: {'k': replace(replace(k, '~', '~0'), '/', '~1'), 'v': json_extract(v, '$."' || k || '"')})
    WHEN 'ARRAY' THEN list_transform(generate_series(0, json_array_length(v)::BIGINT - 1), lambda i: {'k': i::VARCHAR, 'v': json_extract(v, '$[' || i || ']')}) END, recursive := true) FROM jt WHERE json_type(v) IN ('OBJECT', 'ARRAY'))),
lv AS (SELECT id, pointer, CASE json_type(v) WHEN 'VARCHAR' THEN 'str' WHEN 'UBIGINT' THEN 'int' WHEN 'BIGINT' THEN 'int' WHEN 'DOUBLE' THEN 'float' WHEN 'BOOLEAN' THEN 'bool' WHEN 'NULL' THEN 'NoneType' WHEN 'OBJECT' THEN 'dict' ELSE 'list' END AS value_type, v::VARCHAR AS value
  FROM jt WHERE json_type(v) NOT IN ('OBJECT', 'ARRAY') OR v::VARCHAR IN ('{}', '[]'))
"""


@query(_JSON + "SELECT * FROM lv")
def json_pointers(spark, sf):
    return J.leaves(_json_files(spark, sf))


@query(_JSON + """, rf AS (SELECT id, CASE WHEN list_last(string_split(pointer, '/')) = 'limit' THEN 'definition' WHEN value = '"limit"' THEN 'reference' WHEN contains(pointer, 'limit') OR contains(value, 'limit') THEN 'uncertain' END AS certainty FROM lv)
SELECT id, certainty, count(*) AS n FROM rf WHERE certainty IS NOT NULL GROUP BY 1, 2""")
def json_references(spark, sf):
    return J.references(J.leaves(_json_files(spark, sf)), "limit").groupBy("id", "certainty").agg(F.count("*").alias("n"))


@query()
def json_canonical(spark, sf):
    return J.canonical(_json_files(spark, sf))


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY ALL")
def json_extract_group(spark, sf):
    return read_table(spark, sf, "events", "event_type", "props", "value").groupBy("event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


@query(BASE + r""", p AS (SELECT unit_id, text, len(regexp_extract_all(text, '(?i)\b(password|passwd|pwd|secret|token|api[_-]?key)(\s*[:=]\s*)(["'']?)[^\s"'']{8,}')) + len(regexp_extract_all(text, '\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_\w{20,}|glpat-[\w-]{16,}|[srp]k_live_\w{10,})')) + len(regexp_extract_all(text, '(://[^/\s:@]+:)[^@\s/]+@')) AS n FROM units),
m AS (SELECT unit_id, n, regexp_replace(regexp_replace(regexp_replace(text, '(?i)\b(password|passwd|pwd|secret|token|api[_-]?key)(\s*[:=]\s*)(["'']?)[^\s"'']{8,}', '\1\2\3[REDACTED]', 'g'), '\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_\w{20,}|glpat-[\w-]{16,}|[srp]k_live_\w{10,})', '[REDACTED]', 'g'), '(://[^/\s:@]+:)[^@\s/]+@', '\1[REDACTED]@', 'g') AS t FROM p)
SELECT unit_id, n::INT AS n_masked, sha256(t) AS masked_hash FROM m WHERE n > 0""")
def masked_units(spark, sf):
    return units(spark, sf).select("unit_id", masked_count(F.col("text")).alias("n_masked"), F.sha2(masked(F.col("text")), 256).alias("masked_hash")).where("n_masked > 0")


# --- telemetry and events -------------------------------------------------


@query("SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY ALL")
def mode_result_counts(spark, sf):
    return read_table(spark, sf, "events", "event_type", "ts", "value").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


@query("SELECT event_type, count(*) AS n FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 500) GROUP BY 1")
def newest_log_counts(spark, sf):
    return read_table(spark, sf, "events", "event_type", "ts", "event_id").orderBy(F.desc("ts"), F.desc("event_id")).limit(500).groupBy("event_type").agg(F.count("*").alias("n"))


def _changes(events: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "Created").when(F.col("event_type") == "error", "Removed").when(F.col("event_type") == "purchase", "Other").otherwise("Modified")
    return events.select(F.col("user_id").cast("string").alias("path"), kind.alias("kind"), "ts", "event_id").where("kind <> 'Other'")


@query("""WITH e AS (SELECT user_id::VARCHAR AS path, CASE event_type WHEN 'signup' THEN 'Created' WHEN 'error' THEN 'Removed' ELSE 'Modified' END AS kind, ts, event_id FROM events WHERE event_type <> 'purchase'),
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS starts FROM e WINDOW w AS (PARTITION BY path ORDER BY ts, event_id)),
s AS (SELECT *, sum(starts) OVER (PARTITION BY path ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g),
k AS (SELECT path, session, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, (list(kind ORDER BY ts, event_id))[1] AS f, (list(kind ORDER BY ts DESC, event_id DESC))[1] AS z, count(*) AS n_events FROM s GROUP BY 1, 2)
SELECT path, session_start, session_end, CASE WHEN z = 'Removed' THEN 'Remove' ELSE 'Upsert' END AS op, n_events FROM k WHERE NOT (f = 'Created' AND z = 'Removed')""")
def coalesce_batch(spark, sf):
    return S.coalesce_sessions(_changes(read_table(spark, sf, "events", "user_id", "event_type", "ts", "event_id")))


@query(SQL["coalesce_batch"].replace("SELECT path, session_start", "SELECT path, session_start", 1) + " AND session_end <= (SELECT max(ts) FROM e) - INTERVAL 10 MINUTE")
def coalesce_stream(spark, sf):
    """The same over a file stream, run to its end; sessions still open at the watermark are held back."""
    from siftgrain.session import checkpoint_dir

    batch = read_table(spark, sf, "events")
    inside = any("/events.parquet/" in f for f in batch.inputFiles())
    feed = spark.readStream.schema(batch.schema).option("pathGlobFilter", "*.parquet" if inside else "events.parquet").parquet(f"{sf}/events.parquet" if inside else sf)
    name = f"changes_{abs(hash((sf, id(feed)))) % 10**9}"
    out = S.coalesce_stream(_changes(feed.withColumn("ts", F.col("ts").cast("timestamp"))))
    run = out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{checkpoint_dir(spark)}/{name}.at").option("path", f"{checkpoint_dir(spark)}/{name}").trigger(availableNow=True).start()
    run.awaitTermination()
    done = spark.read.schema(out.schema).parquet(f"{checkpoint_dir(spark)}/{name}")
    return done.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(DISTINCT user_id) AS n_paths, count(DISTINCT user_id) > 10 AS overflowed FROM events WHERE event_type <> 'purchase' GROUP BY 1")
def overflow_flag(spark, sf):
    return S.overflow(_changes(read_table(spark, sf, "events", "user_id", "event_type", "ts", "event_id")), "1 hour", 10)


# --- more evidence, pages and boundaries ----------------------------------


@query("""WITH c AS (SELECT * FROM (VALUES ('DEFINITION', 'CURRENT_ONLY', -1, 2, 20, ['SOURCE_CODE', 'GENERATED_SOURCE']), ('EXACT_LOOKUP', 'CURRENT_ONLY', -1, 2, 10, ['SOURCE_CODE', 'CONFIGURATION', 'DOCUMENTATION', 'KNOWLEDGE', 'TEST']), ('SYMBOL_NAVIGATION', 'CURRENT_OR_STALE', 0.6, 2, 30, ['SOURCE_CODE']),
('CONFIGURATION', 'CURRENT_ONLY', -1, 2, 20, ['CONFIGURATION']), ('ARCHITECTURE', 'CURRENT_OR_STALE', 0.5, 3, 50, ['SOURCE_CODE']), ('DEBUGGING', 'CURRENT_ONLY', 0.5, 3, 50, ['SOURCE_CODE']), ('IMPACT', 'CURRENT_OR_STALE', 0.5, 2, 40, ['SOURCE_CODE', 'GENERATED_SOURCE']),
('DEPENDENCY', 'CURRENT_OR_STALE', 0.6, 2, 30, ['CONFIGURATION', 'SOURCE_CODE', 'RELATIONSHIP']), ('CROSS_REPO', 'CURRENT_OR_STALE', 0.6, 2, 30, ['CONFIGURATION', 'SOURCE_CODE', 'RELATIONSHIP']), ('KNOWLEDGE', 'CURRENT_OR_STALE', -1, 1, 20, ['KNOWLEDGE', 'DOCUMENTATION']),
('TEST_BEHAVIOR', 'CURRENT_OR_STALE', -1, 2, 30, ['TEST']), ('GENERIC_SEARCH', 'ANY', -1, 1, 50, ['ANY'])) v(query_type, freshness, least_, rounds, extra, kinds))
SELECT query_type, unnest(kinds) AS source_type, freshness, CASE WHEN least_ > 0 THEN least_::DOUBLE END AS min_confidence, rounds, extra FROM c""")
def contracts(spark, sf):
    rows = [(k, s, c[1], c[2], c[4], c[5]) for k, c in E.CONTRACTS.items() for s in (c[0] or ("ANY",))]
    return spark.createDataFrame(rows, "query_type string, source_type string, freshness string, min_confidence double, rounds int, extra int")


@query(_RANKED + f""", q AS (SELECT repository_id AS query_id, 'CONFIGURATION' AS query_type, {KIND} AS s FROM ranked)
SELECT query_id, query_type, bool_or(s = 'CONFIGURATION') AS satisfied FROM q GROUP BY 1, 2""")
def requirement_sufficiency(spark, sf):
    rows = _ranked(spark, sf).select(F.col("repository_id").alias("query_id"), F.lit("CONFIGURATION").alias("query_type"), source_type(F.col("path")).alias("source_type"))
    needed = spark.createDataFrame([(k, s) for k, c in E.CONTRACTS.items() for s in c[0]], "query_type string, source_type string")
    return E.sufficiency(rows, needed)


@query(_RANKED.replace("WITH occ", "WITH RECURSIVE occ", 1) + f""", i AS (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY (section <> 'SOURCE_CODE')::INT, score DESC, id) AS k FROM (SELECT repository_id, fusion_key AS id, score, {KIND} AS section FROM ranked)),
f AS (SELECT repository_id, k, id, true AS took, [section] AS served FROM i WHERE k = 1
  UNION ALL SELECT i.repository_id, i.k, i.id, section = 'SOURCE_CODE' OR len(list_filter(served, lambda x: x = section)) < CASE WHEN len(list_filter(served, lambda x: x <> section AND x <> 'SOURCE_CODE')) > 0 THEN 1 ELSE 2 END,
    CASE WHEN section = 'SOURCE_CODE' OR len(list_filter(served, lambda x: x = section)) < CASE WHEN len(list_filter(served, lambda x: x <> section AND x <> 'SOURCE_CODE')) > 0 THEN 1 ELSE 2 END THEN list_append(served, section) ELSE served END FROM f JOIN i ON i.repository_id = f.repository_id AND i.k = f.k + 1)
SELECT repository_id, id FROM f WHERE took""")
def section_caps(spark, sf):
    rows = _ranked(spark, sf).select("repository_id", F.col("fusion_key").alias("id"), source_type(F.col("path")).alias("section"), (-F.col("score")).alias("neg"))
    return E.section_caps(rows, ["repository_id"], "SOURCE_CODE", ["neg"])


@query(_RANKED + f""", cd AS (SELECT repository_id, fusion_key AS id, confidence, path || CASE {KIND} WHEN 'CONFIGURATION' THEN ' configures it' WHEN 'TEST' THEN ' tests it' WHEN 'KNOWLEDGE' THEN ' describes it' WHEN 'DOCUMENTATION' THEN ' describes it' ELSE ' implements it' END AS claim FROM ranked),
g AS (SELECT repository_id, claim, max(confidence) AS m, string_agg(DISTINCT id, ',' ORDER BY id) AS evidence_ids FROM cd GROUP BY 1, 2)
SELECT repository_id, claim, evidence_ids FROM g QUALIFY row_number() OVER (PARTITION BY repository_id ORDER BY m DESC, claim) <= 12""")
def claim_derive(spark, sf):
    rows = _ranked(spark, sf).select("repository_id", F.col("fusion_key").alias("id"), "path", "confidence", source_type(F.col("path")).alias("source_type"))
    return E.derive_claims(rows, ["repository_id"]).withColumn("evidence_ids", F.array_join("evidence_ids", ","))


@query(BASE + "SELECT repository_id, path, id FROM newest WHERE path > 'libs/' AND existence_state = 'present' ORDER BY path, repository_id LIMIT 100")
def keyset_page(spark, sf):
    return latest(spark, sf).where("path > 'libs/' AND existence_state = 'present'").orderBy("path", "repository_id").limit(100).select("repository_id", "path", "id")


@query(BASE + "SELECT occurrence_id, unit_id, coalesce(start_line, -1) AS start_line FROM (SELECT occurrence_id, id AS unit_id, start_line, row_number() OVER (PARTITION BY occurrence_id ORDER BY start_line NULLS FIRST, id) AS k FROM un) WHERE k <= 3 AND occurrence_id IS NOT NULL")
def units_per_file_capped(spark, sf):
    from pyspark.sql import Window as W

    u = folded(read_table(spark, sf, "retrieval_units", "id", "file_occurrence_id", "start_line"), "id").select(norm_id(F.col("file_occurrence_id")).alias("occurrence_id"), F.col("id").alias("unit_id"), "start_line").where("occurrence_id IS NOT NULL")
    place = F.row_number().over(W.partitionBy("occurrence_id").orderBy(F.asc_nulls_first("start_line"), "unit_id"))
    return u.withColumn("k", place).where("k <= 3").select("occurrence_id", "unit_id", F.coalesce("start_line", F.lit(-1)).alias("start_line"))


@query(BASE + r""", g AS (SELECT DISTINCT repository_id, '^' || replace(replace(replace(replace(replace(replace(cited_path, '.', '\.'), '**/', chr(1)), '**', chr(2)), '*', '[^/]*'), '?', '[^/]'), chr(1), '(.*/)?') || '$' AS re FROM spec_citations WHERE citation_kind = 'ALLOW_GLOB' AND cited_path IS NOT NULL),
r AS (SELECT repository_id, replace(re, chr(2), '.*') AS re FROM g)
SELECT n.repository_id, count(*) AS n_files, count(*) FILTER (EXISTS (SELECT 1 FROM r WHERE r.repository_id = n.repository_id AND regexp_matches(n.path, r.re))) AS n_covered FROM newest n GROUP BY 1""")
def boundary_coverage(spark, sf):
    """Of each repository's files, how many a glob of its plans covers."""
    globs = read_table(spark, sf, "spec_citations", "repository_id", "citation_kind", "cited_path").where("citation_kind = 'ALLOW_GLOB' AND cited_path IS NOT NULL").select("repository_id", F.col("cited_path").alias("glob")).distinct()
    files = latest(spark, sf).select("repository_id", "path", "id")
    covered = V.glob_covered(files, globs).select("id", F.lit(1).alias("hit"))
    return files.join(covered, "id", "left").groupBy("repository_id").agg(F.count("*").alias("n_files"), F.count("hit").alias("n_covered"))


@query(BASE + "SELECT repository_id, any_value(display_name) AS display_name, count(*) FILTER (language IS NULL) AS n_unknown_language, count(DISTINCT lower(trim(language))) AS n_languages, round(avg(size_bytes), 6) AS mean_size FROM newest JOIN repositories r ON r.id = repository_id WHERE existence_state = 'present' GROUP BY 1")
def repository_languages(spark, sf):
    repos = read_table(spark, sf, "repositories", "id", "display_name").select(F.col("id").alias("repository_id"), "display_name")
    rows = latest(spark, sf, "language", "size_bytes").where("existence_state = 'present'").join(repos, "repository_id")
    return rows.groupBy("repository_id").agg(
        F.first("display_name").alias("display_name"), F.count(F.when(F.col("language").isNull(), 1)).alias("n_unknown_language"), F.count_distinct(F.lower(F.trim("language"))).alias("n_languages"), F.round(F.avg("size_bytes"), 6).alias("mean_size")
    )


@query(BASE + """, r AS (SELECT repository_id AS query_id, path AS item, row_number() OVER (PARTITION BY repository_id ORDER BY size_bytes DESC, path) AS place FROM newest WHERE existence_state = 'present'),
t AS (SELECT repository_id AS query_id, cited_path AS item, max(CASE WHEN citation_kind = 'TARGET_MODIFY' THEN 3 ELSE 2 END) AS rel FROM spec_citations WHERE citation_kind IN ('TARGET_MODIFY', 'EXISTING_REF') AND cited_path IS NOT NULL GROUP BY 1, 2),
g AS (SELECT r.query_id, max(CASE WHEN place <= 10 AND coalesce(rel, 0) >= 3 THEN 1.0::DOUBLE ELSE 0 END) AS recall_at_k, coalesce(max(CASE WHEN rel >= 3 THEN 1.0::DOUBLE / place END), 0) AS rr, sum(CASE WHEN place <= 10 THEN coalesce(rel, 0) / log2(place + 1) ELSE 0 END) AS dcg FROM r LEFT JOIN t USING (query_id, item) GROUP BY 1),
i AS (SELECT query_id, sum(rel / log2(p + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, item) AS p FROM t) WHERE p <= 10 GROUP BY 1)
SELECT query_id, recall_at_k, round(rr, 6) AS reciprocal_rank, round(CASE WHEN coalesce(ideal, 0) > 0 THEN dcg / ideal ELSE 0 END, 6) AS ndcg_at_k FROM g LEFT JOIN i USING (query_id)""")
def retrieval_quality(spark, sf):
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy("repository_id").orderBy(F.desc("size_bytes"), "path"))
    ranked = latest(spark, sf, "size_bytes").where("existence_state = 'present'").select(F.col("repository_id").alias("query_id"), F.col("path").alias("item"), place.alias("place"))
    cited = read_table(spark, sf, "spec_citations", "citation_kind", "repository_id", "cited_path").where("citation_kind IN ('TARGET_MODIFY', 'EXISTING_REF') AND cited_path IS NOT NULL")
    relevant = cited.groupBy(F.col("repository_id").alias("query_id"), F.col("cited_path").alias("item")).agg(F.max(F.when(F.col("citation_kind") == "TARGET_MODIFY", 3).otherwise(2)).alias("rel"))
    return E.quality(ranked, relevant, 10)
