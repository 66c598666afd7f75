"""More graph, evidence and search queries over the corpus tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftgrain.functions.keys import norm_id
from siftgrain.operators import analyzers as A
from siftgrain.operators import evidence as E
from siftgrain.operators import graph as G
from siftgrain.operators import index as X
from siftgrain.plans import corpus_queries as C
from siftgrain.plans import structure_queries as S
from siftgrain.plans.base import BASE, folded, index_of, latest, occurrences, units
from siftgrain.plans.search_queries import _scored_sql
from siftgrain.sources.tables import read_table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_OR = ("journal registry voucher", "has(0) OR has(1) OR has(2)", ["journal", "registry", "voucher"])
_ID = r"regexp_replace(lower(trim({0})), '^\{{|\}}$|^urn:uuid:', '', 'g')"


@query(_scored_sql(_OR[1], _OR[2]) + f""", rv AS (SELECT {_ID.format("id")} AS rid, any_value(branch) AS branch, any_value(commit_sha) AS commit_sha FROM source_revisions GROUP BY 1)
SELECT h.unit_id, score, o.path, coalesce(branch, '-') AS branch, coalesce(commit_sha, '-') AS commit_sha, coalesce(r.display_name, '-') AS display_name FROM hits h JOIN un ON un.id = h.unit_id JOIN occ o ON o.id = un.occurrence_id LEFT JOIN rv ON rid = {_ID.format("o.source_revision_id")} LEFT JOIN repositories r ON r.id = o.repository_id""")
def search_joined(spark, sf):
    """Hits with file, revision and repository: the file by an inner join, revision and repository where they are known."""
    hits = X.score_units(spark, index_of(spark, sf), _OR[0]).select("unit_id", "score", "occurrence_id")
    o = occurrences(spark, sf, "path", "repository_id", "source_revision_id").select(F.col("id").alias("occurrence_id"), "path", "repository_id", norm_id(F.col("source_revision_id")).alias("revision"))
    rv = read_table(spark, sf, "source_revisions", "id", "branch", "commit_sha").withColumn("revision", norm_id(F.col("id"))).groupBy("revision").agg(F.first("branch").alias("branch"), F.first("commit_sha").alias("commit_sha"))
    r = read_table(spark, sf, "repositories", "id", "display_name").withColumnRenamed("id", "repository_id")
    dash = lambda c: F.coalesce(c, F.lit("-")).alias(c)
    return hits.join(o, "occurrence_id").join(rv, "revision", "left").join(r, "repository_id", "left").select("unit_id", "score", "path", dash("branch"), dash("commit_sha"), dash("display_name"))


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS k, count(*) AS n FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 500) GROUP BY ALL")
def newest_counts_by_two(spark, sf):
    """Counts by two keys over the newest five hundred log rows."""
    newest = read_table(spark, sf, "events", "event_type", "ts", "event_id", "props").orderBy(F.desc("ts"), F.desc("event_id")).limit(500)
    return newest.groupBy("event_type", (F.get_json_object("props", "$.k").cast("bigint") % 5).alias("k")).agg(F.count("*").alias("n"))


@query(C._EDGES + """, u AS (SELECT edge_id, source, target FROM e UNION ALL SELECT edge_id, target, source FROM e), r AS (SELECT node, 0 AS depth FROM seed UNION SELECT target, depth + 1 FROM r JOIN u ON source = node WHERE depth < 3),
d AS (SELECT node, min(depth) AS depth FROM r GROUP BY 1) SELECT node, depth, CASE depth WHEN 1 THEN 0.9 WHEN 2 THEN 0.6 ELSE 0.3 END::DOUBLE AS proximity FROM d WHERE depth > 0""")
def graph_expand(spark, sf):
    """Neighbours of a repository within three hops of either direction, nearer ones counting more."""
    return G.with_proximity(G.reach(C._edges(spark, sf), C._seed(spark, sf), 3, directed=False))


@query(C.SQL["impact_levels"].replace("SELECT node, depth, array_to_string(path, ',') AS path, min_confidence, CASE", "SELECT node, min_confidence, row_number() OVER (ORDER BY CASE CASE").replace("END AS level FROM k WHERE place = 1 AND depth > 0", "END WHEN 'DIRECT_RESOLVED' THEN 0 WHEN 'INDIRECT_RESOLVED' THEN 1 WHEN 'POSSIBLE_INFERRED' THEN 2 ELSE 3 END, depth, node)::INT AS place FROM k WHERE place = 1 AND depth > 0"))
def impact_ordered(spark, sf):
    """Dependents in the order they are told: by level, length of path and id."""
    level = F.when(F.col("level") == "DIRECT_RESOLVED", 0).when(F.col("level") == "INDIRECT_RESOLVED", 1).when(F.col("level") == "POSSIBLE_INFERRED", 2).otherwise(3)
    found = G.impact(C._edges(spark, sf), C._seed(spark, sf), 3)
    return found.select("node", "min_confidence", F.row_number().over(W.orderBy(level, "depth", "node")).alias("place"))  # repositories, a few


@query(C._EDGES + """, st AS (SELECT repository_id AS node, avg((freshness_state = 'CURRENT')::INT) < 0.5 AS stale FROM file_occurrences GROUP BY 1),
r AS (SELECT node, 0 AS depth FROM seed UNION SELECT source, depth + 1 FROM r JOIN e ON target = node WHERE depth < 3), d AS (SELECT node, min(depth) AS depth FROM r GROUP BY 1)
SELECT d.node, depth, coalesce(stale, false) AS stale, CASE WHEN coalesce(stale, false) THEN 'UNKNOWN' ELSE 'KNOWN' END AS level FROM d LEFT JOIN st USING (node) WHERE depth > 0""")
def impact_staleness(spark, sf):
    """Dependents whose own index is mostly not current count as unknown."""
    o = read_table(spark, sf, "file_occurrences", "repository_id", "freshness_state")
    stale = o.groupBy(F.col("repository_id").alias("node")).agg((F.avg((F.col("freshness_state") == "CURRENT").cast("int")) < 0.5).alias("stale"))
    reversed_edges = C._edges(spark, sf).select(F.col("target").alias("source"), F.col("source").alias("target"))
    found = G.reach(reversed_edges, C._seed(spark, sf), 3).where("depth > 0").join(stale, "node", "left").withColumn("stale", F.coalesce("stale", F.lit(False)))
    return found.select("node", "depth", "stale", F.when(F.col("stale"), "UNKNOWN").otherwise("KNOWN").alias("level"))


@query(S.SQL["type_edges_resolved"].replace("SELECT repository_id, path, source, edge_type, target_name, coalesce(hit", ", fin AS (SELECT repository_id, path, source, edge_type, target_name, coalesce(hit") + """)
SELECT CASE WHEN confidence < 0.6 AND resolution <> 'SYNTACTIC' THEN 'BELOW_RELATIONSHIP_FLOOR' WHEN resolution = 'SYNTACTIC' THEN 'context_only' WHEN confidence >= 1 THEN 'OVERCONFIDENT' ELSE 'counts' END AS verdict, resolution, count(*) AS n FROM fin GROUP BY ALL""")
def validate_edges(spark, sf):
    """Edges of types as evidence: unresolved ones are context only, resolved ones count from a floor of confidence on."""
    edges = S._type_edges_resolved(spark, sf)
    said = E.edge_verdict(F.col("resolution"), F.col("confidence"), 0.6)
    return edges.groupBy(said.alias("verdict"), "resolution").agg(F.count("*").alias("n"))


@query(BASE + r""", c AS (SELECT file_occurrence_id AS id, any_value(content) AS live FROM file_contents GROUP BY 1), l AS (SELECT unit_id, occurrence_id, trim(regexp_replace(regexp_extract(text, '[^\n]{12,}'), '[ \t\r\n]+', ' ', 'g')) AS line, start_line FROM units JOIN (SELECT id, start_line FROM un) s ON s.id = unit_id),
w AS (SELECT unit_id, line, start_line, live, trim(regexp_replace(array_to_string(string_split(live, chr(10))[greatest(start_line - 5, 0) + 1 : greatest(start_line - 5, 0) + 40], chr(10)), '[ \t\r\n]+', ' ', 'g')) AS near FROM l LEFT JOIN c ON c.id = occurrence_id)
SELECT unit_id, CASE WHEN line = '' THEN 'no_line' WHEN live IS NULL THEN 'no_source' WHEN start_line IS NULL THEN 'no_span' WHEN contains(near, line) THEN 'verified' ELSE 'moved_or_changed' END AS state FROM w""")
def window_verification(spark, sf):
    """Whether a unit's first distinctive line stands in the forty lines around where it was indexed."""
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"[ \t\r\n]+", " "))
    live = read_table(spark, sf, "file_contents", "file_occurrence_id", "content").groupBy(F.col("file_occurrence_id").alias("occurrence_id")).agg(F.first("content").alias("live"))
    spans = folded(read_table(spark, sf, "retrieval_units", "id", "start_line"), "id").withColumnRenamed("id", "unit_id")
    rows = units(spark, sf).select("unit_id", "occurrence_id", squeeze(F.regexp_extract("text", r"[^\n]{12,}", 0)).alias("line")).join(spans, "unit_id").join(live, "occurrence_id", "left")
    first = F.greatest(F.col("start_line") - 5, F.lit(0))
    near = squeeze(F.array_join(F.slice(F.split("live", "\n"), first + 1, 40), "\n"))
    state = F.when(F.col("line") == "", "no_line").when(F.col("live").isNull(), "no_source").when(F.col("start_line").isNull(), "no_span").when(near.contains(F.col("line")), "verified").otherwise("moved_or_changed")
    return rows.select("unit_id", state.alias("state"))


@query("SELECT * FROM (VALUES ('manifest_bytes', 262144), ('declarations_per_repository', 2000), ('identities_per_repository', 512), ('repositories_per_run', 64), ('candidates_per_key', 32)) v(name, most)")
def workspace_limits(spark, sf):
    """Limits of a workspace run."""
    return spark.createDataFrame(list(G.WORKSPACE_LIMITS.items()), "name string, most int")


@query(BASE + r"""SELECT CASE WHEN regexp_matches(lower(path), '\.json$') THEN 'json' WHEN regexp_matches(lower(path), '\.(md|markdown)$') THEN 'markdown' WHEN regexp_matches(lower(path), '\.(py|java|js|ts|go|rs)$') THEN 'structural' ELSE 'text' END AS analyzer_id, count(*) AS n FROM newest GROUP BY 1""")
def analyzer_choice(spark, sf):
    """Which analyzer each file goes to."""
    return latest(spark, sf).groupBy(A.chosen(F.col("path")).alias("analyzer_id")).agg(F.count("*").alias("n"))


@query(S._NODES + r""", al AS (SELECT 'structural' AS analyzer_id, node_type FROM nodes UNION ALL SELECT 'markdown', 'HEADING' FROM (SELECT unnest(regexp_split_to_array(content, '\r\n|\r|\n')) AS line FROM fl WHERE e = 'md') WHERE regexp_matches(line, '^#{1,6} +\S')
  UNION ALL SELECT 'text', 'TEXT' FROM fl WHERE e NOT IN ('py', 'java', 'go', 'js', 'ts', 'rs', 'md', 'json')) SELECT analyzer_id, node_type, count(*) AS n FROM al GROUP BY ALL""")
def analyzer_nodes(spark, sf):
    """Nodes of all files but JSON by analyzer and type."""
    return A.analyze(S.files(spark, sf).where(~F.lower("path").endswith(".json")).select("repository_id", "path", "content")).groupBy("analyzer_id", "node_type").agg(F.count("*").alias("n"))
