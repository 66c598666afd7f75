"""Manifests, the edges they make, reads, pages, sinks and budgets, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftgrain.functions.keys import norm_id
from siftgrain.operators import evidence as E
from siftgrain.operators import incremental as I
from siftgrain.operators import resolver as R
from siftgrain.operators import versions as V
from siftgrain.plans.base import BASE, folded, latest, occurrences, units
from siftgrain.session import checkpoint_dir
from siftgrain.sources import reads
from siftgrain.sources.manifests import scan_manifests
from siftgrain.sources.tables import read_table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def manifest_files(spark, sf) -> DataFrame:
    """Manifest texts written from the corpus's modules: a package file and an interface file for each, which name the next module and the next repository; and a package ``shared`` in some repositories."""
    repos = read_table(spark, sf, "repositories", "id", "root_path", "display_name")
    nxt = repos.select("id", F.lead("root_path").over(W.orderBy("root_path")).alias("after"))  # sixty rows
    modules = read_table(spark, sf, "source_manifests", "repository_id", "module_root").distinct().withColumn("nm", F.element_at(F.split("module_root", "/"), -1))
    named = modules.select("nm").distinct().withColumn("nx", F.coalesce(F.lead("nm").over(W.orderBy("nm")), F.lit("nothing")))  # the modules' names
    rows = modules.join(named, "nm").join(nxt, F.col("repository_id") == F.col("id")).withColumn("base", F.coalesce(F.element_at(F.split("after", "/"), -1), F.lit("nowhere")))
    package = F.to_json(F.struct(
        F.col("nm").alias("name"), F.create_map(F.col("nx"), F.lit("^1.2.0"), F.concat(F.lit("absent-"), "nm"), F.lit("1.0.0"), F.lit("shared"), F.lit("2")).alias("dependencies"),
        F.create_map(F.lit("sibling"), F.concat(F.lit("file:../../../"), "base")).alias("devDependencies"),
    ))
    proto = F.concat(F.lit('syntax = "proto3";\nimport "'), "nx", F.lit('/api.proto";\n'))
    shared = repos.where(F.length("display_name") % 3 == 0).select(F.col("id").alias("repository_id"), F.lit("tools/shared/package.json").alias("path"), F.lit('{"name": "shared"}').alias("content"))
    return rows.select("repository_id", F.concat("module_root", F.lit("/package.json")).alias("path"), package.alias("content")).union(rows.select("repository_id", F.concat("module_root", F.lit("/api.proto")), proto)).union(shared)


_MODULES = """WITH m AS (SELECT DISTINCT repository_id AS r, module_root, regexp_extract(module_root, '([^/]+)$', 1) AS nm FROM source_manifests),
nn AS (SELECT nm, coalesce(lead(nm) OVER (ORDER BY nm), 'nothing') AS nx FROM (SELECT DISTINCT nm FROM m)), rr AS (SELECT id, root_path, display_name, lead(root_path) OVER (ORDER BY root_path) AS after FROM repositories),
mm AS (SELECT m.*, nx, root_path, coalesce(regexp_extract(after, '([^/]+)$', 1), 'nowhere') AS base FROM m JOIN nn USING (nm) JOIN rr ON rr.id = r),
sh AS (SELECT id AS r FROM repositories WHERE length(display_name) % 3 = 0)
"""


@query(_MODULES + """SELECT r AS repository_id, module_root || '/package.json' AS path, 'provides' AS role, 'NPM' AS ecosystem, nm AS name, '-' AS kind, '-' AS hint FROM mm UNION ALL SELECT r, 'tools/shared/package.json', 'provides', 'NPM', 'shared', '-', '-' FROM sh
UNION ALL SELECT r, module_root || '/package.json', 'declares', 'NPM', unnest([nx, 'absent-' || nm, 'shared']), 'External', '-' FROM mm UNION ALL SELECT r, module_root || '/package.json', 'declares', 'NPM', 'sibling', 'LocalPath', '../../../' || base FROM mm
UNION ALL SELECT r, module_root || '/api.proto', 'declares', 'GENERATED_API', nx || '/api.proto', 'External', nx || '/api.proto' FROM mm""")
def manifest_scan(spark, sf):
    """What the modules' manifests provide and declare."""
    got = scan_manifests(manifest_files(spark, sf))
    return got.select("repository_id", "path", "role", "ecosystem", "name", F.coalesce("kind", F.lit("-")).alias("kind"), F.coalesce("hint", F.lit("-")).alias("hint"))


_RESOLVED = _MODULES + """, pv AS (SELECT DISTINCT r, nm AS name FROM mm UNION SELECT r, 'shared' FROM sh), dc AS (SELECT DISTINCT r AS consumer, unnest([nx, 'absent-' || nm, 'shared']) AS name FROM mm),
pk AS (SELECT consumer, 'package' AS kind, dc.name, count(DISTINCT r) AS n, min(r) AS provider FROM dc LEFT JOIN pv ON pv.name = dc.name AND r <> consumer GROUP BY 1, 2, 3),
lc AS (SELECT mm.r AS consumer, 'local' AS kind, '../../../' || base AS name, count(DISTINCT t.id) AS n, min(t.id) AS provider FROM mm LEFT JOIN repositories t ON lower(t.root_path) = lower(regexp_replace(mm.root_path, '[^/]+$', '') || base) AND t.id <> mm.r GROUP BY 1, 2, 3),
pr AS (SELECT a.r AS consumer, 'proto' AS kind, a.nx || '/api.proto' AS name, count(DISTINCT b.r) AS n, min(b.r) AS provider FROM mm a LEFT JOIN mm b ON b.nm = a.nx AND b.r <> a.r GROUP BY 1, 2, 3),
al AS (SELECT * FROM pk UNION ALL SELECT * FROM lc UNION ALL SELECT * FROM pr)
"""


def _workspace(spark, sf) -> DataFrame:
    files = manifest_files(spark, sf)
    roots = read_table(spark, sf, "repositories", "id", "root_path").select(F.col("id").alias("repository_id"), "root_path")
    return R.resolve_workspace(scan_manifests(files), roots, files)


@query(_RESOLVED + """SELECT consumer, kind, name, CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'missing' END AS status, CASE WHEN n = 1 THEN provider ELSE '-' END AS provider, CASE WHEN n = 1 THEN CASE kind WHEN 'local' THEN 0.95 WHEN 'package' THEN 0.9 ELSE 0.8 END ELSE 0 END::DOUBLE AS confidence FROM al""")
def workspace_edges(spark, sf):
    """Edges of all kinds from the scanned manifests, with what is ambiguous and missing."""
    return _workspace(spark, sf).select("consumer", "kind", "name", "status", F.coalesce("provider", F.lit("-")).alias("provider"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


@query(_RESOLVED + "SELECT consumer, name, CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'missing' END AS status, CASE WHEN n = 1 THEN provider END AS provider FROM pk")
def provider_resolution(spark, sf):
    """Declared packages and who provides them."""
    scanned = scan_manifests(manifest_files(spark, sf))
    return R.package_edges(scanned.where("role = 'declares'"), scanned.where("role = 'provides'")).select("consumer", "name", "status", "provider")


@query(_RESOLVED + ", e AS (SELECT consumer AS a, provider AS b FROM al WHERE n = 1) SELECT least(a, b) AS one, greatest(a, b) AS other, count(*) AS n_edges FROM e GROUP BY 1, 2")
def edges_between(spark, sf):
    """How many edges each pair of repositories has between them, of either direction."""
    e = _workspace(spark, sf).where("status = 'resolved'")
    return e.groupBy(F.least("consumer", "provider").alias("one"), F.greatest("consumer", "provider").alias("other")).agg(F.count("*").alias("n_edges"))


@query(_RESOLVED + ", g AS (SELECT DISTINCT consumer, provider FROM al WHERE n = 1) SELECT r.id AS repository_id, r.display_name, (SELECT count(*) FROM g WHERE g.consumer = r.id) AS n_uses, (SELECT count(*) FROM g WHERE g.provider = r.id) AS n_used_by, (SELECT count(*) FROM pv WHERE pv.r = r.id) AS n_provides FROM repositories r")
def catalog_projection(spark, sf):
    """One catalog row per repository: what it uses, who uses it, what it provides; written to the shared folder and read back."""
    files = manifest_files(spark, sf)
    scanned = scan_manifests(files)
    roots = read_table(spark, sf, "repositories", "id", "root_path").select(F.col("id").alias("repository_id"), "root_path")
    edges = R.resolve_workspace(scanned, roots, files).where("status = 'resolved'").select("consumer", "provider").distinct()
    provides = scanned.where("role = 'provides'").select("repository_id", "name").distinct().groupBy("repository_id").agg(F.count("*").alias("n_provides"))
    repos = read_table(spark, sf, "repositories", "id", "display_name").withColumnRenamed("id", "repository_id")
    uses = edges.groupBy(F.col("consumer").alias("repository_id")).agg(F.count("*").alias("n_uses"))
    used = edges.groupBy(F.col("provider").alias("repository_id")).agg(F.count("*").alias("n_used_by"))
    rows = repos.join(uses, "repository_id", "left").join(used, "repository_id", "left").join(provides, "repository_id", "left").select("repository_id", "display_name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_uses", "n_used_by", "n_provides")])
    root = f"{checkpoint_dir(spark)}/catalog-{uuid.uuid4()}"
    V.publish(rows, root, "1")
    return V.published(spark, root)


# --- reads and pages ------------------------------------------------------


@query(BASE + r""", c AS (SELECT n.id, any_value(content) AS t FROM newest n JOIN file_contents f ON f.file_occurrence_id = n.id WHERE NOT regexp_matches(path, '(^|/)\.(git|ssh|gnupg)(/|$)') GROUP BY 1),
h AS (SELECT id, t, strlen(t) AS size, hex(encode(t)) AS hx FROM c), k AS (SELECT *, CASE WHEN size <= 500 THEN size ELSE 500 - CASE WHEN hx[1001] NOT IN ('8', '9', 'A', 'B') THEN 0 WHEN hx[999] NOT IN ('8', '9', 'A', 'B') THEN 1 WHEN hx[997] NOT IN ('8', '9', 'A', 'B') THEN 2 ELSE 3 END END AS kept FROM h)
SELECT id, size::INT AS size_bytes, kept::INT AS n_bytes, size > 500 AS truncated, sha256(decode(unhex(substr(hx, 1, 2 * kept)))) AS text_hash FROM k""")
def bounded_read(spark, sf):
    """The first 500 bytes of each file that may be read, never cutting a character."""
    contents = read_table(spark, sf, "file_contents", "file_occurrence_id", "content").withColumnRenamed("file_occurrence_id", "id").dropDuplicates(["id"])
    got = reads.bounded(latest(spark, sf).select("id", "path").join(contents, "id"), 500)
    return got.select("id", "size_bytes", "n_bytes", "truncated", F.sha2("text", 256).alias("text_hash"))


@query(BASE + ", c AS (SELECT n.id, any_value(content) AS t FROM newest n JOIN file_contents f ON f.file_occurrence_id = n.id GROUP BY 1) SELECT id, ceil(strlen(t) / 256.0)::BIGINT AS n_windows, strlen(t)::BIGINT AS n_bytes FROM c WHERE strlen(t) > 0")
def file_windows(spark, sf):
    """Files as a stream of windows of 256 bytes."""
    contents = read_table(spark, sf, "file_contents", "file_occurrence_id", "content").withColumnRenamed("file_occurrence_id", "id").dropDuplicates(["id"])
    return reads.windows(latest(spark, sf).select("id").join(contents, "id"), 256).groupBy("id").agg(F.count("*").alias("n_windows"), F.sum("n_bytes").cast("bigint").alias("n_bytes"))


@query(BASE + """, st AS (SELECT DISTINCT repository_id, checkpoint FROM (SELECT repository_id, path AS checkpoint FROM occ WHERE freshness_state = 'PENDING_REFRESH'))
SELECT u.unit_id, (SELECT count(*) FROM units x WHERE x.occurrence_id = u.occurrence_id) AS n_siblings, (SELECT count(*) FROM occ o WHERE o.repository_id = u.repository_id AND o.path = u.path) AS n_versions FROM units u
WHERE u.unit_id > '4' AND NOT EXISTS (SELECT 1 FROM st WHERE st.repository_id = u.repository_id AND st.checkpoint = u.path) ORDER BY u.unit_id LIMIT 200""")
def unit_page(spark, sf):
    """A page of 200 units after a key, with the units of their file and the versions of their path; files waiting for eviction are left out."""
    u, o = units(spark, sf), occurrences(spark, sf, "repository_id", "path", "freshness_state")
    waiting = o.where("freshness_state = 'PENDING_REFRESH'").select("repository_id", "path").distinct()
    page = u.where("unit_id > '4'").join(waiting, ["repository_id", "path"], "left_anti").orderBy("unit_id").limit(200)
    siblings = u.groupBy("occurrence_id").agg(F.count("*").alias("n_siblings"))
    versions = o.groupBy("repository_id", "path").agg(F.count("*").alias("n_versions"))
    return page.join(siblings, "occurrence_id").join(versions, ["repository_id", "path"]).select("unit_id", "n_siblings", "n_versions")


@query(BASE + "SELECT unit_id, length(text)::INT AS n_chars FROM units WHERE occurrence_id IN (SELECT min(id) FROM newest GROUP BY repository_id)")
def units_by_ids(spark, sf):
    """The units of a list of files, by a semi-join."""
    wanted = latest(spark, sf).groupBy("repository_id").agg(F.min("id").alias("occurrence_id")).select("occurrence_id")
    return units(spark, sf).join(wanted, "occurrence_id", "left_semi").select("unit_id", F.length("text").alias("n_chars"))


@query("""WITH d AS (SELECT r AS repository_id, path, n FROM (SELECT repository_id AS r, regexp_replace(path, '/[^/]*$', '') AS path, count(DISTINCT id) AS n FROM file_occurrences GROUP BY 1, 2)),
s AS (SELECT *, row_number() OVER (ORDER BY repository_id, path) AS k, strlen(path) + 12 AS size FROM d), t AS (SELECT *, sum(size) OVER (ORDER BY k) AS used FROM s WHERE k > 20) SELECT repository_id, path, n FROM t WHERE used <= 2000 ORDER BY k LIMIT 50""")
def page_within_bytes(spark, sf):
    """Directories from the 21st on, at most fifty and two thousand bytes of them."""
    o = occurrences(spark, sf, "repository_id", "path").withColumn("path", F.regexp_replace("path", "/[^/]*$", "")).groupBy("repository_id", "path").agg(F.count("*").alias("n"))
    return reads.page(o, ["repository_id", "path"], F.octet_length("path") + 12, offset=20, limit=50, budget=2000).select("repository_id", "path", "n")


# --- sinks ----------------------------------------------------------------


@query(BASE + "SELECT repository_id, count(*) AS n_files, max(occurrence_seq) AS last_seq FROM newest WHERE existence_state = 'present' GROUP BY 1")
def workspace_snapshot(spark, sf):
    """A snapshot of the workspace, appended to the snapshots and read back by its number."""
    root = f"{checkpoint_dir(spark)}/snapshots-{uuid.uuid4()}"
    now = latest(spark, sf, "occurrence_seq").where("existence_state = 'present'").groupBy("repository_id").agg(F.count("*").alias("n_files"), F.max("occurrence_seq").alias("last_seq"))
    reads.append_snapshot(now.limit(0), root, 1)
    reads.append_snapshot(now, root, 2)
    return reads.snapshot(spark, root, 2)


@query("SELECT suite, policy_mode, count(*) AS n, round(avg(length(item_text)), 6) AS mean_chars FROM eval_items GROUP BY ALL")
def plan_log(spark, sf):
    """Plans of answered questions appended to a log as JSON, and totals read back from the log."""
    path = f"{checkpoint_dir(spark)}/plans-{uuid.uuid4()}"
    items = read_table(spark, sf, "eval_items", "item_id", "suite", "policy_mode", "item_text")
    reads.append_plans(items.select(F.col("item_id").cast("string").alias("plan_id"), F.struct("suite", "policy_mode", F.length("item_text").alias("n_chars")).alias("plan")), path)
    log = spark.read.parquet(path)
    field = lambda n: F.get_json_object("plan_json", f"$.{n}")
    return log.groupBy(field("suite").alias("suite"), field("policy_mode").alias("policy_mode")).agg(F.count("*").alias("n"), F.round(F.avg(field("n_chars").cast("double")), 6).alias("mean_chars"))


@query(BASE + ", gone AS (SELECT min(id) AS r FROM repositories) SELECT repository_id, count(*) AS n_units FROM units WHERE repository_id <> (SELECT r FROM gone) GROUP BY 1")
def repository_evicted(spark, sf):
    """The units after one repository was evicted, in bounded steps."""
    gone = read_table(spark, sf, "repositories", "id").agg(F.min("id").alias("repository_id"))
    return reads.evict(units(spark, sf).select("repository_id", "unit_id"), gone, "repository_id").groupBy("repository_id").agg(F.count("*").alias("n_units"))


@query(BASE + """, g AS (SELECT occurrence_id, unit_id FROM units), ch AS (SELECT id FROM newest WHERE freshness_state <> 'CURRENT')
SELECT g.occurrence_id, count(*) AS n_units, CASE WHEN ch.id IS NULL THEN 'kept' ELSE 'replaced' END AS origin FROM g LEFT JOIN ch ON ch.id = g.occurrence_id GROUP BY 1, 3""")
def structural_replace(spark, sf):
    """Rows of changed files replaced as a whole, the others kept."""
    rows = units(spark, sf).select("occurrence_id", "unit_id")
    changed = latest(spark, sf).where("freshness_state <> 'CURRENT'").select(F.col("id").alias("occurrence_id"))
    new = rows.join(changed, "occurrence_id", "left_semi").withColumn("origin", F.lit("replaced"))
    return I.replace_parts(rows.withColumn("origin", F.lit("kept")), new, changed, "occurrence_id").groupBy("occurrence_id", "origin").agg(F.count("*").alias("n_units"))


# --- budgets --------------------------------------------------------------

_MODES = "(VALUES ('FAST', 50, 25), ('NORMAL', 500, 200), ('DEEP', 5000, 2000)) md(mode, candidates, graph_nodes)"


@query(BASE + f""", s AS (SELECT repository_id, count(*) AS n, count(*) FILTER (freshness_state = 'CURRENT') AS good FROM units GROUP BY 1)
SELECT repository_id, mode, least(n, candidates)::BIGINT AS candidates_used, CASE WHEN good = 0 AND n > candidates THEN 'DEGRADED_BY_TIME' WHEN good = 0 THEN 'INSUFFICIENT_EVIDENCE' WHEN n > candidates THEN 'DEGRADED_BY_CANDIDATES' WHEN n * 2 > graph_nodes THEN 'DEGRADED_BY_TIME' ELSE 'COMPLETED_WITHIN_BUDGET' END AS result
FROM s CROSS JOIN {_MODES}""")
def budget_results(spark, sf):
    """What each mode's budgets make of each repository: candidates admitted, and the limit that was hit first."""
    s = units(spark, sf).groupBy("repository_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("freshness_state") == "CURRENT", 1)).alias("good"))
    modes = F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(c).alias("candidates"), F.lit(g).alias("graph_nodes")) for m, c, g in (("FAST", 50, 25), ("NORMAL", 500, 200), ("DEEP", 5000, 2000))])
    rows = s.select("*", F.inline(modes))
    over = F.array_compact(F.array(F.when(F.col("n") > F.col("candidates"), "max_candidates"), F.when(F.col("n") * 2 > F.col("graph_nodes"), "max_graph_nodes")))
    return rows.select("repository_id", "mode", F.least("n", "candidates").cast("bigint").alias("candidates_used"), E.budget_result(F.col("good") == 0, over).alias("result"))


@query(BASE + """, i AS (SELECT repository_id, id, path, size_bytes, row_number() OVER (PARTITION BY repository_id ORDER BY occurrence_seq DESC, id) AS k FROM newest WHERE existence_state = 'present'),
c AS (SELECT *, sum(size_bytes) OVER (PARTITION BY repository_id ORDER BY k) AS used FROM i), kept AS (SELECT * FROM c WHERE used <= 6000), cl AS (SELECT repository_id, regexp_extract(path, '\\.([a-z]+)$', 1) AS claim, count(*) AS n_all FROM i GROUP BY 1, 2)
SELECT cl.repository_id, claim, n_all, (SELECT count(*) FROM kept WHERE kept.repository_id = cl.repository_id AND regexp_extract(kept.path, '\\.([a-z]+)$', 1) = claim) AS n_kept FROM cl WHERE n_kept > 0""")
def response_budget(spark, sf):
    """Evidence kept whole within 6,000 bytes per repository, newest first, and the claims that still have some."""
    items = latest(spark, sf, "size_bytes", "occurrence_seq").where("existence_state = 'present'").select("repository_id", "id", "path", "size_bytes", (-F.col("occurrence_seq")).alias("order"))
    claims = items.select("repository_id", F.regexp_extract("path", r"\.([a-z]+)$", 1).alias("claim"), F.col("id"))
    kept, supported = E.response_within(items, claims, ["repository_id"], "size_bytes", 6000, ["order", "id"])
    return supported


@query(BASE.replace("WITH occ", "WITH RECURSIVE occ", 1) + """, i AS (SELECT repository_id, id, size_bytes, row_number() OVER (PARTITION BY repository_id ORDER BY occurrence_seq DESC, id) AS k FROM newest WHERE existence_state = 'present' QUALIFY k <= 50),
f AS (SELECT repository_id, k, id, CASE WHEN size_bytes <= 8000 THEN size_bytes ELSE 0 END AS used, size_bytes <= 8000 AS took FROM i WHERE k = 1
  UNION ALL SELECT i.repository_id, i.k, i.id, used + CASE WHEN used + size_bytes <= 8000 THEN size_bytes ELSE 0 END, used + size_bytes <= 8000 FROM f JOIN i ON i.repository_id = f.repository_id AND i.k = f.k + 1)
SELECT repository_id, id FROM f WHERE took""")
def context_fill(spark, sf):
    """Context under 8,000 bytes out of the fifty best candidates: one that does not fit is skipped, later ones still may."""
    items = latest(spark, sf, "size_bytes", "occurrence_seq").where("existence_state = 'present'").select("repository_id", "id", "size_bytes", (-F.col("occurrence_seq")).alias("order"))
    return E.within_budget(items, ["repository_id"], "size_bytes", 8000, ["order", "id"], most=50)
