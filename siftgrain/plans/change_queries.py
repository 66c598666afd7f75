"""Incremental engine and governance over the corpus tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftgrain.functions.keys import norm_id
from siftgrain.functions.paths import priority
from siftgrain.functions.text import tokens
from siftgrain.operators import governance as V
from siftgrain.operators import incremental as I
from siftgrain.operators import lexical as L
from siftgrain.operators.versions import glob_covered
from siftgrain.plans.base import BASE, folded, latest, occurrences, units
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


#: The day between the two states of the corpus that these queries compare.
DAY = "2025-09-01"
_CUT = f"TIMESTAMP '{DAY}'"


def _before(c: str):
    return F.col(c) < F.lit(DAY).cast("timestamp_ntz")


# --- events ---------------------------------------------------------------

_EVENTS = """WITH ev AS (SELECT event_id, CASE user_id % 7 WHEN 0 THEN '.git/objects/' || user_id WHEN 1 THEN './src/' || user_id || '.py' WHEN 2 THEN 'src/../' || user_id WHEN 3 THEN '/abs/' || user_id WHEN 4 THEN 'web/node_modules/' || user_id || '.js' WHEN 5 THEN 'src/m' || (user_id % 10) || '/.gitignore' ELSE 'lib/' || user_id || '.go' END AS path FROM events)
"""


@query(_EVENTS + r"""SELECT event_id, regexp_replace(path, '^(\./)+', '') AS rel_path, ends_with(path, '.gitignore') AS policy_input FROM ev WHERE NOT starts_with(path, '.git/') AND NOT contains(path, '..') AND NOT starts_with(path, '/') AND NOT contains(path, 'node_modules/')""")
def event_gate(spark, sf):
    """Events of paths that may be read; git's own, absolute, upward and ignored ones are dropped."""
    k = F.col("user_id").cast("string")
    n = F.col("user_id") % 7
    path = (
        F.when(n == 0, F.concat(F.lit(".git/objects/"), k)).when(n == 1, F.concat(F.lit("./src/"), k, F.lit(".py"))).when(n == 2, F.concat(F.lit("src/../"), k)).when(n == 3, F.concat(F.lit("/abs/"), k))
        .when(n == 4, F.concat(F.lit("web/node_modules/"), k, F.lit(".js"))).when(n == 5, F.concat(F.lit("src/m"), (F.col("user_id") % 10).cast("string"), F.lit("/.gitignore"))).otherwise(F.concat(F.lit("lib/"), k, F.lit(".go")))
    )
    events = read_table(spark, sf, "events", "event_id", "user_id").select("event_id", path.alias("path"))
    return I.gate_events(events, priority(F.col("path"), [], ["**/node_modules/**"], [], [])).select("event_id", "rel_path", "policy_input")


_HINTS = BASE + f""", known AS (SELECT repository_id, path, content_hash, freshness_state FROM (SELECT * FROM occ WHERE received_at < {_CUT} QUALIFY row_number() OVER (PARTITION BY repository_id, path ORDER BY occurrence_seq DESC) = 1) WHERE existence_state = 'present'),
reads AS (SELECT repository_id, path, CASE WHEN existence_state = 'deleted' THEN 'missing' WHEN content_hash IS NULL OR freshness_state = 'UNKNOWN' THEN 'uncertain' ELSE 'present' END AS state, content_hash FROM newest),
hints AS (SELECT DISTINCT repository_id, path FROM occ WHERE received_at >= {_CUT}),
verdicts AS (SELECT h.repository_id, h.path, k.freshness_state, CASE WHEN r.state = 'uncertain' THEN 'uncertain' WHEN coalesce(r.state, 'missing') = 'missing' THEN CASE WHEN k.path IS NULL THEN 'unknown_path' ELSE 'deleted' END
  WHEN k.path IS NULL THEN 'added' WHEN k.content_hash IS NOT DISTINCT FROM r.content_hash THEN 'unchanged' ELSE 'modified' END AS verdict FROM hints h LEFT JOIN known k USING (repository_id, path) LEFT JOIN reads r USING (repository_id, path))
"""


def _hinted(spark, sf):
    keys = ["repository_id", "path"]
    o = occurrences(spark, sf, *keys, "content_hash", "existence_state", "freshness_state", "occurrence_seq", "received_at")
    known = o.where(_before("received_at")).groupBy(*keys).agg(F.max_by(F.struct("content_hash", "existence_state", "freshness_state"), "occurrence_seq").alias("x")).select(*keys, "x.*").where("existence_state = 'present'")
    state = F.when(F.col("existence_state") == "deleted", "missing").when(F.col("content_hash").isNull() | (F.col("freshness_state") == "UNKNOWN"), "uncertain").otherwise("present")
    reads = latest(spark, sf, "content_hash").select(*keys, state.alias("state"), "content_hash")
    return I.verify_hints(o.where(~_before("received_at")), known, reads, keys), known


@query(_HINTS + "SELECT repository_id, path, verdict FROM verdicts")
def hint_verification(spark, sf):
    """What the paths touched since the cut come to, by reading them."""
    return _hinted(spark, sf)[0]


@query(_HINTS + "SELECT repository_id, path, CASE verdict WHEN 'uncertain' THEN 'UNKNOWN' WHEN 'unchanged' THEN 'CURRENT' WHEN 'deleted' THEN 'INVALID' WHEN 'modified' THEN 'PENDING_REFRESH' ELSE freshness_state END AS freshness_state FROM verdicts JOIN known USING (repository_id, path, freshness_state)")
def freshness_after_hints(spark, sf):
    """Indexed files after verification: restored without recomputing, marked unknown, invalid or due."""
    verdicts, known = _hinted(spark, sf)
    return verdicts.join(known.select("repository_id", "path", "freshness_state"), ["repository_id", "path"]).select("repository_id", "path", I.after_verdict(F.col("freshness_state"), F.col("verdict")).alias("freshness_state"))


@query(BASE + """, a AS (SELECT repository_id, path, received_at AS invalidated_at FROM occ WHERE freshness_state = 'INVALID'), r AS (SELECT repository_id, path, received_at AS recomputed_at FROM occ WHERE freshness_state = 'CURRENT')
SELECT a.repository_id, a.path, invalidated_at, coalesce((SELECT min(recomputed_at) FROM r WHERE r.repository_id = a.repository_id AND r.path = a.path AND recomputed_at > invalidated_at), TIMESTAMP '1970-01-01') AS closed_at FROM a""")
def audit_closed(spark, sf):
    """Invalidations and when a later recomputation closed them; 1970 stands for those that are open."""
    o = occurrences(spark, sf, "repository_id", "path", "freshness_state", "received_at")
    audit = o.where("freshness_state = 'INVALID'").select("repository_id", "path", F.col("received_at").alias("invalidated_at"))
    return I.close_audit(audit, o.where("freshness_state = 'CURRENT'").select("repository_id", "path", F.col("received_at").alias("recomputed_at")), ["repository_id", "path"]).withColumn("closed_at", F.coalesce("closed_at", F.lit("1970-01-01").cast("timestamp_ntz")))


# --- tasks ----------------------------------------------------------------

_TASKS = BASE + f""", raw AS (SELECT id AS task_id, CASE freshness_state WHEN 'STALE' THEN 'REFRESH' WHEN 'INVALID' THEN 'REINDEX' WHEN 'UNKNOWN' THEN 'VERIFY' ELSE 'STALE_EVICTION' END AS task_type, repository_id, path AS checkpoint,
  CASE freshness_state WHEN 'INVALID' THEN 10 WHEN 'UNKNOWN' THEN 5 ELSE 1 END AS priority, received_at AS created_at, size_bytes % 5 AS r, occurrence_seq FROM occ WHERE freshness_state <> 'CURRENT'),
pend AS (SELECT task_id, task_type, repository_id, checkpoint, priority, created_at, CASE r WHEN 0 THEN 'RUNNING' WHEN 1 THEN 'DONE' ELSE 'PENDING' END AS state, (r % 4)::INT AS retries FROM raw WHERE created_at < {_CUT}),
fresh AS (SELECT task_id, task_type, repository_id, checkpoint, priority, created_at, 'PENDING' AS state, 0 AS retries FROM raw WHERE created_at >= {_CUT}),
tasks AS (SELECT * FROM pend UNION ALL SELECT * FROM (SELECT * FROM fresh QUALIFY row_number() OVER (PARTITION BY task_type, repository_id, checkpoint ORDER BY created_at, task_id) = 1) f
  WHERE NOT EXISTS (SELECT 1 FROM pend p WHERE p.state = 'PENDING' AND p.task_type = f.task_type AND p.repository_id IS NOT DISTINCT FROM f.repository_id AND p.checkpoint IS NOT DISTINCT FROM f.checkpoint))
"""


def _tasks(spark, sf) -> DataFrame:
    o = occurrences(spark, sf, "repository_id", "path", "freshness_state", "size_bytes", "received_at").where("freshness_state <> 'CURRENT'")
    kind = F.when(F.col("freshness_state") == "STALE", "REFRESH").when(F.col("freshness_state") == "INVALID", "REINDEX").when(F.col("freshness_state") == "UNKNOWN", "VERIFY").otherwise("STALE_EVICTION")
    weight = F.when(F.col("freshness_state") == "INVALID", 10).when(F.col("freshness_state") == "UNKNOWN", 5).otherwise(1)
    raw = o.select(F.col("id").alias("task_id"), kind.alias("task_type"), "repository_id", F.col("path").alias("checkpoint"), weight.alias("priority"), F.col("received_at").alias("created_at"), (F.col("size_bytes") % 5).alias("r"))
    state = F.when(F.col("r") == 0, "RUNNING").when(F.col("r") == 1, "DONE").otherwise("PENDING")
    pending = raw.where(_before("created_at")).withColumns({"state": state, "retries": (F.col("r") % 4).cast("int")}).drop("r")
    return I.enqueue(pending, raw.where(~_before("created_at")).withColumns({"state": F.lit("PENDING"), "retries": F.lit(0)}).drop("r"))


@query(_TASKS + "SELECT task_id, task_type, state, retries FROM tasks")
def task_enqueue(spark, sf):
    """The queue after new tasks came in; one that is already pending is not queued again."""
    return _tasks(spark, sf).select("task_id", "task_type", "state", "retries")


@query(_TASKS + "SELECT task_id, task_type, priority FROM tasks WHERE state = 'PENDING' AND task_type <> 'STALE_EVICTION' ORDER BY priority DESC, created_at, task_id LIMIT 25")
def task_claim(spark, sf):
    """The next 25 tasks of a worker."""
    return I.claim(_tasks(spark, sf), 25).select("task_id", "task_type", "priority")


@query(_TASKS + """, o AS (SELECT task_id, CASE length(checkpoint) % 3 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'DONE' ELSE 'CANCELLED' END AS outcome FROM tasks WHERE state = 'RUNNING')
SELECT t.task_id, CASE WHEN outcome = 'FAILED' THEN CASE WHEN retries < 3 THEN 'PENDING' ELSE 'FAILED' END ELSE coalesce(outcome, CASE state WHEN 'RUNNING' THEN 'PENDING' ELSE state END) END AS state, (retries + (outcome IS NOT DISTINCT FROM 'FAILED')::INT)::INT AS retries FROM tasks t LEFT JOIN o USING (task_id)""")
def task_finish(spark, sf):
    """The queue after running tasks ended or were interrupted."""
    tasks = _tasks(spark, sf)
    n = F.length("checkpoint") % 3
    outcomes = tasks.where("state = 'RUNNING'").select("task_id", F.when(n == 0, "FAILED").when(n == 1, "DONE").otherwise("CANCELLED").alias("outcome"))
    return I.recover(I.finish(tasks, outcomes)).select("task_id", "state", "retries")


@query(_TASKS + "SELECT repository_id, count(*) FILTER (state = 'PENDING') AS n_pending, count(*) FILTER (state = 'RUNNING') AS n_running, count(*) FILTER (state = 'FAILED') AS n_failed FROM tasks GROUP BY 1")
def task_states(spark, sf):
    count = lambda s: F.count(F.when(F.col("state") == s, 1)).alias(f"n_{s.lower()}")
    return _tasks(spark, sf).groupBy("repository_id").agg(*map(count, ("PENDING", "RUNNING", "FAILED")))


@query(_TASKS + f"SELECT task_id, task_type, (epoch_us({_CUT}) - epoch_us(created_at)) // 1000000 AS age_seconds FROM tasks WHERE state = 'RUNNING' AND (epoch_us({_CUT}) - epoch_us(created_at)) // 1000000 > 3600")
def stuck_tasks(spark, sf):
    """Tasks that have been running for more than an hour, with their age."""
    age = F.expr(f"(unix_micros(timestamp'{DAY}') - unix_micros(cast(created_at as timestamp))) div 1000000")
    return _tasks(spark, sf).where("state = 'RUNNING'").select("task_id", "task_type", age.alias("age_seconds")).where(F.col("age_seconds") > I.STUCK_SECONDS)


@query(_TASKS + f"SELECT task_id FROM tasks WHERE state IN ('DONE', 'FAILED', 'CANCELLED') AND created_at < {_CUT} - INTERVAL 30 DAY")
def terminal_tasks_pruned(spark, sf):
    """Finished tasks that are older than retention keeps them."""
    return _tasks(spark, sf).where(F.col("state").isin("DONE", "FAILED", "CANCELLED") & (F.col("created_at") < F.expr(f"timestamp_ntz'{DAY}' - make_dt_interval({I.TERMINAL_DAYS})"))).select("task_id")


# --- index in step --------------------------------------------------------

_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


@query(BASE + f", t AS (SELECT unit_id, repository_id, unnest({_TOKENS}) AS term FROM units) SELECT repository_id, count(DISTINCT term) AS n_terms, count(*) AS n_tokens, count(DISTINCT unit_id) AS n_units FROM t GROUP BY 1")
def incremental_index(spark, sf):
    """Postings of the units known before the cut, brought up to date by replacing only what changed since; equal to those of a full rebuild."""
    text = folded(read_table(spark, sf, "retrieval_units", "id", "received_at"), "id")
    now = units(spark, sf)
    changed = now.select("unit_id").join(text.select(F.col("id").alias("unit_id"), "received_at"), "unit_id").where(~_before("received_at"))
    old = now.join(changed.select("unit_id"), "unit_id", "left_anti")
    post = lambda df: df.select("unit_id", "repository_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("unit_id", "repository_id", "term").agg(F.count("*").alias("tf"))
    index = I.replace_parts(post(old), post(now.join(changed.select("unit_id"), "unit_id", "left_semi")), changed, "unit_id")
    return index.groupBy("repository_id").agg(F.count_distinct("term").alias("n_terms"), F.sum("tf").alias("n_tokens"), F.count_distinct("unit_id").alias("n_units"))


@query("""SELECT repository_id AS source, dependency_repository_id AS target, count(DISTINCT run_id || '#' || ordinal) AS n FROM spec_citations WHERE dependency_repository_id IS NOT NULL AND repository_id <> dependency_repository_id GROUP BY 1, 2""")
def incremental_edges(spark, sf):
    """Edges between repositories after those of the repositories with new citations were derived anew and the others kept; equal to a full derivation."""
    rows = read_table(spark, sf, "spec_citations", "run_id", "ordinal", "repository_id", "dependency_repository_id", "received_at").where("dependency_repository_id IS NOT NULL AND repository_id <> dependency_repository_id")
    derive = lambda df: df.groupBy(F.col("repository_id").alias("source"), F.col("dependency_repository_id").alias("target")).agg(F.count_distinct(F.concat_ws("#", "run_id", "ordinal")).alias("n"))
    changed = rows.where(~_before("received_at")).select(F.col("repository_id").alias("source")).distinct()
    again = derive(rows.join(changed.withColumnRenamed("source", "repository_id"), "repository_id", "left_semi"))
    return I.replace_parts(derive(rows.where(_before("received_at"))), again, changed, "source")


@query()
def coalesce_renames(spark, sf):
    """Events folded per burst, renames paired across paths."""
    e = read_table(spark, sf, "events", "event_id", "user_id", "event_type", "ts")
    kind = F.when(F.col("event_type") == "signup", "Created").when(F.col("event_type") == "view", "Modified").when(F.col("event_type") == "error", "Removed").when(F.col("event_type") == "click", F.when(F.col("user_id") % 2 == 0, "RenamedFrom").otherwise("RenamedTo"))
    feed = e.select((F.col("user_id") % 4).cast("string").alias("repository_id"), F.col("user_id").cast("string").alias("path"), kind.alias("kind"), F.expr("unix_millis(cast(ts as timestamp))").alias("at_ms")).where("kind IS NOT NULL")
    return S.coalesce_bursts(feed, 60_000)


# --- governance -----------------------------------------------------------

_STATES = "['UNDER_REVIEW','VERIFIED','APPROVED','IMPLEMENTING','INTERRUPTED','IMPLEMENTED','DRIFTED','ABANDONED']"


@query(f"""WITH p AS (SELECT s AS state, op FROM (SELECT unnest({_STATES}) AS s) CROSS JOIN (SELECT unnest(['register','verify_pass','verify_fail','approve','begin','heartbeat','wave_complete','resume','drift_pass','drift_fail','reopen','abandon']) AS op)),
t AS (SELECT * FROM (VALUES ('ABANDONED','register','UNDER_REVIEW'),('UNDER_REVIEW','verify_pass','VERIFIED'),('VERIFIED','verify_pass','VERIFIED'),('APPROVED','verify_pass','APPROVED'),('UNDER_REVIEW','verify_fail','UNDER_REVIEW'),('VERIFIED','verify_fail','UNDER_REVIEW'),('APPROVED','verify_fail','UNDER_REVIEW'),
 ('VERIFIED','approve','APPROVED'),('APPROVED','begin','IMPLEMENTING'),('INTERRUPTED','resume','IMPLEMENTING'),('IMPLEMENTING','heartbeat','IMPLEMENTING'),('IMPLEMENTING','wave_complete','IMPLEMENTING'),('IMPLEMENTING','drift_pass','IMPLEMENTED'),('IMPLEMENTED','drift_pass','IMPLEMENTED'),('DRIFTED','drift_pass','IMPLEMENTED'),
 ('IMPLEMENTING','drift_fail','DRIFTED'),('IMPLEMENTED','drift_fail','DRIFTED'),('DRIFTED','drift_fail','DRIFTED'),('UNDER_REVIEW','reopen','UNDER_REVIEW'),('APPROVED','reopen','UNDER_REVIEW'),('IMPLEMENTING','reopen','UNDER_REVIEW'),('INTERRUPTED','reopen','UNDER_REVIEW'),('IMPLEMENTED','reopen','UNDER_REVIEW'),('DRIFTED','reopen','UNDER_REVIEW')) v(state, op, after))
SELECT state, op AS operation, coalesce(CASE WHEN op = 'abandon' THEN 'ABANDONED' END, after, CASE WHEN op = 'register' THEN p.state END, 'ERROR') AS after FROM p LEFT JOIN t USING (state, op)""")
def state_transitions(spark, sf):
    """Every state and operation of a governed document with what follows."""
    rows = spark.createDataFrame([(s, o) for s in V.STATES for o in V.OPERATIONS], "state string, operation string")
    return rows.withColumn("after", F.coalesce(V.transition(F.col("state"), F.col("operation")), F.lit("ERROR")))


_DOCS = f"""WITH d AS (SELECT id, {_STATES}[length(branch) % 8 + 1] AS state, working_tree_manifest_hash AS doc_hash, CASE WHEN unstable_capture THEN 'x' ELSE working_tree_manifest_hash END AS verified_hash,
  CASE WHEN length(commit_sha) > 0 AND unstable_capture THEN discovery_policy_hash ELSE working_tree_manifest_hash END AS approved_hash, CASE WHEN branch <> 'main' THEN captured_at + INTERVAL 10 DAY END AS lease_ends
  FROM (SELECT id, any_value(branch) AS branch, any_value(working_tree_manifest_hash) AS working_tree_manifest_hash, any_value(unstable_capture) AS unstable_capture, any_value(commit_sha) AS commit_sha, any_value(discovery_policy_hash) AS discovery_policy_hash, any_value(captured_at) AS captured_at FROM source_revisions GROUP BY 1) WHERE branch IS NOT NULL)
"""


def _governed(spark, sf) -> DataFrame:
    r = folded(read_table(spark, sf, "source_revisions", "id", "branch", "working_tree_manifest_hash", "unstable_capture", "commit_sha", "discovery_policy_hash", "captured_at"), "id").where("branch IS NOT NULL")
    state = F.element_at(F.array(*map(F.lit, V.STATES)), F.length("branch") % 8 + 1)
    changed = (F.length("commit_sha") > 0) & F.col("unstable_capture")
    return r.select(
        "id", state.alias("state"), F.col("working_tree_manifest_hash").alias("doc_hash"), F.when(F.col("unstable_capture"), "x").otherwise(F.col("working_tree_manifest_hash")).alias("verified_hash"),
        F.when(changed, F.col("discovery_policy_hash")).otherwise(F.col("working_tree_manifest_hash")).alias("approved_hash"), F.when(F.col("branch") != "main", F.col("captured_at") + F.expr("INTERVAL 10 DAYS")).alias("lease_ends"),
    )


@query(_DOCS + f""", e AS (SELECT *, coalesce(approved_hash <> doc_hash, false) AS changed, lease_ends IS NULL OR {_CUT} >= lease_ends AS expired FROM d)
SELECT id, state, CASE WHEN coalesce(doc_hash, '') = '' THEN CASE state WHEN 'IMPLEMENTING' THEN 'INTERRUPTED' WHEN 'APPROVED' THEN 'UNDER_REVIEW' WHEN 'VERIFIED' THEN 'UNDER_REVIEW' WHEN 'IMPLEMENTED' THEN 'DRIFTED' ELSE state END
  WHEN state = 'IMPLEMENTING' AND (changed OR expired) THEN 'INTERRUPTED' WHEN state = 'VERIFIED' AND verified_hash IS DISTINCT FROM doc_hash THEN 'UNDER_REVIEW' WHEN state = 'APPROVED' AND changed THEN 'UNDER_REVIEW' ELSE state END AS effective,
  CASE WHEN coalesce(doc_hash, '') = '' THEN 'DOC_UNAVAILABLE' WHEN state = 'IMPLEMENTING' AND changed THEN 'DOC_CHANGED' WHEN state = 'IMPLEMENTING' AND expired THEN 'LEASE_EXPIRED' WHEN state = 'VERIFIED' AND verified_hash IS DISTINCT FROM doc_hash OR state = 'APPROVED' AND changed THEN 'DOC_CHANGED' ELSE '-' END AS reason FROM e""")
def effective_states(spark, sf):
    """Governed documents as they stand on the day of the cut: changed, gone, or with a lease that has run out."""
    after, reason = V.effective_state(F.col("state"), F.col("doc_hash"), F.col("verified_hash"), F.col("approved_hash"), F.col("lease_ends"), F.lit(DAY).cast("timestamp_ntz"))
    return _governed(spark, sf).select("id", "state", after.alias("effective"), F.coalesce(reason, F.lit("-")).alias("reason"))


@query(_DOCS + """, a AS (SELECT *, unnest([left(id, 8), 'other']) AS asked FROM d) SELECT id, asked, CASE WHEN state = 'INTERRUPTED' THEN 'LEASE_EXPIRED' WHEN state <> 'IMPLEMENTING' OR asked <> left(id, 8) THEN 'STALE_FENCING_TOKEN' ELSE '-' END AS error FROM a""")
def fencing_check(spark, sf):
    """Whether the holder of a lease, and one with another lease, may write."""
    asked = _governed(spark, sf).select("id", "state", F.explode(F.array(F.substring("id", 1, 8), F.lit("other"))).alias("asked"))
    error = V.fence_error(F.col("state"), F.substring("id", 1, 8), F.lit(1), F.col("asked"), F.lit(1))
    return asked.select("id", "asked", F.coalesce(error, F.lit("-")).alias("error"))


_LINES = """WITH l AS (SELECT run_id || '#' || ordinal AS ref, CASE WHEN citation_kind = 'CROSS_REPO_DEPENDENCY' THEN citation_kind || ' ' || repository_id || ' -> ' || coalesce(dependency_repository_id, '') ELSE concat_ws(' ', CASE WHEN ordinal = 5 THEN 'SOME_REF' ELSE citation_kind END, repository_id, cited_path, cited_symbol) END || CASE WHEN ordinal = 1 THEN ' # noted' ELSE '' END AS line
  FROM (SELECT run_id, ordinal, any_value(citation_kind) AS citation_kind, any_value(repository_id) AS repository_id, any_value(dependency_repository_id) AS dependency_repository_id, any_value(cited_path) AS cited_path, any_value(cited_symbol) AS cited_symbol FROM spec_citations GROUP BY ALL))
"""


@query(_LINES + r""", t AS (SELECT ref, list_filter(string_split_regex(trim(regexp_replace(line, '#.*$', '')), '\s+'), lambda x: x <> '') AS t FROM l),
e AS (SELECT *, CASE WHEN len(t) < 3 OR len(t) > 4 THEN 'format' WHEN t[1] NOT IN ('EXISTING_REF','TARGET_MODIFY','TARGET_CREATE_FILE','TARGET_CREATE_SYMBOL','CROSS_REPO_DEPENDENCY','ALLOW_GLOB') THEN 'kind' WHEN t[1] = 'CROSS_REPO_DEPENDENCY' AND (len(t) <> 4 OR t[3] <> '->') THEN 'dependency'
  WHEN t[1] = 'TARGET_CREATE_SYMBOL' AND len(t) <> 4 THEN 'symbol' WHEN t[1] = 'ALLOW_GLOB' AND len(t) <> 3 THEN 'glob' WHEN t[1] <> 'CROSS_REPO_DEPENDENCY' AND (regexp_matches(t[3], '[\\:]') OR regexp_matches(t[3], '(^|/)\.{0,2}(/|$)')) THEN 'path' ELSE '-' END AS error FROM t)
SELECT ref, error, CASE WHEN error = '-' THEN t[1] ELSE '-' END AS citation_kind, CASE WHEN error = '-' AND t[1] <> 'CROSS_REPO_DEPENDENCY' THEN t[3] ELSE '-' END AS path, CASE WHEN error = '-' AND t[1] <> 'CROSS_REPO_DEPENDENCY' THEN coalesce(t[4], '-') ELSE '-' END AS symbol FROM e""")
def citation_parse(spark, sf):
    """Citation lines of plans read back into their parts, or why they cannot be."""
    c = read_table(spark, sf, "spec_citations", "run_id", "ordinal", "citation_kind", "repository_id", "dependency_repository_id", "cited_path", "cited_symbol").dropDuplicates(["run_id", "ordinal"])
    plain = F.concat_ws(" ", F.when(F.col("ordinal") == 5, "SOME_REF").otherwise(F.col("citation_kind")), "repository_id", "cited_path", "cited_symbol")
    link = F.concat("citation_kind", F.lit(" "), "repository_id", F.lit(" -> "), F.coalesce("dependency_repository_id", F.lit("")))
    line = F.concat(F.when(F.col("citation_kind") == "CROSS_REPO_DEPENDENCY", link).otherwise(plain), F.when(F.col("ordinal") == 1, " # noted").otherwise(""))
    parts = V.parse_citation(F.col("line"))
    return c.select(F.concat_ws("#", "run_id", "ordinal").alias("ref"), line.alias("line")).select("ref", *[F.coalesce(parts[k], F.lit("-")).alias(k) for k in ("error", "citation_kind", "path", "symbol")])


@query("""WITH c AS (SELECT run_id, ordinal, any_value(cited_path) AS p, any_value(start_line) AS a, any_value(end_line) AS d FROM spec_citations GROUP BY ALL)
SELECT run_id AS source, CASE WHEN ordinal % 3 = 1 THEN 'moved/' || p ELSE p END AS path, CASE WHEN ordinal % 3 = 1 THEN p ELSE '-' END AS orig_path, CASE WHEN a IS NULL OR d IS NULL THEN 0 ELSE a END::BIGINT AS added, CASE WHEN a IS NULL OR d IS NULL THEN 0 ELSE d END::BIGINT AS deleted, a IS NULL OR d IS NULL AS is_binary FROM c WHERE p IS NOT NULL""")
def numstat_parse(spark, sf):
    """Version-control output written from the citations of each run, and read back: renames and binary files included."""
    c = read_table(spark, sf, "spec_citations", "run_id", "ordinal", "cited_path", "start_line", "end_line").where("cited_path IS NOT NULL").dropDuplicates(["run_id", "ordinal"])
    known = F.col("start_line").isNotNull() & F.col("end_line").isNotNull()
    counts = F.when(known, F.concat_ws("\t", "start_line", "end_line")).otherwise("-\t-")
    token = F.concat(counts, F.lit("\t"), F.when(F.col("ordinal") % 3 == 1, F.concat(F.lit("\0"), "cited_path", F.lit("\0moved/"), "cited_path")).otherwise(F.col("cited_path")), F.lit("\0"))
    outputs = c.groupBy(F.col("run_id").alias("source")).agg(F.array_join(F.collect_list(token), "").alias("text"))  # the citations of one plan, 500 at most
    return V.parse_changes(outputs, "numstat").select("source", "path", F.coalesce("orig_path", F.lit("-")).alias("orig_path"), "added", "deleted", "is_binary")


@query(BASE + r""", ch AS (SELECT id, repository_id, path, size_bytes // 40 AS n_lines FROM newest WHERE received_at >= TIMESTAMP '2025-09-01'),
r AS (SELECT DISTINCT repository_id, replace('^' || replace(replace(replace(replace(replace(replace(cited_path, '.', '\.'), '**/', chr(1)), '**', chr(2)), '*', '[^/]*'), '?', '[^/]'), chr(1), '(.*/)?') || '$', chr(2), '.*') AS re FROM spec_citations WHERE citation_kind = 'ALLOW_GLOB' AND cited_path IS NOT NULL),
u AS (SELECT *, NOT EXISTS (SELECT 1 FROM r WHERE r.repository_id = ch.repository_id AND regexp_matches(ch.path, r.re)) AS uncovered FROM ch)
SELECT repository_id, count(*) FILTER (uncovered) AS n_uncovered, coalesce(sum(n_lines) FILTER (uncovered), 0)::BIGINT AS n_lines, count(*) FILTER (uncovered) <= 10 AND coalesce(sum(n_lines) FILTER (uncovered), 0) <= 400 AS allowed FROM u GROUP BY 1""")
def change_limits(spark, sf):
    """Per repository what changed since the cut outside all plans, and whether that stays within ten files and four hundred lines."""
    o = latest(spark, sf, "received_at", "size_bytes").where(~_before("received_at")).select("id", "repository_id", "path", F.expr("size_bytes div 40").alias("n_lines"))
    globs = read_table(spark, sf, "spec_citations", "repository_id", "citation_kind", "cited_path").where("citation_kind = 'ALLOW_GLOB' AND cited_path IS NOT NULL").select("repository_id", F.col("cited_path").alias("glob")).distinct()
    return V.change_limits(o, glob_covered(o, globs), ["repository_id"], 10, 400)
