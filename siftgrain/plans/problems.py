"""Queries p2 (snapshot changes) and p5 (orphan references) over the corpus tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftgrain.operators.orphans import corpus_parents, corpus_references, orphan_references, orphan_report
from siftgrain.operators.snapshots import snapshot_change_counts, snapshot_changes
from siftgrain.sources.tables import read_table


def _manifests(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return (
        read_table(spark, sf, "source_manifests", "manifest_id", "repository_id", "module_root", "captured_at"),
        read_table(spark, sf, "manifest_entries", "manifest_id", "repo_relative", "content_hash", "received_at"),
    )


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return snapshot_changes(*_manifests(spark, sf))


def p2_change_counts(spark: SparkSession, sf: str) -> DataFrame:
    return snapshot_change_counts(*_manifests(spark, sf))


def _orphans(spark: SparkSession, sf: str) -> DataFrame:
    occurrences = read_table(spark, sf, "file_occurrences", "id", "repository_id", "source_revision_id", "path", "existence_state", "occurrence_seq", "received_at")
    repositories = read_table(spark, sf, "repositories", "id", "case_sensitive")
    return orphan_references(
        corpus_references(
            read_table(spark, sf, "retrieval_units", "id", "file_occurrence_id", "received_at"),
            occurrences,
            read_table(spark, sf, "spec_citations", "run_id", "ordinal", "citation_kind", "repository_id", "cited_path", "received_at"),
            repositories,
        ),
        corpus_parents(occurrences, read_table(spark, sf, "source_revisions", "id", "received_at"), repositories),
    )


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _orphans(spark, sf).select("ref_table", "row_key", "orphan_kind")


def p5_orphan_report(spark: SparkSession, sf: str) -> DataFrame:
    return orphan_report(_orphans(spark, sf))


QUERIES = {f.__name__: f for f in (p2_found, p2_change_counts, p5_found, p5_orphan_report)}

_PATH = r"regexp_replace(regexp_replace(replace({0}, '\', '/'), '/(\./)+|/{{2,}}(\./|/)*', '/', 'g'), '^(\./|/)+', '')"
_ID = r"regexp_replace(lower(trim({0})), '^\{{|\}}$|^urn:uuid:', '', 'g')"

_CHANGES = rf"""
WITH s AS (
  SELECT manifest_id, row_number() OVER w AS idx, lead(manifest_id) OVER w AS next_id, r, m
  FROM (SELECT manifest_id, min(coalesce(repository_id, '')) AS r, min(coalesce(module_root, '')) AS m, min(captured_at) AS captured_at
        FROM source_manifests GROUP BY manifest_id)
  WINDOW w AS (PARTITION BY r, m ORDER BY captured_at, manifest_id)),
e AS (
  SELECT manifest_id, {_PATH.format("repo_relative")} AS path,
         arg_min(regexp_replace(lower(trim(content_hash)), '^[a-z0-9_-]+[:=]', ''), received_at) FILTER (content_hash IS NOT NULL) AS hash
  FROM manifest_entries WHERE repo_relative IS NOT NULL GROUP BY 1, 2),
k AS (
  SELECT s.r, s.m, s.idx, s.next_id, e.manifest_id, e.path, e.hash,
         idx - row_number() OVER (PARTITION BY s.r, s.m, e.path ORDER BY s.idx) AS run FROM e JOIN s USING (manifest_id)),
v AS (
  SELECT *, last_value(hash IGNORE NULLS) OVER w AS known, row_number() OVER w AS nth, lead(idx) OVER w IS NULL AS ends
  FROM k WINDOW w AS (PARTITION BY r, m, path, run ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
x AS (SELECT *, lag(known) OVER (PARTITION BY r, m, path, run ORDER BY idx) AS before FROM v),
changes AS (
  SELECT manifest_id, path AS repo_relative, 'added' AS change_kind FROM x WHERE nth = 1 AND idx > 1
  UNION ALL SELECT manifest_id, path, 'changed' FROM x WHERE nth > 1 AND known <> before
  UNION ALL SELECT next_id, path, 'removed' FROM x WHERE ends AND next_id IS NOT NULL)
"""

_ORPHANS = rf"""
WITH repos AS (SELECT {_ID.format("id")} AS repo, bool_or(case_sensitive) AS sensitive FROM repositories GROUP BY 1),
o AS (
  SELECT *, {_ID.format("repository_id")} || chr(10) || CASE WHEN coalesce(sensitive, true) THEN p ELSE lower(p) END AS path_key
  FROM (SELECT *, {_PATH.format("path")} AS p FROM file_occurrences) LEFT JOIN repos ON repo = {_ID.format("repository_id")}),
refs AS (
  SELECT ref_table, row_key, key, min(received_at) AS ref_first FROM (
    SELECT 'retrieval_units' AS ref_table, id AS row_key, {_ID.format("file_occurrence_id")} AS key, received_at FROM retrieval_units
    UNION ALL SELECT 'file_occurrences', id, {_ID.format("source_revision_id")}, received_at FROM file_occurrences
    UNION ALL SELECT 'spec_citations', run_id || '#' || ordinal,
      {_ID.format("repository_id")} || chr(10) || CASE WHEN coalesce(sensitive, true) THEN p ELSE lower(p) END, received_at
      FROM (SELECT *, {_PATH.format("cited_path")} AS p FROM spec_citations WHERE citation_kind IN ('EXISTING_REF', 'TARGET_MODIFY'))
      LEFT JOIN repos ON repo = {_ID.format("repository_id")})
  WHERE key IS NOT NULL GROUP BY ALL),
parents AS (
  SELECT 'retrieval_units' AS ref_table, {_ID.format("id")} AS key, min(received_at) AS parent_first, bool_or(existence_state = 'deleted') AS gone FROM file_occurrences GROUP BY 2
  UNION ALL SELECT 'file_occurrences', {_ID.format("id")}, min(received_at), false FROM source_revisions GROUP BY 2
  UNION ALL SELECT 'spec_citations', path_key, min(received_at), arg_max(existence_state = 'deleted', occurrence_seq) FROM o WHERE path IS NOT NULL GROUP BY 2),
orphans AS (
  SELECT ref_table, row_key, ref_first,
         CASE WHEN p.key IS NULL THEN 'missing' WHEN gone THEN 'deleted' WHEN parent_first > ref_first THEN 'late' END AS orphan_kind
  FROM refs r LEFT JOIN parents p USING (ref_table, key))
"""

SQL = {
    "p2_found": _CHANGES + "SELECT * FROM changes",
    "p2_change_counts": _CHANGES
    + """SELECT manifest_id, count(*) FILTER (change_kind = 'added') AS added, count(*) FILTER (change_kind = 'removed') AS removed,
         count(*) FILTER (change_kind = 'changed') AS changed FROM changes GROUP BY 1""",
    "p5_found": _ORPHANS + "SELECT ref_table, row_key, orphan_kind FROM orphans WHERE orphan_kind IS NOT NULL",
    "p5_orphan_report": _ORPHANS
    + "SELECT ref_table, strftime(ref_first, '%Y-%m') AS month, orphan_kind, count(*) AS n_orphans FROM orphans WHERE orphan_kind IS NOT NULL GROUP BY ALL",
}
