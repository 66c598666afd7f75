"""The corpus's relations with redelivered rows folded and ids in one spelling, in Spark and as SQL views."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftgrain.functions.keys import norm_id
from siftgrain.session import checkpoint_dir
from siftgrain.sources.tables import read_table


def folded(df: DataFrame, *key: str) -> DataFrame:
    """One row per key, the earliest ``received_at``; copies are equal in all other columns."""
    rest = [c for c in df.columns if c not in key and c != "received_at"]
    times = [F.min("received_at").alias("received_at")] if "received_at" in df.columns else []
    return df.groupBy(*key).agg(*[F.first(c).alias(c) for c in rest], *times)


def occurrences(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return folded(read_table(spark, sf, "file_occurrences", "id", *columns), "id")


def latest(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """The newest version of each path of each repository."""
    needed = dict.fromkeys(("repository_id", "path", "occurrence_seq", "existence_state", "freshness_state", *columns))
    rows = occurrences(spark, sf, *needed)
    newest = rows.groupBy("repository_id", "path").agg(F.max_by(F.struct("id", *[c for c in needed if c not in ("repository_id", "path")]), "occurrence_seq").alias("newest"))
    return newest.select("repository_id", "path", "newest.*")


def units(spark: SparkSession, sf: str) -> DataFrame:
    """Units that may be served: ``unit_id, repository_id, path, text, freshness_state``; of present files, not INVALID or UNKNOWN."""
    text = folded(read_table(spark, sf, "retrieval_units", "id", "repository_id", "file_occurrence_id", "retrieval_text", "freshness_state"), "id")
    files = occurrences(spark, sf, "path", "existence_state").select(F.col("id").alias("occurrence_id"), "path", "existence_state")
    seen = text.where(~F.col("freshness_state").isin("INVALID", "UNKNOWN")).withColumn("occurrence_id", norm_id(F.col("file_occurrence_id")))
    return seen.join(files.where("existence_state <> 'deleted'"), "occurrence_id").select(F.col("id").alias("unit_id"), "repository_id", "path", F.col("retrieval_text").alias("text"), "freshness_state", "occurrence_id")


_INDEXES: dict[tuple[str, str], str] = {}


def index_of(spark: SparkSession, sf: str) -> str:
    """The folder of the search index of the served units, built once per application and set of tables in the shared folder."""
    from siftgrain.operators import index

    key = (spark.sparkContext.applicationId, sf)
    if key not in _INDEXES:
        folder = f"{checkpoint_dir(spark)}/index-{uuid.uuid4()}"
        index.build(units(spark, sf), folder)
        _INDEXES[key] = folder
    return _INDEXES[key]


BASE = r"""
WITH occ AS (
  SELECT id, any_value(repository_id) AS repository_id, any_value(source_revision_id) AS source_revision_id, any_value(path) AS path, any_value(content_hash) AS content_hash,
         any_value(size_bytes) AS size_bytes, any_value(language) AS language, any_value(file_type) AS file_type, any_value(security_state) AS security_state, any_value(occurrence_seq) AS occurrence_seq,
         any_value(existence_state) AS existence_state, any_value(freshness_state) AS freshness_state, any_value(file_identity_id) AS file_identity_id, min(received_at) AS received_at
  FROM file_occurrences GROUP BY id),
newest AS (SELECT * FROM occ QUALIFY row_number() OVER (PARTITION BY repository_id, path ORDER BY occurrence_seq DESC) = 1),
un AS (
  SELECT id, any_value(repository_id) AS repository_id, regexp_replace(lower(trim(any_value(file_occurrence_id))), '^\{|\}$|^urn:uuid:', '', 'g') AS occurrence_id,
         any_value(retrieval_text) AS text, any_value(freshness_state) AS freshness_state, any_value(start_line) AS start_line, any_value(end_line) AS end_line
  FROM retrieval_units GROUP BY id),
units AS (
  SELECT un.id AS unit_id, un.repository_id, path, text, un.freshness_state, occurrence_id FROM un JOIN occ ON occ.id = occurrence_id
  WHERE un.freshness_state NOT IN ('INVALID', 'UNKNOWN') AND existence_state <> 'deleted')
"""


#: The kind of a path, stated once more for SQL.
KIND = r"""CASE WHEN regexp_matches(lower(path), '(^|/)knowledge/') THEN 'KNOWLEDGE'
  WHEN regexp_matches(lower(path), '/tests/|/test/|__tests__/|_test\.go|test_|_test\.py|test\.py|test\.java|\.test\.ts|\.test\.js|\.spec\.ts|\.spec\.js|test\.rs') THEN 'TEST'
  WHEN regexp_matches(lower(path), '\.(yml|yaml|toml|ini|properties|env|cfg|conf|xml)$') AND NOT regexp_matches(lower(path), '(^|/)pom\.xml[^/]*$') OR regexp_matches(lower(path), '(^|/)(package\.json|go\.mod)$') THEN 'CONFIGURATION'
  WHEN regexp_matches(lower(path), '\.(md|rst|txt|adoc)$|(^|/)(license|licence|notice|copying|copyright)$') THEN 'DOCUMENTATION' WHEN regexp_matches(lower(path), '\.json$') THEN 'CONFIGURATION' ELSE 'SOURCE_CODE' END"""
