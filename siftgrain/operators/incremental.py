"""Keeping an index in step with its files: event gate, verified hints, audits, restoring, tasks, and re-indexing what changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Files that change what discovery sees, wherever they lie.
POLICY_FILES = (".gitignore",)
#: Seconds after which a running task counts as stuck, and days that finished ones are kept (fixed values).
STUCK_SECONDS = 3600
TERMINAL_DAYS = 30


def is_blocked(path: Column) -> Column:
    """Whether an event's path is never to be read: empty, inside ``.git``, absolute, leading upwards, or with a colon or NUL."""
    plain = F.regexp_replace(path, r"^(\./)+", "")
    return (plain == "") | (plain == ".git") | plain.startswith(".git/") | plain.startswith("/") | plain.contains("..") | plain.contains(":") | plain.contains("\u0000")


def is_policy_input(path: Column, names: tuple[str, ...] = POLICY_FILES) -> Column:
    """Whether a change of this file changes the discovery policy."""
    return F.element_at(F.split(path, "/"), -1).isin(*names)


def gate_events(events: DataFrame, priority: Column) -> DataFrame:
    """The events whose path may be read and is not ignored, with ``rel_path`` normalised, and ``policy_input``; works on streams as well."""
    clean = F.regexp_replace(F.regexp_replace("path", r"\\", "/"), r"^(\./)+", "")
    return events.where(F.col("path").isNotNull() & ~is_blocked(F.col("path")) & (priority != "ignored")).withColumn("rel_path", clean).withColumn("policy_input", is_policy_input(F.col("rel_path")))


def verify_hints(hints: DataFrame, known: DataFrame, reads: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, verdict``: what each hinted path comes to: ``added``, ``modified``, ``deleted``, ``unchanged``, ``unknown_path`` or ``uncertain``.

    ``known`` has the indexed ``content_hash``, ``reads`` the disk's ``state``
    (``present`` with ``content_hash``, ``missing``, ``uncertain``). Only a file
    that is verified to be missing counts as deleted; a path without any read is
    missing; several hints of a path are one.
    """
    asked = hints.select(*keys).distinct()
    joined = asked.join(known.select(*keys, F.col("content_hash").alias("_was"), F.lit(True).alias("_indexed")), keys, "left").join(reads.select(*keys, "state", F.col("content_hash").alias("_is")), keys, "left")
    state = F.coalesce("state", F.lit("missing"))
    indexed = F.coalesce("_indexed", F.lit(False))
    verdict = (
        F.when(state == "uncertain", "uncertain").when(state == "missing", F.when(indexed, "deleted").otherwise("unknown_path"))
        .when(~indexed, "added").when(F.col("_was").eqNullSafe(F.col("_is")), "unchanged").otherwise("modified")
    )
    return joined.select(*keys, verdict.alias("verdict"))


def after_verdict(freshness: Column, verdict: Column) -> Column:
    """The freshness of an indexed file after its hint was verified: restored without recomputing where the content is the same, unknown where it could not be read."""
    return F.when(verdict == "uncertain", "UNKNOWN").when(verdict == "unchanged", "CURRENT").when(verdict == "deleted", "INVALID").when(verdict == "modified", "PENDING_REFRESH").otherwise(freshness)


def close_audit(audit: DataFrame, recomputed: DataFrame, keys: list[str]) -> DataFrame:
    """``audit`` with ``closed_at``: the first recomputation of the same entity after the invalidation, null while it is open."""
    later = audit.select(*keys, "invalidated_at").join(recomputed.select(*keys, "recomputed_at"), keys).where(F.col("recomputed_at") > F.col("invalidated_at"))
    closed = later.groupBy(*keys, "invalidated_at").agg(F.min("recomputed_at").alias("closed_at"))
    return audit.join(closed, [*keys, "invalidated_at"], "left")


def enqueue(pending: DataFrame, asked: DataFrame) -> DataFrame:
    """``pending`` and the tasks of ``asked`` that no pending one equals in type, repository and checkpoint; of equal ones the first by time and id.

    Nulls equal nulls. Tasks have ``task_id, task_type, repository_id, checkpoint, priority, created_at, state, retries``.
    """
    key = ["task_type", "repository_id", "checkpoint"]
    place = F.row_number().over(W.partitionBy(*key).orderBy("created_at", "task_id"))
    new = asked.withColumn("_place", place).where(F.col("_place") == 1).drop("_place")
    known = pending.where(F.col("state") == "PENDING").select(*[F.col(k).alias(f"_{k}") for k in key]).distinct()
    matches = [new[k].eqNullSafe(known[f"_{k}"]) for k in key]
    return pending.unionByName(new.join(known, matches, "left_anti"))


def claim(tasks: DataFrame, n: int, task_type: str | None = None, reserved: tuple[str, ...] = ("STALE_EVICTION",)) -> DataFrame:
    """The ``n`` pending tasks to run next: highest priority, then oldest, then least id; reserved types only if asked for by name."""
    mine = F.col("task_type") == task_type if task_type else ~F.col("task_type").isin(*reserved)
    return tasks.where((F.col("state") == "PENDING") & mine).orderBy(F.desc("priority"), "created_at", "task_id").limit(n)


def finish(tasks: DataFrame, outcomes: DataFrame, most_retries: int = 3) -> DataFrame:
    """``tasks`` after ``outcomes`` (``task_id, outcome``): DONE, CANCELLED, or on FAILED pending again while retries are left."""
    joined = tasks.join(outcomes.select("task_id", "outcome"), "task_id", "left")
    again = F.col("retries") < most_retries
    state = F.when(F.col("outcome") == "FAILED", F.when(again, "PENDING").otherwise("FAILED")).otherwise(F.coalesce("outcome", "state"))
    return joined.withColumns({"state": state, "retries": F.col("retries") + F.when(F.col("outcome") == "FAILED", 1).otherwise(0)}).drop("outcome")


def recover(tasks: DataFrame) -> DataFrame:
    """Tasks that a crash left running are pending again, retries uncounted."""
    return tasks.withColumn("state", F.when(F.col("state") == "RUNNING", "PENDING").otherwise(F.col("state")))


def replace_parts(index: DataFrame, rebuilt: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """``index`` with the rows of ``changed`` keys replaced by ``rebuilt`` ones: an anti-join and a union, so unchanged rows are never recomputed."""
    return index.join(changed.select(key).distinct(), key, "left_anti").unionByName(rebuilt)
