"""Governed changes: citations of plans, state machine, effective state, fencing, version-control output, and limits of a change."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATES = ("UNDER_REVIEW", "VERIFIED", "APPROVED", "IMPLEMENTING", "INTERRUPTED", "IMPLEMENTED", "DRIFTED", "ABANDONED")
OPERATIONS = ("register", "verify_pass", "verify_fail", "approve", "begin", "heartbeat", "wave_complete", "resume", "drift_pass", "drift_fail", "reopen", "abandon")
#: (states, operations, state after) of the legal transitions (fixed values).
TRANSITIONS = [
    (("ABANDONED",), ("register",), "UNDER_REVIEW"),
    (("UNDER_REVIEW", "VERIFIED"), ("verify_pass",), "VERIFIED"),
    (("APPROVED",), ("verify_pass",), "APPROVED"),
    (("UNDER_REVIEW", "VERIFIED", "APPROVED"), ("verify_fail",), "UNDER_REVIEW"),
    (("VERIFIED",), ("approve",), "APPROVED"),
    (("APPROVED",), ("begin",), "IMPLEMENTING"),
    (("INTERRUPTED",), ("resume",), "IMPLEMENTING"),
    (("IMPLEMENTING",), ("heartbeat", "wave_complete"), "IMPLEMENTING"),
    (("IMPLEMENTING", "IMPLEMENTED", "DRIFTED"), ("drift_pass",), "IMPLEMENTED"),
    (("IMPLEMENTING", "IMPLEMENTED", "DRIFTED"), ("drift_fail",), "DRIFTED"),
    (("UNDER_REVIEW", "APPROVED", "IMPLEMENTING", "INTERRUPTED", "IMPLEMENTED", "DRIFTED"), ("reopen",), "UNDER_REVIEW"),
]
#: Kinds of citation (fixed values).
KINDS = ("EXISTING_REF", "TARGET_MODIFY", "TARGET_CREATE_FILE", "TARGET_CREATE_SYMBOL", "CROSS_REPO_DEPENDENCY", "ALLOW_GLOB")


def transition(state: Column, operation: Column) -> Column:
    """The state after an operation, null where it is not allowed. Registering again changes nothing, abandoning is always allowed."""
    out = F.when(operation == "abandon", "ABANDONED")
    for before, operations, after in TRANSITIONS:
        out = out.when(state.isin(*before) & operation.isin(*operations), after)
    return out.when(operation == "register", state)


def effective_state(state: Column, document_hash: Column, verified_hash: Column, approved_hash: Column, lease_ends: Column, now: Column) -> tuple[Column, Column]:
    """(state, reason) as it holds now: a document that is gone or changed, or a lease that has run out, undoes what rested on it."""
    gone = document_hash.isNull() | (document_hash == "")
    changed = F.coalesce(approved_hash != document_hash, F.lit(False))
    expired = lease_ends.isNull() | (now >= lease_ends)
    after = (
        F.when(gone, F.when(state == "IMPLEMENTING", "INTERRUPTED").when(state.isin("APPROVED", "VERIFIED"), "UNDER_REVIEW").when(state == "IMPLEMENTED", "DRIFTED").otherwise(state))
        .when((state == "IMPLEMENTING") & (changed | expired), "INTERRUPTED").when((state == "VERIFIED") & ~verified_hash.eqNullSafe(document_hash), "UNDER_REVIEW")
        .when((state == "APPROVED") & changed, "UNDER_REVIEW").otherwise(state)
    )
    reason = F.when(gone, "DOC_UNAVAILABLE").when((state == "IMPLEMENTING") & changed, "DOC_CHANGED").when((state == "IMPLEMENTING") & expired, "LEASE_EXPIRED").when(after != state, "DOC_CHANGED")
    return after, reason


def fence_error(state: Column, lease: Column, token: Column, asked_lease: Column, asked_token: Column) -> Column:
    """Why a holder may not write: its lease has expired, or lease or token are not the current ones; null if it may."""
    held = (state == "IMPLEMENTING") & lease.eqNullSafe(asked_lease) & token.eqNullSafe(asked_token) & lease.isNotNull()
    return F.when(state == "INTERRUPTED", "LEASE_EXPIRED").when(~held, "STALE_FENCING_TOKEN")


def parse_citation(line: Column) -> dict[str, Column]:
    """``citation_kind, repository, path, symbol, dependency, error`` of one line ``KIND repository path [symbol]`` or ``CROSS_REPO_DEPENDENCY consumer -> provider``; all null for blank lines and comments."""
    plain = F.trim(F.regexp_replace(line, "#.*$", ""))
    t = F.filter(F.split(plain, r"\s+"), lambda x: x != "")
    at = lambda i: F.get(t, i)
    n, kind = F.size(t), at(0)
    link = kind == "CROSS_REPO_DEPENDENCY"
    bad_path = at(2).rlike(r"[\\:\x00]") | at(2).rlike(r"(^|/)\.{0,2}(/|$)")
    error = (
        F.when(n == 0, None).when((n < 3) | (n > 4), "format").when(~kind.isin(*KINDS), "kind").when(link & ((n != 4) | (at(2) != "->")), "dependency")
        .when((kind == "TARGET_CREATE_SYMBOL") & (n != 4), "symbol").when((kind == "ALLOW_GLOB") & (n != 3), "glob").when(~link & bad_path, "path")
    )
    ok = error.isNull() & (n > 0)
    return {
        "citation_kind": F.when(ok, kind), "repository": F.when(ok, at(1)), "path": F.when(ok & ~link, at(2)), "symbol": F.when(ok & ~link, at(3)), "dependency": F.when(ok & link, at(3)), "error": error,
    }


def citation_blocks(documents: DataFrame, name: str) -> DataFrame:
    """``doc_id, line_no, line, error`` of the lines in each document's one fenced block of that name; ``error`` where there is none, an open one, or several (then the line is null)."""
    fence = rf"(?m)^[ \t]*(?:```+|~~~+){name}[ \t]*$"
    whole = rf"(?ms)^[ \t]*(```+|~~~+){name}[ \t]*$\n(.*?)^[ \t]*\1[ \t]*$"
    opened = F.size(F.regexp_extract_all("text", F.lit(fence), F.lit(0)))
    seen = documents.select("doc_id", "text", opened.alias("n"), F.size(F.regexp_extract_all("text", F.lit(whole), F.lit(0))).alias("closed"))
    error = F.when(F.col("n") == 0, "no block").when(F.col("n") > 1, "several blocks").when(F.col("closed") != 1, "open block")
    lines = F.when(error.isNull(), F.split(F.regexp_extract("text", whole, 2), "\n")).otherwise(F.array(F.lit(None).cast("string")))
    return seen.select("doc_id", error.alias("error"), F.posexplode(lines).alias("at", "line")).select("doc_id", (F.col("at") + 1).alias("line_no"), "line", "error")


CHANGE = "source string, path string, orig_path string, added bigint, deleted bigint, is_binary boolean, error string"


def _status(text: str):
    parts = text.split("\0")
    if parts.pop():
        raise ValueError("no final NUL")
    i = 0
    while i < len(parts):
        token = parts[i]
        i += 1
        if len(token) < 4 or token[2] != " ":
            raise ValueError("status")
        old = None
        if set(token[:2]) & {"R", "C"}:
            if i >= len(parts) or not parts[i]:
                raise ValueError("rename")
            old, i = parts[i], i + 1
        yield token[3:], old, 0, 0, False


def _numstat(text: str):
    parts = text.split("\0")
    if parts.pop():
        raise ValueError("no final NUL")
    i = 0
    while i < len(parts):
        added, deleted, path = parts[i].split("\t", 2)
        i += 1
        old = None
        if not path:
            if i + 1 >= len(parts) or not parts[i] or not parts[i + 1]:
                raise ValueError("rename")
            old, path, i = parts[i], parts[i + 1], i + 2
        binary = added == deleted == "-"
        yield path, old, 0 if binary else int(added), 0 if binary else int(deleted), binary


def parse_changes(outputs: DataFrame, form: str) -> DataFrame:
    """``source, path, orig_path, added, deleted, is_binary, error`` of NUL-separated version-control output (``source, text``); ``form`` is ``status`` or ``numstat``. Output that cannot be read gives one row with ``error``, never part of it."""
    reader = {"status": _status, "numstat": _numstat}[form]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for source, text in zip(pdf["source"], pdf["text"]):
                try:
                    rows += [(source, *change, None) for change in reader(text or "")]
                except ValueError as error:
                    rows = [r for r in rows if r[0] != source] + [(source, None, None, None, None, None, str(error))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CHANGE.split(", ")]).astype({"added": "Int64", "deleted": "Int64", "is_binary": "boolean"})

    return outputs.select("source", "text").mapInPandas(read, CHANGE)


def change_limits(changes: DataFrame, covered: DataFrame, by: list[str], most_files: int, most_lines: int) -> DataFrame:
    """``by, n_uncovered, n_lines, allowed``: of each group's changes (``by, id, n_lines``) those that no plan covers (``id``), and whether they stay within the limits."""
    open_ = changes.join(covered.select("id").distinct(), "id", "left_anti").groupBy(*by).agg(F.count("*").alias("n_uncovered"), F.sum("n_lines").alias("n_lines"))
    both = changes.select(*by).distinct().join(open_, by, "left").select(*by, F.coalesce("n_uncovered", F.lit(0)).alias("n_uncovered"), F.coalesce("n_lines", F.lit(0)).alias("n_lines"))
    return both.withColumn("allowed", (F.col("n_uncovered") <= most_files) & (F.col("n_lines") <= most_lines))
