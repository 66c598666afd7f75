"""File events: coalescing in batch and as a stream, with rename pairing and a capacity bound."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

QUIET = "30 minutes"
#: Pending paths of a key beyond which events are shed and a rescan is due.
CAPACITY = 8192
#: Bursts of events that are folded in one group.
BURSTS = 512


def _operation(first: Column, last: Column) -> Column:
    """What a window of events of one path comes to: nothing if it was created and removed in it, else Remove or Upsert by the last event."""
    return F.when((first == "Created") & (last == "Removed"), None).when(last == "Removed", "Remove").otherwise("Upsert")


def coalesce_sessions(events: DataFrame, quiet: str = QUIET) -> DataFrame:
    """``path, session_start, session_end, op, n_events`` of events ``path, kind, ts, event_id``: one operation per path and run of events with no gap longer than ``quiet``.

    Works on batch and streaming DataFrames alike: first and last event are
    aggregates, so no group is collected.
    """
    order = F.struct("ts", "event_id")
    grouped = events.groupBy("path", F.session_window("ts", quiet).alias("w")).agg(F.min_by("kind", order).alias("first"), F.max_by("kind", order).alias("last"), F.count("*").alias("n_events"))
    return grouped.select("path", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), _operation(F.col("first"), F.col("last")).alias("op"), "n_events").where(F.col("op").isNotNull())


def coalesce_stream(events: DataFrame, quiet: str = QUIET, delay: str = "10 minutes") -> DataFrame:
    """As coalesce_sessions, for a stream: a session is emitted once the watermark is past its end."""
    return coalesce_sessions(events.withWatermark("ts", delay), quiet)


class Coalescer:
    """Pending events of one repository; see fold."""

    def __init__(self, quiet_ms: int, capacity: int = CAPACITY, state: dict | None = None):
        self.quiet, self.capacity = quiet_ms, capacity
        state = state or {}
        self.pending: dict = state.get("pending", {})
        self.renames: list = state.get("renames", [])
        self.overflowed: bool = state.get("overflowed", False)

    def state(self) -> dict:
        return {"pending": self.pending, "renames": self.renames, "overflowed": self.overflowed}

    def _touch(self, path: str, kind: str, at: int, source: str | None = None) -> None:
        entry = self.pending.get(path)
        if entry is None:
            if len(self.pending) + len(self.renames) >= self.capacity:
                self.overflowed = True
                return
            entry = self.pending[path] = {"first": kind, "last": kind, "seen": at, "source": source}
        entry["last"], entry["seen"] = kind, at
        if source:
            entry["source"] = source

    def fold(self, path: str, kind: str, at: int) -> None:
        """Takes one event, in order of time. A RenamedTo pairs with the oldest RenamedFrom of the last four quiet periods."""
        self.renames, late = [r for r in self.renames if at - r[1] <= 4 * self.quiet], [r for r in self.renames if at - r[1] > 4 * self.quiet]
        for old, seen in late:
            self._touch(old, "Removed", seen)
        if kind == "RenamedFrom":
            if len(self.pending) + len(self.renames) >= self.capacity and path not in self.pending:
                self.overflowed = True
            else:
                self.pending.pop(path, None)
                self.renames.append([path, at])
        elif kind == "RenamedTo":
            if self.renames:
                self._touch(path, "Renamed", at, self.renames.pop(0)[0])
            else:
                self._touch(path, "Created" if path not in self.pending else "Modified", at)
        elif kind in ("Created", "Modified", "Removed"):
            self._touch(path, kind, at)

    def drain(self, now: int) -> list[tuple]:
        """(op, path, new_path) of the paths that have been quiet, in the order of their paths."""
        for old, seen in [r for r in self.renames if now - r[1] > 4 * self.quiet]:
            self._touch(old, "Removed", seen)
        self.renames = [r for r in self.renames if now - r[1] <= 4 * self.quiet]
        out = []
        for path in sorted(p for p, e in self.pending.items() if now - e["seen"] >= self.quiet):
            e = self.pending.pop(path)
            if e["source"] and e["last"] != "Removed":
                out.append(("Rename", e["source"], path) if e["last"] in ("Renamed", "Modified") else ("Upsert", path, None))
                if out[-1][0] == "Upsert":
                    out.append(("Remove", e["source"], None))
            elif e["source"]:
                out += [("Remove", e["source"], None), ("Remove", path, None)]
            elif e["last"] == "Removed":
                if e["first"] != "Created":
                    out.append(("Remove", path, None))
            else:
                out.append(("Upsert", path, None))
        return out


CHANGE = "repository_id string, op string, path string, new_path string, overflowed boolean"


def coalesce_renames(events: DataFrame, quiet_ms: int, capacity: int = CAPACITY) -> DataFrame:
    """Stateful coalescing of a stream ``repository_id, path, kind, at_ms`` with rename pairing across paths, keyed by repository; the state is bounded by ``capacity``."""

    def update(key, batches: Iterator[pd.DataFrame], state):
        held = Coalescer(quiet_ms, capacity, json.loads(state.get[0]) if state.exists else None)
        rows = pd.concat(list(batches)).sort_values(["at_ms", "path"], kind="stable") if not state.hasTimedOut else pd.DataFrame()
        out, now = [], 0
        for path, kind, at in zip(rows.get("path", []), rows.get("kind", []), rows.get("at_ms", [])):
            out += held.drain(int(at))
            held.fold(path, kind, int(at))
            now = int(at)
        if state.hasTimedOut:
            out += held.drain(1 << 62)
            state.remove()
        else:
            out += held.drain(now)
            state.update((json.dumps(held.state()),))
            state.setTimeoutDuration(max(1, quiet_ms))
        yield pd.DataFrame([(key[0], *change, held.overflowed) for change in out], columns=[c.split()[0] for c in CHANGE.split(", ")])

    return events.groupBy("repository_id").applyInPandasWithState(update, CHANGE, "held string", "append", "ProcessingTimeTimeout")


def coalesce_bursts(events: DataFrame, quiet_ms: int, capacity: int = CAPACITY) -> DataFrame:
    """As coalesce_renames, over a finished log: each repository's events are cut into bursts at gaps of more than five quiet periods.

    Nothing is pending across such a gap (a rename waits four quiet periods at
    most), so bursts are folded apart, and a busy repository is many tasks.
    """
    order = W.partitionBy("repository_id").orderBy("at_ms", "path")
    gap = F.coalesce((F.col("at_ms") - F.lag("at_ms").over(order) > 5 * quiet_ms).cast("int"), F.lit(1))
    cut = events.withColumn("_gap", gap).withColumn("_burst", F.sum("_gap").over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("burst", F.expr(f"_burst div {BURSTS}"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        held, out = Coalescer(quiet_ms, capacity), []
        rows = pdf.sort_values(["at_ms", "path"], kind="stable")
        for path, kind, at in zip(rows["path"], rows["kind"], rows["at_ms"]):
            out += held.drain(int(at))
            held.fold(path, kind, int(at))
        out += held.drain(1 << 62)
        return pd.DataFrame([(pdf["repository_id"].iloc[0], *change, held.overflowed) for change in out], columns=[c.split()[0] for c in CHANGE.split(", ")])

    return cut.groupBy("repository_id", "burst").applyInPandas(fold, CHANGE)


def overflow(events: DataFrame, quiet: str, capacity: int) -> DataFrame:
    """``session_window start, n_paths, overflowed`` per tumbling window: whether more paths were touched than may be pending."""
    counted = events.groupBy(F.window("ts", quiet).alias("w")).agg(F.approx_count_distinct("path").alias("n_paths")) if events.isStreaming else events.groupBy(F.window("ts", quiet).alias("w")).agg(F.count_distinct("path").alias("n_paths"))
    return counted.select(F.col("w.start").alias("window_start"), "n_paths", (F.col("n_paths") > capacity).alias("overflowed"))
