"""What changed between consecutive full snapshots of the same series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftgrain.functions.keys import norm_hash, norm_path

#: A key that is present, but whose value was never read since it appeared.
UNKNOWN = b""


def _packed(digest: Column) -> Column:
    """A digest in half its bytes for the shuffles: hexadecimal as bytes, anything else as itself behind a zero byte. Equal for equal digests only."""
    return F.when(digest.rlike("^([0-9a-f][0-9a-f])+$"), F.concat(F.lit(b"\x01"), F.unhex(digest))).otherwise(F.concat(F.lit(b"\x00"), F.encode(digest, "UTF-8")))


def index_snapshots(manifests: DataFrame) -> DataFrame:
    """One row per snapshot: ``manifest_id``, ``series`` and ``idx`` (from 1, by capture time, then id).

    ``manifests`` needs ``manifest_id, repository_id, module_root, captured_at``.
    Redelivered rows count once. A snapshot without an id is ignored; null
    repository or module root is a series of its own. An empty table gives an
    empty result.
    """
    one = (
        manifests.where(F.col("manifest_id").isNotNull())
        .groupBy("manifest_id")
        .agg(F.min(F.struct(F.coalesce("repository_id", F.lit("")).alias("r"), F.coalesce("module_root", F.lit("")).alias("m"), "captured_at")).alias("s"))
        .select("manifest_id", F.struct("s.r", "s.m").alias("series"), F.col("s.captured_at").alias("captured_at"))
    )
    order = W.partitionBy("series").orderBy("captured_at", "manifest_id")
    return one.select("manifest_id", "series", F.row_number().over(order).alias("idx"))


def snapshot_changes(manifests: DataFrame, entries: DataFrame) -> DataFrame:
    """Rows ``manifest_id, repo_relative, change_kind`` (added, removed, changed) against the snapshot just before in the series.

    Each key is windowed by snapshot index: a lagged hash that differs is a
    change, an index gap is a removal and a later addition. Copies are folded
    with map-side combining before anything is shuffled, so an entry delivered
    very often is one row per input partition; all window functions share one
    shuffle by (series, path). The window of a key holds one row per snapshot,
    whatever the number of keys, so a hot series is spread over its paths.

    Defined cases: copies and several spellings of a path in one snapshot are
    one entry (the earliest delivery with a hash decides); a null hash is
    present and keeps the hash of the snapshot before, or is unknown and equal
    to anything if the key just appeared; entries of unknown snapshots and null
    paths are ignored; a snapshot without entries removes all keys of the one
    before; the first of a series yields nothing. Extra columns are ignored.
    """
    series = index_snapshots(manifests)
    entry = (
        entries.where(F.col("repo_relative").isNotNull() & F.col("manifest_id").isNotNull())
        .select("manifest_id", norm_path(F.col("repo_relative")).alias("path"), _packed(norm_hash(F.col("content_hash"))).alias("hash"), "received_at")
        .groupBy("manifest_id", "path")
        .agg(F.min(F.when(F.col("hash").isNotNull(), F.struct("received_at", "hash"))).getField("hash").alias("hash"))
    )
    one = entry.join(series, "manifest_id").select("series", "path", "idx", "hash")
    order = W.partitionBy("series", "path").orderBy("idx")
    starts = F.lag("idx").over(order).eqNullSafe(F.col("idx") - 1) == F.lit(False)
    runs = one.select(
        "*",
        starts.alias("starts"),
        (F.lead("idx").over(order).eqNullSafe(F.col("idx") + 1) == F.lit(False)).alias("ends"),
    )
    # the first of a run always has a value, so what is carried on never crosses a gap
    known = F.last(F.when(F.col("starts") & F.col("hash").isNull(), F.lit(UNKNOWN)).otherwise(F.col("hash")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    valued = runs.select("*", known.alias("known"))
    before = F.lag("known").over(order)
    marked = valued.select("*", before.alias("before"))
    row = lambda idx, kind: F.struct(idx.alias("idx"), F.lit(kind).alias("change_kind"))
    kinds = F.array(
        F.when(F.col("starts") & (F.col("idx") > 1), row(F.col("idx"), "added")),
        F.when(~F.col("starts") & (F.col("before") != F.lit(UNKNOWN)) & (F.col("known") != F.col("before")), row(F.col("idx"), "changed")),
        F.when(F.col("ends"), row(F.col("idx") + 1, "removed")),
    )
    changes = marked.select("series", F.col("path").alias("repo_relative"), F.inline(F.filter(kinds, lambda k: k.isNotNull())))
    # the series' last snapshot has none after it, so its keys' ends find no partner here
    return changes.join(series, ["series", "idx"]).select("manifest_id", "repo_relative", "change_kind")


def snapshot_change_counts(manifests: DataFrame, entries: DataFrame) -> DataFrame:
    """``manifest_id, added, removed, changed`` of every snapshot that has changes."""
    kind = F.col("change_kind")
    return (
        snapshot_changes(manifests, entries)
        .groupBy("manifest_id")
        .agg(*[F.count(F.when(kind == k, 1)).alias(k) for k in ("added", "removed", "changed")])
    )
