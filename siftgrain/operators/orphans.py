"""References to records that are missing, deleted or arrive later, by bitmap algebra over dictionary-encoded keys."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftgrain.functions.keys import norm_id, norm_path

#: Keys of one bitmap; a compressed one is at most 8 KiB.
BITS = 65536
#: Up to so many positions a bitmap is an array of them.
ARRAY_LIMIT = 4096
#: The period of a reference without a time, after all others: it is never late.
UNDATED = 2_000_000_000


def _month(column: str) -> Column:
    return (F.year(column) * 12 + F.month(column)).cast("int")


def _period(column: str) -> Column:
    return F.coalesce(_month(column), F.lit(UNDATED))


def _first_seen(rows: DataFrame) -> DataFrame:
    return rows.groupBy("ref_table", "row_key", "key").agg(F.min("received_at").alias("ref_first"))


def _path_key(repository: Column, path: Column, sensitive: Column) -> Column:
    # letter case is spelling unless the repository says otherwise; one not listed counts as case-sensitive
    path = norm_path(path)
    return F.concat_ws("\n", F.coalesce(norm_id(repository), F.lit("")), F.when(F.coalesce(sensitive, F.lit(True)), path).otherwise(F.lower(path)))


def corpus_references(units: DataFrame, occurrences: DataFrame, citations: DataFrame, repositories: DataFrame) -> DataFrame:
    """All references of the corpus: ``ref_table, row_key, key, ref_first``; copies folded, null references left out.

    A citation of a repository that is not listed keeps its letter case; one
    without a repository is a reference of its own (to no repository). Extra
    columns are dropped first, so clashing names do no harm.
    """
    units, occurrences = units.select("id", "file_occurrence_id", "received_at"), occurrences.select("id", "source_revision_id", "received_at")
    citations = citations.select("run_id", "ordinal", "citation_kind", "repository_id", "cited_path", "received_at")
    case = repositories.select(norm_id(F.col("id")).alias("repo"), "case_sensitive").groupBy("repo").agg(F.max("case_sensitive").alias("case_sensitive"))
    cited = citations.where(F.col("citation_kind").isin("EXISTING_REF", "TARGET_MODIFY") & F.col("cited_path").isNotNull()).withColumn("repo", norm_id(F.col("repository_id")))
    return _first_seen(
        units.select(F.lit("retrieval_units").alias("ref_table"), F.col("id").alias("row_key"), norm_id(F.col("file_occurrence_id")).alias("key"), "received_at")
        .union(occurrences.select(F.lit("file_occurrences"), "id", norm_id(F.col("source_revision_id")), "received_at"))
        .union(
            cited.join(case, "repo", "left").select(
                F.lit("spec_citations"), F.concat_ws("#", "run_id", "ordinal"), _path_key(F.col("repository_id"), F.col("cited_path"), F.col("case_sensitive")), "received_at"
            )
        )
        .where(F.col("key").isNotNull())
    )


def corpus_parents(occurrences: DataFrame, revisions: DataFrame, repositories: DataFrame) -> DataFrame:
    """What the references may point at: ``ref_table, key, parent_first, deleted``, one row per key.

    A path counts as deleted if its newest occurrence is (of equal numbers, if
    any is). Null ids and paths are no parents; extra columns are dropped first.
    """
    occurrences = occurrences.select("id", "repository_id", "path", "existence_state", "occurrence_seq", "received_at")
    case = repositories.select(norm_id(F.col("id")).alias("repo"), "case_sensitive").groupBy("repo").agg(F.max("case_sensitive").alias("case_sensitive"))
    gone = F.coalesce(F.lower(F.trim("existence_state")) == "deleted", F.lit(False))
    by_path = occurrences.where(F.col("path").isNotNull()).withColumn("repo", norm_id(F.col("repository_id"))).join(case, "repo", "left")
    rows = (
        occurrences.select(F.lit("retrieval_units").alias("ref_table"), norm_id(F.col("id")).alias("key"), "received_at", F.lit(0).cast("bigint").alias("seq"), gone.alias("gone"))
        .union(revisions.select(F.lit("file_occurrences"), norm_id(F.col("id")), "received_at", F.lit(0).cast("bigint"), F.lit(False)))
        .union(by_path.select(F.lit("spec_citations"), _path_key(F.col("repository_id"), F.col("path"), F.col("case_sensitive")), "received_at", "occurrence_seq", gone))
    )
    return (
        rows.where(F.col("key").isNotNull())
        .groupBy("ref_table", "key")
        .agg(F.min("received_at").alias("parent_first"), F.max(F.struct("seq", "gone")).getField("gone").alias("deleted"))
    )


def encode_keys(refs: DataFrame, parents: DataFrame, ranges: int) -> DataFrame:
    """``ref_table, key, period, kind, span, code``: the dictionary applied to both sides, in one pass.

    Every key of ``refs`` (once per period) and of ``parents`` (kind ``parent``
    or ``gone``) is a row. A key's range (``span``) is its hash, its ``code`` its
    dense rank within the range, from 0: codes are dense, no range is larger than
    its share of the keys, and no join is needed to code either side.
    """
    said = refs.select("ref_table", "key", _period("ref_first").alias("period"), F.lit("reference").alias("kind")).distinct()
    held = parents.select("ref_table", "key", F.coalesce(_month("parent_first"), F.lit(-1)).alias("period"), F.when(F.col("deleted"), "gone").otherwise("parent").alias("kind"))
    # a range is never null, or a filter on it would tell one reader's shuffle from another's
    rows = said.union(held).withColumn("span", F.coalesce(F.pmod(F.xxhash64("ref_table", "key"), F.lit(ranges)).cast("int"), F.lit(0)))
    return rows.withColumn("code", (F.dense_rank().over(W.partitionBy("ref_table", "span").orderBy("key")) - 1).cast("bigint"))


def pack_bits(positions: np.ndarray) -> bytes:
    """A compressed bitmap of positions below BITS: a sorted array of 16-bit numbers where they are few, else the bits themselves."""
    positions = np.unique(positions)
    if len(positions) <= ARRAY_LIMIT:
        return b"a" + positions.astype("<u2").tobytes()
    bits = np.zeros(BITS, bool)
    bits[positions] = True
    return b"b" + np.packbits(bits, bitorder="little").tobytes()


def unpack_bits(packed: bytes) -> np.ndarray:
    """The bitmap as BITS booleans."""
    if packed[:1] == b"b":
        return np.unpackbits(np.frombuffer(packed, np.uint8, offset=1), bitorder="little").astype(bool)
    bits = np.zeros(BITS, bool)
    bits[np.frombuffer(packed, "<u2", offset=1)] = True
    return bits


def key_bitmaps(coded: DataFrame) -> DataFrame:
    """``ref_table, span, bucket, kind, period, bits``: a compressed bitmap of codes per range, kind and period.

    A group holds each of its at most BITS codes once per period, so its size is
    bounded by the months of the data, whatever the references; it needs no
    shuffle beyond that of the codes.
    """

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf.iloc[0]
        rows = [(head["ref_table"], head["span"], head["bucket"], kind, period, pack_bits(part["code"].to_numpy() % BITS)) for (kind, period), part in pdf.groupby(["kind", "period"])]
        return pd.DataFrame(rows, columns=["ref_table", "span", "bucket", "kind", "period", "bits"])

    rows = coded.select("ref_table", "span", (F.col("code") / BITS).cast("int").alias("bucket"), "kind", "period", "code")
    return rows.groupBy("ref_table", "span", "bucket").applyInPandas(build, "ref_table string, span int, bucket int, kind string, period int, bits binary")


def _survivors(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one range: reference AND NOT parent, with the codes of surviving bits.

    ``missing``: AND NOT any parent; ``deleted``: AND a deleted parent; ``late``:
    AND NOT any parent of this or an earlier period; ``same``: the parent came in
    the same period, which bits cannot order.
    """
    nothing = np.zeros(BITS, bool)
    head, found = pdf.iloc[0], []
    gone, known = nothing.copy(), {}
    for kind, period, bits in zip(pdf["kind"], pdf["period"], pdf["bits"]):
        if kind != "reference":
            known[period] = known.get(period, nothing) | unpack_bits(bits)
            if kind == "gone":
                gone |= unpack_bits(bits)
    parents = np.logical_or.reduce([nothing, *known.values()])
    earlier, waiting = nothing.copy(), sorted(known)
    for period, bits in sorted((p, b) for k, p, b in zip(pdf["kind"], pdf["period"], pdf["bits"]) if k == "reference"):
        while waiting and waiting[0] < period:
            earlier |= known[waiting.pop(0)]
        refs = unpack_bits(bits)
        same = known.get(period, nothing)
        alive = refs & parents & ~gone
        for state, left in (("missing", refs & ~parents), ("deleted", refs & gone), ("late", alive & ~earlier & ~same), ("same", alive & same)):
            codes = np.flatnonzero(left) + int(head["bucket"]) * BITS
            if len(codes):
                found.append(pd.DataFrame({"ref_table": head["ref_table"], "span": np.int32(head["span"]), "code": codes, "period": np.int32(period), "state": state}))
    return pd.concat(found) if found else pd.DataFrame({"ref_table": pd.Series([], dtype=str), "span": np.zeros(0, np.int32), "code": np.zeros(0, np.int64), "period": np.zeros(0, np.int32), "state": pd.Series([], dtype=str)})


def orphan_references(refs: DataFrame, parents: DataFrame, ranges: int | None = None) -> DataFrame:
    """``ref_table, row_key, orphan_kind, ref_first`` of each reference that leads nowhere.

    ``refs`` has ``ref_table, row_key, key, ref_first``, ``parents`` has
    ``ref_table, key, parent_first, deleted``, each key once. Keys are
    dictionary-encoded, references without any column of their parents; before
    that they are folded to one row per key and month, so a key that a third of
    all rows refers to is one bit. Compressed bitmaps per key range and month are
    AND-NOTed, and only surviving codes are decoded and go back to their rows.
    What the bits say is final for ``missing``, ``deleted`` and ``late`` in an
    earlier month than the parent; only where both came in one month are their
    times compared. Every table is shuffled once by its id; all later stages read
    those shuffles again, so nothing is written to be reused. Null keys are no
    case; a null time is never late; an empty table gives an empty result.
    """
    spark = refs.sparkSession
    ranges = ranges or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    coded = encode_keys(refs, parents, ranges)
    left = key_bitmaps(coded).groupBy("ref_table", "span", "bucket").applyInPandas(_survivors, "ref_table string, span int, code bigint, period int, state string")
    named = coded.where("kind = 'reference'").join(left, ["ref_table", "span", "code", "period"]).select("ref_table", "key", "period", "state")
    marks = named.join(parents, ["ref_table", "key"], "left")
    rows = refs.withColumn("period", _period("ref_first")).join(marks, ["ref_table", "key", "period"])
    # the parents are read whole, as for the codes, so that their shuffle serves both
    kind = F.when(F.col("state") != "same", F.col("state")).when(~F.col("deleted") & (F.col("parent_first") > F.col("ref_first")), "late")
    return rows.select("ref_table", "row_key", kind.alias("orphan_kind"), "ref_first").where(F.col("orphan_kind").isNotNull())


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per table, kind and month of the reference's first delivery."""
    return orphans.groupBy("ref_table", F.date_format("ref_first", "yyyy-MM").alias("month"), "orphan_kind").agg(F.count("*").alias("n_orphans"))
