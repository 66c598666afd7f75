"""Versioned tables: newest rows, diffs, renames, invalidation, retention, publication."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Freshness states a state may go to, besides itself (fixed values).
TRANSITIONS = {
    "CURRENT": ("STALE", "INVALID", "UNKNOWN", "PENDING_REFRESH"),
    "STALE": ("INVALID", "UNKNOWN", "PENDING_REFRESH", "CURRENT"),
    "UNKNOWN": ("STALE", "INVALID", "PENDING_REFRESH", "CURRENT"),
    "INVALID": ("PENDING_REFRESH", "UNKNOWN"),
    "PENDING_REFRESH": ("CURRENT", "INVALID"),
}


def may_follow(before: Column, after: Column) -> Column:
    """Whether a freshness state may go to another."""
    legal = [(before == a) & after.isin(*bs) for a, bs in TRANSITIONS.items()]
    return (before == after) | reduce(lambda a, b: a | b, legal)


def latest_per(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The row with the highest ``seq`` of each key; an aggregate, so it combines map-side and needs no sort."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("newest")).select(*keys, "newest.*")


def upsert(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` with rows replaced or added from ``changes``; a change wins over the base, of several the one with all columns greatest."""
    both = base.withColumn("_rank", F.lit(0)).unionByName(changes.withColumn("_rank", F.lit(1)))
    rest = [c for c in base.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max(F.struct("_rank", *rest)).alias("row")).select(*keys, *[F.col(f"row.{c}").alias(c) for c in rest])


def insert_or_ignore(base: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` and the rows whose key it lacks."""
    return base.unionByName(rows.dropDuplicates(keys).join(base.select(*keys), keys, "left_anti"))


def delete_where(base: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` without the rows whose key is in ``gone``."""
    return base.join(gone.select(*keys).distinct(), keys, "left_anti")


def fingerprint(rows: DataFrame, group: list[str], line: str = "line") -> DataFrame:
    """``group, fingerprint, n``: a hash of each group's distinct lines that their order does not change.

    The SHA-256 values of the lines are added up in four parts of 60 bits, so a
    group of any size is one row of fixed size, combined map-side.
    """
    hashed = rows.select(*group, line).distinct().withColumn("_h", F.sha2(line, 256))
    parts = [F.sum(F.conv(F.substring("_h", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).cast("string") for i in range(4)]
    return hashed.groupBy(*group).agg(F.count("*").alias("n"), *[p.alias(f"_p{i}") for i, p in enumerate(parts)]).select(*group, F.sha2(F.concat_ws(",", F.col("n").cast("string"), *[f"_p{i}" for i in range(4)]), 256).alias("fingerprint"), "n")


def manifest_hash(entries: DataFrame, group: list[str], path: str, content: str) -> DataFrame:
    """``group, manifest_hash, n_entries``: a fingerprint of the lines ``path TAB hash LF``, whatever the order of the rows."""
    line = F.concat(F.col(path), F.lit("\t"), F.coalesce(F.col(content), F.lit("")), F.lit("\n"))
    return fingerprint(entries.select(*group, line.alias("line")), group).select(*group, F.col("fingerprint").alias("manifest_hash"), F.col("n").alias("n_entries"))


def glob_covered(files: DataFrame, globs: DataFrame, within: str = "repository_id") -> DataFrame:
    """``id`` of each file (``within, path, id``) that a glob (``within, glob``) of its repository covers; ``*`` and ``?`` stay within a directory, ``**`` does not.

    A glob joins the files below its literal directories, so the join is an
    equi-join on a prefix of the path, of any depth, the root included.
    """
    mark = lambda c, a, b: F.regexp_replace(c, a, b)
    regex = mark(mark(mark(F.col("glob"), r"[.+^$()\[\]{}|\\]", r"\\$0"), r"\*\*/", "\u0001"), r"\*\*", "\u0002")
    regex = mark(mark(mark(mark(regex, r"\*", "[^/]*"), r"\?", "[^/]"), "\u0001", "(?:.*/)?"), "\u0002", ".*")
    literal = F.regexp_replace(F.regexp_extract("glob", r"^[^*?]*", 0), r"[^/]*$", "")
    rules = globs.select(within, F.concat(F.lit("^"), regex, F.lit("$")).alias("re"), literal.alias("head"))
    parts = F.split("path", "/")
    heads = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.when(n == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/"))))
    return files.select(within, "path", "id", F.explode(heads).alias("head")).join(rules, [within, "head"]).where(F.expr("path rlike re")).select("id").distinct()


def diff(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, change``: added, removed, changed or same, by a full outer join."""
    a = before.select(*keys, F.col(value).alias("_before"), F.lit(1).alias("_in_before"))
    b = after.select(*keys, F.col(value).alias("_after"), F.lit(1).alias("_in_after"))
    change = F.when(F.col("_in_before").isNull(), "added").when(F.col("_in_after").isNull(), "removed").when(F.col("_before").eqNullSafe(F.col("_after")), "same").otherwise("changed")
    return a.join(b, keys, "full_outer").select(*keys, change.alias("change"))


def rename_pairs(removed: DataFrame, added: DataFrame, within: list[str], path: str = "path", content: str = "content_hash") -> DataFrame:
    """``within, old_path, new_path``: removed and added paths of equal content, one to one in the order of their paths."""
    place = F.row_number().over(W.partitionBy(*within, content).orderBy(path))
    a = removed.where(F.col(content).isNotNull()).select(*within, content, F.col(path).alias("old_path"), place.alias("place"))
    b = added.where(F.col(content).isNotNull()).select(*within, content, F.col(path).alias("new_path"), place.alias("place"))
    return a.join(b, [*within, content, "place"]).select(*within, "old_path", "new_path")


def invalidate(changed: DataFrame, dependents: dict[str, DataFrame], key: str) -> DataFrame:
    """``kind, entity_id, cause_id`` audit rows: everything that hangs on a changed occurrence, by semi-joins."""
    parts = [d.join(changed.select(F.col("id").alias(key)).distinct(), key, "left_semi").select(F.lit(kind).alias("kind"), F.col("entity_id"), F.col(key).alias("cause_id")) for kind, d in dependents.items()]
    return reduce(DataFrame.unionByName, parts)


def prune(rows: DataFrame, cutoff: Column, references: list[DataFrame], key: str) -> DataFrame:
    """The rows that retention may delete: old enough, and in none of the reference tables."""
    return reduce(lambda left, ref: left.join(ref.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti"), references, rows.where(cutoff))


def _pointers(spark, root: str):
    """The file system of ``root``, its pointer folder, and the numbers of the pointers in it."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{root}/_current")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    return fs, folder, sorted(int(n) for n in names if n.isdigit())


def publish(df: DataFrame, root: str, generation: str) -> int:
    """Writes a generation beside the others, then points to it; the number of the pointer.

    A pointer is a new file, written under another name and renamed, which is one
    step of the file system; none is ever changed or deleted. Readers take the
    highest number, so they see the old or the new generation, never a mixture
    and never none. A failed write leaves the old one.
    """
    spark = df.sparkSession
    df.write.mode("error").parquet(f"{root}/generation={generation}")
    fs, folder, numbers = _pointers(spark, root)
    fs.mkdirs(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path
    draft = path(folder, f"_draft-{uuid.uuid4()}")
    out = fs.create(draft, False)
    out.write(bytearray(generation.encode()))
    out.close()
    number = (numbers[-1] if numbers else 0) + 1
    while fs.exists(path(folder, str(number))) or not fs.rename(draft, path(folder, str(number))):
        number += 1
    return number


def current_generation(spark, root: str) -> str | None:
    """The name of the generation that is pointed to."""
    _, folder, numbers = _pointers(spark, root)
    return spark.read.text(f"{folder.toString()}/{numbers[-1]}").head()[0] if numbers else None


def published(spark, root: str) -> DataFrame:
    """The generation that is pointed to."""
    return spark.read.parquet(f"{root}/generation={current_generation(spark, root)}")


def violations(rows: DataFrame, keys: list[str], allowed: dict[str, list[str]], required: list[str]) -> DataFrame:
    """``rule, n``: rows that break a unique key, an enumeration or a not-null rule; 0 where none does."""
    unique = rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)).alias("n")).select(F.lit("unique:" + ",".join(keys)).alias("rule"), "n")
    checks = {f"enum:{c}": F.count(F.when(~F.col(c).isin(*v), 1)) for c, v in allowed.items()} | {f"not_null:{c}": F.count(F.when(F.col(c).isNull(), 1)) for c in required}
    one = rows.agg(*[e.alias(f"r{i}") for i, e in enumerate(checks.values())])
    pairs = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("n")) for i, name in enumerate(checks)])
    return one.select(F.inline(pairs)).unionByName(unique)
