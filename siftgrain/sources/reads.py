"""Reading and writing in bounded parts: bounded reads, windows, pages, snapshots, logs, eviction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftgrain.functions.paths import is_contained, is_forbidden


def _kept(content: Column, limit: int) -> Column:
    """How many bytes of the text fit into ``limit`` without cutting a character."""
    data = F.hex(F.encode(content, "UTF-8"))
    inside = lambda at: F.substring(data, 2 * at + 1, 1).isin("8", "9", "A", "B")
    cut = F.when(~inside(limit), limit).when(~inside(limit - 1), limit - 1).when(~inside(limit - 2), limit - 2).otherwise(limit - 3)
    return F.when(F.octet_length(content) <= limit, F.octet_length(content)).otherwise(cut)


def bounded(files: DataFrame, limit: int) -> DataFrame:
    """``id, size_bytes, n_bytes, truncated, text``: the first ``limit`` bytes of each file (``id, path, content``) that may be read and lies inside its root; characters stay whole, null contents are left out."""
    allowed = files.where(~is_forbidden(F.col("path")) & is_contained(F.col("path")) & F.col("content").isNotNull())
    seen = allowed.withColumn("size_bytes", F.octet_length("content")).withColumn("n_bytes", _kept(F.col("content"), limit).cast("int"))
    text = F.decode(F.expr("substring(encode(content, 'UTF-8'), 1, n_bytes)"), "UTF-8")
    return seen.select("id", "size_bytes", "n_bytes", (F.col("size_bytes") > limit).alias("truncated"), text.alias("text"))


def windows(files: DataFrame, size: int) -> DataFrame:
    """``id, window_no, n_bytes, data``: each file's content (``id, content``) in windows of ``size`` bytes, in order; empty files have none."""
    data = F.encode("content", "UTF-8")
    n = F.ceil(F.octet_length("content") / size).cast("int")
    rows = files.where(F.octet_length("content") > 0).select("id", data.alias("_data"), F.explode(F.sequence(F.lit(0), n - 1)).alias("window_no"))
    part = F.expr(f"substring(_data, window_no * {size} + 1, {size})")
    return rows.select("id", "window_no", F.octet_length(part).alias("n_bytes"), part.alias("data"))


def page(rows: DataFrame, order: list[str], size: Column, offset: int, limit: int, budget: int) -> DataFrame:
    """Rows in ``order`` from ``offset`` on, at most ``limit`` of them and ``budget`` bytes of ``size`` together; the cut falls between rows."""
    head = rows.orderBy(*order).offset(offset).limit(limit)  # so the running sum is over one page
    used = F.sum(size).over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return head.withColumn("_used", used).where(F.col("_used") <= budget).drop("_used")


def append_snapshot(rows: DataFrame, root: str, number: int) -> None:
    """Appends a numbered snapshot to the others; a number is written once."""
    rows.write.mode("error").parquet(f"{root}/snapshot={number}")


def snapshot(spark: SparkSession, root: str, number: int) -> DataFrame:
    return spark.read.parquet(f"{root}/snapshot={number}")


def append_plans(plans: DataFrame, path: str) -> None:
    """Appends plans (``plan_id, plan`` as a struct) to the log, as JSON beside their id."""
    plans.select("plan_id", F.to_json("plan").alias("plan_json")).write.mode("append").parquet(path)


def evict(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The rows without those of evicted keys; where the table is partitioned by the key, their folders are not read."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")
