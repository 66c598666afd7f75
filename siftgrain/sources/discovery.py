"""Reading directory trees as a relation of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftgrain.functions.paths import is_forbidden, priority

#: Directories that discovery leaves out unless asked (fixed values).
SKIPPED = ["**/.git/**", "**/node_modules/**", "**/target/**", "**/__pycache__/**"]


def scan_tree(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """``path, size_bytes, content_hash, content, priority`` of the files under ``root``; forbidden ones and excluded ones are not read into the result.

    The files are read once, by the tasks, in the binary source; path filters
    come before the content is touched.
    """
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    path = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + base.replace(".", r"\.") + "/", "")
    rows = files.select(path.alias("path"), F.col("length").alias("size_bytes"), "content")
    rows = rows.withColumn("priority", priority(F.col("path"), include or [], SKIPPED + (exclude or []), [], []))
    return rows.where(~is_forbidden(F.col("path")) & (F.col("priority") != "ignored")).select("path", "size_bytes", F.sha2("content", 256).alias("content_hash"), F.col("content").cast("string").alias("content"), "priority")


#: Patterns whose matches are masked in text that is shown (our own list).
MASKED = [
    (r"(?i)\b(password|passwd|pwd|secret|token|api[_-]?key)(\s*[:=]\s*)([\"']?)[^\s\"']{8,}", "$1$2$3[REDACTED]"),
    (r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_\w{20,}|glpat-[\w-]{16,}|[srp]k_live_\w{10,})", "[REDACTED]"),
    (r"(://[^/\s:@]+:)[^@\s/]+@", "$1[REDACTED]@"),
]


def masked(text: Column) -> Column:
    """The text with what the patterns match masked, in JVM expressions."""
    for pattern, to in MASKED:
        text = F.regexp_replace(text, pattern, to)
    return text


def masked_count(text: Column) -> Column:
    total = F.lit(0)
    for pattern, _ in MASKED:
        total = total + F.regexp_count(text, F.lit(pattern))
    return total
