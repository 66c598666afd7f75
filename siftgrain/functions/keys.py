"""Column expressions that bring ids, paths and hashes to one spelling (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_id(c: Column) -> Column:
    """An id in one spelling: lower case, without surrounding space, braces or ``urn:uuid:``. Null stays null."""
    return F.regexp_replace(F.lower(F.trim(c)), r"^\{|\}$|^urn:uuid:", "")


def norm_path(c: Column) -> Column:
    """A repository-relative path with single forward slashes, without leading slash or ``./``. Null stays null; letter case is kept."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\\", "/"), r"/(\./)+|/{2,}(\./|/)*", "/"), r"^(\./|/)+", "")


def norm_hash(c: Column) -> Column:
    """A content hash in lower case without surrounding space or algorithm prefix (``sha256:``). Null stays null."""
    return F.regexp_replace(F.lower(F.trim(c)), r"^[a-z0-9_-]+[:=]", "")


def extension(c: Column) -> Column:
    """The extension of a path in lower case, '' where it has none."""
    return F.lower(F.regexp_extract(c, r"[^/\\]\.([A-Za-z0-9_]+)\s*$", 1))
