"""What a path says: scope, kind of source, security, priority. JVM-side expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftgrain.functions.text import glob_regex

#: Directories, extensions and file names that are never read (fixed values).
FORBIDDEN_DIRS = (".git", ".ssh", ".gnupg")
FORBIDDEN_EXTENSIONS = ("pem", "key", "p12", "jks")
FORBIDDEN_NAMES = (".env",)
FORBIDDEN_NAME_PREFIXES = (".env.",)

#: What in a lower-case path marks a test, and the names of configuration and documentation (fixed values).
TEST_MARKERS = ("/tests/", "/test/", "__tests__/", "_test.go", "test_", "_test.py", "test.py", "test.java", ".test.ts", ".test.js", ".spec.ts", ".spec.js", "test.rs")
CONFIG_EXTENSIONS = (".yml", ".yaml", ".toml", ".ini", ".properties", ".env", ".cfg", ".conf", ".xml")
CONFIG_NAMES = ("package.json", "go.mod")
DOC_EXTENSIONS = (".md", ".rst", ".txt", ".adoc")
DOC_NAMES = ("license", "licence", "notice", "copying", "copyright")


def in_scope(path: Column, exact: str | None = None, prefix: str | None = None, glob: str | None = None) -> Column:
    """Whether a path is the one named, lies under a directory (whole components only), or matches a search glob; None of them means all."""
    if exact is not None:
        return path == exact
    if prefix is not None:
        root = prefix.rstrip("/")
        return (path == root) | path.startswith(root + "/")
    if glob is not None:
        return path.rlike(glob_regex(glob, star_crosses=True))
    return F.lit(True)


def ends_with_path(path: Column, suffix: str) -> Column:
    """Whether a path is the suffix or ends with it at a component boundary."""
    return (path == suffix) | path.endswith("/" + suffix)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_forbidden(path: Column) -> Column:
    """Whether a path may hold keys or credentials by a component, its extension or its name."""
    name = F.lower(file_name(path))
    parts = F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, FORBIDDEN_DIRS)))
    prefixed = reduce(lambda a, b: a | b, [name.startswith(p) for p in FORBIDDEN_NAME_PREFIXES])
    return parts | name.isin(*FORBIDDEN_NAMES) | prefixed | F.regexp_extract(name, r"\.([^.]*)$", 1).isin(*FORBIDDEN_EXTENSIONS)


def priority(path: Column, include: list[str], exclude: list[str], low: list[str], high: list[str]) -> Column:
    """ignored, low, normal or high by discovery globs; an include pattern rescues what an exclude pattern drops."""
    any_of = lambda globs: F.lit(False) if not globs else path.rlike("|".join(glob_regex(g, star_crosses=False) for g in globs))
    return F.when(any_of(exclude) & ~any_of(include), "ignored").when(any_of(high), "high").when(any_of(low), "low").otherwise("normal")


def source_type(path: Column) -> Column:
    """The kind of evidence a path holds: KNOWLEDGE, TEST, CONFIGURATION, DOCUMENTATION or SOURCE_CODE, by the first rule that applies.

    ``knowledge/`` counts as the curated folder of a module, so at any depth. A
    test marker counts anywhere in the path (``latest_x`` has one).
    """
    low, name = F.lower(path), F.lower(file_name(path))
    any_of = lambda tests: reduce(lambda a, b: a | b, tests)
    return (
        F.when(low.startswith("knowledge/") | low.contains("/knowledge/"), "KNOWLEDGE")
        .when(any_of([low.contains(m) for m in TEST_MARKERS]), "TEST")
        .when(any_of([name.endswith(e) for e in CONFIG_EXTENSIONS]) & ~name.startswith("pom.xml") | name.isin(*CONFIG_NAMES), "CONFIGURATION")
        .when(any_of([name.endswith(e) for e in DOC_EXTENSIONS]) | name.isin(*DOC_NAMES), "DOCUMENTATION")
        .when(name.endswith(".json"), "CONFIGURATION")
        .otherwise("SOURCE_CODE")
    )


def search_label(kind: Column) -> Column:
    """The short label of a kind of source in search results."""
    return F.when(kind == "KNOWLEDGE", "knowledge").when(kind == "DOCUMENTATION", "documentation").when(kind == "CONFIGURATION", "config").when(kind == "TEST", "test").otherwise("code")


def authority(kind: Column) -> Column:
    """How far a kind of source is to be believed: IMPLEMENTATION, CONFIGURED, TEST_EXPECTATION, PROJECT_KNOWLEDGE, DOC or DERIVED."""
    return (
        F.when(kind.isin("SOURCE_CODE", "GENERATED_SOURCE"), "IMPLEMENTATION").when(kind == "TEST", "TEST_EXPECTATION").when(kind == "CONFIGURATION", "CONFIGURED")
        .when(kind == "KNOWLEDGE", "PROJECT_KNOWLEDGE").when(kind == "DOCUMENTATION", "DOC").otherwise("DERIVED")
    )


#: Extensions of the languages that are told by path (fixed values).
LANGUAGE_OF = {
    "py": "python", "java": "java", "js": "javascript", "ts": "typescript", "go": "go", "rs": "rust", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "md": "markdown",
    "kt": "kotlin", "scala": "scala", "lua": "lua", "c": "c", "h": "c", "cpp": "cpp", "cs": "csharp", "rb": "ruby", "php": "php", "swift": "swift",
}


def language_of(path: Column) -> Column:
    """The language a path's extension names, ``dockerfile`` by name, else null."""
    known = F.create_map(*[F.lit(x) for pair in LANGUAGE_OF.items() for x in pair])
    return F.when(F.lower(file_name(path)).startswith("dockerfile"), "dockerfile").otherwise(known[F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))])


def normal_path(path: Column) -> Column:
    """A path without empty and ``.`` parts, each ``..`` taking the part before it; one that leads above the root keeps its ``..``."""
    parts = F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda p: (p != "") & (p != "."))
    empty = F.array().cast("array<string>")
    step = lambda acc, p: F.when((p == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, 1, F.size(acc) - 1)).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(parts, empty, lambda acc, p: step(F.when(F.size(acc) >= 0, acc), p).cast("array<string>")), "/")


def is_contained(path: Column) -> Column:
    """Whether a path, once normalised, stays below its root."""
    return ~path.startswith("/") & ~normal_path(path).startswith("..")
