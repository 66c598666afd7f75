"""Symbols and imports of source files by line patterns, and what imports resolve to; all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftgrain.functions.paths import language_of

#: (kind, name) of a definition on a line, by language.
DEFINITIONS = {
    "python": r"^\s*(?:async\s+)?(class|def)\s+([A-Za-z_]\w*)",
    "java": r"^\s*(?:(?:public|protected|private|static|final|abstract|sealed)\s+)*(class|interface|enum|record)\s+([A-Za-z_]\w*)",
    "go": r"^(func|type)\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)",
    "javascript": r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(class|function|const)\s+([A-Za-z_]\w*)",
    "typescript": r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+|async\s+)*(class|function|interface|enum|type|const)\s+([A-Za-z_]\w*)",
    "rust": r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*(struct|enum|trait|union|fn|mod|type)\s+([A-Za-z_]\w*)",
    "kotlin": r"^\s*(?:\w+\s+)*(class|interface|object|fun|typealias)\s+([A-Za-z_]\w*)",
    "scala": r"^\s*(?:\w+\s+)*(class|trait|object|def)\s+([A-Za-z_]\w*)",
    "csharp": r"^\s*(?:\w+\s+)*(class|interface|struct|enum|record|namespace)\s+([A-Za-z_]\w*)",
    "c": r"^\s*(?:typedef\s+)?(struct|union|enum|#define)\s+([A-Za-z_]\w*)",
    "cpp": r"^\s*(?:template\s*<[^>]*>\s*)?(class|struct|union|enum|namespace|#define)\s+([A-Za-z_]\w*)",
    "ruby": r"^\s*(class|module|def)\s+(?:self\.)?([A-Za-z_]\w*)",
    "php": r"^\s*(?:\w+\s+)*(class|interface|trait|enum|function|namespace)\s+([A-Za-z_]\w*)",
    "swift": r"^\s*(?:\w+\s+)*(class|struct|enum|protocol|extension|func)\s+([A-Za-z_]\w*)",
    "lua": r"^\s*(?:local\s+)?(function)\s+(?:\w+[.:])*([A-Za-z_]\w*)",
    "dockerfile": r"^(?i)\s*(from|arg|env)\s+(?:\S+\s+as\s+)?([A-Za-z_]\w*)",
}
IMPORTS = {
    "python": r"^\s*(?:from|import)\s+([A-Za-z_.][\w.]*)",
    "java": r"^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;",
    "go": r"^\s*import\s+(?:\w+\s+)?\"([^\"]+)\"",
    "javascript": r"(?:\bfrom\s+|\brequire\(\s*|\bimport\s+|\bimport\(\s*)[\"']([^\"']+)[\"']",
    "typescript": r"(?:\bfrom\s+|\brequire\(\s*|\bimport\s+|\bimport\(\s*)[\"']([^\"']+)[\"']",
    "rust": r"^\s*(?:pub\s+)?use\s+([\w:]+)",
    "kotlin": r"^\s*import\s+([\w.]+(?:\.\*)?)",
    "scala": r"^\s*import\s+([\w.]+)",
    "csharp": r"^\s*using\s+(?:static\s+)?([\w.]+)\s*;",
    "c": r"^\s*#include\s+[<\"]([^>\"]+)[>\"]",
    "cpp": r"^\s*#include\s+[<\"]([^>\"]+)[>\"]",
    "ruby": r"^\s*(?:require|require_relative|load)\s+[\"']([^\"']+)[\"']",
    "php": r"^\s*(?:use\s+([\w\\]+)|(?:include|require)(?:_once)?\s*\(?[\"']([^\"']+)[\"'])",
    "swift": r"^\s*import\s+(\w+)",
    "lua": r"\brequire\s*\(?\s*[\"']([^\"']+)[\"']",
    "dockerfile": r"^(?i)\s*(?:copy|add)\s+(?:--from=\S+\s+)?(\S+)",
}


def _lines(files: DataFrame) -> DataFrame:
    language = language_of(F.col("path"))
    return files.withColumn("by_path", language).where(F.col("by_path").isin(*DEFINITIONS)).select("repository_id", "path", "by_path", F.posexplode(F.split("content", r"\r\n|\r|\n")).alias("at", "line"))


def _by_language(patterns: dict[str, str], group: int) -> Column:
    out = F.lit(None).cast("string")
    for language, pattern in patterns.items():
        found = F.regexp_extract("line", pattern, group)
        out = F.when(F.col("by_path") == language, found).otherwise(out)
    return out


def symbols(files: DataFrame) -> DataFrame:
    """``repository_id, path, language, kind, name, line_no`` of the definitions; files have ``repository_id, path, content``."""
    rows = _lines(files).withColumn("kind", F.lower(_by_language(DEFINITIONS, 1))).withColumn("name", _by_language(DEFINITIONS, 2))
    return rows.where(F.col("name") != "").select("repository_id", "path", F.col("by_path").alias("language"), "kind", "name", (F.col("at") + 1).alias("line_no"))


def imports(files: DataFrame) -> DataFrame:
    """``repository_id, path, language, specifier`` of the imports, each once per file."""
    first = _by_language(IMPORTS, 1)
    included = F.regexp_extract("line", IMPORTS["php"], 2)  # use is group 1, include and require are group 2
    rows = _lines(files).withColumn("specifier", F.when((F.col("by_path") == "php") & (first == ""), included).otherwise(first)).where(F.col("specifier") != "")
    return rows.select("repository_id", "path", F.col("by_path").alias("language"), "specifier").distinct()


def headings(files: DataFrame) -> DataFrame:
    """``repository_id, path, level, title, line_no`` of Markdown headings."""
    rows = files.where(F.lower("path").rlike(r"\.(md|markdown)$")).select("repository_id", "path", F.posexplode(F.split("content", r"\r\n|\r|\n")).alias("at", "line"))
    return rows.where(F.col("line").rlike(r"^#{1,6} +\S")).select(
        "repository_id", "path", F.length(F.regexp_extract("line", "^(#+)", 1)).alias("level"), F.trim(F.regexp_extract("line", r"^#+ +(.*)$", 1)).alias("title"), (F.col("at") + 1).alias("line_no")
    )


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def import_candidates(path: Column, language: Column, specifier: Column) -> Column:
    """Paths an import may mean, the likeliest first: relative specifiers beside the file, dotted names beside it and under source roots."""
    here = directory(path)
    plain = F.regexp_replace(specifier, r"^\./", "")
    joined = F.concat_ws("/", here, plain)
    dotted = F.regexp_replace(specifier, r"\.", "/")
    js = F.array(joined, *[F.concat(F.regexp_replace(joined, r"\.js$", ""), F.lit(e)) for e in (".ts", ".js", "/index.ts", "/index.js")])
    py = F.array(F.concat_ws("/", here, F.concat(dotted, F.lit(".py"))), F.concat_ws("/", here, F.concat(dotted, F.lit("/__init__.py"))), F.concat(F.lit("src/"), dotted, F.lit(".py")))
    java = F.array(*[F.concat(F.lit(root), dotted, F.lit(e)) for root in ("src/main/java/", "src/test/java/", "src/", "") for e in (".java", ".kt")])
    rust = F.array(F.concat_ws("/", here, F.concat(F.regexp_replace(F.regexp_replace(specifier, r"^crate::", ""), "::.*", ""), F.lit(".rs"))))
    none = F.array().cast("array<string>")
    return F.when(language.isin("javascript", "typescript"), js).when(language == "python", py).when(language == "java", java).when(language == "rust", rust).otherwise(none)


def resolve_imports(found: DataFrame, paths: DataFrame) -> DataFrame:
    """``repository_id, path, specifier, target``: the first candidate that is a known path; an unresolved target is ``logical:`` and the specifier."""
    tries = found.select("repository_id", "path", "specifier", F.posexplode_outer(import_candidates(F.col("path"), F.col("language"), F.col("specifier"))).alias("at", "candidate"))
    known = paths.select(F.col("repository_id").alias("r"), F.col("path").alias("known")).distinct()
    hits = tries.join(known, (F.col("repository_id") == F.col("r")) & (F.col("candidate") == F.col("known")), "left")
    best = F.min_by("known", F.when(F.col("known").isNotNull(), F.col("at")).otherwise(F.lit(1_000_000)))
    return hits.groupBy("repository_id", "path", "specifier").agg(best.alias("target")).withColumn("target", F.coalesce("target", F.concat(F.lit("logical:"), F.col("specifier"))))


def find_symbol(defined: DataFrame, name: str, k: int = 50) -> DataFrame:
    """Symbols named so; if there are none, those that contain the name: shorter names first, then path and line."""
    ranked = defined.where(F.col("name").contains(name)).withColumn("is_exact", (F.col("name") == name).cast("int"))
    best = ranked.orderBy(F.desc("is_exact"), F.length("name"), "path", "line_no", "repository_id").limit(k)
    top = F.max("is_exact").over(W.partitionBy(F.lit(1)))  # of at most k rows
    return best.withColumn("top", top).where(F.col("is_exact") == F.col("top")).drop("is_exact", "top")


def nearest_names(wanted: DataFrame, known: DataFrame, k: int = 5) -> DataFrame:
    """``id, name, distance``: of each wanted path that is missing, the ``k`` nearest names in its directory by edit distance.

    Both sides have ``repository_id, directory, name``; the join is on the
    directory, so pairs stay within it.
    """
    near = wanted.select("id", "repository_id", "directory", F.col("name").alias("asked")).join(known.select("repository_id", "directory", "name").distinct(), ["repository_id", "directory"])
    ranked = near.withColumn("distance", F.levenshtein(F.substring("asked", 1, 128), F.substring("name", 1, 128))).withColumn("place", F.row_number().over(W.partitionBy("id").orderBy("distance", "name")))
    return ranked.where(F.col("place") <= k).select("id", "name", "distance")
