"""Structure of source files by line patterns: nodes, symbols, edges, and what they resolve to; all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftgrain.functions.paths import language_of
from siftgrain.operators.code import DEFINITIONS

#: What a definition's word makes of it.
NODE_TYPES = {
    "class": "CLASS", "interface": "INTERFACE", "enum": "ENUM", "record": "CLASS", "def": "FUNCTION", "func": "FUNCTION", "fn": "FUNCTION", "function": "FUNCTION", "fun": "FUNCTION", "struct": "STRUCT",
    "trait": "INTERFACE", "protocol": "PROTOCOL", "type": "TYPE_ALIAS", "typealias": "TYPE_ALIAS", "const": "CONST", "union": "UNION", "mod": "MODULE", "module": "MODULE", "namespace": "NAMESPACE", "object": "OBJECT",
    "extension": "EXTENSION", "#define": "MACRO", "from": "STAGE", "arg": "ARG", "env": "ENV",
}
#: Languages whose nesting shows in the indentation of a definition's line.
_INDENTED = ("python", "java", "kotlin", "scala", "csharp", "ruby", "php", "swift", "javascript", "typescript", "rust", "cpp")
_NAME = r"[A-Za-z_][\w.]*"
#: What a type extends or implements, on the line of its definition.
HERITAGE = {
    ("python", "EXTENDS"): rf"^\s*class\s+\w+\s*\(([^)]*)\)", ("java", "EXTENDS"): rf"\bextends\s+({_NAME})", ("java", "IMPLEMENTS"): r"\bimplements\s+([^{]+)",
    ("javascript", "EXTENDS"): rf"\bclass\s+\w+\s+extends\s+({_NAME})", ("typescript", "EXTENDS"): rf"\b(?:class|interface)\s+\w+(?:<[^>]*>)?\s+extends\s+([^{{]+?)(?:\s+implements\b|\s*\{{|$)", ("typescript", "IMPLEMENTS"): r"\bimplements\s+([^{]+)",
    ("csharp", "EXTENDS"): r"\b(?:class|interface|struct)\s+\w+\s*:\s*([^{]+)", ("kotlin", "EXTENDS"): r"\b(?:class|interface|object)\s+\w+(?:\([^)]*\))?\s*:\s*([^{]+)", ("scala", "EXTENDS"): rf"\bextends\s+({_NAME})",
    ("ruby", "EXTENDS"): r"^\s*class\s+\w+\s*<\s*([\w:]+)", ("php", "EXTENDS"): r"\bextends\s+([\w\\]+)", ("php", "IMPLEMENTS"): r"\bimplements\s+([^{]+)", ("swift", "EXTENDS"): r"\b(?:class|struct|enum|protocol|extension)\s+\w+\s*:\s*([^{]+)",
    ("rust", "IMPLEMENTS"): r"^\s*impl(?:<[^>]*>)?\s+([\w:]+)(?:<[^>]*>)?\s+for\s+\w+", ("cpp", "EXTENDS"): r"\b(?:class|struct)\s+\w+\s*:\s*([^{]+)",
}
#: Confidence of a call to a name that its own file defines (fixed values).
CALL_CONFIDENCE = {"java": 0.9, "go": 0.9, "cpp": 0.8}
HERITAGE_CONFIDENCE = 0.5


def lines_of(files: DataFrame) -> DataFrame:
    """``repository_id, path, language, at, line`` of the files (``repository_id, path, content``) whose language is known."""
    language = language_of(F.col("path"))
    return files.withColumn("language", language).where(F.col("language").isin(*DEFINITIONS)).select("repository_id", "path", "language", F.posexplode(F.split("content", r"\r\n|\r|\n")).alias("at", "line"))


def _of(patterns: dict[str, str], group: int) -> Column:
    out = F.lit(None).cast("string")
    for language, pattern in patterns.items():
        out = F.when(F.col("language") == language, F.regexp_extract("line", pattern, group)).otherwise(out)
    return out


def nodes(files: DataFrame) -> DataFrame:
    """``repository_id, path, language, node_type, name, qualified_name, identity, start_line, end_line``: a node per definition, lines from 0, the end exclusive.

    A definition lies in the nearest one above it that is indented less (where
    indentation shows nesting), else in its file; it reaches to the next one that
    is indented no more. A function in a class is a METHOD. ``identity`` names it
    by language, qualified name and type, so that moves and renames of the file
    keep it. The file's definitions are one ordered list, no larger than the file.
    """
    rows = lines_of(files).withColumn("word", F.lower(_of(DEFINITIONS, 1))).withColumn("name", _of(DEFINITIONS, 2)).where(F.col("name") != "")
    indent = F.when(F.col("language").isin(*_INDENTED), F.length(F.regexp_replace(F.regexp_extract("line", r"^([ \t]*)", 1), "\t", "    "))).otherwise(0)
    types = F.create_map(*[F.lit(x) for pair in NODE_TYPES.items() for x in pair])
    found = rows.select("repository_id", "path", "language", types[F.col("word")].alias("node_type"), "name", F.col("at").alias("start_line"), indent.alias("depth"))
    grouped = found.groupBy("repository_id", "path", "language").agg(F.array_sort(F.collect_list(F.struct("start_line", "depth", "name", "node_type"))).alias("_all"))
    # the nearest shallower one above, and the first below that is no deeper; nothing but the file's own list is kept
    shape = "struct<start_line:int,depth:int,name:string,node_type:string>"
    parent = lambda x, i: F.aggregate(F.slice("_all", 1, i), F.lit(None).cast(shape), lambda acc, y: F.when(y["depth"] < x["depth"], y).otherwise(acc))
    stop = lambda x, i: F.aggregate(F.slice("_all", i + 2, F.size("_all")), F.lit(None).cast("int"), lambda acc, y: F.coalesce(acc, F.when(y["depth"] <= x["depth"], y["start_line"])))
    each = F.transform("_all", lambda x, i: F.struct(x["name"].alias("name"), x["node_type"].alias("node_type"), x["start_line"].alias("start_line"), parent(x, i).alias("_parent"), stop(x, i).alias("end_line")))
    seen = grouped.select("repository_id", "path", "language", F.inline(each))
    kind = F.when((F.col("node_type") == "FUNCTION") & F.col("_parent.node_type").isin("CLASS", "INTERFACE", "STRUCT", "ENUM", "OBJECT"), "METHOD").otherwise(F.col("node_type"))
    qualified = F.concat_ws(".", F.col("_parent.name"), F.col("name"))
    return seen.select("repository_id", "path", "language", kind.alias("node_type"), "name", qualified.alias("qualified_name"), F.concat_ws("|", "language", qualified, kind).alias("identity"), "start_line", F.coalesce("end_line", F.lit(2147483647)).alias("end_line"))


def symbol_identities(found: DataFrame) -> DataFrame:
    """``symbol_id, repository_id, language, qualified_name, kind``: one row per thing named, however many files and versions name it."""
    return found.select("repository_id", "language", "qualified_name", F.col("node_type").alias("kind")).distinct().withColumn("symbol_id", F.sha2(F.concat_ws("|", "repository_id", "language", "qualified_name", "kind"), 256))


def heritage(files: DataFrame) -> DataFrame:
    """``repository_id, path, source, edge_type, target_name, resolution, confidence``: what types extend and implement, by the name on the line."""
    rows = lines_of(files)
    pairs = []
    for edge in ("EXTENDS", "IMPLEMENTS"):
        named = _of({lang: p for (lang, e), p in HERITAGE.items() if e == edge}, 1)
        owner = F.when((F.col("language") == "rust"), F.regexp_extract("line", r"\bfor\s+(\w+)", 1)).otherwise(F.regexp_extract("line", r"\b(?:class|interface|struct|enum|protocol|extension|object)\s+(\w+)", 1))
        pairs.append(rows.select("repository_id", "path", owner.alias("source"), F.lit(edge).alias("edge_type"), F.explode(F.split(F.regexp_replace(named, r"<[^>]*>|\([^)]*\)", ""), r"\s*,\s*")).alias("target_name")))
    out = pairs[0].union(pairs[1]).withColumn("target_name", F.trim("target_name"))
    return out.where((F.col("source") != "") & F.col("target_name").rlike(r"^[A-Za-z_][\w.:\\]*$")).distinct().withColumns({"resolution": F.lit("SYNTACTIC"), "confidence": F.lit(HERITAGE_CONFIDENCE)})


def type_references(files: DataFrame) -> DataFrame:
    """``repository_id, path, source, edge_type, target_name, resolution, confidence``: names in the form of types that a file mentions (two capitals or more), each once; the source is the file."""
    words = lines_of(files).select("repository_id", "path", F.explode(F.regexp_extract_all("line", F.lit(r"\b([A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+)\b"), F.lit(1))).alias("target_name")).distinct()
    return words.select("repository_id", "path", F.col("path").alias("source"), F.lit("REFERENCES").alias("edge_type"), "target_name", F.lit("SYNTACTIC").alias("resolution"), F.lit(0.7).alias("confidence"))


def calls(files: DataFrame, defined: DataFrame) -> DataFrame:
    """``repository_id, path, source, target, confidence``: calls of functions that the same file defines, from the definition they stand in (null outside any)."""
    words = lines_of(files).select("repository_id", "path", "language", "at", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(r"(?<![\w.])([A-Za-z_]\w*)\s*\("), F.lit(1)))).alias("target"))
    targets = defined.where(F.col("node_type").isin("FUNCTION", "METHOD")).groupBy("repository_id", "path", F.col("name").alias("target")).agg(F.collect_set("start_line").alias("at_lines"))
    used = words.join(targets, ["repository_id", "path", "target"]).where(~F.array_contains("at_lines", F.col("at")))
    spans = defined.where(F.col("node_type").isin("FUNCTION", "METHOD")).select("repository_id", "path", F.col("qualified_name").alias("source"), "start_line", "end_line")
    inside = used.join(spans, ["repository_id", "path"], "left").where((F.col("at") > F.col("start_line")) & (F.col("at") < F.col("end_line")))
    innermost = inside.groupBy("repository_id", "path", "language", "at", "target").agg(F.max_by("source", "start_line").alias("source"))
    confidence = F.coalesce(F.create_map(*[F.lit(x) for pair in CALL_CONFIDENCE.items() for x in pair])[F.col("language")], F.lit(0.85))
    return innermost.where(F.col("source").isNotNull()).select("repository_id", "path", "source", "target", confidence.alias("confidence")).distinct()


def resolve_types(edges: DataFrame, types: DataFrame) -> DataFrame:
    """``edges`` (``repository_id, target_name``) with ``target_id, resolution, confidence``: the type of that very name, else one whose qualified name ends with it; of several the newest.

    ``types`` has ``repository_id, qualified_name, symbol_id, seq``. The join is on
    the last part of both names. What is not found keeps ``logical:`` and its name.
    """
    last = lambda c: F.element_at(F.split(c, r"[.:\\]+"), -1)
    asked = edges.withColumn("_last", last(F.col("target_name"))).withColumn("_row", F.xxhash64(*edges.columns))
    known = types.select(F.col("repository_id").alias("_r"), "qualified_name", "symbol_id", "seq", last(F.col("qualified_name")).alias("_l"))
    exact = F.col("qualified_name") == F.col("target_name")
    suffix = F.col("qualified_name").endswith(F.concat(F.lit("."), F.col("target_name"))) | F.col("qualified_name").endswith(F.concat(F.lit("::"), F.col("target_name")))
    hits = asked.join(known, (F.col("repository_id") == F.col("_r")) & (F.col("_last") == F.col("_l")), "left").withColumn("_score", F.when(exact, 2).when(suffix, 1))
    best = hits.groupBy(*edges.columns).agg(F.max_by("symbol_id", F.when(F.col("_score").isNotNull(), F.struct("_score", "seq", "symbol_id"))).alias("_id"))
    return best.select(*[c for c in edges.columns if c not in ("resolution", "confidence")], F.coalesce("_id", F.concat(F.lit("logical:"), "target_name")).alias("target_id"), F.when(F.col("_id").isNotNull(), "SYMBOL_RESOLVED").otherwise("SYNTACTIC").alias("resolution"), F.when(F.col("_id").isNotNull(), 0.9).otherwise(HERITAGE_CONFIDENCE).alias("confidence"))


def endpoint_paths(edges: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """``edges`` with ``target_path``: endpoints of either kind brought to a file, by ``target_type`` (SYMBOL: the symbol's file, FILE: the path itself), null for logical ones.

    The key is computed first (a symbol's file by a left join on symbol ids only),
    then one equi-join finds the file.
    """
    named = symbols.groupBy(F.col("repository_id").alias("_r"), F.col("symbol_id").alias("_s")).agg(F.min("path").alias("_path"))
    keyed = edges.join(named, (F.col("target_type") == "SYMBOL") & (F.col("repository_id") == F.col("_r")) & (F.col("target_id") == F.col("_s")), "left").withColumn("_key", F.when(F.col("target_type") == "SYMBOL", F.col("_path")).when(F.col("target_type") == "FILE", F.col("target_id")))
    known = files.select(F.col("repository_id").alias("_fr"), F.col("path").alias("_fp")).distinct()
    return keyed.join(known, (F.col("repository_id") == F.col("_fr")) & (F.col("_key") == F.col("_fp")), "left").select(*edges.columns, F.col("_fp").alias("target_path"))


def ambiguous_definitions(defined: DataFrame) -> DataFrame:
    """``name, before_id, id``: definitions of one name next to each other by id whose files differ; a pair per step, never all pairs. ``defined`` has ``name, id, path``, current ones only."""
    w = W.partitionBy("name").orderBy("id", "path")
    seen = defined.withColumn("before_id", F.lag("id").over(w)).withColumn("before_path", F.lag("path").over(w))
    return seen.where(F.col("before_id").isNotNull() & (F.col("before_path") != F.col("path"))).select("name", "before_id", "id")


def apply_contradictions(evidence: DataFrame, contradictions: DataFrame) -> DataFrame:
    """``evidence`` (``id, verification``) after contradictions (``before_id, id``): either side is CONTRADICTED, but what was verified stays so and discloses with how many it conflicts."""
    sides = contradictions.select(F.col("before_id").alias("id"), F.col("id").alias("other")).union(contradictions.select("id", "before_id"))
    counted = sides.groupBy("id").agg(F.count_distinct("other").alias("n_conflicts"))
    joined = evidence.join(counted, "id", "left").withColumn("n_conflicts", F.coalesce("n_conflicts", F.lit(0)))
    return joined.withColumn("verification", F.when((F.col("n_conflicts") > 0) & (F.col("verification") != "VERIFIED"), "CONTRADICTED").otherwise(F.col("verification")))
