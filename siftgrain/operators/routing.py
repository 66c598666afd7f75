"""What a question is after: its type, its search terms and its hints; all column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases that tell the type of a question, in the order of the rules (fixed values).
RULES = [
    ("DEFINITION", "High", ("where is", "where's ", "definition of", "defined in", "declared in", "locate the definition")),
    ("SYMBOL_NAVIGATION", "High", ("caller", "callee", "who calls", "what calls", "usages of", "usage of", "references to", "all references")),
    ("CONFIGURATION", "High", ("configured", "configuration", "config value", "setting", "port is", "database url", "environment variable", "env var", ".yml", ".yaml", ".toml", ".properties", "timeout value")),
    ("DEBUGGING", "High", ("why does", "why is", "fails", "failing", "failure", "root cause", "unexpected", "broken", "debug", "error when", "exception when", "not working")),
    ("IMPACT", "High", ("impact", "what would break", "break if", "affected by changing", "ripple", "blast radius", "who uses this", "downstream effects")),
    ("DEPENDENCY", "High", ("depends on", "depend on", "depending on", "dependency", "which services use", "which repos use", "package depend", "library depend", "transitive")),
    ("CROSS_REPO", "High", ("cross-repo", "cross repo", "across repositories", "across repos", "other repositories")),
    ("TEST_BEHAVIOR", "High", ("test suite", "tests cover", "test cover", "what scenarios", "unit test", "integration test", "verify in tests", "tested")),
    ("KNOWLEDGE", "High", ("runbook", "documented", "documentation say", "docs say", "knowledge", "project notes", "architecture doc", "adr", "design doc")),
    ("ARCHITECTURE", "Medium", ("how does", "how is", "explain", "walk me through", "architecture", "overview of", "behavior of", "behaves", "flow of", "works")),
]
DEFINITION_OPENINGS = ("find the definition", "show me the definition")
PATH_LOOKUP_WORDS = ("where", "is", "the", "file", "path", "find", "locate", "show", "me", "open", "to")
STOP_WORDS = (
    "the", "a", "an", "is", "are", "was", "were", "of", "in", "on", "for", "to", "and", "or", "how", "does", "do", "what", "where", "which", "who", "show", "me", "find", "tell",
    "about", "with", "at", "from", "by", "it", "this", "that", "there", "their",
)
PATH_EXTENSIONS = (".rs", ".java", ".py", ".go", ".ts", ".tsx", ".js", ".jsx", ".c", ".cpp", ".h", ".md", ".yml", ".yaml", ".toml", ".json", ".properties", ".xml", ".ini", ".sql", ".sh")
#: Terms a search takes at most.
MOST_TERMS = 24


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _trim(c: Column, marks: str) -> Column:
    return F.regexp_replace(c, f"^[{marks}]+|[{marks}]+$", "")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def is_identifier(word: Column) -> Column:
    """Whether a word looks like a name in code: letters, digits, ``_`` and ``.``, with mixed case, a digit, ``_`` or ``.``."""
    return word.rlike(r"^[A-Za-z_][A-Za-z0-9_.]*$") & (F.length(word) <= 128) & ((word.rlike("[A-Z]") & word.rlike("[a-z]")) | word.rlike(r"[_.0-9]"))


def search_terms(text: Column) -> Column:
    """The distinct lower-case words without stop words, in order."""
    words = F.transform(F.split(F.lower(text), r"[\s,?.!;:]+"), lambda w: _trim(w, "\"'`()"))
    return F.array_distinct(F.filter(words, lambda w: (F.octet_length(w) >= 2) & ~w.isin(*STOP_WORDS)))


def prioritized(terms: Column, most: int = MOST_TERMS) -> Column:
    """The terms with identifiers and long words first, else in order, at most ``most``."""
    weight = lambda w: F.when(w.rlike(r"[_.0-9]|[a-z][A-Z]"), 2).otherwise(0) + F.when(F.length(w) >= 9, 1).otherwise(0)
    ranked = F.array_sort(F.transform(terms, lambda w, i: F.struct((-weight(w)).alias("w"), i.alias("i"), w.alias("word"))))
    return F.slice(F.transform(ranked, lambda x: x.getField("word")), 1, most)


def path_hints(text: Column) -> Column:
    """The distinct words that look like paths, in order; addresses are none."""
    words = F.transform(_words(text), lambda w: _trim(w, r"\"'`,?:;\[\]"))
    named = lambda w: _any([F.lower(w).endswith(e) for e in PATH_EXTENSIONS])
    return F.array_distinct(F.filter(words, lambda w: ~w.contains("://") & (named(w) | (w.contains("/") & ~w.startswith("/") & ~w.contains("(")))))


def symbol_hint(text: Column) -> Column:
    """The longest identifier, the last of equal ones; null if there is none."""
    found = F.filter(F.transform(_words(text), lambda w, i: F.struct(F.length(_trim(w, "\"'`,?().")).alias("n"), i.alias("i"), _trim(w, "\"'`,?().").alias("w"))), lambda x: is_identifier(x.getField("w")))
    return F.array_max(found).getField("w")


def config_key_hint(text: Column) -> Column:
    """The word after the first ``setting`` or ``variable``, an ``of`` between them left out; null if there is none."""
    low = _words(F.lower(text))
    at = F.array_min(F.filter(F.transform(low, lambda w, i: F.when(w.isin("setting", "variable"), i)), lambda i: i.isNotNull()))
    after = at + F.when(F.get(low, at + 1) == "of", 2).otherwise(1)
    return F.when(at.isNotNull(), F.regexp_replace(F.get(_words(text), after), r"^\?+|\?+$", ""))


def classify(questions: DataFrame, text: str) -> DataFrame:
    """``questions`` with ``query_type, confidence, competing, terms, path_hints, symbol_hint, config_key``.

    The first rule that applies gives the type: a request for one path, the
    phrases in their order, a bare identifier of at most three words. Other types
    whose phrases occur are ``competing``, and make High a Medium. Phrases count
    inside words (``adr`` in address). None gives GENERIC_SEARCH and Low; a null
    text gives nulls.
    """
    t = F.col(text)
    low, hints = F.lower(t), F.col("path_hints")
    asks = F.transform(_words(t), lambda w: _trim(w, "\"'`,?:;"))
    path_only = (F.size("path_hints") == 1) & F.forall(asks, lambda w: (w == F.get(hints, 0)) | F.lower(w).isin(*PATH_LOOKUP_WORDS))
    matched = lambda kind, words: _any([low.contains(w) for w in words] + ([low.startswith(w) for w in DEFINITION_OPENINGS] if kind == "DEFINITION" else []))
    rules = [F.when(path_only, F.lit("EXACT_LOOKUP"))] + [F.when(matched(kind, words), F.lit(kind)) for kind, _, words in RULES]
    out = questions.withColumns({"terms": search_terms(t), "path_hints": path_hints(t), "symbol_hint": symbol_hint(t), "config_key": config_key_hint(t)})
    out = out.withColumn("_hits", F.filter(F.array(*rules), lambda x: x.isNotNull()))
    bare = (F.size("path_hints") == 0) & (F.size(_words(t)) <= 3) & F.col("symbol_hint").isNotNull()
    first = F.get("_hits", 0)
    kind = F.when(first.isNotNull(), first).when(bare, "DEFINITION").otherwise("GENERIC_SEARCH")
    level = F.when(first.isNull(), F.when(bare, "Medium").otherwise("Low")).when(first == "ARCHITECTURE", "Medium").when(F.size("_hits") > 1, "Medium").otherwise("High")
    return out.withColumns({"query_type": F.when(t.isNotNull(), kind), "confidence": F.when(t.isNotNull(), level), "competing": F.slice("_hits", 2, 16)}).drop("_hits")


#: How well an origin of evidence fits a type of question: fts, path, symbol, structural, relationship, knowledge (fixed values).
ORIGINS = ("fts", "path", "symbol", "structural", "relationship", "knowledge")
ORIGIN_INTENT = {
    "EXACT_LOOKUP": (0.5, 1.0, 1.0, 0.7, 0.3, 0.1),
    "DEFINITION": (0.5, 1.0, 1.0, 0.7, 0.3, 0.1),
    "SYMBOL_NAVIGATION": (0.5, 0.4, 1.0, 0.6, 0.9, 0.1),
    "CONFIGURATION": (0.8, 1.0, 0.3, 0.3, 0.2, 0.5),
    "ARCHITECTURE": (0.7, 0.4, 0.6, 0.9, 0.7, 0.9),
    "DEBUGGING": (0.8, 0.4, 0.6, 0.7, 0.6, 0.6),
    "IMPACT": (0.5, 0.4, 0.9, 0.7, 1.0, 0.2),
    "DEPENDENCY": (0.6, 0.4, 0.6, 0.5, 1.0, 0.4),
    "CROSS_REPO": (0.6, 0.4, 0.6, 0.5, 1.0, 0.4),
    "TEST_BEHAVIOR": (0.8, 0.5, 0.6, 0.5, 0.4, 0.5),
    "KNOWLEDGE": (0.7, 0.4, 0.3, 0.2, 0.2, 1.0),
    "GENERIC_SEARCH": (1.0, 0.8, 0.8, 0.6, 0.5, 0.6),
}


def origin_intent(query_type: Column, origin: Column) -> Column:
    """How well evidence of an origin fits a type of question; evidence from other repositories counts as relationships."""
    table = F.create_map(*[F.lit(x) for k, vs in ORIGIN_INTENT.items() for o, v in zip(ORIGINS, vs) for x in (f"{k}/{o}", v)])
    return table[F.concat_ws("/", query_type, F.when(origin == "cross_repo", "relationship").otherwise(origin))]


#: Evidence that a type of question requires or prefers: name, kinds of source (fixed values).
REQUIREMENTS = {
    "DEFINITION": ([("definition", ("SOURCE_CODE", "GENERATED_SOURCE"))], [("symbol_occurrence", ("SOURCE_CODE",)), ("implementation_span", ("SOURCE_CODE",))]),
    "EXACT_LOOKUP": ([("file_content", ("SOURCE_CODE", "CONFIGURATION", "DOCUMENTATION", "KNOWLEDGE", "TEST"))], [("structural_outline", ("SOURCE_CODE",))]),
    "SYMBOL_NAVIGATION": ([("symbol_occurrence", ("SOURCE_CODE",))], [("call_relationship", ("RELATIONSHIP",)), ("import", ("SOURCE_CODE",))]),
    "CONFIGURATION": ([("config_value", ("CONFIGURATION",))], [("config_schema", ("SOURCE_CODE", "DOCUMENTATION")), ("knowledge_note", ("KNOWLEDGE",))]),
    "ARCHITECTURE": ([("implementation", ("SOURCE_CODE",))], [("knowledge_architecture", ("KNOWLEDGE",)), ("test_expectation", ("TEST",)), ("configuration", ("CONFIGURATION",)), ("caller_chain", ("RELATIONSHIP",))]),
    "DEBUGGING": ([("implementation", ("SOURCE_CODE",))], [("test_expectation", ("TEST",)), ("error_handling_span", ("SOURCE_CODE",)), ("configuration", ("CONFIGURATION",)), ("knowledge_note", ("KNOWLEDGE",)), ("dependency_chain", ("RELATIONSHIP",))]),
    "IMPACT": ([("definition", ("SOURCE_CODE", "GENERATED_SOURCE"))], [("callers", ("RELATIONSHIP", "SOURCE_CODE")), ("dependents", ("RELATIONSHIP",)), ("test_coverage", ("TEST",))]),
    "DEPENDENCY": ([("dependency_declaration", ("CONFIGURATION", "SOURCE_CODE", "RELATIONSHIP"))], [("transitive_dependency", ("RELATIONSHIP",)), ("build_config", ("CONFIGURATION",))]),
    "CROSS_REPO": ([("dependency_declaration", ("CONFIGURATION", "SOURCE_CODE", "RELATIONSHIP"))], [("transitive_dependency", ("RELATIONSHIP",)), ("build_config", ("CONFIGURATION",))]),
    "KNOWLEDGE": ([("knowledge_content", ("KNOWLEDGE", "DOCUMENTATION"))], [("related_source", ("SOURCE_CODE",)), ("related_config", ("CONFIGURATION",))]),
    "TEST_BEHAVIOR": ([("test_content", ("TEST",))], [("subject_implementation", ("SOURCE_CODE",)), ("test_fixture", ("TEST", "CONFIGURATION"))]),
    "GENERIC_SEARCH": ([], [("any", ("SOURCE_CODE", "TEST", "CONFIGURATION", "KNOWLEDGE"))]),
}


def requirements(spark) -> DataFrame:
    """``query_type, requirement, required, source_type, min_count``: the requirements as a relation, one row per kind of source that meets one."""
    rows = [(k, name, side == 0, source, 1) for k, sides in REQUIREMENTS.items() for side, needs in enumerate(sides) for name, sources in needs for source in sources]
    return spark.createDataFrame(rows, "query_type string, requirement string, required boolean, source_type string, min_count int")


def satisfaction(evidence: DataFrame, needs: DataFrame) -> DataFrame:
    """``query_id, query_type, requirement, required, n, satisfied``: how much evidence meets each requirement of each question, whether any does or not.

    ``evidence`` has ``query_id, query_type, source_type``; it is counted per
    kind of source first, so the join has a row per question and kind.
    """
    counted = evidence.groupBy("query_id", "query_type", "source_type").agg(F.count("*").alias("n"))
    asked = evidence.select("query_id", "query_type").distinct().join(needs, "query_type")
    met = asked.join(counted, ["query_id", "query_type", "source_type"], "left").groupBy("query_id", "query_type", "requirement", "required").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.max("min_count").alias("least"))
    return met.select("query_id", "query_type", "requirement", "required", "n", (F.col("n") >= F.col("least")).alias("satisfied"))


def broader_terms(snippets: DataFrame, by: list[str], order: list[str], top: int = 5, most: int = 4) -> DataFrame:
    """``by, terms``: up to ``most`` words of four or more characters from the first six words of each group's ``top`` snippets, in lower case, each once."""
    from pyspark.sql import Window as W

    ranked = snippets.withColumn("_place", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_place") <= top)
    words = F.transform(F.slice(_words(F.col("snippet")), 1, 6), lambda w: F.lower(F.regexp_replace(w, r"[^A-Za-z0-9_]", "")))
    each = ranked.select(*by, "_place", F.filter(words, lambda w: F.length(w) >= 4).alias("_words"))
    grouped = each.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_place", "_words"))).alias("_all"))  # at most ``top`` rows
    return grouped.select(*by, F.slice(F.array_distinct(F.flatten(F.transform("_all", lambda x: x.getField("_words")))), 1, most).alias("terms"))


#: Ways to widen a search, by type of question, in order (fixed values).
FALLBACKS = {
    "DEFINITION": ("broader", "verify"), "EXACT_LOOKUP": ("broader", "verify"), "SYMBOL_NAVIGATION": ("graph", "broader"), "CONFIGURATION": ("broader", "knowledge", "verify"),
    "ARCHITECTURE": ("graph", "knowledge", "broader", "verify"), "DEBUGGING": ("verify", "graph", "knowledge", "broader"), "IMPACT": ("graph", "broader"), "DEPENDENCY": ("graph", "broader"),
    "CROSS_REPO": ("graph", "broader"), "KNOWLEDGE": ("knowledge", "broader"), "TEST_BEHAVIOR": ("broader", "verify"), "GENERIC_SEARCH": ("broader", "knowledge"),
}
CURRENT_ONLY = ("DEFINITION", "EXACT_LOOKUP", "CONFIGURATION", "DEBUGGING")


def next_fallback(query_type: Column, used: Column, has_stale: Column, has_entities: Column, has_unverified: Column) -> Column:
    """The next way to widen a search, null if none is left: each at most once, in the type's order.

    Where only current evidence counts and some is stale, verification comes
    first. The graph needs an entity to start from, verification something that
    is unverified or not current.
    """
    table = F.create_map(*[x for k, ways in FALLBACKS.items() for x in (F.lit(k), F.array(*map(F.lit, ways)))])
    open_ = F.filter(table[query_type], lambda w: ~F.array_contains(used, w) & ((w != "graph") | has_entities) & ((w != "verify") | has_unverified | has_stale))
    first = query_type.isin(*CURRENT_ONLY) & has_stale & ~F.array_contains(used, "verify")
    return F.when(first, "verify").otherwise(F.get(open_, 0))
