"""Evidence: intent of a question, fusion, ranking, validation, contradictions, claims and context under a budget."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SIGNALS = ("lexical", "symbol", "intent", "repo", "freshness", "structural", "relationship", "knowledge", "test")
#: Weights of the signals by kind of question (fixed values).
WEIGHTS = {
    "EXACT_LOOKUP": (1.5, 3, 2, 0.5, 2, 0.5, 0, 0, 0),
    "DEFINITION": (1.5, 3, 2, 0.5, 2, 0.5, 0, 0, 0),
    "SYMBOL_NAVIGATION": (1, 2.5, 2, 0.5, 1, 0.5, 2.5, 0, 0),
    "CONFIGURATION": (1.5, 0.5, 2, 0.5, 2, 0, 0, 1.5, 0),
    "ARCHITECTURE": (1.5, 1, 2, 0.5, 1, 1.5, 1, 2, 1),
    "DEBUGGING": (1.5, 1, 2, 0.5, 1.5, 1, 1, 1.5, 2),
    "IMPACT": (1, 2, 2, 0.5, 1, 1, 2.5, 0, 1.5),
    "DEPENDENCY": (1, 1, 2, 1, 1, 0.5, 3, 0.5, 0),
    "CROSS_REPO": (1, 1, 2, 1, 1, 0.5, 3, 0.5, 0),
    "TEST_BEHAVIOR": (1.5, 1, 2, 0.5, 1, 0.5, 0.5, 0.5, 3),
    "KNOWLEDGE": (1.5, 0.5, 2, 0.5, 1, 0, 0, 3, 0),
    "GENERIC_SEARCH": (2.5, 1, 1, 0.5, 1, 0.5, 0.5, 0.5, 0.5),
}
FRESHNESS_SCORE = {"CURRENT": 1.0, "STALE": 0.4, "UNKNOWN": 0.3, "INVALID": 0.0, "PENDING_REFRESH": 0.75}

def saturate(x: Column) -> Column:
    """A raw score in [0, 1): x / (x + 3)."""
    return F.greatest(x, F.lit(0.0)) / (F.greatest(x, F.lit(0.0)) + 3.0)


def fuse(candidates: DataFrame, signals: tuple[str, ...] = ("lexical", "symbol", "structural")) -> DataFrame:
    """Candidates of one ``fusion_key`` as one: the most confident (then least id) stands for all, signals are maxima, sources a set, confidence 0.85 conf + 0.05 per source (3 at most), below 0.99."""
    best = F.min(F.struct((-F.col("confidence")).alias("c"), "candidate_id")).getField("candidate_id")
    grouped = candidates.groupBy("fusion_key").agg(
        best.alias("candidate_id"), F.max("confidence").alias("best_confidence"), F.array_sort(F.collect_set("retriever")).alias("retrievers"), *[F.max(s).alias(s) for s in signals]
    )
    fused = F.least(F.greatest(0.85 * F.col("best_confidence") + 0.05 * F.least(F.size("retrievers"), F.lit(3)), F.lit(0.0)), F.lit(0.99))
    return grouped.withColumn("confidence", F.round(fused, 6)).drop("best_confidence")


def rank_score(kind: str, values: dict[str, Column]) -> Column:
    """Sum of weight times signal over the sum of weights; a missing signal counts in the denominator."""
    weights = {s: float(w) for s, w in zip(SIGNALS, WEIGHTS[kind]) if w}
    clamp = lambda v: F.least(F.greatest(F.coalesce(F.nanvl(v.cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    total = sum(weights.values())
    return F.round(reduce(lambda a, b: a + b, [F.lit(w) * clamp(values[s]) for s, w in weights.items() if s in values], F.lit(0.0)) / total, 6)


def typed_score(query_type: Column, values: dict[str, Column]) -> Column:
    """As rank_score, where every row has its own type of question."""
    clamp = lambda v: F.least(F.greatest(F.coalesce(F.nanvl(v.cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    weight = lambda i: F.create_map(*[F.lit(x) for k, ws in WEIGHTS.items() for x in (k, float(ws[i]))])[query_type]
    total = F.create_map(*[F.lit(x) for k, ws in WEIGHTS.items() for x in (k, float(sum(ws)))])[query_type]
    return F.round(reduce(lambda a, b: a + b, [weight(SIGNALS.index(s)) * clamp(v) for s, v in values.items()], F.lit(0.0)) / total, 6)


def freshness_score(state: Column) -> Column:
    pairs = [F.lit(x) for pair in FRESHNESS_SCORE.items() for x in pair]
    return F.create_map(*pairs)[state]


def verdict(provenance: Column, freshness: Column, start: Column, end: Column, resolution: Column, confidence: Column, current_only: bool) -> Column:
    """Why evidence is dropped, or ``context_only`` or ``counts``; the first rule that applies."""
    allowed = freshness == "CURRENT" if current_only else freshness.isin("CURRENT", "STALE", "PENDING_REFRESH")
    return (
        F.when(provenance.isNull() | (provenance == ""), "MISSING_PROVENANCE")
        .when(freshness == "INVALID", "INVALID_SOURCE")
        .when(start.isNotNull() & end.isNotNull() & (start >= end), "BAD_SPAN")
        .when(confidence >= 1.0, "OVERCONFIDENT")
        .when(~F.coalesce(allowed, F.lit(False)), "FRESHNESS")
        .when(resolution == "SYNTACTIC", "context_only")
        .otherwise("counts")
    )


def edge_verdict(resolution: Column, confidence: Column, floor: float) -> Column:
    """How a relationship counts as evidence: below the floor not at all, unresolved only as context, certain ones are not believed."""
    return (
        F.when((resolution != "SYNTACTIC") & (confidence < floor), "BELOW_RELATIONSHIP_FLOOR").when(resolution == "SYNTACTIC", "context_only").when(confidence >= 1.0, "OVERCONFIDENT").otherwise("counts")
    )


def adjacent_conflicts(rows: DataFrame, key: list[str], value: str, order: list[str]) -> DataFrame:
    """``key, before_id, id``: neighbours of one key, in order, whose values differ; a pair per change, never all pairs."""
    w = W.partitionBy(*key).orderBy(*order)
    seen = rows.withColumn("before_value", F.lag(value).over(w)).withColumn("before_id", F.lag("id").over(w))
    return seen.where(F.col("before_id").isNotNull() & (F.col("before_value") != F.col(value))).select(*key, "before_id", "id")


def stated_values(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` without ``text``, with ``key, value``: each distinct key = value or key: value that a line of the text states.

    Every line counts. Keys of more than three words, and empty keys and values,
    are none; quotes and commas around a value are no part of it.
    """
    trim = lambda c: F.regexp_replace(c, r"^[ \t\r\f]+|[ \t\r\f]+$", "")
    rest = [c for c in rows.columns if c != text]
    lines = rows.select(*rest, F.explode(F.split(text, "\n")).alias("line")).where(F.col("line").rlike("[=:]"))
    pairs = lines.select(*rest, trim(F.regexp_extract("line", r"(?s)^([^=:]*)[=:](.*)$", 1)).alias("key"), F.regexp_replace(trim(F.regexp_extract("line", r"(?s)^([^=:]*)[=:](.*)$", 2)), r"""^["',]+|["',]+$""", "").alias("value"))
    return pairs.where("key <> '' AND value <> ''").where(~(F.col("key").contains(" ") & F.col("key").rlike(r"[^ \t]+([ \t]+[^ \t]+){3}"))).distinct()


def conflicting_values(stated: DataFrame) -> DataFrame:
    """``key, before_id, id, before_path, path``: files next to each other by path and id that state one key with other values; keys in lower case. A file has all its values, ``stated`` has ``id, path, key, value``."""
    files = stated.groupBy(F.lower("key").alias("key"), "path", "id").agg(F.sort_array(F.collect_set("value")).alias("held"))
    w = W.partitionBy("key").orderBy("path", "id")
    seen = files.select("*", *[F.lag(c).over(w).alias(f"before_{c}") for c in ("id", "path", "held")])
    return seen.where((F.col("before_path") != F.col("path")) & (F.col("before_held") != F.col("held"))).select("key", "before_id", "id", "before_path", "path")


def denied_statements(said: DataFrame, held: DataFrame) -> DataFrame:
    """``repository_id, key, said_path, n_conflicts``: in how many paths of its repository ``held`` gives a key of ``said`` another value.

    Both have ``repository_id, path, key, value``. A path that begins the
    stating one (a file and the note beside it) is no conflict. The pairs are
    counted, never listed.
    """
    other = held.select("repository_id", "key", F.col("path").alias("held_path"), F.col("value").alias("held_value"))
    own = F.regexp_replace(F.regexp_replace("held_path", "/+$", ""), r"(\.md)+$", "")
    pairs = said.join(other, ["repository_id", "key"]).where((F.col("value") != F.col("held_value")) & ~F.col("path").startswith(own))
    return pairs.groupBy("repository_id", "key", F.col("path").alias("said_path")).agg(F.count_distinct("held_path").alias("n_conflicts"))


def floors(scored: DataFrame, by: list[str]) -> DataFrame:
    """Rows above the soft floor of their group with ``tier``: primary from max(0.65 top, 0.20), secondary from max(0.35 top, 0.15)."""
    top = F.max("score").over(W.partitionBy(*by))
    hard, soft = F.greatest(0.65 * F.col("top"), F.lit(0.20)), F.greatest(0.35 * F.col("top"), F.lit(0.15))
    return scored.withColumn("top", top).withColumn("tier", F.when(F.col("score") >= hard, "primary").when(F.col("score") >= soft, "secondary")).where(F.col("tier").isNotNull()).drop("top")


#: Candidates of one question in the deepest mode (fixed value).
MOST_CANDIDATES = 5000


def best_candidates(items: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows of each group: what a mode admits as candidates. The limit is part of the question, and makes the groups that are folded bounded."""
    place = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return items.withColumn("_place", place).where(F.col("_place") <= most)


def within_budget(items: DataFrame, by: list[str], size: str, budget: int, order: list[str], most: int = MOST_CANDIDATES) -> DataFrame:
    """``by, id``: items taken in order as long as they fit, one too large being skipped, not the end; a fold over each group's ordered array.

    Only the ``most`` first candidates of a group are looked at (its mode's
    limit), ranked before anything is collected; the fold keeps a running total
    and the ids taken.
    """
    arrays = best_candidates(items, by, order, most).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_place", F.col(size).cast("bigint").alias("size"), F.col("id")))).alias("all"))
    zero = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<string>").alias("kept"))
    step = lambda acc, x: F.when(
        acc.getField("used") + x.getField("size") <= budget,
        F.struct((acc.getField("used") + x.getField("size")).alias("used"), F.concat(acc.getField("kept"), F.array(x.getField("id").cast("string"))).alias("kept")),
    ).otherwise(acc)
    return arrays.select(*by, F.explode(F.aggregate("all", zero, step).getField("kept")).alias("id"))


def response_within(items: DataFrame, claims: DataFrame, by: list[str], size: str, budget: int, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(kept items, supported claims) of a response of at most ``budget`` bytes: items whole and in order up to the first that does not fit, and ``by, claim, n_all, n_kept`` of the claims that still have evidence (``claims`` has ``by, claim, id``)."""
    used = F.sum(size).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    kept = items.withColumn("_used", used).where(F.col("_used") <= budget).drop("_used")
    marked = claims.join(kept.select("id", F.lit(1).alias("_kept")).distinct(), "id", "left")
    return kept, marked.groupBy(*by, "claim").agg(F.count("*").alias("n_all"), F.count("_kept").alias("n_kept")).where("n_kept > 0")


def budget_result(insufficient: Column, limits_hit: Column) -> Column:
    """The result of an answer from whether its evidence is insufficient and the limits it hit, in order. Insufficient with any limit hit counts as degraded by time."""
    first = F.get(limits_hit, 0)
    return (
        F.when(insufficient & first.isNotNull(), "DEGRADED_BY_TIME").when(insufficient, "INSUFFICIENT_EVIDENCE").when(first.isNull(), "COMPLETED_WITHIN_BUDGET")
        .when(first == "max_candidates", "DEGRADED_BY_CANDIDATES").when(first.isin("max_fs_files", "max_fs_bytes"), "DEGRADED_BY_FS_BUDGET").otherwise("DEGRADED_BY_TIME")
    )


def verify_claims(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """``claim_id, status``: SUPPORTED if all its evidence exists and is current, WITH_DISCLOSURE if some is stale, REJECTED if any is missing or invalid or it has none."""
    refs = claims.select("claim_id", F.explode_outer("evidence_ids").alias("id")).join(evidence.select("id", "freshness_state"), "id", "left")
    bad = F.max(F.when(F.col("freshness_state").isNull() | (F.col("freshness_state") == "INVALID"), 1).otherwise(0))
    stale = F.max(F.when(F.col("freshness_state") != "CURRENT", 1).otherwise(0))
    return refs.groupBy("claim_id").agg(F.when(bad == 1, "REJECTED").when(stale == 1, "WITH_DISCLOSURE").otherwise("SUPPORTED").alias("status"))


def quality(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """``query_id, recall_at_k, reciprocal_rank, ndcg_at_k``. ``ranked`` has ``query_id, item, place``, ``relevant`` has ``query_id, item, rel``; gain is linear, ideal the relevant items by rel; recall is hit or miss on rel 3."""
    joined = ranked.join(relevant, ["query_id", "item"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    got = joined.groupBy("query_id").agg(
        F.max(F.when((F.col("place") <= k) & (F.col("rel") >= 3), 1.0).otherwise(0.0)).alias("recall_at_k"),
        F.coalesce(F.max(F.when(F.col("rel") >= 3, 1.0 / F.col("place"))), F.lit(0.0)).alias("reciprocal_rank"),
        F.sum(F.when(F.col("place") <= k, F.col("rel") / F.log2(F.col("place") + 1.0)).otherwise(0.0)).alias("dcg"),
    )
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("rel"), "item"))
    ideal = relevant.withColumn("p", place).where(F.col("p") <= k).groupBy("query_id").agg(F.sum(F.col("rel") / F.log2(F.col("p") + 1.0)).alias("ideal"))
    ndcg = F.when(F.coalesce("ideal", F.lit(0.0)) > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0)
    return got.join(ideal, "query_id", "left").select("query_id", "recall_at_k", F.round("reciprocal_rank", 6).alias("reciprocal_rank"), F.round(ndcg, 6).alias("ndcg_at_k"))


#: Evidence kinds that a question requires and prefers, its freshness, least confidence and fallbacks (fixed values).
CONTRACTS = {
    "DEFINITION": (("SOURCE_CODE", "GENERATED_SOURCE"), "CURRENT_ONLY", None, ("broader", "verify"), 2, 20),
    "EXACT_LOOKUP": (("SOURCE_CODE", "CONFIGURATION", "DOCUMENTATION", "KNOWLEDGE", "TEST"), "CURRENT_ONLY", None, ("broader", "verify"), 2, 10),
    "SYMBOL_NAVIGATION": (("SOURCE_CODE",), "CURRENT_OR_STALE", 0.6, ("graph", "broader"), 2, 30),
    "CONFIGURATION": (("CONFIGURATION",), "CURRENT_ONLY", None, ("broader", "knowledge", "verify"), 2, 20),
    "ARCHITECTURE": (("SOURCE_CODE",), "CURRENT_OR_STALE", 0.5, ("graph", "knowledge", "broader", "verify"), 3, 50),
    "DEBUGGING": (("SOURCE_CODE",), "CURRENT_ONLY", 0.5, ("verify", "graph", "knowledge", "broader"), 3, 50),
    "IMPACT": (("SOURCE_CODE", "GENERATED_SOURCE"), "CURRENT_OR_STALE", 0.5, ("graph", "broader"), 2, 40),
    "DEPENDENCY": (("CONFIGURATION", "SOURCE_CODE", "RELATIONSHIP"), "CURRENT_OR_STALE", 0.6, ("graph", "broader"), 2, 30),
    "CROSS_REPO": (("CONFIGURATION", "SOURCE_CODE", "RELATIONSHIP"), "CURRENT_OR_STALE", 0.6, ("graph", "broader"), 2, 30),
    "KNOWLEDGE": (("KNOWLEDGE", "DOCUMENTATION"), "CURRENT_OR_STALE", None, ("knowledge", "broader"), 1, 20),
    "TEST_BEHAVIOR": (("TEST",), "CURRENT_OR_STALE", None, ("broader", "verify"), 2, 30),
    "GENERIC_SEARCH": ((), "ANY", None, ("broader", "knowledge"), 1, 50),
}


def sufficiency(evidence: DataFrame, required: DataFrame) -> DataFrame:
    """``query_id, query_type, satisfied``: whether each question has evidence of a kind its contract requires. ``evidence`` has ``query_id, query_type, source_type``, ``required`` ``query_type, source_type``."""
    needs = required.groupBy("query_type").agg(F.collect_set("source_type").alias("kinds"))
    seen = evidence.groupBy("query_id", "query_type").agg(F.collect_set("source_type").alias("have"))
    return seen.join(needs, "query_type", "left").select("query_id", "query_type", (F.col("kinds").isNull() | F.arrays_overlap("kinds", "have")).alias("satisfied"))


def section_caps(ranked: DataFrame, by: list[str], primary: str, order: list[str], most: int = MOST_CANDIDATES) -> DataFrame:
    """``by, id`` kept per section: the primary section uncapped, another at most two while no other has been served, else one. Order-dependent, so a fold over the ordered array of each group's ``most`` best candidates."""
    rest = (F.col("section") != primary).cast("int")
    arrays = best_candidates(ranked.withColumn("_rest", rest), by, ["_rest", *order, "id"], most).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_place", "id", "section"))).alias("all"))
    zero = F.struct(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>")).alias("served"), F.array().cast("array<string>").alias("kept"))
    had = lambda acc, s: F.coalesce(acc.getField("served")[s], F.lit(0))
    others = lambda acc, s: F.size(F.filter(F.map_keys(acc.getField("served")), lambda k: (k != s) & (k != primary)))
    take = lambda acc, x: F.struct(
        F.map_concat(F.map_filter(acc.getField("served"), lambda k, _: k != x.getField("section")), F.create_map(x.getField("section"), had(acc, x.getField("section")) + 1)).alias("served"),
        F.concat(acc.getField("kept"), F.array(x.getField("id"))).alias("kept"),
    )
    fits = lambda acc, x: (x.getField("section") == primary) | (had(acc, x.getField("section")) < F.when(others(acc, x.getField("section")) == 0, 2).otherwise(1))
    return arrays.select(*by, F.explode(F.aggregate("all", zero, lambda acc, x: F.when(fits(acc, x), take(acc, x)).otherwise(acc)).getField("kept")).alias("id"))


def derive_claims(evidence: DataFrame, by: list[str], most: int = 12) -> DataFrame:
    """``by, claim, evidence_ids``: one sentence per distinct thing the evidence shows, at most ``most`` per question by confidence."""
    claim = (
        F.when(F.col("source_type") == "CONFIGURATION", F.format_string("%s configures it", "path")).when(F.col("source_type") == "TEST", F.format_string("%s tests it", "path"))
        .when(F.col("source_type").isin("KNOWLEDGE", "DOCUMENTATION"), F.format_string("%s describes it", "path")).otherwise(F.format_string("%s implements it", "path"))
    )
    grouped = evidence.groupBy(*by, claim.alias("claim")).agg(F.max("confidence").alias("confidence"), F.array_sort(F.collect_set("id")).alias("evidence_ids"))
    place = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("confidence"), "claim"))
    return grouped.withColumn("place", place).where(F.col("place") <= most).select(*by, "claim", "evidence_ids")
