"""Full-text search over units: postings, BM25, boolean matching, collapse, snippets, grep."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftgrain.functions.text import count_of, lines, tokens
from siftgrain.plans.matchquery import parse, positive_terms, predicate
from siftgrain.session import cut_lineage

#: BM25 constants of the literature.
K1, B = 1.2, 0.75
RRF = 60


def postings(units: DataFrame) -> DataFrame:
    """``term, unit_id, tf, first_position``: the inverted index, positions from 0. One shuffle, combined map-side."""
    at = units.select("unit_id", F.posexplode(tokens(F.col("text"))).alias("position", "term"))
    return at.groupBy("term", "unit_id").agg(F.count("*").cast("int").alias("tf"), F.min("position").alias("first_position"))


def corpus_stats(units: DataFrame) -> DataFrame:
    """``repository_id, n_units, n_tokens``: what BM25 needs to know of each repository."""
    return units.groupBy("repository_id").agg(F.count("*").alias("n_units"), F.sum(F.size(tokens(F.col("text")))).alias("n_tokens"))


def score_units(units: DataFrame, query: str, implicit: str = "or") -> DataFrame:
    """The matching units with ``score``, BM25 within their repository.

    The counts of the query's terms are taken per unit in one scan, so nothing
    but one small row per repository is aggregated and joined back; there is no
    shuffle of postings. Document frequencies are of the whole repository, never
    of a filtered part of it.
    """
    node = parse(query, implicit)
    terms = positive_terms(node)
    tf = lambda i: F.col(f"tf_{i}")
    counted = units.withColumn("tokens", tokens(F.col("text"))).withColumn("dl", F.size("tokens"))
    counted = counted.withColumns({f"tf_{i}": count_of(F.col("tokens"), t) for i, t in enumerate(terms)}).withColumn("matches", predicate(node, F.col("tokens"))).drop("tokens")
    # statistics and hits both read the counts, so texts are scanned once; only hits keep theirs
    counted = cut_lineage(counted.withColumn("text", F.when(F.col("matches"), F.col("text"))))
    stats = counted.groupBy(F.col("repository_id").alias("stats_of")).agg(
        F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count(F.when(tf(i) > 0, 1)).alias(f"df_{i}") for i in range(len(terms))]
    )
    part = lambda i: (
        F.greatest(F.log((F.col("n") - F.col(f"df_{i}") + 0.5) / (F.col(f"df_{i}") + 0.5)), F.lit(1e-6)) * tf(i) * (K1 + 1) / (tf(i) + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    )
    score = reduce(lambda a, b: a + b, [F.when(tf(i) > 0, part(i)).otherwise(0.0) for i in range(len(terms))], F.lit(0.0))
    keep = [c for c in units.columns]
    return counted.where("matches").join(stats, F.col("repository_id").eqNullSafe(F.col("stats_of"))).select(*keep, F.round(score, 6).alias("score"))


def search(units: DataFrame, query: str, k: int = 10, scope: Column | None = None, implicit: str = "or") -> DataFrame:
    """The best ``k`` units; scope and visibility are applied before the limit. Ties by unit id."""
    hits = score_units(units, query, implicit)
    hits = hits if scope is None else hits.where(scope)
    return hits.orderBy(F.desc("score"), "unit_id").limit(k)


def collapse(hits: DataFrame, alternates: int = 64) -> DataFrame:
    """Hits of equal text as one: the best, with the ids of up to ``alternates`` others and the number left out."""
    order = W.partitionBy("canonical_hash").orderBy(F.desc("score"), "unit_id")
    hashed = hits if "canonical_hash" in hits.columns else hits.withColumn("canonical_hash", F.sha2("text", 256))
    ranked = hashed.withColumn("place", F.row_number().over(order))
    return (
        ranked.groupBy("canonical_hash")
        .agg(
            F.min_by("unit_id", "place").alias("unit_id"),
            F.max("score").alias("score"),
            F.array_sort(F.collect_list(F.when((F.col("place") > 1) & (F.col("place") <= alternates + 1), F.col("unit_id")))).alias("also_in"),
            F.greatest(F.count("*") - 1 - alternates, F.lit(0)).alias("n_omitted"),
        )
        .drop("canonical_hash")
    )


def merge_repositories(hits: DataFrame, depth: int = 20) -> DataFrame:
    """Ranks of each repository merged by reciprocal rank; raw scores of different repositories are never compared."""
    rank = F.row_number().over(W.partitionBy("repository_id").orderBy(F.desc("score"), "unit_id"))
    return hits.withColumn("place", rank).where(F.col("place") <= depth).withColumn("rrf_score", F.round(1.0 / (RRF + F.col("place")), 9))


def term_diagnostics(units: DataFrame, terms: list[str]) -> DataFrame:
    """Of each term (at most six, as the caller gives them) how many units have it, also those that none has."""
    ts = list(dict.fromkeys(terms))[:6]
    counts = units.select(tokens(F.col("text")).alias("tokens")).agg(*[F.count(F.when(F.array_contains("tokens", t), 1)).alias(f"t{i}") for i, t in enumerate(ts)])
    pairs = F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"t{i}").alias("n_units")) for i, t in enumerate(ts)])
    return counts.select(F.inline(pairs))


def focused_snippet(text: Column, terms: list[str], around: int = 1, limit: int = 240) -> Column:
    """The lines around the first line with most of the terms, cut to ``limit`` characters."""
    rows = lines(text)
    hits = lambda line: reduce(lambda a, b: a + b, [F.when(F.array_contains(tokens(line), t), 1).otherwise(0) for t in terms])
    scored = F.transform(rows, lambda line, i: F.struct(hits(line).alias("n"), (-i).alias("at")))
    best = -F.array_max(scored).getField("at")
    first = F.greatest(best - around, F.lit(0))
    return F.substring(F.array_join(F.slice(rows, first + 1, best - first + 1 + around), "\n"), 1, limit)


def grep(units: DataFrame, pattern: str, regex: bool = False) -> DataFrame:
    """``unit_id, line_no, byte_column, line`` of each line that has the text or matches the expression; lines and columns from 1, columns in bytes."""
    rows = units.select("unit_id", F.posexplode(lines(F.col("text"))).alias("at", "line"))
    if regex:
        rows = rows.where(F.col("line").rlike(pattern)).withColumn("found", F.regexp_extract("line", f"^(.*?){pattern}", 1))
    else:
        rows = rows.where(F.col("line").contains(pattern)).withColumn("found", F.substring_index("line", pattern, 1))
    return rows.select("unit_id", (F.col("at") + 1).alias("line_no"), (F.octet_length("found") + 1).alias("byte_column"), "line")


def line_window(text: Column, first: int, n: int) -> Column:
    """Lines ``first`` (from 1) to ``first + n - 1`` of a text."""
    return F.array_join(F.slice(lines(text), first, n), "\n")


def pack_lines(text: Column, limit: int = 2000) -> Column:
    """Whole lines packed greedily into chunks of at most ``limit`` bytes: an array of (first line, lines), from line 0. A longer line is a chunk of its own."""
    sizes = F.transform(lines(text), lambda x: F.octet_length(x) + 1)
    chunk = "array<struct<first:int,n:int,size:int>>"
    start = F.array().cast(chunk)
    step = lambda acc, x: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1).getField("size") + x.getField("s") <= limit),
        F.concat(
            F.slice(acc, 1, F.size(acc) - 1),
            F.array(F.struct(F.element_at(acc, -1).getField("first").alias("first"), (F.element_at(acc, -1).getField("n") + 1).alias("n"), (F.element_at(acc, -1).getField("size") + x.getField("s")).alias("size"))),
        ),
    ).otherwise(F.concat(acc, F.array(F.struct(x.getField("i").alias("first"), F.lit(1).alias("n"), x.getField("s").alias("size")))))
    numbered = F.transform(sizes, lambda s, i: F.struct(s.alias("s"), i.alias("i")))
    return F.aggregate(numbered, start, lambda acc, x: step(F.when(F.size(acc) >= 0, acc), x).cast(chunk))
