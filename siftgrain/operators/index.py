"""An inverted index: postings in buckets of terms, with positions, and the statistics of each repository; searched without reading any text."""

from __future__ import annotations

import re
from functools import reduce
from zlib import crc32

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftgrain.functions.text import fold_word, tokens
from siftgrain.operators.lexical import B, K1
from siftgrain.plans.matchquery import Node, parse, positive_terms

#: Folders that postings are spread over by their term.
BUCKETS = 32


def all_terms(node: Node) -> list[str]:
    """Every term of an expression, each once."""
    if node.op == "phrase":
        return list(dict.fromkeys(node.parts))
    return list(dict.fromkeys(t for part in node.parts for t in all_terms(part)))


def folded_query(node: Node) -> Node:
    """The expression with diacritics folded, as the index's terms are."""
    if node.op == "phrase":
        return Node("phrase", [x for t in node.parts for x in re.findall(r"[^\W_]+", fold_word(t))])
    return Node(node.op, [folded_query(p) for p in node.parts])


def postings(units: DataFrame) -> DataFrame:
    """``term, unit_id, repository_id, tf, positions, dl`` of units ``unit_id, repository_id, text``; diacritics are folded, positions count from 0. A unit's own terms are grouped, so no group is larger than a unit."""
    split = units.withColumn("_tokens", tokens(F.col("text"), fold=True)).withColumn("dl", F.size("_tokens"))
    at = split.select("unit_id", "repository_id", "dl", F.posexplode("_tokens").alias("position", "term"))
    return at.groupBy("term", "unit_id", "repository_id", "dl").agg(F.count("*").cast("int").alias("tf"), F.sort_array(F.collect_list("position")).alias("positions"))


def build(units: DataFrame, folder: str, buckets: int = BUCKETS) -> None:
    """Writes the index of ``units`` (``unit_id, repository_id, text`` and what searches are to return) to ``folder``.

    ``postings`` lie in one folder per bucket of terms, sorted by term, so that a
    search reads a few row groups; ``units`` has everything but the texts, and a
    hash of each text; ``stats`` one row per repository.
    """
    split = units.withColumn("dl", F.size(tokens(F.col("text"), fold=True))).withColumn("canonical_hash", F.sha2("text", 256))
    split.drop("text").write.mode("overwrite").parquet(f"{folder}/units")
    known = units.sparkSession.read.parquet(f"{folder}/units")
    known.groupBy("repository_id").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).write.mode("overwrite").parquet(f"{folder}/stats")
    rows = postings(units).withColumn("bucket", F.pmod(F.crc32("term"), F.lit(buckets)).cast("int"))
    rows.repartition("bucket", F.pmod(F.xxhash64("unit_id"), F.lit(8))).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")


def read_postings(spark: SparkSession, folder: str, terms: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The postings of some terms: only their buckets are listed, and the term is pushed into the scan."""
    wanted = sorted({crc32(t.encode()) % buckets for t in terms})
    return spark.read.parquet(f"{folder}/postings").where(F.col("bucket").isin(*wanted) & F.col("term").isin(*terms))


def _matches(node: Node, at: dict[str, Column]) -> Column:
    """Whether a unit matches, from its positions of each term."""
    if node.op == "phrase":
        first, rest = at[node.parts[0]], node.parts[1:]
        if not rest:
            return F.size(first) > 0
        return F.exists(first, lambda p: reduce(lambda a, b: a & b, [F.array_contains(at[t], p + k) for k, t in enumerate(rest, 1)]))
    if node.op == "not":
        return ~_matches(node.parts[0], at)
    parts = [_matches(p, at) for p in node.parts]
    return reduce((lambda a, b: a & b) if node.op == "and" else (lambda a, b: a | b), parts)


def _matches_nothing(node: Node) -> bool:
    """Whether a unit without any of the terms matches."""
    if node.op == "phrase":
        return False
    if node.op == "not":
        return not _matches_nothing(node.parts[0])
    return (all if node.op == "and" else any)(map(_matches_nothing, node.parts))


def score_units(spark: SparkSession, folder: str, query: str, implicit: str = "or", buckets: int = BUCKETS) -> DataFrame:
    """The matching units with ``score``: BM25 within their repository.

    Only the postings of the query's terms are read. They are grouped per unit
    (as many rows as units that have one of them); document frequencies are
    counted from the same postings over whole repositories, before any scope.
    Where a unit without any term matches, the index's units come in as well.
    """
    node = folded_query(parse(query, implicit))
    terms, scored = all_terms(node), positive_terms(node)
    found = read_postings(spark, folder, terms, buckets)
    none = F.array().cast("array<int>")
    column = lambda i: F.max(F.when(F.col("term") == terms[i], F.col("positions")))
    per_unit = found.groupBy("unit_id").agg(*[column(i).alias(f"p{i}") for i in range(len(terms))])
    frequency = found.groupBy("repository_id").agg(*[F.count(F.when(F.col("term") == t, 1)).alias(f"df{i}") for i, t in enumerate(terms)])
    known = spark.read.parquet(f"{folder}/units")
    joined = known.join(per_unit, "unit_id", "left" if _matches_nothing(node) else "inner")
    at = {t: F.coalesce(f"p{i}", none) for i, t in enumerate(terms)}
    hits = joined.where(_matches(node, at))
    stats = spark.read.parquet(f"{folder}/stats").join(frequency, "repository_id", "left").select(F.col("repository_id").alias("_of"), "n", "avgdl", *[F.coalesce(f"df{i}", F.lit(0)).alias(f"df{i}") for i in range(len(terms))])

    def part(i: int) -> Column:
        tf, df = F.size(at[terms[i]]), F.col(f"df{i}")
        weight = F.greatest(F.log((F.col("n") - df + 0.5) / (df + 0.5)), F.lit(1e-6))
        return F.when(tf > 0, weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))).otherwise(0.0)

    score = reduce(lambda a, b: a + b, [part(terms.index(t)) for t in scored], F.lit(0.0))
    return hits.join(stats, F.col("repository_id").eqNullSafe(F.col("_of"))).select(*known.columns, F.round(score, 6).alias("score"))


def refresh(spark: SparkSession, folder: str, target: str, changed: DataFrame, gone: DataFrame, buckets: int = BUCKETS) -> None:
    """Writes to ``target`` the index of ``folder`` with ``changed`` units put in and ``gone`` ones (``unit_id``) taken out; unchanged units are not tokenised again."""
    stale = changed.select("unit_id").union(gone.select("unit_id")).distinct()
    split = changed.withColumn("dl", F.size(tokens(F.col("text"), fold=True))).withColumn("canonical_hash", F.sha2("text", 256)).drop("text")
    spark.read.parquet(f"{folder}/units").join(stale, "unit_id", "left_anti").unionByName(split).write.mode("overwrite").parquet(f"{target}/units")
    spark.read.parquet(f"{target}/units").groupBy("repository_id").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).write.mode("overwrite").parquet(f"{target}/stats")
    new = postings(changed).withColumn("bucket", F.pmod(F.crc32("term"), F.lit(buckets)).cast("int"))
    kept = spark.read.parquet(f"{folder}/postings").join(stale, "unit_id", "left_anti")
    kept.unionByName(new).repartition("bucket", F.pmod(F.xxhash64("unit_id"), F.lit(8))).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/postings")
