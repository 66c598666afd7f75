"""Queries of the text and code operators over the corpus tables, each over its whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftgrain.llm import handwritten, leakage, packing, parsing, secrets, sentences, splitting, terms
from siftgrain.llm.sql import SQL  # noqa: F401
from siftgrain.sources.tables import read_table


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return parsing.with_paths(read_table(spark, sf, "file_contents", "file_occurrence_id", "content"), read_table(spark, sf, "file_occurrences", "id", "path", "repository_id"))


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents", "doc_id", "text")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return parsing.unparsable(_files(spark, sf))


def p1_parse_rates(spark: SparkSession, sf: str) -> DataFrame:
    return parsing.parse_rates(_files(spark, sf))


def _pieces(spark: SparkSession, sf: str) -> DataFrame:
    units = read_table(spark, sf, "retrieval_units", "id", "analyzer_id", "retrieval_text", "start_line")
    return splitting.split_oversized(units, read_table(spark, sf, "split_limits", "analyzer_id", "max_bytes", "overlap_bytes"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    # the second piece of a unit says that the unit was cut
    return _pieces(spark, sf).where("piece_no = 1").select("unit_id")


def p3_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return _pieces(spark, sf)


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    units = read_table(spark, sf, "retrieval_units", "id", "retrieval_text")
    n = units.where(F.col("id").isNotNull()).select("id").distinct().count()
    return terms.log_entropy(terms.term_frequencies(units), n)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf).where("tf >= 3 AND df BETWEEN 2 AND 4").select("unit_id", "term")


def p4_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.credential_lines(read_table(spark, sf, "retrieval_units", "id", "retrieval_text"))


def p6_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.redact_units(read_table(spark, sf, "retrieval_units", "id", "retrieval_text"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return handwritten.not_handwritten(_files(spark, sf))


def p7_reasons(spark: SparkSession, sf: str) -> DataFrame:
    flagged = handwritten.classify(_files(spark, sf)).where("not_handwritten").dropDuplicates(["file_occurrence_id"])
    return flagged.groupBy("repository_id", "reasons").agg(F.count("*").alias("n_files"))


def p7_validation(spark: SparkSession, sf: str) -> DataFrame:
    return handwritten.validate(_files(spark, sf))


def p8_windows(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf))


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    return packing.fill_report(packing.pack_documents(_documents(spark, sf)))


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaked_items(_documents(spark, sf), read_table(spark, sf, "eval_items", "item_id", "item_text"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf)


def p9_item_counts(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leak_counts(_leaks(spark, sf))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.split_sentences(_documents(spark, sf), starts=False)


def p10_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.split_sentences(_documents(spark, sf))


QUERIES = {f.__name__: f for f in (
    p1_found, p1_parse_rates, p3_found, p3_pieces, p4_found, p4_scores, p6_found, p6_redacted, p7_found, p7_reasons, p7_validation, p8_windows, p8_fill, p9_found, p9_item_counts, p10_found, p10_sentences,
)}
