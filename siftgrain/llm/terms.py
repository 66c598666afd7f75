"""How distinctive a term is of a record: log-entropy weighting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def term_frequencies(records: DataFrame, key: str = "id", text: str = "retrieval_text", least_length: int = 5) -> DataFrame:
    """``unit_id, term, tf``. A term is a maximal run of letters and digits, lower-cased, that begins with a letter and has ``least_length`` characters.

    Redelivered records count once. The text is shuffled by key once; the
    counting of a record's terms then needs no shuffle of its own.
    """
    one = records.where(F.col(key).isNotNull()).select(F.col(key).alias("unit_id"), F.col(text).alias("t")).groupBy("unit_id").agg(F.first("t", ignorenulls=True).alias("t"))
    runs = F.expr(r"regexp_extract_all(t, '(?<![\\p{L}\\p{N}])\\p{L}[\\p{L}\\p{N}]{%d,}', 0)" % (least_length - 1))
    return one.select("unit_id", F.explode(runs).alias("run")).groupBy("unit_id", F.lower("run").alias("term")).agg(F.count("*").cast("int").alias("tf"))


def log_entropy(frequencies: DataFrame, n_records: int) -> DataFrame:
    """``unit_id, term, tf, df, score`` from ``unit_id, term, tf``.

    score = ln(1 + tf) * (1 - H / ln N), H the entropy of the term's spread over
    the records that have it: ln gf - sum(tf ln tf) / gf. A term of one record
    only has H = 0 and full weight; one spread evenly over all records has none.
    ``n_records`` is N; with fewer than two records the weight is 1. The term
    aggregate combines before its shuffle, so a term that all records have is a
    few partial rows; the join back is by term, where a hot term's rows are
    split by adaptive skew handling.
    """
    spread = frequencies.groupBy("term").agg(
        F.count("*").alias("df"), F.sum("tf").alias("gf"), F.sum(F.col("tf") * F.log(F.col("tf").cast("double"))).alias("s")
    )
    entropy = F.log(F.col("gf").cast("double")) - F.col("s") / F.col("gf")
    weight = F.lit(1.0) if n_records < 2 else 1 - entropy / F.log(F.lit(float(n_records)))
    weights = spread.select("term", "df", weight.alias("weight"))
    return frequencies.join(weights, "term").select("unit_id", "term", "tf", "df", F.round(F.log(1.0 + F.col("tf")) * F.col("weight"), 6).alias("score"))
