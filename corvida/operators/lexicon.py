"""Sentiment lexicons: scores of terms seen in documents beside the scores of a known lexicon."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: a term's score on the axis, -1 to 1, becomes -5 to 5.
LINEAR = 5


def linear_scores(occurrences: DataFrame) -> DataFrame:
    """term, total_doc_count, axis_score (positive less negative share), linear_score, of (doc_id, term, sentiment)."""
    net = F.count_if(F.col("sentiment") == "positive") - F.count_if(F.col("sentiment") == "negative")
    out = occurrences.where("sentiment is not null").groupBy("term").agg(F.count_distinct("doc_id").alias("total_doc_count"), F.round(net / F.count(F.lit(1)), 6).alias("axis_score"))
    return out.withColumn("linear_score", F.round(LINEAR * F.col("axis_score"), 6))


def beside_known(scores: DataFrame, known: DataFrame) -> DataFrame:
    """scores with the known score (0 if there is none), whether the term is novel, whether the signs
    conflict, and how far the score of a known term moved."""
    both = scores.join(known.select("term", "known_score"), "term", "left").withColumn("known_score", F.coalesce("known_score", F.lit(0)).cast("double"))
    novel = F.col("known_score") == 0
    return both.select(
        "*",
        novel.alias("novel"),
        (F.col("known_score") * F.col("linear_score") < 0).alias("conflict"),
        F.when(novel, 0.0).otherwise(F.round(F.abs(F.col("known_score") - F.col("linear_score")), 6)).alias("change"),
    )
