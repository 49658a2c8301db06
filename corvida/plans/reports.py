"""Concept reports over the star tables: volume, sentiment, drivers, outliers, distinctive terms.

A report by subset or over time is one aggregate with more keys, never a loop over values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvida.functions import slices as S
from corvida.operators import concepts as C
from corvida.plans.star import SCORE_FIELDS, Star

TOP, LIST_KEYS = 10, ("list", "concept")
SUBSET = ("field", "value")
SLICE = ("start_date", "end_date", "iteration_counter", "range_type")


class Reports:
    """The shared inputs of all reports of one directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.star = Star(spark, sf_dir)
        self.spark = spark
        self.docs = self.star.docs()
        self.terms = self.star.terms()
        self.concepts = self.star.concept_terms()
        self.found = C.matches(self.terms, self.concepts)
        self.subsets = self.star.metadata().select("doc_id", *SUBSET)
        self.n_docs = self.star.table("orders").count()

    def listed(self) -> DataFrame:
        return C.matches(self.terms, self.star.list_terms(), LIST_KEYS)

    def with_sentiment(self) -> DataFrame:
        return C.first_sentiments(self.terms, self.concepts)

    def in_slices(self, kind: str, iterations: int = 7) -> DataFrame:
        """doc_id and the slices before the newest date."""
        end = self.docs.agg(F.max("date")).first()[0]
        table = S.slice_table(self.spark, S.time_slices(end, kind, iterations))
        return S.in_slices(self.docs.select("doc_id", "date"), table).drop("date")

    def scores(self, scope: DataFrame | None = None) -> DataFrame:
        """doc_id, driver_field, score (and the keys of a scope)."""
        rows = self.docs.select("doc_id", F.explode(F.array(*(F.struct(F.lit(f).alias("driver_field"), F.col(f).alias("score")) for f in SCORE_FIELDS))).alias("s"))
        rows = rows.select("doc_id", "s.driver_field", "s.score")
        return rows if scope is None else rows.join(scope, "doc_id")


def volume_top(r: Reports) -> DataFrame:
    return C.ranked(C.volume(r.found, None, r.n_docs), (), "relevance", TOP)


def volume_subsets(r: Reports) -> DataFrame:
    return C.ranked(C.volume(r.found, r.subsets, r.n_docs, SUBSET), SUBSET, "relevance", TOP)


def volume_subsets_all(r: Reports) -> DataFrame:
    """Of each field, over all documents that have a value of it; a document counts once."""
    scope = r.subsets.select("doc_id", "field").distinct()
    return C.ranked(C.volume(r.found, scope, r.n_docs, ("field",)), ("field",), "relevance", TOP).withColumn("value", F.lit("_all_"))


def volume_over_time(kind: str) -> Callable[[Reports], DataFrame]:
    return lambda r: C.ranked(C.volume(r.found, r.in_slices(kind), r.n_docs, SLICE), SLICE, "relevance", TOP)


def sentiment_top(r: Reports) -> DataFrame:
    return C.sentiment(r.with_sentiment())


def sentiment_subsets(r: Reports) -> DataFrame:
    return C.sentiment(r.with_sentiment(), r.subsets, SUBSET)


def sentiment_over_time(r: Reports) -> DataFrame:
    return C.sentiment(r.with_sentiment(), r.in_slices("M"), SLICE)


def drivers(r: Reports) -> DataFrame:
    return C.drivers(r.found, r.scores(), ("driver_field",))


def drivers_suggested(r: Reports) -> DataFrame:
    return C.ranked(C.drivers(r.found, r.scores(), ("driver_field",)), ("driver_field",), "importance", 100)


def drivers_subsets(r: Reports) -> DataFrame:
    return C.drivers(r.found, r.scores(r.subsets), ("driver_field", *SUBSET))


def drivers_over_time(r: Reports) -> DataFrame:
    return C.drivers(r.found, r.scores(r.in_slices("M")), ("driver_field", *SLICE))


def _outlier_scope(r: Reports, match_type: str, keys: tuple[str, ...], scope: DataFrame) -> DataFrame:
    """Coverage of each key: documents without any of the top concepts."""
    top = volume_top(r).select("concept")
    hits = r.found.join(F.broadcast(top), "concept", "left_semi")  # as many names as the top has
    out = C.uncovered(scope, hits, match_type).groupBy(*keys).agg(F.count_distinct("doc_id").alias("filter_count"))
    total = scope.groupBy(*keys).agg(F.count_distinct("doc_id").alias("document_count"))
    both = total.join(out, list(keys), "left") if keys else total.crossJoin(out)  # without keys: one row each
    count = F.coalesce("filter_count", F.lit(0)).cast("long")
    return both.select(*keys, F.lit(match_type).alias("match_type"), count.alias("filter_count"), "document_count", F.round(100 - 100 * count / F.col("document_count"), 4).alias("coverage"))


def outliers(match_type: str) -> Callable[[Reports], DataFrame]:
    def run(r: Reports) -> DataFrame:
        """Concepts of the documents that the top concepts leave out, and the coverage."""
        scope = r.docs.select("doc_id")
        top = volume_top(r).select("concept")
        out = C.uncovered(scope, r.found.join(F.broadcast(top), "concept", "left_semi"), match_type).withColumn("special", F.lit("outliers"))
        rows = C.ranked(C.unique_to(r.found, out, r.n_docs, ("special",)), ("special",), "g2", 20)
        return rows.crossJoin(F.broadcast(_outlier_scope(r, match_type, (), scope))).drop("total_count")  # one row of coverage

    return run


def outlier_subsets(r: Reports) -> DataFrame:
    return _outlier_scope(r, "both", SUBSET, r.subsets).unionByName(_outlier_scope(r, "exact", SUBSET, r.subsets))


def outliers_over_time(r: Reports) -> DataFrame:
    scope = r.in_slices("M")
    return _outlier_scope(r, "both", SLICE, scope).unionByName(_outlier_scope(r, "exact", SLICE, scope))


def unique_to_filter(r: Reports) -> DataFrame:
    return C.ranked(C.unique_to(r.found, r.subsets, r.n_docs, SUBSET), SUBSET, "g2", 20)


def unique_over_time(r: Reports) -> DataFrame:
    return C.ranked(C.unique_to(r.found, r.in_slices("M"), r.n_docs, SLICE), SLICE, "g2", 20)


def terms(r: Reports) -> DataFrame:
    """Top concepts and shared lists with exact and related counts."""
    top = C.volume(r.found, None, r.n_docs).withColumn("list", F.lit("top"))
    lists = C.volume(r.listed(), None, r.n_docs, by=LIST_KEYS)
    return top.unionByName(lists).select("list", "concept", F.col("exact_match_count").alias("exact_matches"), F.col("conceptual_match_count").alias("related_matches"), "relevance")


def relative_frequency(r: Reports) -> DataFrame:
    """Concepts by relevance with their share of all documents as text."""
    rows = C.ranked(C.volume(r.found, None, r.n_docs), (), "relevance", 500)
    share = lambda c: F.format_string("%.2f%%", 100.0 * F.col(c) / F.col("total_count"))
    return rows.select("rank", "concept", "exact_match_count", "match_count", share("exact_match_count").alias("exact_share"), share("match_count").alias("match_share"))


def example_docs_top3(r: Reports) -> DataFrame:
    """Each concept with the ids of its three documents of the largest total price."""
    hits = r.found.where("exact = 1").join(r.docs.select("doc_id", "total_price"), "doc_id")
    rows = C.volume(r.found, None, r.n_docs).select("concept", "exact_match_count")
    return C.with_examples(rows, hits, ["concept"], F.col("total_price"))


def doc_count_by_filter(r: Reports) -> DataFrame:
    """For each list and field value, the documents with each concept of the list and their share
    of the value's documents, 0 for those without any; _ALL_ has the value's documents and 100."""
    values = r.subsets.groupBy(*SUBSET).agg(F.count_distinct("doc_id").alias("value_count"))
    few = values.groupBy("field").agg(F.count(F.lit(1)).alias("n")).where("n < 20").select("field")
    values = values.join(few, "field", "left_semi")
    concepts = r.star.list_terms().select("list", "concept").distinct()
    hits = r.listed().select("doc_id", "list", "concept").distinct().join(r.subsets, "doc_id").groupBy("list", "concept", *SUBSET).agg(F.count_distinct("doc_id").alias("count"))
    # every concept of the lists with every value of the few fields: less than 20 values a field
    rows = concepts.crossJoin(F.broadcast(values)).join(hits, ["list", "concept", *SUBSET], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    rows = rows.select("list", *SUBSET, "concept", "count", F.round(F.col("count") / F.col("value_count"), 6).alias("field_value_percent"))
    every = concepts.select("list").distinct().crossJoin(F.broadcast(values))
    return rows.unionByName(every.select("list", *SUBSET, F.lit("_ALL_").alias("concept"), F.col("value_count").alias("count"), F.lit(100.0).alias("field_value_percent")))


REPORTS: dict[str, Callable[[Reports], DataFrame]] = {
    "volume_top": volume_top,
    "volume_subsets": volume_subsets,
    "volume_subsets_all": volume_subsets_all,
    "volume_over_time_month": volume_over_time("M"),
    "volume_over_time_week": volume_over_time("W"),
    "volume_over_time_day": volume_over_time("D"),
    "sentiment_top": sentiment_top,
    "sentiment_subsets": sentiment_subsets,
    "sentiment_over_time": sentiment_over_time,
    "drivers": drivers,
    "drivers_suggested": drivers_suggested,
    "drivers_subsets": drivers_subsets,
    "drivers_over_time": drivers_over_time,
    "outliers_both": outliers("both"),
    "outliers_exact": outliers("exact"),
    "outlier_subsets": outlier_subsets,
    "outliers_over_time": outliers_over_time,
    "unique_to_filter": unique_to_filter,
    "unique_over_time": unique_over_time,
    "terms": terms,
    "relative_frequency": relative_frequency,
    "example_docs_top3": example_docs_top3,
    "doc_count_by_filter": doc_count_by_filter,
}
