"""Concept matching and the measures that reports are made of.

Every report is one aggregate over (keys..., concept): keys are columns such as field, value
or a time slice. ``scope`` names the documents of each key: one row for each (doc_id, keys).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def matches(terms: DataFrame, concepts: DataFrame, by: tuple[str, ...] = ("concept",)) -> DataFrame:
    """doc_id, concept, exact: documents with an exact or related term of the concept; exact wins."""
    return terms.join(concepts, "term").groupBy("doc_id", *by).agg(F.max("exact").alias("exact"))


def totals(scope: DataFrame, keys: list[str]) -> DataFrame:
    """keys..., total_count: the distinct documents of each key."""
    return scope.groupBy(*keys).agg(F.count_distinct("doc_id").alias("total_count"))


def corpus_counts(found: DataFrame, by: tuple[str, ...] = ("concept",)) -> DataFrame:
    """concept, df0: exact documents in the whole corpus."""
    return found.where("exact = 1").groupBy(*by).agg(F.count("doc_id").alias("df0"))


def relevance(df: Column, df0: Column, n0: Column) -> Column:
    """df * ln(N0 / df0), 0 where a concept has no document."""
    return F.when((df > 0) & (df0 > 0), df * F.ln(n0 / df0)).otherwise(0.0)


def volume(found: DataFrame, scope: DataFrame | None, n_docs: int, keys: tuple[str, ...] = (), by: tuple[str, ...] = ("concept",)) -> DataFrame:
    """Match counts of each concept and key, with relevance; concepts without a match are left out."""
    keys, by = list(keys), list(by)
    inside = found if scope is None else found.join(scope, "doc_id")
    # one row for each document, concept and key, so documents are counted without distinct
    counts = inside.groupBy(*keys, *by).agg(
        F.count(F.when(F.col("exact") == 1, F.col("doc_id"))).alias("exact_match_count"),
        F.count("doc_id").alias("match_count"),
    )
    counts = counts.join(corpus_counts(found, tuple(by)), by, "left")
    total = counts.withColumn("total_count", F.lit(n_docs).cast("long")) if not keys else counts.join(totals(scope, keys), keys)
    return total.select(
        *keys,
        *by,
        "match_count",
        "exact_match_count",
        (F.col("match_count") - F.col("exact_match_count")).alias("conceptual_match_count"),
        "total_count",
        F.round(relevance(F.col("exact_match_count"), F.col("df0"), F.lit(float(n_docs))), 6).alias("relevance"),
    )


def ranked(df: DataFrame, keys: tuple[str, ...], measure: str, limit: int, name: str = "concept") -> DataFrame:
    """The ``limit`` largest of each key by a measure, ties by name, with their rank."""
    order = [F.desc(measure), F.asc(name)]
    if not keys:
        top = df.orderBy(*order).limit(limit)
        # at most ``limit`` rows are left to number
        return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def first_sentiments(terms: DataFrame, concepts: DataFrame, by: tuple[str, ...] = ("concept",)) -> DataFrame:
    """doc_id, concept, sentiment: that of the first exact occurrence."""
    exact = terms.join(concepts.where("exact = 1"), "term")
    return exact.groupBy("doc_id", *by).agg(F.min_by("sentiment", "pos").alias("sentiment"), F.min_by("confidence", "pos").alias("confidence"))


def sentiment(found: DataFrame, scope: DataFrame | None = None, keys: tuple[str, ...] = (), by: tuple[str, ...] = ("concept",)) -> DataFrame:
    """Counts and shares of sentiments over the exact documents of each concept and key."""
    inside = (found if scope is None else found.join(scope, "doc_id")).where("sentiment is not null")
    kinds = ("positive", "neutral", "negative")
    counts = [F.count_if(F.col("sentiment") == k).alias(f"{k}_count") for k in kinds]
    out = inside.groupBy(*keys, *by).agg(*counts, F.count(F.lit(1)).alias("sentiment_total"))
    shares = [F.round(F.try_divide(f"{k}_count", "sentiment_total"), 6).alias(f"{k}_share") for k in kinds]
    return out.select(*keys, *by, *(f"{k}_count" for k in kinds), "sentiment_total", *shares)


def drivers(found: DataFrame, scores: DataFrame, keys: tuple[str, ...] = (), by: tuple[str, ...] = ("concept",)) -> DataFrame:
    """Of (doc_id, keys..., score): how far the documents of a concept are from the average.

    impact is the difference of averages; importance is |impact| * sqrt(n) / deviation."""
    scores = scores.where("score is not null")
    exact = found.where("exact = 1").select("doc_id", *by)
    overall = scores.groupBy(*keys).agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("dev"))
    per = exact.join(scores, "doc_id").groupBy(*keys, *by).agg(F.avg("score").alias("avg"), F.count(F.lit(1)).alias("exact_match_count"))
    both = per.join(F.broadcast(overall), list(keys)) if keys else per.crossJoin(F.broadcast(overall))  # one row for each key
    impact = F.col("avg") - F.col("mean")
    importance = F.try_divide(F.abs(impact) * F.sqrt("exact_match_count"), F.nullif("dev", F.lit(0.0)))
    return both.select(*keys, *by, "exact_match_count", F.round("avg", 4).alias("average_score"), F.round(impact, 4).alias("impact"), F.round(importance, 4).alias("importance"))


def uncovered(scope: DataFrame, found: DataFrame, match_type: str = "both") -> DataFrame:
    """The rows of scope whose documents match no concept."""
    hit = found if match_type == "both" else found.where("exact = 1")
    return scope.join(hit.select("doc_id").distinct(), "doc_id", "left_anti")


def outside(found: DataFrame, covered: DataFrame, names: DataFrame, scope: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Of each key and list: the documents the list doesn't cover, and the concepts in them.

    found: doc_id, concept, exact. covered: doc_id, list. names: list. scope: doc_id, keys (one row each).
    What a list covers is taken off what all documents have, so that no row is made for a document and
    a list that lacks it. Returns keys..., list, concept, document_count, filter_count, match_count, exact_match_count."""
    keys, listed = list(keys), [*keys, "list"]
    covered = covered.select("doc_id", "list").distinct()
    counts = (F.count(F.lit(1)).alias("match_count"), F.count(F.when(F.col("exact") == 1, F.lit(1))).alias("exact_match_count"))
    inside = found.join(scope, "doc_id")
    every = inside.groupBy(*keys, "concept").agg(*counts)
    off = inside.join(covered, "doc_id").groupBy(*listed, "concept").agg(*counts).withColumnsRenamed({"match_count": "m", "exact_match_count": "e"})
    size = scope.groupBy(*keys).agg(F.count(F.lit(1)).alias("document_count")).crossJoin(names.select("list").distinct())  # a row for each key and list
    gone = scope.join(covered, "doc_id").groupBy(*listed).agg(F.count(F.lit(1)).alias("gone"))
    size = size.join(gone, listed, "left").withColumn("filter_count", F.col("document_count") - F.coalesce("gone", F.lit(0)))
    rest = lambda a, b: (F.col(a) - F.coalesce(b, F.lit(0))).alias(a)
    rows = size.join(every, keys).join(off, [*listed, "concept"], "left")
    return rows.select(*listed, "concept", "document_count", "filter_count", rest("match_count", "m"), rest("exact_match_count", "e"))


def g2(a: Column, row: Column, n: Column, n0: Column) -> Column:
    """Dunning's G2 of a word in ``a`` of n documents and in ``row`` of all n0."""
    cells = [(a, row, n), (n - a, n0 - row, n), (row - a, row, n0 - n), (n0 - n - row + a, n0 - row, n0 - n)]
    return sum((F.when(o > 0, o * F.ln(o * n0 / (r * c))).otherwise(0.0) for o, r, c in cells), F.lit(0.0)) * 2


def unique_to(found: DataFrame, scope: DataFrame, n_docs: int, keys: tuple[str, ...], by: str = "concept") -> DataFrame:
    """Concepts more frequent inside a key than in the corpus, with Dunning's G2."""
    keys = list(keys)
    inside = found.where("exact = 1").select("doc_id", by).join(scope, "doc_id").groupBy(*keys, by).agg(F.count_distinct("doc_id").alias("a"))
    all_of = inside.join(totals(scope, keys), keys).join(corpus_counts(found, (by,)), by)
    n, n0 = F.col("total_count").cast("double"), F.lit(float(n_docs))
    a, row = F.col("a").cast("double"), F.col("df0").cast("double")
    return all_of.where(a * n0 > row * n).select(*keys, by, F.col("a").alias("exact_match_count"), "total_count", F.round(g2(a, row, n, n0), 4).alias("g2"))


def with_examples(rows: DataFrame, hits: DataFrame, keys: list[str], score: Column, n: int = 3, label: str = "example_doc") -> DataFrame:
    """Adds the ids of the n best documents of each key, padded with ''."""
    w = Window.partitionBy(*keys).orderBy(score.desc(), "doc_id")
    best = hits.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
    wide = best.groupBy(*keys).agg(*(F.max(F.when(F.col("rn") == i, F.col("doc_id").cast("string"))).alias(f"{label}{i}") for i in range(1, n + 1)))
    out = rows.join(wide, keys, "left")
    return out.fillna("", [f"{label}{i}" for i in range(1, n + 1)])
