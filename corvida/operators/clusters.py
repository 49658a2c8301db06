"""Suggested clusters: spherical k-means for all keys at once.

Keys are columns, so a report by subset or time slice is one job of k + rounds steps, not one model
for each value. Steps are aggregates by key; nothing but the centres (k vectors for each key) is met by
all rows of a key. The first centre is the heaviest concept, each next one is the concept least like the
centres so far, ties by name; so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvida.functions import vectors as V
from corvida.session import stored

K, NEAREST, ROUNDS, DIGITS = 7, 4, 4, 9


def _likeness(vector: Column, centres: Column) -> Column:
    return F.transform(centres, lambda c: F.round(V.cosine(vector, c["v"]), DIGITS))


def _seeds(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """keys..., centres: at most k concepts of each key, each far from those before it."""
    first = F.min_by("vector", F.struct(-F.col("weight"), F.col("concept")))
    centres = rows.groupBy(*keys).agg(F.array(F.struct(F.lit(0).alias("c"), first.alias("v"))).alias("centres"))
    for i in range(1, k):
        met = rows.join(centres, keys).withColumn("likeness", F.array_max(_likeness(F.col("vector"), F.col("centres"))))
        far = met.where("likeness < 1").groupBy(*keys).agg(F.min_by("vector", F.struct("likeness", "concept")).alias("far"))
        both = centres.join(far, keys, "left")
        more = F.concat("centres", F.array(F.struct(F.lit(i).alias("c"), F.col("far").alias("v"))))
        centres = stored(both.select(*keys, F.when(F.col("far").isNull(), F.col("centres")).otherwise(more).alias("centres")), "seeds")
    return centres


def _placed(rows: DataFrame, centres: DataFrame, keys: list[str]) -> DataFrame:
    """Each row with the centre most like it, the first of several."""
    likeness = _likeness(F.col("vector"), F.col("centres"))
    met = rows.join(centres, keys).withColumn("likeness", likeness)
    near = F.get("centres", F.array_position("likeness", F.array_max("likeness")).cast("int") - 1)
    return met.select(*rows.columns, near["c"].alias("cluster"), F.array_max("likeness").alias("score"))


def suggested(rows: DataFrame, keys: tuple[str, ...] = (), k: int = K, nearest: int = NEAREST, rounds: int = ROUNDS) -> DataFrame:
    """keys..., cluster, cluster_label, rank, concept, score: of each cluster the ``nearest`` concepts, of which the first is the label.

    rows: keys..., concept, vector, weight, one row for each key and concept. Rows whose vector is null or
    zero, or whose concept is null, have no direction and are left out; a null weight counts as 0; null keys
    are left out. With fewer different directions than k there are fewer clusters; equal vectors share one.
    A centre that loses all its concepts goes. An empty table gives an empty one."""
    alone = not keys
    if alone:
        rows, keys = rows.withColumn("_all", F.lit(1)), ("_all",)
    keys = list(keys)
    rows = rows.select(*keys, "concept", F.col("vector").cast("array<double>").alias("vector"), F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("weight"))
    rows = rows.dropna(subset=[*keys, "concept"]).where(V.norm(F.col("vector")) > 0).withColumn("vector", V.unit(F.col("vector")))
    rows = stored(rows, "clustered")
    centres = _seeds(rows, keys, k)
    for _ in range(rounds):
        means = V.centroids(_placed(rows, centres, keys), [*keys, "cluster"])
        kept = means.where(V.norm(F.col("centroid")) > 0)
        centres = stored(kept.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("cluster").alias("c"), F.col("centroid").alias("v")))).alias("centres")), "centres")  # k of each key
    w = Window.partitionBy(*keys, "cluster").orderBy(F.desc("score"), "concept")
    out = _placed(rows, centres, keys).withColumn("rank", F.row_number().over(w)).withColumn("cluster_label", F.first("concept").over(w)).where(F.col("rank") <= nearest)
    return out.select(*([] if alone else keys), "cluster", "cluster_label", "rank", "concept", F.round("score", 5).alias("score"))
