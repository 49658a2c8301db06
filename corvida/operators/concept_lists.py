"""Concept lists as tables (list, concept, texts, color): merge, rules, threads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def copied(source: DataFrame, target: DataFrame, overwrite: bool = False) -> DataFrame:
    """The target with the source's lists; lists of the same name stay, or are overwritten."""
    names = (source if overwrite else target).select("list").distinct()
    if overwrite:
        return target.join(names, "list", "left_anti").unionByName(source)
    return target.unionByName(source.join(names, "list", "left_anti"))


def copied_views(views: DataFrame, lists: DataFrame, new_lists: DataFrame) -> DataFrame:
    """Views (view_id, name, concept_list_id) with the ids that lists of the same name have in the new project."""
    names = lists.select(F.col("concept_list_id"), F.col("name").alias("list_name")).join(new_lists.select(F.col("concept_list_id").alias("new_id"), F.col("name").alias("list_name")), "list_name")
    out = views.join(names, "concept_list_id", "left")
    return out.select("view_id", "name", F.coalesce("new_id", "concept_list_id").alias("concept_list_id"))


def with_rules(terms: DataFrame, ignore: DataFrame | None = None, merge: DataFrame | None = None, column: str = "term") -> DataFrame:
    """Terms without the ignored ones, and with merged ones under their new name (old, new)."""
    if ignore is not None:
        terms = terms.join(ignore.select(column).distinct(), column, "left_anti")
    if merge is not None:
        terms = terms.join(merge.withColumnRenamed("old", column), column, "left")
        terms = terms.withColumn(column, F.coalesce("new", column)).drop("new")
    return terms


def collocated(text, phrases: list[str]):
    """The phrases' spaces as underscores, so that each is one word."""
    for phrase in phrases:
        text = F.replace(text, F.lit(phrase), F.lit(phrase.replace(" ", "_")))
    return text


def thread_roots(comments: DataFrame) -> DataFrame:
    """Of (id, parent_id): id, root_id; parents that are missing end the thread."""
    from corvida.operators.components import roots

    known = comments.select(F.col("id").alias("parent_id"))
    linked = comments.where("parent_id is not null").join(known, "parent_id", "left_semi")
    found = roots(linked, "id", "parent_id").select(F.col("node").alias("id"), F.col("component").alias("root_id"))
    return comments.select("id").join(found, "id", "left").select("id", F.coalesce("root_id", "id").alias("root_id"))
