"""Fuzzy logic on scores in [0, 1] and on arrays of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def tanh_clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.tanh(x))


def hadamard(a: Column, b: Column) -> Column:
    """ab / (a + b - ab), 0 where that is 0 / 0."""
    return F.coalesce(F.try_divide(a * b, F.nullif(a + b - a * b, F.lit(0.0))), F.lit(0.0))


def fuzzy_and(scores: Column) -> Column:
    """The Hadamard product of all scores: 1 / (sum of 1/x - (n - 1)); 1 for none, 0 if one is 0."""
    inverse = F.aggregate(scores, F.lit(0.0), lambda acc, x: acc + F.coalesce(F.try_divide(F.lit(1.0), x), F.lit(0.0)))
    return F.when(F.size(scores) == 0, 1.0).when(F.exists(scores, lambda x: x == 0), 0.0).otherwise(1.0 / (inverse - F.size(scores) + 1))


def fuzzy_not(x: Column) -> Column:
    return 1.0 - x


def fuzzy_or(scores: Column) -> Column:
    """By De Morgan; 0 for none."""
    return 1.0 - fuzzy_and(F.transform(scores, lambda x: 1.0 - x))


def max_or(scores: Column) -> Column:
    return F.coalesce(F.array_max(scores), F.lit(0.0))


def min_and(scores: Column) -> Column:
    return F.coalesce(F.array_min(scores), F.lit(0.0))
