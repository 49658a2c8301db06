"""Row numbers and running sums over whole tables, without one task for all rows.

Rows are dealt into ranges of the order; each range is numbered by itself, and starts after
the rows of the ranges before. Only a row for each range (and each value of ``within``) passes
the window that adds those up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvida.session import stored

_PART = "__part"


def _ranged(df: DataFrame, order: list[str | Column], within: list[str], parts: int | None) -> DataFrame:
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # written, so that a range's number stays the same each time the rows are read
    return stored(df.repartitionByRange(n, *within, *order).withColumn(_PART, F.spark_partition_id()), "ranges")


def _before(sums: DataFrame, within: list[str]) -> Column:
    return F.coalesce(F.sum("__own").over(Window.partitionBy(*within).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before")


def _joined(rows: DataFrame, base: DataFrame, within: list[str]) -> DataFrame:
    names = [F.col(c).alias(f"__{c}") for c in within]
    base = base.select(F.col(_PART).alias("__range"), *names, "__before")
    on = F.col(_PART) == F.col("__range")
    for c in within:
        on &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    return rows.join(base, on).drop("__range", *(f"__{c}" for c in within), _PART)


def numbered(df: DataFrame, *order: str | Column, name: str = "number", within: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """Adds what row_number() over (partition by within order by order) would give. Rows that are
    equal in ``order`` stay in one range, so it should tell rows apart."""
    by, order = list(within), list(order)
    rows = _ranged(df, order, by, parts)
    sums = rows.groupBy(_PART, *by).agg(F.count(F.lit(1)).alias("__own"))
    rn = F.row_number().over(Window.partitionBy(_PART, *by).orderBy(*order))
    out = _joined(rows.withColumn("__rn", rn), sums.select(_PART, *by, _before(sums, by)), by)
    return out.withColumn(name, (F.col("__before") + F.col("__rn")).cast("long")).drop("__before", "__rn")


def running(df: DataFrame, value: str, *order: str, name: str = "before", within: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """Adds the sum of ``value`` (whole numbers) over all rows before a row, in the order."""
    by, order = list(within), list(order)
    rows = _ranged(df, order, by, parts)
    sums = rows.groupBy(_PART, *by).agg(F.sum(value).alias("__own"))
    inside = Window.partitionBy(_PART, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = _joined(rows.withColumn("__sum", F.coalesce(F.sum(value).over(inside), F.lit(0))), sums.select(_PART, *by, _before(sums, by)), by)
    return out.withColumn(name, (F.col("__before") + F.col("__sum")).cast("long")).drop("__before", "__sum")
