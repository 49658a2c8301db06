"""Small helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvida.session import small_batches, stored  # noqa: F401 (the operators take both from here)

ROW = "__row"


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of the file system that Spark takes it from, so that no worker falls back to its own disk."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()


def numbered(docs: DataFrame) -> DataFrame:
    """The rows with a number of their own in ``ROW``; they are stored, so it stays the same each time they are read."""
    return stored(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def one_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """Of numbered rows one for each group of groups (ROW, group): that with the smallest doc_id, nulls last, and of equal ones the first."""
    rows = docs.select(F.col(ROW).alias("row"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
    best = groups.select(F.col(ROW).alias("row"), "group").join(rows, "row").groupBy("group").agg(F.min(F.struct("none", "id", "row")).alias("best"))
    return docs.join(best.select(F.col("best.row").alias("__kept")), F.col(ROW) == F.col("__kept"), "left_semi").drop(ROW)


def commonest(df: DataFrame, column: str, most: int, page: int = 10_000) -> DataFrame:
    """The rows with the largest values of a whole-number column, at most ``most`` of them; rows
    with equal values are in or out together.

    The bound comes from the number of rows for each value, taken from the largest on in pages of
    ``page`` values, a job each; no task or driver holds more than a page or the result."""
    sizes = df.groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
    least, taken, more = None, 0, True
    while more:
        rows = (sizes if least is None else sizes.where(F.col(column) < least)).orderBy(F.desc(column)).limit(page).collect()
        more = len(rows) == page
        for row in rows:
            taken += row["rows"]
            if taken > most:
                more = False
                break
            least = row[column]
    return df.where(F.col(column) >= least) if least is not None else df.limit(0)
