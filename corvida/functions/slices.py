"""Date parsing and slices of time that run backwards from an end date."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Accepted date formats (fixed values); seconds may have one to six decimals.
FORMATS = ("yyyy-M-d'T'H:m:s'Z'", *(f"yyyy-M-d'T'H:m:s.{'S' * n}'Z'" for n in range(1, 7)), "yyyy-M-d", "M/d/yyyy", "M/d/yy", "M/d/yy H:m")


def parsed(text: Column, formats: tuple[str, ...] = FORMATS) -> Column:
    """The timestamp of a text in one of the formats, or null. Years of two digits are 1969 to 2068."""
    found = []
    for f in formats:
        at = F.try_to_timestamp(text, F.lit(f))
        found.append(at if "yyyy" in f else F.when(F.year(at) >= 2069, at - F.expr("interval 100 years")).otherwise(at))
    return F.coalesce(*found)


def epoch(text: Column) -> Column:
    """Seconds since 1970; plain numbers pass through."""
    return F.coalesce(text.try_cast("double"), F.unix_timestamp(parsed(text)).cast("double"))


def formatted(seconds: Column, pattern: str = "yyyy-MM-dd") -> Column:
    """Epoch seconds as a date; other texts stay as they are."""
    return F.coalesce(F.date_format(F.timestamp_seconds(seconds.try_cast("double")), pattern), seconds)


def time_slices(end: datetime, kind: str, iterations: int = 7, full_last_day: bool = False) -> list[tuple[datetime, datetime, int, str]]:
    """(start, end, counter, kind) of the last ``iterations`` months (M), weeks (W) or days (D).

    The first slice ends at ``end``. Earlier months run to 00:00 of their last day, or to its
    last second. Both ends are part of a slice, so neighbouring weeks share a moment."""
    if kind not in ("M", "W", "D"):
        raise ValueError(f"unknown range {kind}")
    out = []
    if kind == "M":
        if end.day == 1:
            end = (end - timedelta(days=1)).replace(hour=0, minute=0, second=0, microsecond=0)
        for i in range(iterations):
            start = end.replace(day=1, hour=0, minute=0, second=0, microsecond=0)
            out.append((start, end, i, kind))
            end = start - (timedelta(seconds=1) if full_last_day else timedelta(days=1))
        return out
    step = timedelta(days=7 if kind == "W" else 1)
    for i in range(iterations):
        out.append((end - step, end, i, kind))
        end -= step
    return out


def slice_table(spark: SparkSession, slices: list) -> DataFrame:
    return spark.createDataFrame(slices, "start_date timestamp, end_date timestamp, iteration_counter int, range_type string")


def in_slices(docs: DataFrame, slices: DataFrame, date: str = "date") -> DataFrame:
    """A row for each document and slice that holds its date; slices are a handful of rows."""
    return docs.join(F.broadcast(slices), F.col(date).between(F.col("start_date"), F.col("end_date")))


def best_interval(bins: dict[str, int], iterations: int = 7) -> str:
    """The first of months, weeks and days with more bins than iterations, else days."""
    return next((k for k in ("M", "W", "D") if bins[k] > iterations), "D")
