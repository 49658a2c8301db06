"""All queries by name, each with the SQL that another engine can run, where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvida.plans import built, kinds, oracle_reports, suggested, tables, texts  # noqa: F401 (kinds adds its queries to tables, built and suggested to texts)
from corvida.plans.reports import REPORTS, Reports

Query = Callable[[SparkSession, str], DataFrame]


def _report(build: Callable[[Reports], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(Reports(spark, sf_dir))


QUERIES: dict[str, Query] = {name: _report(build) for name, build in (REPORTS | tables.QUERIES).items()} | texts.QUERIES
SQL: dict[str, str] = {**oracle_reports.SQL, **tables.SQL, **texts.SQL}
