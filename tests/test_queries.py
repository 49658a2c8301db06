"""Every query with a SQL twin gives the rows that the other engine gives."""

import pytest
from comparing import of_duckdb, of_spark

from corvida import catalogue

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(catalogue.SQL))
def test_same_rows(spark, name):
    assert of_spark(catalogue.QUERIES[name](spark, SMALL)) == of_duckdb(catalogue.SQL[name], SMALL)


@pytest.mark.parametrize("name", [q for q in catalogue.QUERIES if q not in catalogue.SQL])
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SMALL).count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
