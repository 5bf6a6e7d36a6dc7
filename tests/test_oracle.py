"""Every query with SQL gives the same rows at the smallest scale."""

import pytest
from compare import oracle_rows, rows_of

from mosaiq.plans.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, name):
    assert rows_of(QUERIES[name](spark, FOLDER)) == oracle_rows(SQL[name], FOLDER)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    rows = QUERIES[name](spark, FOLDER)
    assert rows.columns and rows.collect() is not None


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
