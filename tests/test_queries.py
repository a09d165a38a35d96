"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest
from oracle_check import connect, spark_rows, sql_rows
from test_plans import physical_plan

from __spark_entry__ import entry, oracle_sql, queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["series_id", "ds", "y", "status"]
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, duck, name):
    df = queries()[name](spark, SF_DIR)
    plan = physical_plan(df)
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    columns, rows = spark_rows(df)
    assert rows
    if name in oracle_sql():
        assert (columns, rows) == sql_rows(duck, oracle_sql()[name])
