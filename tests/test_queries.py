"""Every registered query against its SQL on a second engine."""

import pytest

import __spark_entry__ as entry_point
from tests.oracle import connect, spark_rows, sql_rows
from workload.oracles import ORACLES
from workload.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"

# Python in tasks, and joins that pair every row with every row.
UNWANTED = ("EvalPython", "InPandas", "InArrow", "CartesianProduct", "BroadcastNestedLoopJoin")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_point.queries())


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    frame = QUERIES[name](spark, SF_DIR)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert not [node for node in UNWANTED if node in plan]
    columns, rows = spark_rows(frame)
    sql_columns, expected = sql_rows(con, ORACLES[name])
    assert columns == sql_columns
    assert len(rows) == len(expected)
    assert rows == expected
    assert rows, "a query over the given tables has rows"
