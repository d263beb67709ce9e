"""The registered queries that SQL can express, against that SQL."""

import duckdb
import pytest

import __spark_entry__ as entry_point
from reconcile.llm.oracles import ORACLES
from reconcile.llm.queries import QUERIES
from tests.llm.cases import SF_DIR, as_dicts


def test_all_are_registered():
    names = set(entry_point.queries())
    assert set(QUERIES) | {"pipeline"} <= names
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
    assert set(ORACLES) <= set(entry_point.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    result = con.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    rows = sorted((dict(zip(columns, r, strict=True)) for r in result.fetchall()), key=lambda r: str(sorted(r.items())))
    got = sorted(as_dicts(QUERIES[name](spark, SF_DIR)), key=lambda r: str(sorted(r.items())))
    assert got == rows
