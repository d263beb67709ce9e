"""Run a registered query and its SQL, and compare the rows in any order."""

import datetime as dt
import decimal
import math

import duckdb

from workload.planted import TABLES


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else value
    if isinstance(value, decimal.Decimal):
        return str(value)
    if isinstance(value, dt.datetime):
        return value.isoformat()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def spark_rows(frame):
    return sorted(frame.columns), rows_of(frame.columns, frame.collect())


def sql_rows(con, sql):
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    return sorted(columns), rows_of(columns, result.fetchall())
