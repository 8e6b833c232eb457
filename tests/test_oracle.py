"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from siltstone.plans import catalog


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for name in os.listdir(data):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{data}/{name}')")
    return con


def plain(value):
    if value is None or isinstance(value, str | bool):
        return str(value)
    try:
        number = float(value)
    except (TypeError, ValueError):
        return str(value)
    return "nan" if math.isnan(number) else f"{round(number, 6) + 0.0:.6f}"


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(name, spark, duck, data):
    frame = catalog.QUERIES[name](spark, data)
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(frame.columns) == sorted(want.columns)
    assert sorted_rows(frame.columns, frame.collect()) == sorted_rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_runs(name, spark, data):
    assert catalog.QUERIES[name](spark, data).count() > 0
