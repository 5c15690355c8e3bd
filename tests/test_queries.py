"""Every query of the library that has SQL gives the rows that SQL gives."""

import datetime
import decimal
import os

import duckdb
import pytest

from ferrule.plans import catalogue

DATA = os.environ.get("QUERY_DATA", "/root/testdata/sf0.001")


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6)
    if isinstance(value, list | tuple):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return str(value) if isinstance(value, datetime.date) else value


def sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"create view {file.removesuffix('.parquet')} as select * from '{DATA}/{file}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    found = catalogue.QUERIES[name](spark, DATA)
    want = duck.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(found.columns) == sorted(names)
    rows = want.fetchall()
    assert sorted_rows(found.columns, found.collect()) == sorted_rows(names, rows)
    assert rows


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_gives_rows(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0
