"""Every query that SQL can express against DuckDB on the same tables."""

import datetime
import os

import duckdb
import pytest

from conftest import SMALL
from quadloom.plans import queries_graph, queries_service, queries_sparql

QUERIES = queries_sparql.QUERIES | queries_graph.QUERIES | queries_service.QUERIES
SQL = queries_sparql.SQL | queries_graph.SQL | queries_service.SQL


def value(x):
    if isinstance(x, float):
        return f"{x:.9g}"
    return x.isoformat() if isinstance(x, datetime.datetime) else str(x)


def table(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(value(r[i]) for i in order) for r in rows)


def compare(spark, query, sql, sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{sf}/{f}')")
    df = query(spark, sf)
    got = con.execute(sql)
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    assert table(df.collect(), df.columns) == table(got.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_sql(spark, name):
    compare(spark, QUERIES[name], SQL[name], SMALL)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == spark.read.parquet(f"{SMALL}/customer.parquet").count()
    assert set(e.oracle_sql()) <= set(e.queries())
