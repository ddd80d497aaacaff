"""Every registered query that has SQL gives the rows of that SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from sparkrecon.plans import registry
from tools.check_oracle import _rows

SF_DIR = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(SF_DIR):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF_DIR}/{f}'")
    return con


def test_flagship(spark):
    row = entry.entry(spark).first()
    assert tuple(row)[1:7] == (1500, 1479, 1042, 321, 137, 116)


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, tables, name):
    df = entry.queries()[name](spark, SF_DIR)
    got = _rows(df.columns, df.collect())
    assert got
    if name in SQL:
        rel = tables.sql(SQL[name])
        assert sorted(df.columns) == sorted(rel.columns)
        assert got == _rows(rel.columns, rel.fetchall())
