"""The driver's contract: every query runs on the smallest tables and agrees with its SQL."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SMALL = os.environ.get("SMALL_SF_DIR", "/root/testdata/sf0.001")


def _value(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if v != v else round(float(v), 4)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    return [_value(x) for x in v] if isinstance(v, (list, tuple)) else v


def _shape(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([_value(r[i]) for i in order]) for r in rows)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def _core(names):
    """The text operators' queries have their own tests."""
    own = entry.text_queries.QUERIES if entry.text_queries else {}
    return sorted(n for n in names if n not in own)


@pytest.mark.parametrize("name", _core(entry.oracle_sql()))
def test_query_agrees_with_its_sql(spark, tables, name):
    got = entry.queries()[name](spark, SMALL)
    expected = tables.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(expected.columns)
    assert _shape(got.collect(), got.columns) == _shape(expected.fetchall(), expected.columns)


@pytest.mark.parametrize("name", _core(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert entry.queries()[name](spark, SMALL).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
