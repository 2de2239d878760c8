"""The text operators' queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from almagre.llm.queries import QUERIES
from almagre.llm.sql import SQL

SMALL = os.environ.get("SMALL_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_its_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    got, expected = QUERIES[name](spark, SMALL), con.sql(SQL[name])
    assert got.columns == expected.columns
    assert sorted(map(tuple, got.collect())) == sorted(expected.fetchall())
