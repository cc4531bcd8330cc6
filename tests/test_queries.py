"""Every registered query against its oracle, at the smallest scale."""

import os

import pytest

import __spark_entry__ as entry
from oracles.sql import ORACLES
from srcgraph.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(frame):
    columns = sorted(frame.columns)
    return columns, sorted(map(repr, (tuple(None if v != v else v for v in row) for row in frame[columns].values.tolist())))


def test_names_agree():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, duck, name):
    got = plain(entry.queries()[name](spark, SF).toPandas())
    assert got == plain(duck.execute(entry.oracle_sql()[name]).df())
    assert got[1]


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
