"""Queries that SQL can express, against it."""

import duckdb
import pytest

from loomgraph.llm import registry
from tests.test_queries import TABLES, rows


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{small}/{t}.parquet')")
    got, want = registry.QUERIES[name](spark, small).toPandas(), con.execute(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))
