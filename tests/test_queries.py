"""Queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from rollcall.jobs import registry

DIR = "/root/testdata/sf0.001"


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple("" if v[i] is None else repr(float(v[i])) if isinstance(v[i], float) else str(v[i]) for i in order) for v in values)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_as_sql_says(spark, name):
    con = duckdb.connect()
    for t in ("customer", "orders", "part", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got = registry.queries()[name](spark, DIR)
    want = con.execute(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(d[0] for d in want.description)
    assert rows(got.columns, got.collect()) == rows([d[0] for d in want.description], want.fetchall())


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql()) and len(registry.queries()) >= 90


def test_entry(spark):
    assert entry.entry(spark).count() > 0
