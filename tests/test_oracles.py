"""Every registered query of the suite against its SQL at the smallest scale."""

import os

import duckdb
import pytest

from procgraph import suite, suite_checks, suite_listing  # noqa: F401

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(float(v[i]) if isinstance(v[i], (int, float)) and not isinstance(v[i], bool) else v[i] for i in order)) for v in values)


@pytest.mark.parametrize("name", sorted(suite.QUERIES))
def test_matches_sql(spark, con, name):
    df = suite.QUERIES[name](spark, DATA)
    assert name in suite.ORACLES
    want = con.sql(suite.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())
