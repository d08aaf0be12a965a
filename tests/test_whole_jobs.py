"""Queries whose SQL had a cut: orphans follow all calls however far, witness cycles may be of any length."""

import random

import duckdb
import pytest

from procgraph import suite, suite_structure  # noqa: F401
from procgraph.operators import graph


def tables(spark, d, chains):
    """Lines of one year that call each other in turn, for each of the chains of parts, which are brands."""
    lines = [(100_000 * b + n, part) for b, chain in enumerate(chains) for n, part in enumerate(chain)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").selectExpr("l_orderkey", "1 as l_linenumber", "l_partkey", "date'1995-05-05' as l_shipdate").coalesce(1).write.parquet(f"{d}/lineitem.parquet")
    parts = sorted({(p, f"Brand#{b}", "Z") for b, chain in enumerate(chains) for p in chain})
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_type string").coalesce(1).write.parquet(f"{d}/part.parquet")
    con = duckdb.connect()
    for name in ("lineitem", "part"):
        con.sql(f"create view {name} as select * from '{d}/{name}.parquet/*.parquet'")
    return con


@pytest.fixture(scope="module")
def far(spark, tmp_path_factory):
    """Part 2 leads on to 120 parts one by one; part 1 calls 50, 60 and 70, the last alone in its last call; 500 and 501 are called from no entry."""
    d = str(tmp_path_factory.mktemp("far"))
    return d, tables(spark, d, [[2, *range(100, 220)], [1, 50, 1, 60, 1, 70], [500, 501]])


def test_orphans_after_all_calls(spark, far):
    d, con = far
    got = {r["node"] for r in suite.QUERIES["orphans"](spark, d).collect()}
    assert got == {r[0] for r in con.sql(suite.ORACLES["orphans"]).fetchall()} == {500, 501}


@pytest.mark.parametrize(("block", "largest"), [(200_000, 1_000_000), (4, 12)])
def test_reached_by_blocks_and_frontiers(spark, monkeypatch, block, largest):
    monkeypatch.setattr(graph, "BLOCK", block)
    monkeypatch.setattr(graph, "LARGEST", largest)
    rng = random.Random(7)
    pairs = {(f"{k}{rng.randrange(14)}", f"{k}{rng.randrange(14)}") for k in "abc" for _ in range(16)} | {(f"d{i}", f"d{i + 1}") for i in range(9)} | {("e1", "e1"), ("e2", "e3")}
    starts, want = {"a1", "b2", "d3", "e1", "f"}, set()
    todo = [*starts]
    while todo:
        if (x := todo.pop()) not in want:
            want.add(x)
            todo += [b for a, b in pairs if a == x]
    edges, entries = spark.createDataFrame([*sorted(pairs), (None, "a1"), ("a1", None)], "src string, dst string"), spark.createDataFrame([(x,) for x in starts], "node string")
    assert sorted(r["node"] for r in graph.reached(edges, entries).collect()) == sorted(want)


def test_witness_of_any_length(spark, tmp_path):
    d = str(tmp_path)
    con = tables(spark, d, [[*range(1, 301), 1], [400, 401, 400, 401], [500, 501]])
    got = {tuple(r) for r in suite.QUERIES["witness_cycles"](spark, d).select("start", "cycle", "length", "type").collect()}
    assert got == {(1, ">".join(map(str, range(1, 301))), 300, "complex"), (400, "400>401", 2, "mutual")}
    assert got == set(con.sql(f"select start, cycle, length, type from ({suite.ORACLES['witness_cycles']})").fetchall())
