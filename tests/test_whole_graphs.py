"""Reachable nodes and edges on cycles take every call of the lines; depths stop where their SQL does."""

import duckdb
import pytest

from procgraph import suite, suite_checks, suite_structure  # noqa: F401


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Part 1 has three calls, the middle one alone leads on and back; parts 100 to 189 are a line behind part 2, of one supplier as of one brand."""
    d = str(tmp_path_factory.mktemp("graph"))
    steps = [(1, 50), (1, 60), (1, 70), (60, 1)]
    calls = [(i, a, b, 100 + i) for i, (a, b) in enumerate(steps)] + [(500, 2, 100, 900)]
    rows = [(i, n, part, s) for i, a, b, s in calls for n, part in enumerate((a, b))] + [(1000 + i, 0, 100 + i, 900) for i in range(1, 90)]
    dated = [(o, n, p, s, 1.0, 0.0, f"1995-{1 + (o // 120) % 12:02}-{1 + o % 28:02}") for o, n, p, s in rows]
    lines = spark.createDataFrame(dated, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_discount double, l_shipdate string")
    lines.withColumn("l_shipdate", lines.l_shipdate.cast("date")).coalesce(1).write.parquet(f"{d}/lineitem.parquet")
    parts = [(p, f"n{p}", 1, "B" if p in (1, 50, 60, 70) else "A", "Z") for p in sorted({p for _, _, p, _ in rows})]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_size int, p_brand string, p_type string").coalesce(1).write.parquet(f"{d}/part.parquet")
    con = duckdb.connect()
    for name in ("lineitem", "part"):
        con.sql(f"create view {name} as select * from '{d}/{name}.parquet/*.parquet'")
    return d, con


@pytest.mark.parametrize("name", ["reachable", "cycle_edges", "orphans"])
def test_matches_sql(spark, tables, name):
    d, con = tables
    got = sorted(tuple(r) for r in suite.QUERIES[name](spark, d).collect())
    assert got == sorted(con.sql(suite.ORACLES[name]).fetchall())
    if name == "reachable":
        assert {50, 60, 70} <= {r[0] for r in got} and len(got) == 4 + 1 + 70  # part 2 and 70 of its line
    if name == "cycle_edges":
        assert set(got) == {(1, 60, "mutual"), (60, 1, "mutual")}
