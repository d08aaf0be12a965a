"""Whole jobs where a cut was before: small fixtures against brute force."""

import random

from procgraph import suite
from procgraph.operators import graph, relate


def test_whole_edges_and_packages(spark, tmp_path):
    rows = [(1, 1, 100, 7, 1.0, 0.0), (1, 2, 161, 7, 50.0, 0.1), (2, 1, 39, 7, 3.0, 0.02), (3, 1, 3, 8, 50.0, 0.1), (4, 1, 100, 8, 9.0, 0.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    parts = [(100, "a", 1), (161, "b", 2), (39, "c", 7), (3, "d", 3), (5, "e", 9)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    assert {tuple(r) for r in suite.edges(spark, str(tmp_path)).collect()} == {(100, 161), (161, 39), (3, 100)}
    depths = {tuple(r) for r in suite.QUERIES["call_depth"](spark, str(tmp_path)).collect()}
    assert depths == {(3, 0), (100, 1), (161, 2), (39, 3)}
    assert {r[0] for r in suite.QUERIES["unused_packages"](spark, str(tmp_path)).collect()} == {"e"}


def test_cycles_of_any_length(spark):
    rng = random.Random(3)
    ring = [(i, (i + 1) % 6) for i in range(6)]
    pairs = sorted({*ring, (9, 0), (5, 20), (20, 21), (21, 22), (30, 30), (5, 5), *((rng.randrange(40, 75), rng.randrange(40, 75)) for _ in range(45))})
    after = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)

    def reached(a):
        seen, todo = set(), [*after.get(a, ())]
        while todo:
            if (x := todo.pop()) not in seen:
                seen.add(x)
                todo += after.get(x, ())
        return seen

    want = {a: reached(a) for a in after}
    e = spark.createDataFrame(pairs, "src long, dst long")
    got = {r["node"]: r["component"] for r in graph.cyclic_nodes(e).collect()}
    assert got == {a: max(b for b in s if a in want.get(b, ())) for a, s in want.items() if a in s}
    assert {0, 1, 2, 3, 4, 5, 30} <= set(got)
    assert {(r["src"], r["dst"]) for r in graph.cyclic_edges(e).collect()} == {(a, b) for a, b in pairs if a in want.get(b, ())}
    assert graph.cyclic_nodes(e.limit(0)).count() == 0


def test_targets_match_whole_suffixes(spark):
    long = "/".join(f"d{i}" for i in range(80))
    catalog = spark.createDataFrame([(1, 1, "a/b/c.xaml"), (2, 2, "x/b/c.xaml"), (3, 3, "c.xaml"), (4, 4, long)], "id int, rank int, path string")
    calls = spark.createDataFrame([("a/b/c.xaml",), ("b/c.xaml",), ("c.xaml",), ("b",), ("d79",), ("d70/d71",), ("d78/d79",), ("/c.xaml",)], "target string")
    got = {r["target"]: (r["id"], r["match"]) for r in relate.resolve_targets(calls, catalog).collect()}
    missing = (None, "missing")
    assert got == {
        "a/b/c.xaml": (1, "exact"), "b/c.xaml": (1, "suffix"), "c.xaml": (3, "exact"), "b": missing, "d79": (4, "suffix"), "d70/d71": missing, "d78/d79": (4, "suffix"), "/c.xaml": missing,
    }
