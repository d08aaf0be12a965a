"""Cycle operators by blocks of components: long ways cost no rounds, and blocks agree with frontiers and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from procgraph.operators import graph


def reach(pairs):
    after = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    out = {}
    for a in after:
        seen, todo = set(), [*after[a]]
        while todo:
            if (x := todo.pop()) not in seen:
                seen.add(x)
                todo += after.get(x, ())
        out[a] = seen
    return out


@pytest.mark.parametrize(("block", "largest"), [(200_000, 1_000_000), (4, 12), (2, 2)])
def test_blocks_and_frontiers_agree(spark, monkeypatch, block, largest):
    monkeypatch.setattr(graph, "BLOCK", block)
    monkeypatch.setattr(graph, "LARGEST", largest)
    rng = random.Random(5)
    pairs = sorted({*((f"a{rng.randrange(9)}", f"a{rng.randrange(9)}") for _ in range(12)), *((f"b{rng.randrange(12)}", f"b{rng.randrange(12)}") for _ in range(14)), ("c1", "c2"), ("c2", "c1"), ("d1", "d2")})
    edges, far = spark.createDataFrame(pairs, "src string, dst string"), reach(pairs)
    want = {a: max(b for b in s if a in far.get(b, ())) for a, s in far.items() if a in s}
    assert {r["node"]: r["component"] for r in graph.cyclic_nodes(edges).collect()} == want
    found = graph.witness_cycles(edges).collect()
    assert len(found) == len(set(want.values())) and {r["component"] for r in found} == set(want.values())
    for r in found:
        c = r["cycle"]
        assert c[0] == min(n for n, k in want.items() if k == r["component"]) and all(e in pairs for e in zip(c, c[1:] + c[:1])) and r["length"] == len(c)


def test_long_ways_cost_no_rounds(spark):
    n = 3000
    ring = spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst")).unionByName(spark.range(n).select((F.col("id") + n).alias("src"), (F.col("id") + n + 1).alias("dst")))
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("ring"))
    spark.sparkContext.setJobGroup("ring", "ring")
    try:
        row = graph.witness_cycles(ring).collect()
        assert len(row) == 1 and row[0]["cycle"] == list(range(n)) and row[0]["component"] == n - 1
        assert jobs() < 200
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert graph.witness_cycles(ring, n - 1).count() == 0 and graph.witness_cycles(ring, n).count() == 1
