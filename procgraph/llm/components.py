"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from procgraph.llm.common import cut


def connected_components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(id, component): the smallest id reachable, for every id in edges (a, b).

    Each round hangs every neighbour of a node onto the smallest neighbour
    (large stars), then every smaller one (small stars); the edges end as stars
    around the smallest ids, in about log(n) rounds. A half round is one shuffle by node and a
    sorted pass over its neighbours, which are streamed and spill, not held; each round is checkpointed.
    """
    beside = Window.partitionBy("a").orderBy("b")  # running from the smallest neighbour on
    fresh, least = F.lag("b").over(beside).eqNullSafe(F.col("b")), F.first("b").over(beside)
    sorted_ = lambda df: df.select("a", "b", fresh.alias("repeated"), least.alias("least")).where("not repeated")
    now, state = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b"), None
    for _ in range(most_rounds):
        both = now.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
        large = sorted_(both).where("b > a").select(F.col("b").alias("a"), F.least("least", "a").alias("b"))
        small = sorted_(large).select(F.when(F.col("b") == F.col("least"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("least").alias("b"))
        now = cut(small)
        last, state = state, now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            break
    else:
        raise RuntimeError("components didn't settle")
    heads = now.select("b").distinct().select(F.col("b").alias("id"), F.col("b").alias("component"))
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(heads)
