"""The order of the sample at very small and very large weights, by logarithms."""

import hashlib
import math
import random

from pyspark.sql import functions as F

from procgraph.llm import mixing


def test_order_of_extreme_weights(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("w" * rng.randint(1, 9)), "s" if i % 4 else "t", 10.0 ** rng.randint(-6, 6)) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, weight double").repartition(3)
    got = {r["doc_id"]: r for r in mixing.mix(docs, quality=F.col("weight"), bins=7).collect()}
    for source in ("s", "t"):
        mine = []
        for i, text, s, w in rows:
            if s == source:
                u = (int(hashlib.md5(f"0:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                mine.append((-math.log(u) / w, i, len(text.split())))
        total, target = sum(x[2] for x in mine), got[mine[0][1]]["__target"]
        epochs = int(target // total)
        budget, start = target - epochs * total, 0
        for _, i, size in sorted(mine):
            assert got[i]["__copies"] == epochs + (start < budget and 2 * (budget - start) >= size), i
            start += size
    small = mixing.mix(docs, quality=F.lit(1e-6))
    assert small.count() == len(rows)
