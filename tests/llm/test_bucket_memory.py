"""A bucket of the language model takes few bytes for each pair it holds."""

import tracemalloc

import numpy as np

from procgraph.llm import pitman_yor


def test_bucket_memory():
    rng, spread, rows = np.random.default_rng(5), np.empty(0, np.uint64), []
    hashes = rng.integers(0, 2**63, 20_000).astype(np.uint64)
    for name in range(4):
        n = np.full(500, 200, np.uint32)
        codes = (20_000 * rng.random(int(n.sum())) ** 2).astype(np.uint32)
        data = pitman_yor.pack(np.arange(500) + 500 * name, n, hashes, codes)
        rows += pitman_yor.Slice(data, 1, spread).rows(name)
    sent = pitman_yor.table(rows)
    pitman_yor.log_stirling(0.8)
    tracemalloc.start()
    bucket = pitman_yor.Bucket(sent, pitman_yor.Model(), 1, spread)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    print(peak / len(bucket.pair))
    assert len(bucket.pair) > 300_000
    assert peak < 55 * len(bucket.pair)
