"""What a bucket of the language model does with its slices follows their pairs, not their number."""

import numpy as np
import pytest

from procgraph.llm import pitman_yor


def test_values_are_sorted_a_few_times(monkeypatch):
    rng, joined, concatenate = np.random.default_rng(2), [], np.concatenate
    arrays = [np.unique(rng.integers(0, 2**63, 500_000).astype(np.uint64)[:1000] % 400_000) for _ in range(1500)]
    want = np.unique(concatenate(arrays))
    monkeypatch.setattr(pitman_yor.np, "concatenate", lambda a, *b, **c: joined.append(sum(map(len, a))) or concatenate(a, *b, **c))
    got = pitman_yor.distinct(arrays)
    monkeypatch.undo()
    assert np.array_equal(got, want)
    assert sum(joined) < 5 * sum(map(len, arrays))


@pytest.mark.parametrize("most", [50, 1 << 62])
def test_order_of_keys(most):
    keys = np.random.default_rng(4).integers(0, 50, 1000) * ((most - 1) // 50)
    for some in (keys, keys[:1], keys[:0]):
        order, by = pitman_yor.ordered(some, most)
        assert np.array_equal(order, np.argsort(some, kind="stable")) and np.array_equal(by, some[order])


def test_dishes_of_many_customers_in_runs(monkeypatch):
    rng, spread = np.random.default_rng(6), np.empty(0, np.uint64)
    hashes, n = rng.integers(0, 2**63, 3000).astype(np.uint64), np.full(800, 300, np.uint32)
    codes = (3000 * rng.random(int(n.sum())) ** 6).astype(np.uint32)
    rows = pitman_yor.Slice(pitman_yor.pack(np.arange(800), n, hashes, codes), 1, spread).rows(0)
    bucket = pitman_yor.Bucket(pitman_yor.table(rows), pitman_yor.Model(), 1, spread)
    state = {"root": np.full(len(bucket.words), 1e-3), "tables": bucket.by_context(np.minimum(bucket.count, 1))}
    assert (bucket.count > pitman_yor.TABULATED).sum() > 3
    want = bucket.seat(state, 2)
    monkeypatch.setattr(pitman_yor, "DISHES", 1000)
    calls, draw = [], pitman_yor.draw_tables
    monkeypatch.setattr(pitman_yor, "draw_tables", lambda c, *a: calls.append(bool((c > pitman_yor.TABULATED).any())) or draw(c, *a))
    assert np.array_equal(bucket.seat(state, 2), want)
    few = ((bucket.count > 1) & (bucket.count <= pitman_yor.TABULATED)).sum()
    assert few > 5000 and len(calls) == -(-few // 1000) + 1 and sum(calls) == 1
    assert want[bucket.count > pitman_yor.TABULATED].max() > 1
