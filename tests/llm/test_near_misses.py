"""A large group of near misses: alike in most coordinates, below the limit from each other."""

from __future__ import annotations

import random

import numpy as np
import pytest

from procgraph.llm import near_dedup
from tests.llm.test_operators import components_of


def near_misses(n: int) -> dict[int, str]:
    """Copies of one text, each with words of its own, and some copies that are near to the one before."""
    draw, texts = random.Random(7), {}
    base = [f"w{i}" for i in range(300)]
    for i in range(n):
        words = list(texts[i - 1].split(" ")) if i % 9 == 8 else list(base)
        for at in draw.sample(range(300), 3 if i % 9 == 8 else 10):
            words[at] = f"own{i}x{at}"
        texts[i] = " ".join(words)
    return texts


@pytest.mark.parametrize("tile, shingles", [(4096, 1_000_000), (16, 2_000)])
def test_group_of_near_misses(spark, monkeypatch, tile, shingles):
    monkeypatch.setattr(near_dedup, "TILE", tile)
    monkeypatch.setattr(near_dedup, "TILE_ASKS", tile)
    monkeypatch.setattr(near_dedup, "TILE_SHINGLES", shingles)
    asked = []
    kept = near_dedup.meetings
    monkeypatch.setattr(near_dedup, "meetings", lambda *rows: asked.append(kept(*rows)) or asked[-1])
    texts = near_misses(90)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()}
    want = components_of(texts, 5)
    assert got == want and 40 < len(set(want.values())) < 90
    pairs = len(set(want.values())) ** 2
    if tile > 90:
        assert 0 < asked[0].count() < pairs / 3


def test_spanning():
    """What is joined is what all pairs would join, in no more rows than askers and members."""
    draw = np.random.default_rng(3)
    labels = draw.integers(0, 40, 60)
    spanning, rows, of = near_dedup.Spanning(labels), [], {("l", int(x)): ("l", int(x)) for x in labels}
    asks = [np.sort(draw.choice(60, draw.integers(1, 4), replace=False)) for _ in range(12)]

    def joined(edges):
        of = {}
        for a, b in edges:
            old, new = of.get(b, b), of.get(a, a)
            of = {x: new if of.get(x, x) == old else of.get(x, x) for x in [*of, a, b]}
        groups = {}
        for x, r in of.items():
            groups.setdefault(r, set()).add(x)
        return {frozenset(g) for g in groups.values()}

    for n, touched in enumerate(asks):
        rows += [(("q", n), ("l", int(labels[y]))) for y in spanning.join(touched)]
    assert len(rows) <= len(asks) + len(of)
    assert joined(rows) == joined([(("q", n), ("l", int(labels[y]))) for n, t in enumerate(asks) for y in t])
