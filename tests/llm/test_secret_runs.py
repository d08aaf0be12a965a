"""Web tokens: long runs in linear time, and the same spans as pattern after pattern."""

import random
import time

from procgraph.llm import secrets


def test_runs_of_heads_in_linear_time():
    began = time.process_time()
    assert secrets.Scanner()("eyJ" * 700_000) == []
    assert [s for s in secrets.Scanner()("x." + "eyJ." * 300_000) if s[1] == "jwt"] == []
    assert time.process_time() - began < 20


def test_spans_of_web_tokens():
    rng, (_, pattern, holds) = random.Random(8), secrets.CHECKED["jwt"]
    pieces = ["eyJhbGciOiJIUzI1NiJ9", "eyJ", "eyJh", ".", ".", ".eyJx.", "a", " ", "-", "é", "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxIn0.c2ln"]
    met = 0
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 12)))
        expect, end = [], 0
        for at in range(len(text)):
            if at >= end and text.startswith("eyJ", at) and (m := pattern.match(text, at)) and holds(m):
                expect.append((at, "jwt", m.end()))
                end = m.end()
        assert [s for s in secrets.Scanner()(text) if s[1] == "jwt"] == expect, text
        met += bool(expect)
    assert met > 300
