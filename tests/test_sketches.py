"""Sketches against exact values."""

import random
from collections import deque

import pytest

from codegrove.operators import sketches as K


def test_closeness_against_breadth_first_search(spark):
    rng = random.Random(11)
    n = 1000
    pairs = {(i, (i + 1) % 700) for i in range(700)} | {(rng.randrange(n), rng.randrange(n)) for _ in range(1800)} | {(5, 5)}
    nodes = spark.createDataFrame([(str(i),) for i in range(n)], "id string")
    edges = spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "src string, dst string")
    got = {r.id: r for r in K.closeness(nodes, edges).collect()}
    out = {i: [b for a, b in pairs if a == i and b != i] for i in range(n)}
    assert len(got) == n
    for start in range(0, n, 7):
        seen, queue = {start: 0}, deque([start])
        while queue:
            v = queue.popleft()
            for w in out[v]:
                if w not in seen:
                    seen[w] = seen[v] + 1
                    queue.append(w)
        r, reached = got[str(start)], len(seen) - 1
        assert r.reached == pytest.approx(reached, rel=0.07, abs=0.5)
        assert r.distance == pytest.approx(sum(seen.values()), rel=0.1, abs=0.5)
        assert r.harmonic == pytest.approx(sum(1 / d for d in seen.values() if d), rel=0.1, abs=0.5)
    assert K.closeness(nodes.limit(0), edges).count() == 0


def test_quantiles_of_merged_sketches(spark):
    rng = random.Random(12)
    rows = [(d, g, rng.lognormvariate(0, 2) if g else float(i % 10)) for d in range(5) for g in (0, 1) for i in range(3000)] + [(1, 2, None)]
    df = spark.createDataFrame(rows, "day int, g int, x double")
    stored = K.quantile_sketches(df, ["day", "g"], "x")
    for r in K.merged_quantiles(stored.filter("day > 0"), ["g"], [0.0, 0.1, 0.5, 0.99, 1.0]).collect():
        xs = [x for d, g, x in rows if g == r.g and d > 0]
        assert r.n == len(xs) == 12000
        assert sum(x < r.value for x in xs) / len(xs) <= r.p + 0.01 and sum(x <= r.value for x in xs) / len(xs) >= r.p - 0.01
