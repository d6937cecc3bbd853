"""Longest ways against recursion over components found by plain reachability; long chains in few rounds."""

import random

import pytest

from buildscope.operators import graph as G
from buildscope.operators import longest as L


def brute(edges, weights):
    reach = {n: {n} for n in weights}
    for _ in weights:
        for a, b in edges:
            if a in reach and b in reach:
                for n in reach:
                    if a in reach[n]:
                        reach[n].add(b)
    comp = {n: min(m for m in weights if m in reach[n] and n in reach[m]) for n in weights}
    size = {c: sum(comp[n] == c for n in weights) for c in weights}
    total = {c: sum(w for n, w in weights.items() if comp[n] == c) for c in set(comp.values())}
    memo = {}

    def worst(c):
        if c not in memo:
            below = [(worst(comp[b])[0], b) for a, b in edges if a in comp and b in comp and comp[a] == c and comp[b] != c]
            memo[c] = (total[c] + max((v for v, _ in below), default=0), None)
        return memo[c]

    return {n: (worst(comp[n])[0], comp[n], size[comp[n]] > 1 or (n, n) in edges) for n in weights}


@pytest.mark.parametrize("seed", range(5))
def test_longest(spark, seed):
    rng = random.Random(seed)
    n = 30
    weights = {k: rng.randint(0, 9) for k in range(n)}
    edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(rng.choice([20, 35, 60]))}
    if seed % 2:
        edges = {(max(e), min(e)) for e in edges if e[0] != e[1]} | ({(3, 9)} if seed == 3 else set())
    edges |= {(5, 99), (98, 5)}
    frame = spark.createDataFrame(sorted(edges), "src long, dst long")
    found = G.cut(L.longest(frame, spark.createDataFrame(list(weights.items()), "node long, weight long")))
    got = {r.node: (r.worst, r.component, r.recursive) for r in found.collect()}
    want = brute(edges, weights)
    assert got == want
    paths = {r.node: r.path for r in L.ways(found).collect()}
    assert len(paths) == n and all(sum(weights[m] for m in p) == want[k][0] and k in p for k, p in paths.items())
    some = {r.node: r.path for r in L.ways(found, spark.createDataFrame([(4,), (7,)], "node long")).collect()}
    assert some == {k: paths[k] for k in (4, 7)}


def test_a_circle_above_others(spark):
    """What lies below a circle is summed: 3 -> 1 <-> 2 -> 4."""
    found = L.longest(spark.createDataFrame([(1, 2), (2, 1), (3, 1), (2, 4), (4, 4)], "src long, dst long"), spark.createDataFrame([(1, 10), (2, 20), (3, 1), (4, 5)], "node long, weight long"))
    assert {(r.node, r.worst, r.next, r.recursive) for r in found.collect()} == {(1, 35, 4, True), (2, 35, 4, True), (3, 36, 1, False), (4, 5, None, True)}


def test_long_chain(spark):
    n = 20_000
    found = G.cut(L.longest(spark.createDataFrame([(k, k + 1) for k in range(n - 1)], "src long, dst long"), spark.range(n).selectExpr("id as node", "1L as weight")))
    assert {(r.node, r.worst) for r in found.where("node % 997 = 0").collect()} == {(k, n - k) for k in range(0, n, 997)}
    assert [len(r.path) for r in L.ways(found, spark.createDataFrame([(n - 50,)], "node long")).collect()] == [50]


def test_nothing(spark):
    none = spark.createDataFrame([], "src long, dst long")
    assert L.longest(none, spark.createDataFrame([], "node long, weight long")).count() == 0
    assert [tuple(r) for r in L.longest(none, spark.createDataFrame([(1, 4)], "node long, weight long")).collect()] == [(1, 4, None, 1, False)]
