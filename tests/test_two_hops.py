"""Two-hop costs against sets, with many and few hubs, and a star."""

import random

import pytest

from strandline.operators import graph as G


def brute(pairs, ticks):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for x in ticks:
        far = set(near.get(x, ()))
        for y in near.get(x, ()):
            far |= near[y]
        out[x] = sum(ticks.get(y) or 0 for y in far - {x}) / 10
    return out


@pytest.mark.parametrize("heavy", [0, 2, 6, 256])
def test_costs_equal_those_of_sets(spark, heavy):
    rnd = random.Random(heavy)
    ticks = {f"n{i}": rnd.choice([0, None, 1, 7, 1000, 2**40 + i]) for i in range(150)}
    pairs = [(f"n{rnd.randrange(150)}", f"n{int(rnd.random() ** 3 * 150)}") for _ in range(260)] + [("n1", "n1"), ("n2", "out"), ("out", "n3"), ("n149", "n149")]
    got = G.two_hop_cost(spark.createDataFrame(pairs, "src string, dst string"), spark.createDataFrame(list(ticks.items()), "id string, ticks long").repartition(7), heavy=heavy)
    assert {r.id: r.hop_2_cost for r in got.collect()} == brute(pairs, ticks)


def test_a_star_of_twenty_thousand_leaves(spark):
    nodes = spark.range(20_001).selectExpr("id", "id % 3 AS ticks")
    pairs = spark.range(1, 20_001).selectExpr("0L AS src", "id AS dst")
    got = {r.id: r.hop_2_cost for r in G.two_hop_cost(pairs, nodes).collect()}
    total = sum(i % 3 for i in range(20_001))
    assert all(got[i] == (total - i % 3) / 10 for i in (0, 1, 2, 3, 19_999, 20_000)) and len(got) == 20_001


def test_no_pairs_and_no_nodes(spark):
    nodes = spark.range(2).selectExpr("id", "5L AS ticks")
    none = spark.createDataFrame([], "src long, dst long")
    assert [r.hop_2_cost for r in G.two_hop_cost(none, nodes).collect()] == [0.0, 0.0]
    assert G.two_hop_cost(none, nodes.limit(0)).count() == 0
