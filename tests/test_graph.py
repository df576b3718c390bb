"""Graph operators against small independent versions, on seeded random graphs."""

import random
from collections import deque

import pytest

from strandline.operators import graph as G
from strandline.operators import structure as S


def random_graph(seed, n=24, density=0.08):
    rnd = random.Random(seed)
    pairs = {(a, b): round(rnd.random(), 3) or 0.5 for a in range(n) for b in range(n) if a != b and rnd.random() < density}
    return list(range(n)), pairs


def frames(spark, nodes, pairs):
    return spark.createDataFrame([(i, i * 3) for i in nodes], "id long, ticks long"), spark.createDataFrame([(a, b, w) for (a, b), w in pairs.items()], "src long, dst long, weight double")


def reachable(pairs, a):
    seen, todo = {a}, [a]
    while todo:
        x = todo.pop()
        for s, d in pairs:
            if s == x and d not in seen:
                seen.add(d)
                todo.append(d)
    return seen


@pytest.mark.parametrize("seed", range(3))
def test_pagerank(spark, seed):
    nodes, pairs = random_graph(seed)
    n = len(nodes)
    score = dict.fromkeys(nodes, 1 / n)
    for _ in range(6):
        new = dict.fromkeys(nodes, 0.15 / n)
        for a in nodes:
            out = [(b, w) for (s, b), w in pairs.items() if s == a]
            for b, w in out:
                new[b] += 0.85 * score[a] / len(out) * w
            rest = 0.85 * score[a] * (1 - sum(w for _, w in out) / len(out)) if out else 0.85 * score[a]
            for b in nodes:
                new[b] += rest / n
        score = new
    v, e = frames(spark, nodes, pairs)
    got = {r.id: r.score for r in G.pagerank(e, v, 6, tolerance=None).collect()}
    assert all(abs(got[i] - score[i]) < 1e-12 for i in nodes) and abs(sum(got.values()) - 1) < 1e-9


def test_pagerank_of_one_node_and_of_none(spark):
    v, e = frames(spark, [7], {})
    assert [r.score for r in G.pagerank(e, v).collect()] == [1.0]
    assert G.pagerank(e, v.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_components_and_distances(spark, seed):
    nodes, pairs = random_graph(seed, density=0.06)
    v, e = frames(spark, nodes, pairs)
    both = set(pairs) | {(b, a) for a, b in pairs}
    assert {r.id: r.component for r in G.components(e, v).collect()} == {i: min(reachable(both, i)) for i in nodes}
    mutual = {i: {j for j in reachable(pairs, i) if i in reachable(pairs, j)} for i in nodes}
    assert {r.id: r.component for r in G.strong_components(e).collect()} == {i: min(m) for i, m in mutual.items() if len(m) > 1}
    near = {i: {b for a, b in both if a == i} for i in nodes}
    want = {i: sum(j * 3 for j in (near[i] | {k for j in near[i] for k in near[j]}) - {i}) / 10 for i in nodes}
    assert {r.id: r.hop_2_cost for r in G.two_hop_cost(e, v).collect()} == want
    assert {r.id for r in G.reach(e, v.where("id < 3").select("id")).collect()} == set().union(*(reachable(pairs, i) for i in range(3)))
    got = {(r.src, r.dst) for r in G.closure(e).collect()}
    assert got == {(a, d) for a in nodes for b in {y for x, y in pairs if x == a} for d in reachable(pairs, b)}


@pytest.mark.parametrize("few", [True, False])
def test_components_of_a_hub_and_a_chain_make_a_row_a_link(spark, monkeypatch, few):
    from strandline.operators import components

    plans, write = [], components.Scratch.write

    def kept(self, df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(self, df)

    monkeypatch.setattr(components.Scratch, "write", kept)
    monkeypatch.setattr(components, "BROADCAST_ROWS", 10**6 if few else 0)
    pairs = [(5, k) for k in range(6, 40)] + [(k, k + 1) for k in range(50, 70)] + [(70, 3), (3, 60), (80, 81), (81, 80), (90, 90)]
    got = components.star_components(spark.createDataFrame(pairs, "a long, b long")).collect()
    want = {k: 5 for k in range(5, 40)} | {k: 3 for k in [3, *range(50, 71)]} | {80: 80, 81: 80}
    assert {r.node: r.component for r in got} == want and len(got) == len(want)
    assert len(plans) > 1 and not any("Generate" in p for p in plans)


def brute_betweenness(nodes, pairs, sources, scale):
    total = dict.fromkeys(nodes, 0.0)
    for s in sources:
        dist, count, order, back = {s: 0}, {s: 1.0}, [], {i: [] for i in nodes}
        todo = deque([s])
        while todo:
            x = todo.popleft()
            order.append(x)
            for a, b in pairs:
                if a == x:
                    if b not in dist:
                        dist[b], count[b] = dist[x] + 1, 0.0
                        todo.append(b)
                    if dist[b] == dist[x] + 1:
                        count[b] += count[x]
                        back[b].append(x)
        dep = dict.fromkeys(nodes, 0.0)
        for x in reversed(order):
            for p in back[x]:
                dep[p] += count[p] / count[x] * (1 + dep[x])
            if x != s:
                total[x] += dep[x]
    return {i: t / scale for i, t in total.items()}


def test_betweenness_exact_and_sampled(spark):
    nodes, pairs = random_graph(11, n=18, density=0.15)
    v, e = frames(spark, nodes, pairs)
    n = len(nodes)
    got = {r.id: r.betweenness for r in G.betweenness(e, v.select("id")).collect()}
    want = brute_betweenness(nodes, pairs, nodes, (n - 1) * (n - 2))
    assert all(abs(got[i] - want[i]) < 1e-12 for i in nodes)
    sources = [sorted(nodes)[i * n // 5] for i in range(5)]
    assert sorted(r.id for r in G.sample_sources(v.select("id"), 5).collect()) == sources
    got = {r.id: r.betweenness for r in G.betweenness(e, v.select("id"), exact_up_to=3, sample=5).collect()}
    want = brute_betweenness(nodes, pairs, sources, 5 * (n - 2))
    assert all(abs(got[i] - want[i]) < 1e-12 for i in nodes)


@pytest.mark.parametrize(("n", "k"), [(1, 1), (7, 3), (10, 10), (11, 20), (250, 100)])
def test_sampled_places(spark, n, k):
    ids = [i * i for i in range(n)]
    got = sorted(r.id for r in G.sample_sources(spark.createDataFrame([(i,) for i in ids], "id long"), k).collect())
    assert got == sorted({ids[i * n // min(n, k)] for i in range(min(n, k))})


def test_first_visits_go_to_the_end_of_a_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(9, 0), (0, 2)], "src long, dst long")
    roots = spark.createDataFrame([(0,), (20,)], "id long")
    want = {0: 0, 20: 0, 1: 1} | {i: i - 1 for i in range(2, 10)}
    assert {r.id: r.depth for r in G.first_visits(chain, roots).collect()} == want
    assert {r.id: r.depth for r in G.first_visits(chain, roots, 3).collect()} == {i: d for i, d in want.items() if d <= 3}


def test_empty_graph(spark):
    v, e = frames(spark, [1, 2], {})
    assert G.strong_components(e).count() == 0
    assert {r.id: r.component for r in G.components(e, v).collect()} == {1: 1, 2: 2}
    assert {r.id: r.hop_2_cost for r in G.two_hop_cost(e, v).collect()} == {1: 0.0, 2: 0.0}


def test_ambiguous_targets_share_and_self_loops_go(spark):
    rows = [(1, 2, 3, 3, "CALLS", "static_certain", "ambiguous"), (1, 1, None, None, "CALLS", "static_certain", "exact"), (1, 2, None, None, "READS", "static_inferred", "exact")]
    e = G.project(spark.createDataFrame(rows, "from_id long, to_id long, alt1 long, alt2 long, relation string, confidence string, resolution string"))
    assert sorted((r.target, r.share) for r in e.where("relation = 'CALLS' and resolution = 'ambiguous'").collect()) == [(2, 0.5), (3, 0.5)]
    assert {(r.src, r.dst): round(r.weight, 6) for r in G.pair_weights(e).collect()} == {(1, 2): 0.3, (1, 3): 0.15}


def test_enclosing_spans_against_all(spark):
    rnd = random.Random(3)
    spans = [(i, rnd.choice("ab"), s := rnd.randint(0, 60), s + rnd.randint(0, 40)) for i in range(60)]
    uses = [(f, line) for f in "abc" for line in range(0, 110, 3)]
    got = {(r.file_path, r.line): r.node_id for r in S.enclosing(spark.createDataFrame(uses, "file_path string, line long"), spark.createDataFrame(spans, "node_id long, file_path string, start_line long, end_line long")).collect()}
    want = {}
    for f, line in uses:
        hit = [(e - s, i) for i, g, s, e in spans if g == f and s <= line <= e]
        if hit:
            want[(f, line)] = min(hit)[1]
    assert got == want


def test_longest_prefix(spark):
    files = spark.createDataFrame([("a/b/c.py",), ("a/x.py",), ("top.py",), ("ab/y.py",)], "path string")
    modules = spark.createDataFrame([("", "root"), ("a", "m2"), ("a", "m1"), ("a/b", "deep")], "module_dir string, module_path string")
    assert {r.path: r.module_path for r in S.longest_prefix(files, modules).collect()} == {"a/b/c.py": "deep", "a/x.py": "m1", "top.py": "root", "ab/y.py": "root"}


def test_changes(spark):
    now, then = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), spark.createDataFrame([("b", 2), ("c", 3)], "k string, v int")
    assert sorted(map(tuple, S.changes(now, then, ["k", "v"]).collect())) == [("a", 1, "new"), ("c", 3, "gone")]


def test_strong_components_of_rings_tails_and_chords(spark):
    """A ring of 20,000 takes a logarithm of rounds; runs between branching nodes, and rings that meet in one node."""
    ring = [(i, (i + 1) % 20_000) for i in range(20_000)]
    tail = [(30_000 + i, 30_001 + i) for i in range(3_000)] + [(0, 30_000)]
    eight = [(40_000, 40_001), (40_001, 40_002), (40_002, 40_000), (40_000, 40_003), (40_003, 40_000)]
    ladder = [(50_000 + i, 50_000 + (i + d) % 9) for i in range(9) for d in (1, 2)] + [(50_003, 60_000), (60_000, 60_001), (60_001, 50_005), (50_004, 61_000), (61_000, 61_001)]
    got = {r.id: r.component for r in G.strong_components(spark.createDataFrame(ring + tail + eight + ladder, "src long, dst long")).collect()}
    want = dict.fromkeys(range(20_000), 0) | dict.fromkeys(range(40_000, 40_004), 40_000) | dict.fromkeys([*range(50_000, 50_009), 60_000, 60_001], 50_000)
    assert got == want


@pytest.mark.parametrize("seed", range(2))
def test_strong_components_of_subdivided_graphs(spark, seed):
    """Random graphs whose pairs are drawn out into runs of one to four nodes."""
    nodes, pairs = random_graph(seed + 20, n=9, density=0.2)
    drawn, new = [], 100
    for k, (a, b) in enumerate(pairs):
        for _ in range(k % 4):
            drawn.append((a, new))
            a, new = new, new + 1
        drawn.append((a, b))
    every = {x for p in drawn for x in p}
    away = {x: reachable(drawn, x) for x in every}
    want = {x: min(m) for x in every if len(m := {y for y in away[x] if x in away[y]}) > 1}
    assert {r.id: r.component for r in G.strong_components(spark.createDataFrame(drawn, "src long, dst long")).collect()} == want


def test_loops_that_do_not_end_say_so(spark):
    v = spark.createDataFrame([(i, 1) for i in range(8)], "id long, ticks long")
    ring = spark.createDataFrame([(i, (i + d) % 8, 0.5 + i / 20) for i in range(8) for d in (1, 2)], "src long, dst long, weight double")
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "src long, dst long")
    for run in (
        lambda: G.pagerank(ring, v, 2),
        lambda: G.components(chain, v, 1),
        lambda: G.reach(chain, v.where("id = 0").select("id"), 3),
        lambda: G.closure(chain, 1),
        lambda: G.strong_components(ring.select("src", "dst"), 1),
        lambda: G.shortest_paths(chain, v.where("id = 0").select("id"), 3),
    ):
        with pytest.raises(G.NotConverged):
            run()
