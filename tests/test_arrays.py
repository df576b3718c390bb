"""Graphs in a task's arrays: against brute force, against the joins that take over for larger ones, and the number of jobs."""

import glob
import random
import time

import numpy as np
import pyarrow as pa
import pytest

from strandline import session
from strandline.operators import arrays
from strandline.operators import graph as G
from strandline.plans import registry
from tests.test_graph import brute_betweenness, reachable
from tests.test_two_hops import brute


def neighbours(n, pairs, at_a_time, in_order):
    held = arrays.Neighbours(n, len(pairs) + 3)
    for k in range(0, len(pairs), at_a_time):
        part = np.array(pairs[k : k + at_a_time])
        part = part[np.argsort(part[:, 0], kind="stable")] if in_order else part
        starts, lengths = arrays._runs(part[:, 0])
        held.add(part[starts, 0], lengths, part[:, 1])
    return held.done()


def drawn(seed, n, m):
    rnd = random.Random(seed)
    return list({(rnd.randrange(n), int(rnd.random() ** 2 * n)) for _ in range(m)})


@pytest.fixture
def writes(monkeypatch):
    """The tables written while the test runs."""
    seen, write = [], session.Scratch.write

    def counted(self, df):
        seen.append(self.label)
        return write(self, df)

    monkeypatch.setattr(session.Scratch, "write", counted)
    return seen


@pytest.mark.parametrize("seed", range(24))
def test_dependencies_in_small_parts(monkeypatch, seed):
    monkeypatch.setattr(arrays, "AT_ONCE", (1, 2, 5, 1 << 20)[seed % 4])
    n = 2 + seed * 2
    pairs = drawn(seed, n, 3 * n)
    held = neighbours(n, pairs, 7, seed % 3)
    for x in range(n):
        assert sorted(y for _, _, to in held.of(np.array([x])) for y in to) == sorted(b for a, b in pairs if a == x)
    total, seen, paths, sums = np.zeros(n), np.zeros(n, bool), np.empty(n), np.zeros(n)
    for s in range(n):
        arrays.add_dependencies(held, s, total, seen, paths, sums)
        assert not seen.any() and not sums.any()
    want = brute_betweenness(list(range(n)), pairs, list(range(n)), 1)
    assert all(abs(total[i] - want[i]) < 1e-9 for i in range(n))


@pytest.mark.parametrize("joined", [False, True])
def test_betweenness_by_both_ways(spark, monkeypatch, joined):
    if joined:
        monkeypatch.setattr(arrays, "TASK_BYTES", 0)
    n, pairs = 30, drawn(5, 27, 60)
    nodes = spark.createDataFrame([(i,) for i in range(n)], "id long")
    got = {r.id: r.betweenness for r in G.betweenness(spark.createDataFrame(pairs, "src long, dst long").repartition(3), nodes, exact_up_to=3, sample=11).collect()}
    want = brute_betweenness(list(range(n)), pairs, [i * n // 11 for i in range(11)], 11 * (n - 2))
    assert len(got) == n and all(abs(got[i] - want[i]) < 1e-12 for i in range(n))


def test_betweenness_of_a_long_chain_takes_no_table_a_level(spark, writes):
    n = 40
    nodes, chain = spark.range(n), spark.range(n - 1).selectExpr("id AS src", "id + 1 AS dst")
    got = {r.id: round(r.betweenness * (n - 1) * (n - 2)) for r in G.betweenness(chain, nodes).collect()}
    assert got == {i: i * (n - 1 - i) for i in range(n)}
    assert len(writes) < 10


def listed(rows, kind):
    """rows (x, apart, positions) in batches of three."""
    for k in range(0, len(rows), 3):
        x, apart, to = zip(*rows[k : k + 3], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(apart), pa.array([np.array(z, arrays.KINDS[kind]).tobytes() for z in to], pa.binary())], ["x", "apart", "to"])


@pytest.mark.parametrize("seed", range(8))
def test_unions_in_small_parts(monkeypatch, seed):
    monkeypatch.setattr(arrays, "AT_ONCE", (1, 4, 1 << 20)[seed % 3])
    kind, rnd = ("int", "long")[seed % 2], random.Random(seed)
    rows = sorted(((rnd.randrange(9), rnd.random() < 0.1, [rnd.randrange(200) for _ in range(rnd.randint(1, 30))]) for _ in range(40)), key=lambda r: r[0])
    ticks = [(0, 50), (7, 100), (2**50, 50)]
    worth = [t for t, n in ticks for _ in range(n)]
    want, far = {}, set()
    for x, apart, z in rows:
        want.setdefault(x, set()).update(z)
        far |= {x} if apart else set()
    cost, sets = {}, {}
    for batch in arrays.joined(listed(rows, kind), kind, ticks):
        for r in batch.to_pylist():
            if r["word"] is None:
                assert r["x"] not in cost
                cost[r["x"]] = r["cost"]
            else:
                sets.setdefault(r["x"], set()).update(64 * r["word"] + k for k in range(64) if r["bits"] >> k & 1)
    assert cost == {x: sum(worth[z] for z in s) for x, s in want.items() if x not in far} and sets == {x: want[x] for x in far}


@pytest.mark.parametrize(("heavy", "few"), [(256, True), (256, False), (4, True), (4, False)])
def test_two_hops_in_many_shares(spark, monkeypatch, heavy, few):
    """The lists on their way at once stay in proportion to the pairs; ticks that are all different go by words."""
    monkeypatch.setattr(G, "LISTS_A_PAIR", 2)
    if not few:
        monkeypatch.setattr(G, "BROADCAST_ROWS", 0)
    taken, unions = [], arrays.unions

    def counted(rows, kind, ticks):
        taken.append(rows.selectExpr("length(to) / 4 AS n").agg({"n": "sum"}).first()[0] or 0)
        return unions(rows, kind, ticks)

    monkeypatch.setattr(arrays, "unions", counted)
    pairs, ticks = drawn(7, 80, 500), {i: i * i for i in range(80)}
    got = G.two_hop_cost(spark.createDataFrame(pairs, "src long, dst long"), spark.createDataFrame(list(ticks.items()), "id long, ticks long"), heavy=heavy)
    assert {r.id: r.hop_2_cost for r in got.collect()} == brute(pairs, ticks)
    both = len({p for a, b in pairs for p in ((a, b), (b, a))})
    assert max(taken) <= 6 * both and (len(taken) > 4 or heavy == 4)


def test_writes_leave_no_shuffle_files(spark):
    """Also where nobody has set Spark's setting for it."""
    assert spark.conf.get(session.CLEANUP) == "false"
    local = [str(d) for d in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for d in local for f in glob.glob(f"{d}/*/shuffle_*.data")}
    before = files()
    table = session.written(spark.range(10_000).selectExpr("id % 5000 AS id").distinct(), "left")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and table.count() == 5000


@pytest.mark.parametrize("joined", [False, True])
def test_reach_by_both_ways(spark, monkeypatch, joined):
    if joined:
        monkeypatch.setattr(arrays, "TASK_BYTES", 0)
    pairs = drawn(3, 40, 45) + [(90, None), (None, 91)]
    seeds = [1, 5, 60]
    got = [r.id for r in G.reach(spark.createDataFrame(pairs, "src long, dst long"), spark.createDataFrame([(s,) for s in [*seeds, 5]], "id long")).collect()]
    assert sorted(got) == sorted(set().union(*(reachable(pairs, s) for s in seeds)))


def test_reach_along_a_long_chain_takes_no_table_a_level(spark, writes):
    chain = spark.range(50).selectExpr("id AS src", "id + 1 AS dst")
    assert G.reach(chain, spark.createDataFrame([(20,)], "id long")).count() == 31
    assert len(writes) < 10


def test_reach_status_reads_the_line_items_once(spark, monkeypatch):
    given, reach = [], G.reach

    def seen(pairs, seeds):
        given.append(pairs._jdf.queryExecution().optimizedPlan().toString())
        return reach(pairs, seeds)

    monkeypatch.setattr(G, "reach", seen)
    registry.QUERIES["reach_status"](spark, "/root/testdata/sf0.001").collect()
    assert len(given) == 2 and not any("Window" in p for p in given)


def test_betweenness_sampled_reads_the_line_items_once(spark, monkeypatch):
    given, dependencies = [], G._dependencies

    def seen(pairs, sources):
        given.append(pairs._jdf.queryExecution().optimizedPlan().toString())
        return dependencies(pairs, sources)

    monkeypatch.setattr(arrays, "TASK_BYTES", 0)
    monkeypatch.setattr(G, "_dependencies", seen)
    registry.QUERIES["betweenness_sampled"](spark, "/root/testdata/sf0.001").collect()
    assert len(given) == 1 and "Window" not in given[0]
