"""Graphs in the arrays of a task: reach, and what shortest paths give the nodes on their way.

A loop of joins takes a job a level. Here nodes get positions, pairs are sorted once, and a task reads all of them (four bytes a
pair, 50 a node) and goes through the levels by itself. How much that takes is counted first; callers join level by level
where it is too much for a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.session import BROADCAST_ROWS, written

#: Bytes of a graph that each core's task may hold. A graph of up to four times as many goes to so many fewer tasks.
TASK_BYTES = 256 << 20
#: Pairs that are looked at together.
AT_ONCE = 1 << 20
#: Pairs in a row on their way to the tasks.
IN_A_ROW = 1024


@dataclass
class Graph:
    """at: id, pos of the nodes that have pairs, by id from 0; steps: s, t, the pairs' positions, those of one s together."""

    at: DataFrame
    steps: DataFrame
    nodes: int
    pairs: int

    @property
    def bytes(self) -> int:
        return _bytes(self.nodes, self.pairs)


def _bytes(nodes: int, pairs: int) -> int:
    return 4 * pairs + 50 * nodes


def places(ids: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """ids (id and what else there is, each id once) with pos, its place in the order of these columns and the id, from 0,
    written; and how many there are.
    """
    at = written(ids.orderBy(*order, "id").withColumn("wide", F.monotonically_increasing_id()), "places")
    part = F.shiftright("wide", 33).cast("int")
    held = dict(at.groupBy(part.alias("part")).count().collect())
    starts, n = [], 0
    for k in range(max(held, default=0) + 1):
        starts.append(n)
        n += held.get(k, 0)
    first = F.element_at(F.array(*[F.lit(x).cast("long") for x in starts]), part + 1)
    return at.select(*ids.columns, (first + F.col("wide").bitwiseAND(F.lit((1 << 33) - 1))).alias("pos")), n


def numbered(pairs: DataFrame) -> Graph | None:
    """The graph of pairs (src, dst), which are a written table; None if it is too large for a task."""
    count = pairs.count()
    if _bytes(0, count) > 4 * TASK_BYTES:
        return None
    ends = pairs.select(F.col("src").alias("id")).unionByName(pairs.select(F.col("dst").alias("id")))
    at, n = places(ends.where("id is not null").distinct())
    if _bytes(n, count) > 4 * TASK_BYTES:
        return None
    side = F.broadcast if n <= BROADCAST_ROWS else lambda x: x
    here = lambda name: side(at.select(F.col("id").alias(f"{name}_id"), F.col("pos").cast("int").alias(name)))
    steps = pairs.join(here("t"), F.col("dst") == F.col("t_id")).join(here("s"), F.col("src") == F.col("s_id")).select("s", "t")
    return Graph(at, written(steps.repartition("s").sortWithinPartitions("s"), "steps"), n, count)


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of ranges, one range after another."""
    ends = np.cumsum(lengths)
    out = np.repeat(starts - (ends - lengths), lengths)
    out += np.arange(len(out), dtype=out.dtype)
    return out


def _runs(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin, and how long they are."""
    starts = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.empty(0, np.int64)
    return starts, np.diff(np.append(starts, len(s)))


class Neighbours:
    """The targets of each node. Pairs come in any order; those that come one after another from one node are a run."""

    def __init__(self, nodes: int, pairs: int):
        self.nodes, self.ends, self.filled = nodes, np.empty(pairs, np.int32), 0
        self.came: list[tuple[np.ndarray, ...]] = []

    def add(self, nodes: np.ndarray, lengths: np.ndarray, targets: np.ndarray) -> None:
        starts = self.filled + np.cumsum(lengths) - lengths
        self.ends[self.filled : self.filled + len(targets)] = targets
        self.filled += len(targets)
        self.came.append((nodes.astype(np.int32), starts.astype(np.int64), lengths.astype(np.int32)))

    def done(self) -> Neighbours:
        empty = np.empty(0, np.int32)
        node, self.start, self.length = (np.concatenate(x) for x in zip(*self.came, strict=True)) if self.came else (empty, empty.astype(np.int64), empty)
        self.came = []
        order = np.argsort(node, kind="stable")
        self.start, self.length = self.start[order], self.length[order]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(node, minlength=self.nodes)))).astype(np.int32)
        return self

    def of(self, nodes: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """(slice of nodes, how many targets each of them has there, the targets), a bounded number of targets at a time."""
        lo, n = self.first[nodes], self.first[nodes + 1] - self.first[nodes]
        at = np.arange(len(nodes))
        single = bool((n == 1).all())
        if single:
            run, owner = lo, at
        else:
            run, owner = _spread(lo.astype(np.int64), n), np.repeat(at, n)
        start, length = self.start[run], self.length[run].astype(np.int64)
        upto = np.cumsum(length)
        i = 0
        while i < len(run):
            before = int(upto[i] - length[i])
            j = max(i + 1, int(np.searchsorted(upto, before + AT_ONCE, side="right")))
            a, b = int(owner[i]), int(owner[j - 1]) + 1
            if j == i + 1 and length[i] > AT_ONCE:
                for k in range(0, int(length[i]), AT_ONCE):
                    part = self.ends[start[i] + k : start[i] + min(k + AT_ONCE, int(length[i]))]
                    yield slice(a, b), np.array([len(part)]), part
            else:
                many = length[i:j] if single else np.bincount(owner[i:j] - a, length[i:j], b - a).astype(np.int64)
                yield slice(a, b), many, self.ends[_spread(start[i:j], length[i:j])]
            i = j


def add_dependencies(graph: Neighbours, source: int, total: np.ndarray, seen: np.ndarray, paths: np.ndarray, sums: np.ndarray) -> None:
    """Adds to total what shortest paths from the source give the nodes between their ends.

    seen, paths and sums are work space, seen and sums empty before and after.
    """
    seen[source], paths[source] = True, 1.0
    levels = [np.array([source])]
    while True:
        here, met, few = levels[-1], [], True
        for part, many, to in graph.of(here):
            new = ~seen[to]
            to, by = to[new], np.repeat(paths[here[part]], many)[new]
            np.add.at(sums, to, by)
            few = few and sum(map(len, met)) + len(to) < len(sums) // 16
            met = [*met, to] if few else []
        there = np.unique(np.concatenate(met)) if few and met else np.empty(0, np.int64) if few else np.flatnonzero(sums)
        if not len(there):
            break
        paths[there], seen[there], sums[there] = sums[there], True, 0.0
        levels.append(there)
    # backward, sums holds (1 + dependency) / paths of the level below, and nothing of other levels
    below = levels[-1]
    sums[below] = 1 / paths[below]
    seen[below] = False
    for here in levels[-2::-1]:
        dep = np.zeros(len(here))
        for part, many, to in graph.of(here):
            dep[part] += np.bincount(np.repeat(np.arange(len(many)), many), sums[to], len(many))
        dep *= paths[here]
        sums[below] = 0.0
        seen[here] = False
        if here is not levels[0]:
            total[here] += dep
            sums[here] = (1 + dep) / paths[here]
        below = here
    sums[below] = 0.0


def _packed(batches):
    """s, t in rows of many: the nodes of runs, the runs' lengths, their targets, as bytes."""
    for batch in batches:
        s, t = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        rows = []
        for k in range(0, len(s), IN_A_ROW):
            part = s[k : k + IN_A_ROW]
            starts, lengths = _runs(part)
            rows.append((part[starts].tobytes(), lengths.astype(np.int32).tobytes(), t[k : k + IN_A_ROW].tobytes()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*rows, strict=True)], ["s", "n", "t"])


def _results(pos: np.ndarray, dep: np.ndarray | None = None):
    for k in range(0, len(pos), 1 << 16):
        part = slice(k, k + (1 << 16))
        columns = {"pos": pa.array(pos[part], pa.int64())} | ({} if dep is None else {"dep": pa.array(dep[part], pa.float64())})
        yield pa.RecordBatch.from_pydict(columns)


def dependencies(graph: Graph, sources: DataFrame) -> DataFrame:
    """id, dep: the sum over sources (id) of the dependency of each other node; some tasks each take a share of the sources."""
    spark, nodes, pairs = graph.steps.sparkSession, graph.nodes, graph.pairs
    from_ = sorted(r.pos for r in graph.at.join(sources.select("id"), "id").collect())
    cores = max(1, spark.sparkContext.defaultParallelism // math.ceil(graph.bytes / TASK_BYTES)) if graph.bytes else 1
    tasks = max(1, min(len(from_), cores))
    # a key for each task, so that no two tasks' keys are dealt to one
    found = {r.at: r.id for r in spark.range(tasks * 64).select("id", F.pmod(F.hash("id"), F.lit(tasks)).alias("at")).collect()}
    keys = [found.get(k, tasks * 64 + k) for k in range(tasks)]
    shares = {key: from_[k::tasks] for k, key in enumerate(keys)}

    def run(batches):
        key, held = None, None

        def finish():
            total, seen, paths, sums = np.zeros(nodes), np.zeros(nodes, bool), np.empty(nodes), np.zeros(nodes)
            held.done()
            for source in shares[key]:
                add_dependencies(held, source, total, seen, paths, sums)
            pos = np.flatnonzero(total)
            yield from _results(pos, total[pos])

        for batch in batches:
            for at, s, n, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != key:
                    if held is not None:
                        yield from finish()
                    key, held = at, Neighbours(nodes, pairs)
                held.add(*(np.frombuffer(x, np.int32) for x in (s, n, t)))
        if held is not None:
            yield from finish()

    packed = written(graph.steps.mapInArrow(_packed, "s binary, n binary, t binary"), "packed")
    each = packed.crossJoin(F.broadcast(spark.createDataFrame([(k,) for k in keys], "key long"))).select("key", "s", "n", "t")
    dealt = each.repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(run, "pos long, dep double")
    summed = written(dealt, "dependencies").groupBy("pos").agg(F.sum("dep").alias("dep"))
    return graph.at.join(summed, "pos").select("id", "dep")


def reached(graph: Graph, seeds: DataFrame, most_rounds: int) -> DataFrame | None:
    """id of the nodes with pairs that are seeds or that pairs lead to from them, in one task; None if that takes more rounds."""
    nodes, pairs = graph.nodes, graph.pairs

    def run(batches):
        held, seen = Neighbours(nodes, pairs), np.zeros(nodes, bool)
        for batch in batches:
            s, t = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            own = t < 0
            if own.any():
                seen[s[own]] = True
                s, t = s[~own], t[~own]
            starts, lengths = _runs(s)
            held.add(s[starts], lengths, t)
        held.done()
        here, rounds = np.flatnonzero(seen), 0
        while len(here) and rounds < most_rounds:
            rounds, met = rounds + 1, []
            for _, _, to in held.of(here):
                to = np.unique(to[~seen[to]])
                seen[to] = True
                met.append(to)
            here = np.concatenate(met) if met else here[:0]
        yield from _results(np.array([-1]) if len(here) else np.flatnonzero(seen))

    # -1 as a target marks a seed
    first = graph.at.join(seeds, "id").select(F.col("pos").cast("int").alias("s"), F.lit(-1).alias("t"))
    found = written(graph.steps.unionByName(first).coalesce(1).mapInArrow(run, "pos long"), "reached")
    if not found.where("pos < 0").isEmpty():
        return None
    return graph.at.join(found, "pos").select("id")


def lists(steps: DataFrame, kind: str) -> DataFrame:
    """of, to: the targets t of each s as bytes, in one row or several. steps (s, t, both of that kind) have those of one s together."""
    width = np.dtype(KINDS[kind]).itemsize

    def run(batches):
        for batch in batches:
            s, t = batch.column(0).to_numpy(), np.ascontiguousarray(batch.column(1).to_numpy())
            cuts = np.union1d(_runs(s)[0], np.arange(0, len(s), IN_A_ROW))
            at = pa.py_buffer(np.append(cuts * width, len(s) * width).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(s[cuts]), pa.Array.from_buffers(pa.binary(), len(cuts), [None, at, pa.py_buffer(t)])], ["of", "to"])

    return steps.select("s", "t").mapInArrow(run, f"of {kind}, to binary")


#: Positions as Spark and NumPy name them.
KINDS = {"int": np.int32, "long": np.int64}


def unions(rows: DataFrame, kind: str, ticks: list[tuple[int, int]]) -> DataFrame:
    """x, cost, word, bits of rows (x, apart, to: positions as bytes) that are sorted by x: the ticks of all of x's positions, each
    once; but if one of its rows says apart, the positions themselves, a row for each word of 64 bits.

    ticks: how many of the next positions have which tick. A task holds these, a batch and one node's positions.
    """
    return rows.mapInArrow(lambda batches: joined(batches, kind, ticks), "x long, cost long, word long, bits long")


def _words(x: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, ...]:
    """x, word, bits: positions z in order, as words."""
    word, bit = z >> 6, np.left_shift(np.uint64(1), (z & 63).astype(np.uint64))
    at = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (word[1:] != word[:-1]))))
    return x[at], word[at], np.bitwise_or.reduceat(bit, at).view(np.int64)


def _rows_of_unions(*columns: np.ndarray | None):
    n = len(columns[0])
    whole = pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()) if c is None else pa.array(c, pa.int64()) for c in columns], ["x", "cost", "word", "bits"])
    for k in range(0, n, 1 << 16):
        yield whole.slice(k, 1 << 16)


def joined(batches, kind: str, ticks: list[tuple[int, int]]):
    """The batches of unions()."""
    dtype, low = np.dtype(KINDS[kind]), (1 << 42) - 1
    worth = np.repeat(np.array([t for t, _ in ticks], np.int64), np.array([n for _, n in ticks], np.int64))
    # the last node is not complete before another one comes
    last, apart, kept = None, False, np.empty(0, np.int64)

    def finished(xs, flags, key):
        group = key >> 42
        wide = flags[group]
        if wide.any():
            x, word, bits = _words(xs[group[wide]], key[wide] & low)
            yield from _rows_of_unions(x, None, word, bits)
        if not wide.all():
            group, z = group[~wide], key[~wide] & low
            at, _ = _runs(group)
            yield from _rows_of_unions(xs[group[at]], np.add.reduceat(worth[z], at), None, None)

    for batch in batches:
        x, wide, to = (batch.column(k) for k in range(3))
        x, wide = x.to_numpy().astype(np.int64), wide.to_numpy(zero_copy_only=False)
        ends = np.frombuffer(to.buffers()[1], np.int32)[to.offset : to.offset + len(to) + 1].astype(np.int64) if len(x) else x
        i = 0
        while i < len(x):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + 8 * AT_ONCE, side="right")) - 1)
            z = np.frombuffer(to.buffers()[2], dtype, int(ends[j] - ends[i]) // dtype.itemsize, int(ends[i]))
            starts, many = _runs(x[i:j])
            xs, flags = x[i:j][starts], np.logical_or.reduceat(wide[i:j], starts)
            if last is not None and xs[0] == last:
                flags[0] |= apart
            elif last is not None:
                xs, flags, many = np.append(last, xs), np.append(apart, flags), np.append(0, many)
            group = np.repeat(np.repeat(np.arange(len(xs)), many), np.diff(ends[i : j + 1]) // dtype.itemsize)
            key = np.concatenate((kept, group << 42 | z))
            key.sort()
            key = key[np.concatenate(([True], key[1:] != key[:-1]))]
            upto = int(np.searchsorted(key, (len(xs) - 1) << 42))
            if upto:
                yield from finished(xs, flags, key[:upto])
            last, apart, kept = xs[-1], flags[-1], key[upto:] & low
            i = j
    if last is not None:
        yield from finished(np.array([last]), np.array([apart]), kept)
