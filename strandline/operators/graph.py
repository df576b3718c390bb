"""Graph operators: projection of relations to pairs, degrees, ranks, components, reach and distances.

Fixpoints are loops on the driver over DataFrames; each round is written to the shared folder, and only its counts come
back. A loop that ends before its result is complete raises NotConverged. Pairs are (src, dst[, weight]).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from strandline.functions.edges import candidate_targets, edge_rank, edge_weight
from strandline.operators import arrays
from strandline.operators.components import NotConverged, star_components
from strandline.session import BROADCAST_ROWS, Scratch, written

#: Positions in lists on their way at once in two_hop_cost, for each pair.
LISTS_A_PAIR = 4
#: Bytes of lists that a task joins.
UNION_BYTES = 32 << 20


def project(edges: DataFrame) -> DataFrame:
    """One row for each target a relation may have, with its share, its weight before sharing and its tier's rank."""
    targets = candidate_targets(F.col("to_id"), F.array("alt1", "alt2"), F.col("resolution"))
    rows = edges.withColumn("targets", targets).withColumn("share", 1 / F.size("targets"))
    return rows.select("from_id", F.explode("targets").alias("target"), "relation", "confidence", "resolution", "share", edge_weight(F.col("confidence"), F.col("resolution")).alias("base_weight"), edge_rank(F.col("confidence"), F.col("resolution")).alias("rank"))


def pair_weights(projected: DataFrame) -> DataFrame:
    """Parallel relations merged: the greatest weight of a pair; no self-pairs."""
    return projected.where("from_id <> target").groupBy(F.col("from_id").alias("src"), F.col("target").alias("dst")).agg(F.max(F.col("base_weight") * F.col("share")).alias("weight"))


def degrees(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """fan_in, fan_out and their weighted twins for every node, zero where there is no pair."""
    both = pairs.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("out"), "weight"), F.struct(F.col("dst").alias("id"), F.lit(0).alias("out"), "weight"))).alias("x")).select("x.*")
    out = F.col("out") == 1
    d = both.groupBy(F.col("id").alias("node")).agg(F.sum(1 - F.col("out")).alias("fan_in"), F.sum("out").alias("fan_out"), F.sum(F.when(~out, F.col("weight"))).alias("weighted_fan_in"), F.sum(F.when(out, F.col("weight"))).alias("weighted_fan_out"))
    filled = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("fan_in", "fan_out")] + [F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("weighted_fan_in", "weighted_fan_out")]
    return nodes.join(d, F.col("id") == F.col("node"), "left").select(*nodes.columns, *filled)


def pagerank(pairs: DataFrame, nodes: DataFrame, iterations: int = 100, damping: float = 0.85, tolerance: float | None = 1e-10) -> DataFrame:
    """id, score. A node gives each neighbour damping * score / degree times the pair's weight; what weights below one
    hold back, and the scores of nodes without neighbours, go to all nodes alike. Stops when the scores move by no more
    than the tolerance in all (None: after so many iterations); NotConverged if so many iterations are not enough.

    Pairs are dealt by their source once and kept so while the rounds last; a round is one job, whose sums come back
    with the write.
    """
    spark = nodes.sparkSession
    ids = nodes.select("id")
    n = ids.count()
    if not n:
        return ids.withColumn("score", F.lit(None).cast("double"))
    out = pairs.groupBy("src").agg(F.count("*").alias("degree"), F.sum("weight").alias("given"))
    given = written(out.withColumnRenamed("src", "s"), "pr")
    e = pairs.join(given, F.col("src") == F.col("s")).select("src", "dst", (F.col("weight") / F.col("degree")).alias("part"))
    e = written(e, "pr").repartition(F.col("src")).persist()
    scores, spread = Scratch(spark, "pr"), 0.0

    def step(df: DataFrame) -> tuple[DataFrame, dict]:
        seen = Observation()
        now = scores.write(df.observe(seen, F.sum("score").alias("total"), F.sum(F.col("score") * F.col("kept")).alias("lost"), F.sum(F.abs(F.col("score") - F.col("was"))).alias("change")))
        return now, seen.get

    kept = F.coalesce(F.col("given") / F.col("degree"), F.lit(0.0)).alias("kept")
    now, sums = step(ids.join(given, F.col("id") == F.col("s"), "left").select("id", kept, F.lit(1.0 / n).alias("score"), F.lit(0.0).alias("was")))
    try:
        for _ in range(iterations):
            # all that is not given along pairs is spread: 1 - d, the discounts and the dangling scores
            spread = sums["total"] - sums["lost"]
            base = ((1.0 - damping) + damping * spread) / n
            before = now.select("id", "kept", "score")
            moved = e.join(before.select(F.col("id").alias("f"), "score"), F.col("src") == F.col("f")).groupBy("dst").agg((damping * F.sum(F.col("score") * F.col("part"))).alias("got"))
            now, sums = step(before.join(moved, F.col("id") == F.col("dst"), "left").select("id", "kept", (base + F.coalesce("got", F.lit(0.0))).alias("score"), F.col("score").alias("was")))
            scores.keep(1)
            if tolerance is not None and sums["change"] <= tolerance:
                return now.select("id", "score")
    finally:
        e.unpersist()
    if tolerance is not None:
        raise NotConverged(f"pagerank: {iterations} iterations were not enough")
    return now.select("id", "score")


def undirected(pairs: DataFrame) -> DataFrame:
    return pairs.select("src", "dst").unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def _word_cost(bits: str | Column, places: int) -> Column:
    """Ticks of all nodes whose bits are set: for each binary place of the ticks, how many of them have it."""
    bits = F.col(bits) if isinstance(bits, str) else bits
    out = F.lit(0).cast("long")
    for i in range(places):
        out = out + F.shiftleft(F.bit_count(bits.bitwiseAND(F.coalesce(f"plane{i}", F.lit(0).cast("long")))).cast("long"), i)
    return out


def two_hop_cost(pairs: DataFrame, nodes: DataFrame, ticks: str = "ticks", heavy: int = 256) -> DataFrame:
    """id, hop_2_cost: a tenth of the ticks (whole numbers from 0; null is 0) of all nodes one or two steps away, either way; not of the
    node itself.

    Nodes get positions by ticks. A node with no more than `heavy` neighbours hands the list of them to each of them, and the
    lists that a node got are joined by sorting them in arrays. That goes by shares of the nodes, so that the lists on their
    way stay in proportion to the pairs. Those with more neighbours do not: nodes with the same heavy neighbours form one
    group, for which the neighbours' sets, as words of 64 bits, are joined once, and a node only adds what its group has not.
    A star of n leaves thus takes n rows and n / 64 words, not n * n pairs. Costs of words are counted by the ticks' binary places.
    """
    pairs = written(pairs.select("src", "dst"), "pairs")
    every = nodes.select("id", F.coalesce(F.col(ticks).cast("long"), F.lit(0)).alias("t"))
    for end in ("src", "dst"):
        every = every.unionByName(pairs.select(F.col(end).alias("id"), F.lit(0).cast("long").alias("t")).distinct())
    at, n = arrays.places(every.groupBy("id").agg(F.max("t").alias("t")), "t")
    kind = "int" if n < 1 << 31 else "long"
    here = lambda name: at.select(F.col("id").alias(f"{name}_id"), F.col("pos").cast(kind).alias(name))
    e = pairs.join(here("y"), F.col("dst") == F.col("y_id")).join(here("x"), F.col("src") == F.col("x_id"))
    e = e.select(F.col("x").alias("s"), F.col("y").alias("t")).unionByName(e.select(F.col("y").alias("s"), F.col("x").alias("t")))
    e = written(e.repartition("s").distinct().sortWithinPartitions("s"), "steps")
    count = e.count()
    fan = e.groupBy(F.col("s").alias("hub")).count()
    handed = fan.where(F.col("count") <= heavy).agg(F.sum(F.col("count") * F.col("count"))).first()[0] or 0
    hubs = written(fan.where(F.col("count") > heavy).select("hub"), "hubs")
    some = not hubs.isEmpty()
    if some:
        sets = written(e.join(hubs, F.col("t") == F.col("hub")).groupBy(F.col("s").alias("x")).agg(F.sort_array(F.collect_list("t")).alias("hubs")), "sets")
        groups = written(sets.select("hubs").distinct().withColumn("group", F.monotonically_increasing_id()), "groups")
        of = written(sets.join(groups, "hubs").select(F.col("x").alias("gx"), "group"), "of")
    # the ticks of positions, of which few differ; else all sets are handed on as words
    differ = at.groupBy("t").count()
    whole = differ.count() > BROADCAST_ROWS
    worth = [] if whole else [tuple(r) for r in differ.orderBy("t").collect()]
    lists = arrays.lists(e, kind)
    if some:
        lists = lists.join(of, F.col("of") == F.col("gx"), "left").select("of", (F.lit(whole) | F.col("gx").isNotNull()).alias("apart"), "to")
    else:
        lists = lists.select("of", F.lit(whole).alias("apart"), "to")
    lists = written(lists, "lists")
    light = lists.join(hubs, F.col("of") == F.col("hub"), "left_anti") if some else lists
    shares = -(-handed // (LISTS_A_PAIR * max(1, count)))
    share = lambda c: F.pmod(F.hash(c), F.lit(max(1, shares)))
    steps = e if shares <= 1 else written(e.withColumn("share", share("s")).repartitionByRange("share", "s").sortWithinPartitions("share"), "steps")
    parts = max(1, (handed // max(1, shares) + count) * (4 if kind == "int" else 8) // UNION_BYTES)
    parts = max(parts, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    own = None
    for k in range(max(1, shares)):
        from_ = steps if shares <= 1 else steps.where(F.col("share") == k)
        got = from_.join(light.select("of", "to"), F.col("t") == F.col("of")).select(F.col("s").alias("x"), F.lit(False).alias("apart"), "to")
        got = got.unionByName(lists.where(share("of") == k).select(F.col("of").alias("x"), "apart", "to"))
        part = written(arrays.unions(got.repartition(parts, "x").sortWithinPartitions("x"), kind, worth), "own")
        own = part if own is None else own.unionByName(part)
    cost = own.where("word is null").select("x", "cost")
    if some or whole:
        own = own.where("word is not null").select("x", "word", "bits")
        places = int(at.agg(F.max("t")).first()[0] or 0).bit_length()
        word, bit = F.shiftright("pos", 6), F.expr("shiftleft(1L, cast(pos & 63 as int))")
        marks = [F.bit_or(F.when(F.shiftright("t", i).bitwiseAND(F.lit(1)) == 1, bit)).alias(f"plane{i}") for i in range(places)]
        planes = at.groupBy(word.alias("pw")).agg(F.count("*").alias("held"), *marks)
        if some:
            words = e.join(hubs, F.col("s") == F.col("hub")).groupBy("hub", F.shiftright(F.col("t").cast("long"), 6).alias("word"))
            words = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(t & 63 as int))")).alias("bits")).withColumnRenamed("hub", "of")
            shared = groups.select("group", F.explode("hubs").alias("hub")).join(written(words, "words"), F.col("hub") == F.col("of")).groupBy("group", "word").agg(F.bit_or("bits").alias("bits"))
            shared = written(shared, "shared").select(F.col("group").alias("sg"), F.col("word").alias("sw"), F.col("bits").alias("sbits"))
            base = shared.join(planes, F.col("sw") == F.col("pw")).groupBy("sg").agg(F.sum(_word_cost("sbits", places)).alias("base"))
            based = of.join(base, F.col("group") == F.col("sg")).select(F.col("gx").cast("long").alias("x"), F.col("base").alias("cost"))
            own = own.join(of, F.col("x") == F.col("gx"), "left").join(shared, (F.col("group") == F.col("sg")) & (F.col("word") == F.col("sw")), "left")
            own = own.select("x", "word", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("sbits", F.lit(0).cast("long")))).alias("bits")).where("bits <> 0")
            cost = cost.unionByName(based)
        rest = own.join(planes, F.col("word") == F.col("pw")).groupBy("x").agg(F.sum(_word_cost("bits", places)).alias("cost"))
        cost = cost.unionByName(rest).groupBy("x").agg(F.sum("cost").alias("cost"))
    cost = cost.join(at, F.col("x") == F.col("pos")).select(F.col("id").alias("k"), (F.col("cost") - F.col("t")).alias("cost"))
    return nodes.select("id").join(cost, F.col("id") == F.col("k"), "left").select("id", (F.coalesce("cost", F.lit(0)) / 10).alias("hop_2_cost"))


def components(pairs: DataFrame, nodes: DataFrame, most_rounds: int = 200) -> DataFrame:
    """id, component: the least node that pairs reach either way (see star_components)."""
    found = star_components(pairs.select(F.col("src").alias("a"), F.col("dst").alias("b")), most_rounds)
    return nodes.select("id").join(found, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("component"))


class _Seen:
    """What a search has visited: one written table a level, never written again but when there are many of them."""

    def __init__(self, first: DataFrame, label: str):
        self.label, self.levels = label, [first]

    def all(self) -> DataFrame:
        if len(self.levels) > 24:
            self.levels = [written(self._union(), self.label)]
        return self._union()

    def _union(self) -> DataFrame:
        out = self.levels[0]
        for x in self.levels[1:]:
            out = out.unionByName(x)
        return out


def reach(pairs: DataFrame, seeds: DataFrame, most_rounds: int = 100_000) -> DataFrame:
    """id of every node that directed pairs reach from the seeds, the seeds among them.

    One task goes through the levels if it can hold the graph (see arrays); else they are joined, a round a level.
    """
    pairs, frontier = written(pairs.select("src", "dst"), "reach"), written(seeds.select("id").distinct(), "reach")
    graph = arrays.numbered(pairs)
    if graph is not None:
        found = arrays.reached(graph, frontier, most_rounds)
        if found is None:
            raise NotConverged(f"reach: {most_rounds} rounds were not enough")
        return found.unionByName(frontier.join(graph.at, "id", "left_anti"))
    seen = _Seen(frontier, "reach")
    for _ in range(most_rounds):
        new = frontier.join(pairs, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
        frontier = written(new.join(seen.all(), "id", "left_anti"), "reach")
        if frontier.isEmpty():
            return seen.all()
        seen.levels.append(frontier)
    raise NotConverged(f"reach: {most_rounds} rounds were not enough")


def first_visits(pairs: DataFrame, roots: DataFrame, most_depth: int | None = None) -> DataFrame:
    """id, depth of every node that directed pairs reach from the roots (depth 0), in the fewest steps; at most most_depth, if given."""
    frontier = written(roots.select("id", F.lit(0).alias("depth")).distinct(), "visit")
    seen = _Seen(frontier, "visit")
    depth = 0
    while most_depth is None or depth < most_depth:
        depth += 1
        new = frontier.join(pairs, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct().join(seen.all(), "id", "left_anti")
        frontier = written(new.select("id", F.lit(depth).alias("depth")), "visit")
        if frontier.isEmpty():
            break
        seen.levels.append(frontier)
    return seen.all()


def closure(pairs: DataFrame, most_rounds: int = 64) -> DataFrame:
    """All (src, dst) with a directed path of one step or more, by doubling the paths' lengths."""
    paths, rounds = written(pairs.select("src", "dst").distinct(), "closure"), Scratch(pairs.sparkSession, "closure")
    size = paths.count()
    for _ in range(most_rounds):
        longer = paths.join(paths.select(F.col("src").alias("via"), F.col("dst").alias("far")), F.col("dst") == F.col("via")).select("src", F.col("far").alias("dst"))
        paths = rounds.write(paths.unionByName(longer).distinct())
        now = paths.count()
        rounds.keep(1)
        if now == size:
            return paths
        size = now
    raise NotConverged(f"closure: {most_rounds} rounds were not enough")


def chains(pairs: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """The runs of nodes with one way in and one way out: (members: id, before, after; rings: id, ring), or None.

    before and after are the nodes at both ends of a member's run. Runs without ends are rings, named by their least
    node. Pointers double, so that the rounds are the logarithm of the longest run.
    """
    ways_out = pairs.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("outs"), F.min("dst").alias("to"))
    ways_in = pairs.groupBy(F.col("dst").alias("k")).agg(F.count("*").alias("ins"), F.min("src").alias("from"))
    inner = written(ways_out.join(ways_in, F.col("id") == F.col("k")).where("outs = 1 and ins = 1").select("id", "from", "to"), "chain")
    n = inner.count()
    if not n:
        return None
    rounds = Scratch(pairs.sparkSession, "jump")
    at = rounds.write(inner.select("id", F.col("to").alias("after"), F.col("id").alias("last"), F.col("id").alias("low")))
    for _ in range(math.ceil(math.log2(n)) + 1):
        further = at.select(F.col("id").alias("k"), F.col("after").alias("after2"), F.col("last").alias("last2"), F.col("low").alias("low2"))
        on = at.join(further, F.col("after") == F.col("k"), "left")
        at = rounds.write(on.select("id", F.coalesce("after2", "after").alias("after"), F.coalesce("last2", "last").alias("last"), F.least("low", "low2").alias("low"), F.col("k").isNotNull().alias("going")))
        rounds.keep(2)
        if at.where("going").isEmpty():
            break
    # after 2 ** rounds steps only a ring is still inside
    at = at.select("id", "after", "last", "low")
    open_ = at.join(inner.select(F.col("id").alias("k")), F.col("after") == F.col("k"), "left_anti")
    rings = written(at.join(open_.select(F.col("id").alias("k")), F.col("id") == F.col("k"), "left_anti").select("id", F.col("low").alias("ring")), "rings")
    heads = inner.join(inner.select(F.col("id").alias("k")), F.col("from") == F.col("k"), "left_anti").select(F.col("id").alias("h"), F.col("from").alias("before"))
    first = open_.join(heads, F.col("id") == F.col("h")).select(F.col("last").alias("run"), "before")
    return written(open_.join(first, F.col("last") == F.col("run")).select("id", "before", "after"), "runs"), rings


def strong_components(pairs: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """id, component (the least member) of every node on a cycle of two nodes or more.

    First the graph is reduced: nodes without a way in or out lie on no cycle and go; runs of nodes with one way in and
    one way out become one pair between their ends, since such a node is in a component exactly if both ends are in it.
    Rings and long tails take a logarithm of rounds. What is left is coloured forward and backward: the greatest node
    that reaches a node colours it; within a colour, what reaches its root backwards is the root's component.
    NotConverged if a component's longest way takes more than most_rounds.
    """
    pairs = pairs.where("src <> dst").select("src", "dst").distinct()
    left, kept = written(pairs, "scc"), Scratch(pairs.sparkSession, "scc")
    size, layers, found = left.count(), [], []
    while size:
        into, out = left.select(F.col("dst").alias("k")).distinct(), left.select(F.col("src").alias("k")).distinct()
        left = kept.write(left.join(into, F.col("src") == F.col("k"), "left_semi").join(out, F.col("dst") == F.col("k"), "left_semi"))
        runs = chains(left)
        if runs is not None:
            members, rings = runs
            found.append(rings.select("id", F.col("ring").alias("c")))
            layers.append(members)
            inner = written(members.select("id").unionByName(rings.select("id")), "inner").select(F.col("id").alias("k"))
            bare = left.join(inner, F.col("src") == F.col("k"), "left_anti").join(inner, F.col("dst") == F.col("k"), "left_anti")
            left = kept.write(bare.unionByName(members.where("before <> after").select(F.col("before").alias("src"), F.col("after").alias("dst"))).distinct())
        kept.keep(2)
        now = left.count()
        if now == size:
            break
        size = now
    if size:
        found.append(_coloured(left, most_rounds))
    if not found:
        return pairs.select(F.col("src").alias("id"), F.col("src").alias("component")).limit(0)
    labels = found[0]
    for x in found[1:]:
        labels = labels.unionByName(x)
    labels = written(labels, "scc")
    for members in reversed(layers):
        a, b = labels.select(F.col("id").alias("ka"), F.col("c").alias("ca")), labels.select(F.col("id").alias("kb"), F.col("c").alias("cb"))
        own = members.join(a, F.col("before") == F.col("ka"), "left").join(b, F.col("after") == F.col("kb"), "left")
        # an end in no component is its own
        ca, cb = F.coalesce("ca", "before"), F.coalesce("cb", "after")
        inside = written(own.where(ca == cb).select("id", "before", ca.alias("c")), "scc")
        ends = inside.select(F.col("before").alias("id"), "c").distinct().join(labels.select(F.col("id").alias("k")), F.col("id") == F.col("k"), "left_anti")
        labels = written(labels.unionByName(inside.select("id", "c")).unionByName(ends), "scc")
    sized = labels.groupBy(F.col("c").alias("k")).agg(F.count("*").alias("n"), F.min("id").alias("component")).where("n > 1")
    return labels.join(sized, F.col("c") == F.col("k")).select("id", "component")


def _coloured(left: DataFrame, most_rounds: int) -> DataFrame:
    """id, c: the nodes of each strong component under one c; a node by itself may be left out or be its own."""
    found, kept = None, Scratch(left.sparkSession, "colour")
    while not left.isEmpty():
        color = kept.write(left.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("c", F.col("id")))
        for _ in range(most_rounds):
            sent = left.join(color, F.col("src") == F.col("id")).groupBy("dst").agg(F.max("c").alias("got"))
            now = kept.write(color.join(sent, F.col("id") == F.col("dst"), "left").select("id", F.greatest("c", F.coalesce("got", "c")).alias("c"), (F.coalesce("got", "c") > F.col("c")).alias("up")))
            kept.keep(1)
            color = now.select("id", "c")
            if now.where("up").isEmpty():
                break
        else:
            raise NotConverged(f"strong components: {most_rounds} rounds were not enough")
        a, b = color.select(F.col("id").alias("src"), F.col("c").alias("cs")), color.select(F.col("id").alias("dst"), F.col("c").alias("cd"))
        inside = written(left.join(a, "src").join(b, "dst").where("cs = cd").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("cs").alias("c")), "scc")
        frontier = written(color.where("id = c"), "scc")
        members = _Seen(frontier, "scc")
        for _ in range(most_rounds):
            step = frontier.join(inside, (F.col("id") == F.col("src")) & (frontier["c"] == inside["c"])).select(F.col("dst").alias("id"), inside["c"]).distinct()
            frontier = written(step.join(members.all(), ["id", "c"], "left_anti"), "scc")
            if frontier.isEmpty():
                break
            members.levels.append(frontier)
        else:
            raise NotConverged(f"strong components: {most_rounds} rounds were not enough")
        done = written(members.all(), "scc")
        found = done if found is None else found.unionByName(done)
        gone = done.select(F.col("id").alias("k"))
        left = written(left.join(gone, F.col("src") == F.col("k"), "left_anti").join(gone, F.col("dst") == F.col("k"), "left_anti"), "scc")
    return found


def shortest_paths(pairs: DataFrame, sources: DataFrame, most_rounds: int = 100_000) -> DataFrame:
    """source, node, distance and number of shortest paths, level by level from all sources together."""
    frontier = written(sources.select(F.col("id").alias("source"), F.col("id").alias("node"), F.lit(0).alias("distance"), F.lit(1.0).alias("paths")).distinct(), "bfs")
    seen = _Seen(frontier, "bfs")
    for level in range(1, most_rounds):
        step = frontier.join(pairs.select("src", "dst"), F.col("node") == F.col("src")).groupBy("source", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
        new = step.join(seen.all().select("source", "node"), ["source", "node"], "left_anti").select("source", "node", F.lit(level).alias("distance"), "paths")
        frontier = written(new, "bfs")
        if frontier.isEmpty():
            return seen.all()
        seen.levels.append(frontier)
    raise NotConverged(f"shortest paths: {most_rounds} rounds were not enough")


def sample_sources(nodes: DataFrame, k: int) -> DataFrame:
    """k of the sorted ids, at the places i * n / k rounded down. Ranks come from exact counts of id ranges."""
    n = nodes.count()
    k = min(n, k)
    if not k:
        return nodes.select("id").limit(0)
    lo, hi = nodes.agg(F.min("id"), F.max("id")).first()
    width = max(1, -(-(hi - lo + 1) // 1024))
    cell = F.floor((F.col("id") - F.lit(lo)) / width).cast("int")
    counts = nodes.groupBy(cell.alias("c")).agg(F.count("*").alias("m"))
    before = counts.select(F.col("c").alias("k"), F.coalesce(F.sum("m").over(Window.orderBy("c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b"))
    ranked = nodes.select("id", cell.alias("c")).withColumn("r", F.row_number().over(Window.partitionBy("c").orderBy("id")) - 1).join(F.broadcast(before), F.col("c") == F.col("k")).select("id", (F.col("r") + F.col("b")).alias("rank"))
    # rank r is sampled when floor(i * n / k) = r for the least i that reaches it
    i = F.ceil(F.col("rank") * k / n)
    return ranked.where((i < k) & (F.floor(i * n / k) == F.col("rank"))).select("id")


def betweenness(pairs: DataFrame, nodes: DataFrame, exact_up_to: int = 500, sample: int = 100) -> DataFrame:
    """id, betweenness over directed shortest paths without their ends: of all sources for few nodes, else of a sample.

    Tasks that hold the graph each take some of the sources (see arrays); a graph that is too large for that is joined
    with its levels.
    """
    n = nodes.count()
    exact = n <= exact_up_to
    sources = nodes.select("id") if exact else sample_sources(nodes, sample)
    k = n if exact else min(n, sample)
    scale = (n - 1) * (n - 2) if exact else k * max(1, n - 2)
    if scale <= 0:
        return nodes.select("id", F.lit(0.0).alias("betweenness"))
    pairs = written(pairs.select("src", "dst"), "bc")
    graph = arrays.numbered(pairs)
    total = _dependencies(pairs, sources) if graph is None else arrays.dependencies(graph, sources)
    summed = total.groupBy(F.col("id").alias("node")).agg((F.sum("dep") / scale).alias("b"))
    return nodes.select("id").join(summed, F.col("id") == F.col("node"), "left").select("id", F.coalesce("b", F.lit(0.0)).alias("betweenness"))


def _dependencies(pairs: DataFrame, sources: DataFrame) -> DataFrame:
    """id, dep: of each node but the source, by source. Dependencies go back level by level: each node gives its
    predecessors their share of the paths through it.
    """
    paths = shortest_paths(pairs, sources)
    deepest = paths.agg(F.max("distance")).first()[0] or 0
    below = written(paths.where(F.col("distance") == deepest).select("source", "node", "paths", F.lit(0.0).alias("dep")), "bc")
    total = below.where("node <> source").select(F.col("node").alias("id"), "dep")
    for level in range(deepest - 1, -1, -1):
        here = paths.where(F.col("distance") == level).select("source", F.col("node").alias("v"), F.col("paths").alias("pv"))
        given = below.join(pairs.select("src", "dst"), F.col("node") == F.col("dst")).join(here.withColumnRenamed("source", "s"), (F.col("source") == F.col("s")) & (F.col("src") == F.col("v")))
        dep = given.groupBy("source", F.col("v").alias("n")).agg(F.sum(F.col("pv") / F.col("paths") * (1 + F.col("dep"))).alias("d"))
        level_dep = here.join(dep.withColumnRenamed("source", "s2"), (F.col("source") == F.col("s2")) & (F.col("v") == F.col("n")), "left").select("source", F.col("v").alias("node"), F.col("pv").alias("paths"), F.coalesce("d", F.lit(0.0)).alias("dep"))
        below = written(level_dep, "bc")
        total = total.unionByName(below.where("node <> source").select(F.col("node").alias("id"), "dep"))
    return total
