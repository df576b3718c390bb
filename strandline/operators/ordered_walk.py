"""Walks that visit nodes in the order in which steps are written, as a depth-first search would, found by levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.components import NotConverged
from strandline.session import written


def first_ways(roots: DataFrame, steps: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """root, node, way, labels: the way on which a depth-first search from each root, trying steps by their place, first comes to each
    node, with the labels of its steps; the root itself has an empty way.

    roots (root, node), steps (src, place, dst, label). A node's first way is the least of the first ways to the nodes
    before it, each with the place of its step, where ways compare as lists and one that begins another is less; so a
    round extends the ways that became less in the round before, and keeps the least for each node. Rings end,
    since a way around one begins with the way it started from. The rounds are the longest first way.
    """
    start = roots.select("root", "node", F.array().cast("array<long>").alias("way"), F.array().cast("array<string>").alias("labels")).distinct()
    new = written(start, "ways")
    best = new
    s = steps.groupBy("src", F.col("place").cast("long").alias("place")).agg(F.min(F.struct("dst", "label")).alias("to")).select("src", "place", "to.dst", "to.label")
    for _ in range(most_rounds):
        on = new.join(s, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node"), F.array_append("way", F.col("place")).alias("way"), F.array_append("labels", F.col("label")).alias("labels"))
        on = on.groupBy("root", "node").agg(F.min(F.struct("way", "labels")).alias("b")).select("root", "node", "b.way", "b.labels")
        was = best.select(F.col("root").alias("r"), F.col("node").alias("n"), F.col("way").alias("was"))
        new = written(on.join(was, (F.col("root") == F.col("r")) & (F.col("node") == F.col("n")), "left").where("was is null or way < was").select("root", "node", "way", "labels"), "ways")
        if new.isEmpty():
            return best
        best = written(best.unionByName(new).groupBy("root", "node").agg(F.min(F.struct("way", "labels")).alias("b")).select("root", "node", "b.way", "b.labels"), "best")
    raise NotConverged(f"first_ways: {most_rounds} rounds were not enough")
