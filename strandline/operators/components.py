"""Connected components of an edge table, by star contraction over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.session import BROADCAST_ROWS, Scratch


class NotConverged(RuntimeError):
    """A loop used up its rounds before its result was complete."""


def _is_star(e: DataFrame) -> bool:
    """Whether every a has one b, and no b is an a."""
    ends = e.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))).alias("x"))
    return ends.groupBy("x.node").agg(F.sum("x.up").alias("ups"), F.min("x.up").alias("least")).where("ups > 1 or ups = 1 and least = 0").isEmpty()


def star_components(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """node, component (the least node that links reach), for the nodes of edges (a, b), undirected.

    Alternates large-star and small-star steps until every node hangs on its least one; the rounds grow with the
    logarithm of the edges, and NotConverged is raised if most_rounds do not do. Self-links and repeated links do no
    harm. Nodes' least neighbours are broadcast if the counted links are few; else they are written before they are
    joined, so that adaptive execution may split a hub's rows among several tasks.
    """
    links, least = Scratch(edges.sparkSession, "links"), Scratch(edges.sparkSession, "least")
    e = links.write(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(most_rounds):
        if _is_star(e):
            roots = e.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
        few = e.count() <= BROADCAST_ROWS
        side = F.broadcast if few else least.write
        # large star: every larger neighbour of a node moves to the node's least neighbour
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = side(both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.min("a")).alias("m")))
        large = both.where("b > a").join(low, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = large if few else links.write(large)
        # small star: a node and its smaller neighbours move to the least of them, whose own link is the node's
        low = side(large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")))
        moved = large.join(low, F.col("a") == F.col("n")).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        e = links.write(moved.distinct())
        links.keep(1)
        least.keep(0)
    raise NotConverged(f"components: {most_rounds} rounds were not enough")
