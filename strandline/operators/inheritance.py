"""Members of classes, found in the order in which their bases are written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.components import NotConverged
from strandline.session import written


def first_definers(asked: DataFrame, bases: DataFrame, members: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """class, member, id: the member that a walk from the class finds first, itself, then its bases in order, each with all above it.

    asked (class, member), bases (class, place, base), members (class, member, id; the least of several counts). The walk goes by
    levels: a row holds the places on its way, ways are compared as lists (a way that begins another comes first), and the
    least one whose end has the member wins. Ways that are not below the best found, or below the one by which
    their end was reached before, stop, so that rings end and a class is opened again only for a lesser way. The rounds
    are the longest chain of bases; pairs without a definer are not in the result.
    """
    ways = written(asked.select("class", "member").distinct().select("class", "member", F.col("class").alias("at"), F.array().cast("array<int>").alias("way")), "walk")
    own = members.groupBy(F.col("class").alias("c"), F.col("member").alias("m")).agg(F.min("id").alias("id"))
    up = bases.select(F.col("class").alias("c"), F.col("place").cast("int").alias("place"), "base").distinct()
    seen, best = ways, None
    for _ in range(most_rounds):
        met = written(ways.join(own, (F.col("at") == F.col("c")) & (F.col("member") == F.col("m")), "left").select("class", "member", "at", "way", "id"), "met")
        hits = met.where("id is not null").select("class", "member", "way", "id")
        if best is not None:
            hits = best.unionByName(hits)
        best = written(hits.groupBy("class", "member").agg(F.min(F.struct("way", "id")).alias("b")).select("class", "member", "b.way", "b.id"), "best")
        on = met.where("id is null").join(up, F.col("at") == F.col("c")).select("class", "member", F.col("base").alias("at"), F.array_append("way", F.col("place")).alias("way"))
        on = on.groupBy("class", "member", "at").agg(F.min("way").alias("way"))
        known = seen.groupBy(F.col("class").alias("c"), F.col("member").alias("m"), F.col("at").alias("a")).agg(F.min("way").alias("was"))
        on = on.join(known, (F.col("class") == F.col("c")) & (F.col("member") == F.col("m")) & (F.col("at") == F.col("a")), "left").where("was is null or way < was").drop("c", "m", "a", "was")
        found = best.select(F.col("class").alias("c"), F.col("member").alias("m"), F.col("way").alias("won"))
        on = on.join(found, (F.col("class") == F.col("c")) & (F.col("member") == F.col("m")), "left").where("won is null or way < won").select("class", "member", "at", "way")
        ways = written(on, "walk")
        if ways.isEmpty():
            return best.select("class", "member", "id")
        seen = seen.unionByName(ways)
    raise NotConverged(f"first_definers: {most_rounds} rounds were not enough")
