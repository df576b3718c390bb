"""Candidate groups: each list of possible targets once, as rows (group_id, target); ambiguous relations hold its id.

An id is "cg:" and a digest of the distinct targets' number, least one and sums of their hashes: lists of the same targets have
the same id, and no list is gathered to make it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.edges import edge_rank, edge_weight


def digest_parts(target: Column) -> list[Column]:
    """Aggregates over a group's distinct targets from which group_id() makes its id."""
    t = target.cast("string")
    return [F.count("*").alias("n_targets"), F.min(t).alias("least"), F.sum(F.xxhash64(t).cast("decimal(38,0)")).alias("sum1"), F.bit_xor(F.xxhash64(t, F.lit(1))).alias("sum2")]


def group_id() -> Column:
    return F.concat(F.lit("cg:"), F.sha2(F.concat_ws("|", "n_targets", "least", "sum1", "sum2"), 256))


def intern(edges: DataFrame, to: str = "to_id", candidates: str = "candidates") -> tuple[DataFrame, DataFrame]:
    """(edges, groups): edges without their candidate lists but with group_id, which is null unless the relation is ambiguous and
    has two targets or more; groups (group_id, target) with each list of distinct targets once.

    Nulls in lists are left out; a null list is empty; equal lists in any order, with repetitions or not, are one group.
    """
    listed = F.array_sort(F.array_distinct(F.array_compact(F.concat(F.array(to), F.coalesce(candidates, F.array())))))
    some = (F.col("resolution") == "ambiguous") & (F.size("__t") > 1)
    e = edges.withColumn("__t", listed)
    lists = e.where(some).select("__t").distinct()
    of = lists.select("__t", F.explode("__t").alias("target")).groupBy("__t").agg(*digest_parts(F.col("target"))).select("__t", group_id().alias("group_id"))
    out = e.withColumn("__k", F.when(some, F.col("__t"))).join(of.withColumnRenamed("__t", "__l"), F.col("__k") == F.col("__l"), "left")
    groups = of.select("group_id", F.explode("__t").alias("target"))
    return out.drop("__t", "__k", "__l", candidates), groups


def listed(edges: DataFrame, groups: DataFrame, to: str = "to_id") -> DataFrame:
    """edges with `candidates`, the sorted targets of their group besides the stated one; for reports, since it repeats each list."""
    lists = groups.groupBy("group_id").agg(F.sort_array(F.collect_set("target")).alias("__t"))
    out = edges.join(lists.withColumnRenamed("group_id", "__g"), F.col("group_id") == F.col("__g"), "left").drop("__g")
    none = F.array().cast(lists.schema["__t"].dataType)
    return out.withColumn("candidates", F.coalesce(F.array_except("__t", F.array(to)), none)).drop("__t")


def project(edges: DataFrame, groups: DataFrame, to: str = "to_id") -> DataFrame:
    """A row for each target a relation may have: target, share (the relation's own `share` if it has that column and it is not null, else
    one over the group's size), base_weight and rank. Targets are joined here and nowhere earlier."""
    sizes = groups.groupBy("group_id").agg(F.count("*").alias("__n"))
    wide = groups.join(sizes.withColumnRenamed("group_id", "__g"), F.col("group_id") == F.col("__g")).select("__g", F.col("target").alias("__t"), "__n")
    given = F.col("share") if "share" in edges.columns else F.lit(None).cast("double")
    out = edges.withColumn("__given", given).drop("share").join(wide, F.col("group_id") == F.col("__g"), "left")
    weight = edge_weight(F.col("confidence"), F.col("resolution")).alias("base_weight")
    return out.select(*[c for c in edges.columns if c not in ("share", to)], F.coalesce("__t", to).alias("target"), F.coalesce("__given", 1 / F.coalesce("__n", F.lit(1))).alias("share"), weight, edge_rank(F.col("confidence"), F.col("resolution")).alias("rank"))
