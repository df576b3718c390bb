"""Findings on tables of nodes and relations.

nodes: id, category and what a finding measures; edges: from_id, to_id, relation, confidence, resolution. Each finding
is one row for each target, with what it counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.checks import check_same, require
from strandline.session import written

#: Resolutions that leave no doubt about the target, and those that do. Fixed values.
SURE = ("exact", "unique_name")
UNSURE = ("ambiguous", "unresolved")


def sure(resolution: Column) -> Column:
    return resolution.isin(*SURE)


def large_nodes(nodes: DataFrame, lines: int = 2000, tokens: int = 24000) -> DataFrame:
    """Rows of nodes (line_count, token_count) above one of the thresholds."""
    return nodes.where((F.col("line_count") > lines) | (F.col("token_count") > tokens))


def untested_hubs(nodes: DataFrame, edges: DataFrame, scores: DataFrame, most: int = 50) -> DataFrame:
    """id, rank, uncertain: of the production nodes of greatest score (id, score; ties by id), those that no test reaches
    for certain, and how many uncertain relations from tests lead to each."""
    best = nodes.where("category = 'production'").select("id").join(scores.select(F.col("id").alias("k"), "score"), F.col("id") == F.col("k")).orderBy(F.desc("score"), "id").limit(most)
    hubs = best.select("id", F.row_number().over(Window.orderBy(F.desc("score"), "id")).cast("long").alias("rank"))
    tests = nodes.where("category = 'test'").select(F.col("id").alias("t"))
    from_tests = edges.where("relation = 'TESTS'").join(tests, F.col("from_id") == F.col("t"))
    reached = from_tests.groupBy("to_id").agg(F.count_if(sure(F.col("resolution"))).alias("sure"), F.count_if(F.col("resolution").isin(*UNSURE)).alias("unsure"))
    return hubs.join(reached, F.col("id") == F.col("to_id"), "left").where("coalesce(sure, 0) = 0").select("id", "rank", F.coalesce("unsure", F.lit(0)).alias("uncertain"))


def isolated_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id and its other relations by kind, of the nodes that no certain static relation links with another node."""
    ends = edges.where("from_id <> to_id").select(F.explode(F.array("from_id", "to_id")).alias("k"), "confidence", "resolution")
    static = F.col("confidence").startswith("static_")
    kinds = {"framework_edges": F.col("confidence") == "framework_inferred", "dynamic_edges": F.col("confidence") == "dynamic_required", "uncertain_static_edges": static}
    counted = ends.groupBy("k").agg(F.count_if(static & sure(F.col("resolution"))).alias("linked"), *[F.count_if(c).alias(a) for a, c in kinds.items()])
    return nodes.select("id").join(counted, F.col("id") == F.col("k"), "left").where("coalesce(linked, 0) = 0").select("id", *[F.coalesce(F.col(a), F.lit(0)).alias(a) for a in kinds])


def unreferenced(nodes: DataFrame, edges: DataFrame, by: str) -> DataFrame:
    """by, unreferenced_count: how many nodes of each group no relation leads to."""
    used = edges.select(F.col("to_id").alias("k")).distinct()
    return nodes.join(used, F.col("id") == F.col("k"), "left_anti").groupBy(by).agg(F.count("*").alias("unreferenced_count"))


def unresolved_boundaries(edges: DataFrame, by: str) -> DataFrame:
    """by, edges, sources: relations that stay unresolved or need a run, and the nodes that they come from, by group."""
    open_ = edges.where("resolution = 'unresolved' or confidence = 'dynamic_required'")
    return open_.groupBy(by).agg(F.count("*").alias("edges"), F.countDistinct("from_id").alias("sources"))


def changed_findings(now: DataFrame, then: DataFrame, strength: str) -> DataFrame:
    """kind, target, change (new, resolved, strengthened), baseline, current: findings (kind, target and a measure) of
    two reports; those that are as strong or weaker say nothing. Each (kind, target) is in a report once."""
    a = now.select(F.col("kind").alias("kn"), F.col("target").alias("tn"), F.col(strength).alias("current"))
    b = then.select(F.col("kind").alias("kt"), F.col("target").alias("tt"), F.col(strength).alias("baseline"))
    j = a.join(b, (F.col("kn") == F.col("kt")) & (F.col("tn") == F.col("tt")), "full")
    change = F.when(F.col("kt").isNull(), "new").when(F.col("kn").isNull(), "resolved").when(F.col("current") > F.col("baseline"), "strengthened")
    return j.select(F.coalesce("kn", "kt").alias("kind"), F.coalesce("tn", "tt").alias("target"), change.alias("change"), "baseline", "current").where("change is not null")


def added_evidence(now: DataFrame, then: DataFrame) -> DataFrame:
    """kind, target, added: how many distinct pieces of evidence (kind, target, signature) are new in each finding that both reports have."""
    old = then.select(F.col("kind").alias("k"), F.col("target").alias("t"), F.col("signature").alias("s")).distinct()
    known = old.select("k", "t").distinct()
    new = now.select("kind", "target", "signature").distinct().join(known, (F.col("kind") == F.col("k")) & (F.col("target") == F.col("t")), "left_semi")
    return new.join(old, (F.col("kind") == F.col("k")) & (F.col("target") == F.col("t")) & (F.col("signature") == F.col("s")), "left_anti").groupBy("kind", "target").agg(F.count("*").alias("added"))


def merge_graphs(graphs: list[DataFrame], key: list[str]) -> DataFrame:
    """Relations of several analyzers, in order: one that an earlier analyzer has is left out of the later ones;
    repeats within one analyzer stay."""
    whole = None
    for i, g in enumerate(graphs):
        own = g.withColumn("__a", F.lit(i))
        whole = own if whole is None else whole.unionByName(own)
    first = whole.groupBy(*[F.col(c).alias(f"__k_{c}") for c in key]).agg(F.min("__a").alias("__first"))
    on = [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in key] + [F.col("__a") == F.col("__first")]
    return whole.join(first, on, "left_semi").drop("__a")


def merge_nodes(graphs: list[DataFrame], key: str, columns: list[str]) -> DataFrame:
    """The nodes of several analyzers, one row a key: columns must agree wherever a key comes more than once, else InputError
    names the first such keys. Nulls agree with nulls only."""
    rows = graphs[0].select(key, *columns)
    for g in graphs[1:]:
        rows = rows.unionByName(g.select(key, *columns))
    require(check_same(rows, key, columns))
    return rows.distinct()


def positions(files: DataFrame, cells: int = 256) -> DataFrame:
    """path, position: each distinct path's place in their order, from 0. Ranks within ranges add to the ranges' counts."""
    ranged = written(files.select("path").distinct().repartitionByRange(cells, "path").withColumn("part", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"), F.min("path").alias("first"))
    before = counts.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return ranged.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy("path")) - 1).join(F.broadcast(before), F.col("part") == F.col("p")).select("path", (F.col("r") + F.col("before")).cast("long").alias("position"))
