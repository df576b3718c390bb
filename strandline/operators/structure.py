"""Roll-ups of relations to files and packages, their metrics, rules and changes between snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.edges import TIERS
from strandline.functions.paths import dirname
from strandline.session import written


def roll_up(projected: DataFrame, owner: DataFrame) -> DataFrame:
    """Relations between owners: projected has edge_id; owner (node, file). A file's share of an ambiguous relation is
    its part of the projected nodes; relations of one key count their evidence and keep their greatest share."""
    src = owner.select(F.col("node").alias("na"), F.col("file").alias("src"))
    dst = owner.select(F.col("node").alias("nb"), F.col("file").alias("dst"))
    rows = projected.join(src, F.col("from_id") == F.col("na")).join(dst, F.col("target") == F.col("nb"))
    each = rows.groupBy("edge_id", "src", "dst", "relation", "confidence", "resolution", "n_targets").agg(F.count("*").alias("hits"))
    return each.groupBy("src", "dst", "relation", "confidence", "resolution").agg(F.count("*").alias("evidence_count"), F.max(F.col("hits") / F.col("n_targets")).alias("share"))


def tier_pairs(rolled: DataFrame, weight: Column, rank: Column) -> DataFrame:
    """For each cumulative tier the pairs of files: greatest weight, evidence, strictest rank and relations."""
    edges = rolled.where("relation <> 'TESTS' and src <> dst").select("src", "dst", "relation", "evidence_count", weight.alias("weight"), rank.alias("rank"))
    tiers = edges.select("*", F.explode(F.sequence(F.col("rank"), F.lit(len(TIERS) - 1))).alias("t"))
    got = tiers.groupBy("t", "src", "dst").agg(F.max("weight").alias("max_weight"), F.sum("evidence_count").alias("evidence_count"), F.min("rank").alias("rank"), F.array_join(F.sort_array(F.collect_set("relation")), ",").alias("relations"))
    name = F.array(*[F.lit(t) for t in TIERS])
    return got.select(F.get(name, F.col("t")).alias("tier"), "src", "dst", "max_weight", "evidence_count", F.get(name, F.col("rank")).alias("pair_tier"), "relations")


def package_metrics(pairs: DataFrame, packages: DataFrame) -> DataFrame:
    """package, file_count, ca, ce, weighted twins and instabilities (null without any dependency).

    pairs: distinct (src, dst, max_weight) between packages; packages: (package, file_count)."""
    both = pairs.select(F.explode(F.array(F.struct(F.col("src").alias("p"), F.lit(1).alias("out"), "max_weight"), F.struct(F.col("dst").alias("p"), F.lit(0).alias("out"), "max_weight"))).alias("x")).select("x.*")
    m = both.groupBy("p").agg(F.sum(1 - F.col("out")).alias("ca"), F.sum("out").alias("ce"), F.sum(F.when(F.col("out") == 0, F.col("max_weight"))).alias("weighted_ca"), F.sum(F.when(F.col("out") == 1, F.col("max_weight"))).alias("weighted_ce"))
    z = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("ca", "ce")] + [F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("weighted_ca", "weighted_ce")]
    out = packages.join(m, F.col("package") == F.col("p"), "left").select("package", "file_count", *z)
    return out.withColumns({"instability": F.try_divide(F.col("ce"), F.col("ca") + F.col("ce")), "weighted_instability": F.when(F.col("weighted_ca") + F.col("weighted_ce") > 0, F.col("weighted_ce") / (F.col("weighted_ca") + F.col("weighted_ce")))})


def ancestors(path: Column) -> Column:
    """All directories above a path, the root ('') first."""
    parts = F.split(dirname(path), "/")
    n = F.when(dirname(path) == "", 0).otherwise(F.size(parts))
    return F.transform(F.sequence(F.lit(0), n), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def longest_prefix(files: DataFrame, modules: DataFrame) -> DataFrame:
    """files (path) with the module of the longest directory at or above each: equi-joins on ancestors, then the best."""
    rows = files.select("path", F.explode(ancestors(F.col("path"))).alias("d")).join(modules, F.col("d") == F.col("module_dir"))
    best = rows.groupBy("path").agg(F.min(F.struct((-F.length("module_dir")).alias("n"), "module_path")).alias("b"))
    return best.select("path", F.col("b.module_path").alias("module_path"))


def enclosing(uses: DataFrame, spans: DataFrame, width: int = 16) -> DataFrame:
    """uses (file_path, line) with the smallest span that holds the line, ties by id. Spans are dealt to blocks of lines,
    so that a use meets the spans of its block only."""
    blocks = F.explode(F.sequence(F.floor(F.col("start_line") / width), F.floor(F.col("end_line") / width)))
    s = spans.select("node_id", F.col("file_path").alias("f"), "start_line", "end_line", blocks.alias("b"))
    u = uses.withColumn("block", F.floor(F.col("line") / width))
    met = u.join(s, (F.col("file_path") == F.col("f")) & (F.col("block") == F.col("b"))).where("line between start_line and end_line")
    best = met.groupBy("file_path", "line").agg(F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("n"), "node_id")).alias("x"))
    return best.select("file_path", "line", F.col("x.node_id").alias("node_id"))


def resolve(names: DataFrame, uses: DataFrame) -> DataFrame:
    """uses (name, n) by how many things have the name: exact one, several (ambiguous, the first and the number) or none."""
    have = names.groupBy("name").agg(F.count("*").alias("k"), F.min("id").alias("first"))
    j = uses.join(have.withColumnRenamed("name", "known"), F.col("name") == F.col("known"), "left")
    return j.select("name", F.when(F.col("k").isNull(), "unresolved").when(F.col("k") == 1, "unique_name").otherwise("ambiguous").alias("resolution"), F.col("first").alias("target"), F.coalesce("k", F.lit(0)).alias("candidates"))


def top(df: DataFrame, by: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col(name) <= k)


def changes(now: DataFrame, then: DataFrame, keys: list[str]) -> DataFrame:
    """keys and change: new or gone. Both sides have distinct keys."""
    a, b = now.select(*keys, F.lit(1).alias("__n")), then.select(*keys, F.lit(1).alias("__t"))
    return a.join(b, keys, "full").where("__n is null or __t is null").select(*keys, F.when(F.col("__n").isNull(), "gone").otherwise("new").alias("change"))


def short_labels(paths: DataFrame) -> DataFrame:
    """path, label of every distinct path (column path): its last segments, as many as tell all paths of the same last
    segment apart; the last one alone where no other path ends in it.

    A path's segments are counted at every depth, so that the depth of a group is a grouping and not a comparison of
    pairs. Paths of equal segments (their slashes differ) cannot be told apart: their group takes all segments.
    """
    named = F.filter(F.split("path", "/"), lambda s: s != "")
    segments = F.when(F.size(named) > 0, named).otherwise(F.array("path"))
    p = paths.where("path is not null").select("path").distinct().select("path", segments.alias("s")).withColumn("last", F.element_at("s", -1))
    suffix = F.array_join(F.slice("s", -F.col("d"), F.col("d")), "/")
    at = p.select("path", "last", F.size("s").alias("size"), F.explode(F.sequence(F.lit(1), F.size("s"))).alias("d"), "s").select("path", "last", "size", "d", suffix.alias("label"))
    # written, so that a label of very many paths is split where it is joined
    alike = written(at.groupBy("d", "label").agg(F.count("*").alias("n"), F.count_if(F.col("d") == F.col("size")).alias("whole")), "labels")
    own = at.join(alike, ["d", "label"]).groupBy("path").agg(
        F.first("last").alias("last"), F.first("size").alias("size"), F.min(F.when(F.col("n") == 1, F.col("d"))).alias("unique"), F.max((F.col("d") == F.col("size")) & (F.col("whole") > 1)).alias("twin")
    )
    needed = F.when(F.col("twin"), F.lit(1 << 30)).otherwise(F.coalesce("unique", F.col("size") + 1))
    depth = own.groupBy(F.col("last").alias("k")).agg(F.count("*").alias("n"), F.max(needed).alias("need"), F.max("size").alias("longest"))
    depth = written(depth.select("k", F.when(F.col("n") == 1, 1).otherwise(F.least(F.greatest("need", F.lit(2)), "longest")).alias("d")), "depths")
    some = F.least("d", F.size("s"))
    return p.join(depth, F.col("last") == F.col("k")).select("path", F.array_join(F.slice("s", -some, some), "/").alias("label"))
