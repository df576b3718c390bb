"""Coverage of files by analyzers: statuses merged for each file, each file and producer, and each producer, in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values.
STATUSES = ("complete", "partial", "failed", "skipped")


def merged(status: str = "status") -> Column:
    """The aggregate of statuses: partial if one is, or if some but not all are complete; else failed if one is; else complete or
    skipped. It may be applied to merged statuses again: the whole has the status of all rows at once."""
    s = F.col(status)
    any_ = lambda x: F.coalesce(F.bool_or(s == x), F.lit(False))
    mixed = any_("complete") & any_("failed") | any_("complete") & any_("skipped")
    return F.when(any_("partial") | mixed, "partial").when(any_("failed"), "failed").when(any_("complete"), "complete").otherwise("skipped")


def coverage(inventory: DataFrame, results: DataFrame) -> DataFrame:
    """level (file, result, producer), path, producer, status, reasons, n_results of inventory (path, excluded: a reason or null) and
    results (path, producer, status, reasons: array of strings or null).

    The levels are grouping sets of one aggregation over the results of files that are not excluded; reasons are the distinct ones,
    sorted. Excluded files have status excluded and their reason, files without results not_targeted. Results of paths that are not in the
    inventory do not count.
    """
    here = inventory.groupBy("path").agg(F.max("excluded").alias("excluded"))
    r = results.join(here.where("excluded is null").select(F.col("path").alias("k")), F.col("path") == F.col("k"), "left_semi")
    r = r.select(F.col("path").alias("p"), F.col("producer").alias("q"), "status", "reasons")
    some = r.groupingSets([[F.col("p")], [F.col("p"), F.col("q")], [F.col("q")]], F.col("p"), F.col("q")).agg(F.grouping_id("p", "q").alias("g"), merged().alias("status"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("reasons")))).alias("reasons"), F.count("*").alias("n_results"))
    level = F.when(F.col("g") == 1, "file").when(F.col("g") == 0, "result").otherwise("producer")
    some = some.select(level.alias("level"), F.col("p").alias("path"), F.col("q").alias("producer"), "status", "reasons", "n_results")
    seen = some.where("level = 'file'").select(F.col("path").alias("k"))
    rest = here.join(seen, F.col("path") == F.col("k"), "left_anti")
    none = F.array().cast("array<string>")
    rest = rest.select(F.lit("file").alias("level"), "path", F.lit(None).cast("string").alias("producer"), F.when(F.col("excluded").isNotNull(), "excluded").otherwise("not_targeted").alias("status"), F.when(F.col("excluded").isNotNull(), F.array("excluded")).otherwise(none).alias("reasons"), F.lit(0).cast("long").alias("n_results"))
    return some.unionByName(rest)


def summary(covered: DataFrame) -> DataFrame:
    """producer (null: all files), inventory, targeted and how many files have each status, of coverage()."""
    own = covered.where("level in ('file', 'result')").withColumn("producer", F.when(F.col("level") == "result", F.col("producer")))
    counts = [F.count_if(F.col("status") == s).alias(s) for s in (*STATUSES, "excluded", "not_targeted")]
    return own.groupBy("producer").agg(F.count("*").alias("inventory"), F.count_if(F.col("n_results") > 0).alias("targeted"), *counts)
