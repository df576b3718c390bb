"""Snapshots of source repositories as tables of files."""

from __future__ import annotations

import subprocess

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.paths import ScanPolicy, exclusion_reason


def tracked_paths(root: str) -> list[str] | None:
    """The paths git tracks under root; None where root is no repository or tracks nothing."""
    try:
        out = subprocess.run(["git", "ls-files", "-z"], cwd=root, capture_output=True, timeout=120)
    except (OSError, subprocess.TimeoutExpired):
        return None
    names = [x for x in out.stdout.decode("utf-8", "replace").split("\0") if x]
    return sorted(names) if out.returncode == 0 and names else None


def read_files(spark: SparkSession, root: str, paths: list[str] | None = None) -> DataFrame:
    """path (relative), content (UTF-8, with replacement characters) of the files under root, read by Spark.

    paths: keep these only, as from tracked_paths. Folders whose name begins with a dot are left out.
    """
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    relative = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + base.removeprefix("file://") + "/", "")
    files = raw.select(relative.alias("path"), "content").where(~F.col("path").rlike(r"(^|/)\.[^/]+/"))
    if paths is not None:
        files = files.join(spark.createDataFrame([(p,) for p in paths], "p string"), F.col("path") == F.col("p"), "left_semi")

    @F.pandas_udf("string")
    def decoded(data: pd.Series) -> pd.Series:
        return data.map(lambda b: None if b is None else bytes(b).decode("utf-8", "replace"))

    return files.select("path", decoded("content").alias("content"))


def snapshot(files: DataFrame, policy: ScanPolicy = ScanPolicy()) -> tuple[DataFrame, DataFrame]:
    """(kept: path, content; excluded: path, reason)."""
    judged = files.withColumn("reason", exclusion_reason(F.col("path"), F.col("content"), policy))
    return judged.where("reason is null").select("path", F.coalesce("content", F.lit("")).alias("content")), judged.where("reason is not null").select("path", "reason")
