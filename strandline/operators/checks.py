"""Checks of input tables: each finds the rows that are wrong, as (check, what), and require() raises with the first few."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class InputError(ValueError):
    """A table that an analysis cannot work on."""


def require(problems: DataFrame, shown: int = 5) -> None:
    """Raises InputError if there is a problem; names some of them, in order."""
    first = problems.orderBy("check", "what").limit(shown).collect()
    if first:
        raise InputError("; ".join(f"{r.check}: {r.what}" for r in first))


def _bad(df: DataFrame, check: str, holds: Column, what: str | Column) -> DataFrame:
    w = F.col(what) if isinstance(what, str) else what
    return df.where(~F.coalesce(holds, F.lit(False))).select(F.lit(check).alias("check"), F.coalesce(w.cast("string"), F.lit("null")).alias("what"))


def _twice(df: DataFrame, check: str, key: str) -> DataFrame:
    return _bad(df.groupBy(key).agg(F.count("*").alias("n")), check, F.col("n") == 1, key)


def _all(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


def check_snapshot(files: DataFrame) -> DataFrame:
    """files (path, content): paths are unique, relative and plain (no empty, . or .. segments), contents are there."""
    plain = ~F.col("path").rlike(r"(^|/)(\.{0,2})(/|$)")
    return _all(_twice(files, "path is not unique", "path"), _bad(files, "path is not a plain relative path", plain, "path"), _bad(files, "no content", F.col("content").isNotNull(), "path"))


def check_graph(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """nodes (id, file, start_line, end_line, token_estimate), edges (from_id, to_id, candidates), files (path, lines).

    Ids are unique and not empty, spans lie inside their files, costs are not negative, and every end of an edge, the
    candidates among them, is a node. A node without a file has no span; a null cost is none.
    """
    spans = nodes.where("file is not null").join(files.select(F.col("path").alias("p"), "lines"), F.col("file") == F.col("p"), "left")
    inside = (F.col("start_line") >= 1) & (F.col("end_line") >= F.col("start_line")) & (F.col("end_line") <= F.col("lines"))
    ends = edges.select(F.explode(F.concat(F.array("from_id", "to_id"), F.coalesce("candidates", F.array().cast("array<string>")))).alias("end")).distinct()
    known = nodes.select(F.col("id").alias("k"), F.lit(True).alias("known"))
    return _all(
        _twice(nodes, "id is not unique", "id"),
        _bad(nodes, "id is empty", F.col("id") != "", "id"),
        _bad(spans, "span is outside its file", inside, "id"),
        _bad(nodes, "cost is negative", F.coalesce(F.col("token_estimate") >= 0, F.lit(True)), "id"),
        _bad(ends.join(known, F.col("end") == F.col("k"), "left"), "edge leads to no node", F.col("known"), "end"),
    )


def check_same(rows: DataFrame, key: str, columns: list[str], what: str = "has several definitions") -> DataFrame:
    """Rows of one key, as several analyzers or walks give them, agree in all these columns (nulls are equal to each other); for nodes of
    merged graphs, or labels that reach a node by several ways, with require()."""
    same = F.struct(*columns)
    each = rows.groupBy(key).agg(F.min(same).alias("low"), F.max(same).alias("high"))
    return _bad(each, what, F.col("low").eqNullSafe(F.col("high")), key)


def check_shares(edges: DataFrame) -> DataFrame:
    """edges (from_id, to_id, candidates, share): a given share is above 0, at most 1, and then there is one target."""
    ok = F.col("share").isNull() | ((F.col("share") > 0) & (F.col("share") <= 1) & (F.coalesce(F.size("candidates"), F.lit(0)) == 0))
    return _bad(edges, "share", ok, F.concat_ws(" -> ", "from_id", "to_id"))


def check_groups(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """edges (id, resolution, group_id), groups (group_id, targets), or a row for each (group_id, target): groups are unique, have
    two targets or more without repetition, each is used, and exactly ambiguous edges lead to one that exists."""
    if "targets" in groups.columns:
        again = _twice(groups, "group is not unique", "group_id")
        each = groups.select("group_id", F.size("targets").alias("size"), F.size(F.array_distinct("targets")).alias("distinct"))
    else:
        again = None
        pairs = groups.groupBy("group_id", "target").agg(F.count("*").alias("n"))
        each = pairs.groupBy("group_id").agg(F.sum("n").alias("size"), F.count("*").alias("distinct"))
    known = each.select(F.col("group_id").alias("g"), F.lit(True).alias("known")).distinct()
    named = edges.join(known, F.col("group_id") == F.col("g"), "left")
    used = edges.where("group_id is not null").select(F.col("group_id").alias("u"), F.lit(True).alias("used")).distinct()
    ambiguous = F.col("resolution") == "ambiguous"
    found = [
        _bad(each, "group has no choice", (F.col("size") >= 2) & (F.col("size") == F.col("distinct")), "group_id"),
        _bad(each.join(used, F.col("group_id") == F.col("u"), "left"), "group is not used", F.col("used"), "group_id"),
        _bad(named.where(ambiguous), "ambiguous edge without a group", F.col("known"), "id"),
        _bad(edges.where(~ambiguous), "group of an edge that is not ambiguous", F.col("group_id").isNull(), "id"),
    ]
    return _all(*([again] if again is not None else []), *found)


def check_weights(weights: dict[str, float], keys: set[str], thresholds: dict[str, int]) -> None:
    """Weights have exactly these keys, are numbers above 0 and at most 1; thresholds are integers from 1."""
    if set(weights) != keys:
        raise InputError(f"weights must have the keys {sorted(keys)}")
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v)
    wrong = [k for k, v in weights.items() if not number(v) or not 0 < v <= 1] + [k for k, v in thresholds.items() if not isinstance(v, int) or isinstance(v, bool) or v < 1]
    if wrong:
        raise InputError(f"not a weight or threshold: {', '.join(sorted(wrong))}")
