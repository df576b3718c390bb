"""Relations: possible targets, weights, tiers and identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Default weights. Fixed values.
CONFIDENCE = {"static_certain": 1.0, "static_inferred": 0.3, "framework_inferred": 0.3, "dynamic_required": 0.3}
RESOLUTION = {"exact": 1.0, "unique_name": 1.0, "ambiguous": 0.3, "unresolved": 0.3}
TIERS = ("certain", "resolved", "all")


def _lookup(c: Column, table: dict[str, float]) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("double"))
    for k, v in table.items():
        out = out.when(c == k, F.lit(v))
    return out


def candidate_targets(to: Column, candidates: Column, resolution: Column) -> Column:
    """All targets a relation may have: the stated one, or for ambiguous ones the sorted distinct candidates with it."""
    return F.when(resolution == "ambiguous", F.array_sort(F.array_distinct(F.array_compact(F.concat(F.array(to), F.coalesce(candidates, F.array().cast("array<bigint>"))))))).otherwise(F.array(to))


def edge_weight(confidence: Column, resolution: Column, by_confidence: dict[str, float] = CONFIDENCE, by_resolution: dict[str, float] = RESOLUTION) -> Column:
    return F.least(_lookup(confidence, by_confidence), _lookup(resolution, by_resolution))


def edge_rank(confidence: Column, resolution: Column) -> Column:
    """0 certain, 1 resolved, 2 all: the strictest tier the relation belongs to."""
    return F.when((resolution == "exact") & (confidence == "static_certain"), 0).when(resolution.isin("exact", "unique_name"), 1).otherwise(2)


def tier_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in TIERS]), rank + 1)


def candidate_id(identifier: Column) -> Column:
    return F.concat(F.lit("b:"), F.substring(F.sha2(identifier, 256), 1, 16))
