"""Checks of JSON documents (baselines, reports) against tables of expectations: what is wrong, by its path.

A table of expectations is data; each is compiled to an expression over the parsed document. Lists and objects on its way
are exploded by Spark, so that a document's candidates are rows and not a walk in one task.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.edges import TIERS


@dataclass(frozen=True)
class Expect:
    """What is at a path. path: names after dots, [] for each item of a list, .* for each value of an object. kind: one of
    KINDS, several with "or", or a tuple of texts of which it is one. when: (name beside it, values) under which it counts;
    unless: the same, under which it does not. versions: of the document's $.schema, all if empty."""

    path: str
    kind: str | tuple[str, ...]
    optional: bool = False
    when: tuple[str, tuple[str, ...]] | None = None
    unless: tuple[str, tuple[str, ...]] | None = None
    versions: tuple[str, ...] = ()


#: Patterns of the types that a parsed value reports.
KINDS = {"object": "^OBJECT", "list": "^ARRAY", "string": "^STRING$", "boolean": "^BOOLEAN$", "integer": r"^(BIGINT|DECIMAL\((19|[23]\d),0\))$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL)", "null": "^VOID$"}

# Versions, kinds and fields of the documents.
V8, V9 = "bottlenecks.v8", "bottlenecks.v9"
CYCLES = ("dependency_cycle", "package_cycle")
RULES = ("rule_violation",)
LISTED = ("unresolved_boundary", "dangling_doc_reference", "unreferenced_symbol", "unprovided_injection")
NETWORK = "$.dependency_network"
V7 = "bottlenecks.v7"
#: Names that a report's root may have, each with the versions that it may have it in (all if empty).
REPORT_FIELDS = dict.fromkeys(("schema", "snapshot", "edge_weights", "versions", "coverage", "dependency_network", "candidates", "limitations"), ()) | {"granularity": (V7, V8, V9), "delta": (V8, V9), "details_file": (V9,)}


def baseline_expectations(tiers: tuple[str, ...] = TIERS) -> list[Expect]:
    """What a baseline holds, in the order in which faults are named."""
    pairs, c = f"{NETWORK}.package_dependencies", "$.candidates[]"
    return [
        Expect("$", "object"),
        Expect("$.schema", (V8, V9)),
        Expect("$.granularity", ("file",)),
        Expect("$.snapshot", "object"),
        Expect("$.snapshot.file_count", "integer"),
        Expect("$.snapshot.git_commit", "string or null", optional=True),
        Expect(NETWORK, "object"),
        Expect(f"{NETWORK}.file_ids", "list", versions=(V9,)),
        Expect(f"{NETWORK}.file_ids[]", "string", versions=(V9,)),
        Expect(f"{NETWORK}.evidence_columns", "object", versions=(V9,)),
        *[Expect(f"{NETWORK}.evidence_columns.{k}", "list", versions=(V9,)) for k in ("file_pair", "package_pair")],
        *[Expect(f"{NETWORK}.evidence_columns.{k}[]", "string", versions=(V9,)) for k in ("file_pair", "package_pair")],
        Expect(f"{NETWORK}.structure_policy", "string"),
        Expect(pairs, "object"),
        Expect(f"{pairs}.*", "list"),
        Expect(f"{pairs}.*[]", "object"),
        *[Expect(f"{pairs}.*[].{k}", "string") for k in ("from_id", "to_id")],
        Expect(f"{pairs}.*[].tier", tiers),
        Expect(f"{NETWORK}.package_metrics", "object"),
        Expect(f"{NETWORK}.package_metrics.*", "object"),
        Expect(f"{NETWORK}.package_metrics.*.*", "object"),
        Expect(f"{NETWORK}.package_metrics.*.*.instability", "number or null"),
        Expect("$.candidates", "list"),
        Expect(c, "object"),
        *[Expect(f"{c}.{k}", "string") for k in ("id", "kind")],
        Expect(f"{c}.structure", "object", when=("kind", CYCLES + RULES)),
        Expect(f"{c}.evidence", "list", when=("kind", CYCLES + LISTED)),
        Expect(f"{c}.target", "string", unless=("kind", CYCLES + RULES)),
        Expect(f"{c}.metrics", "object", unless=("kind", CYCLES + RULES)),
        Expect("$.coverage", "object or null", optional=True),
        Expect("$.coverage.architecture_rules", "object", optional=True),
        Expect("$.coverage.architecture_rules.rules_sha256", "string", optional=True),
    ]


def report_expectations(kinds: tuple[str, ...]) -> list[Expect]:
    """What a report holds; kinds: of candidates."""
    versions = ("bottlenecks.v6", V7, V8, V9)
    c, ranked = "$.candidates[]", f"{NETWORK}.rankings"
    return [
        Expect("$", "object"),
        Expect("$.schema", versions),
        Expect("$.granularity", ("file",), versions=versions[1:]),
        *[Expect(f"$.{k}", "object") for k in ("snapshot", "edge_weights", "versions", "coverage", "dependency_network")],
        Expect("$.delta", "object", optional=True, versions=(V8, V9)),
        Expect("$.details_file", "string", optional=True, versions=(V9,)),
        Expect("$.limitations", "list"),
        Expect("$.limitations[]", "string"),
        Expect(ranked, "object", optional=True),
        Expect(f"{ranked}.*", "list"),
        Expect(f"{ranked}.*[]", "object"),
        Expect(f"{ranked}.*[].value", "number"),
        Expect("$.candidates", "list"),
        Expect(c, "object"),
        Expect(f"{c}.id", "string"),
        Expect(f"{c}.kind", kinds),
        *[Expect(f"{c}.{k}", "string") for k in ("target", "coverage")],
        Expect(f"{c}.status", ("static_candidate",)),
        Expect(f"{c}.metrics", "object"),
        Expect(f"{c}.metrics.*", "number"),
        Expect(f"{c}.evidence", "list or object"),
    ]


def _text(v: Column, name: str | None = None) -> Column:
    return F.try_variant_get(v, "$" if name is None else f"$['{name}']", "string")


def _is(v: Column, kind: str | tuple[str, ...]) -> Column:
    t = F.schema_of_variant(v)
    if isinstance(kind, tuple):
        return (t == "STRING") & _text(v).isin(*kind)
    return reduce(Column.__or__, [t.rlike(KINDS[k]) for k in kind.split(" or ")])


def _steps(path: str) -> list[str]:
    return re.findall(r"\[\]|[^.\[\]$]+", path)


def _down(at: DataFrame, step: str) -> DataFrame:
    """at (document, version, where, places, owner, v) one step further; a missing name stays a row, with a null v."""
    if step not in ("[]", "*"):
        has = F.schema_of_variant("v").rlike(KINDS["object"])
        return at.where(has).select("document", "version", F.concat("where", F.lit(f".{step}")).alias("where"), "places", F.col("v").alias("owner"), F.try_variant_get("v", f"$['{step}']", "variant").alias("v"))
    inside = at.where(F.schema_of_variant("v").rlike(KINDS["list" if step == "[]" else "object"]))
    named = "concat(where, '[', e.pos, ']')" if step == "[]" else "concat(where, '.', e.key)"
    return at.sparkSession.sql(f"SELECT document, version, {named} AS where, array_append(places, e.pos) AS places, v AS owner, e.value AS v FROM {{t}}, LATERAL variant_explode(v) AS e", t=inside)


def faults(documents: DataFrame, expectations: list[Expect], fields: dict[str, tuple[str, ...]] | None = None, unique: tuple[str, ...] = ()) -> DataFrame:
    """All faults of documents (document, json): document, rule (number of the expectation), places, where, expected.

    fields: the only names that the root may have, with their versions; unique: paths whose texts occur once. What is below a missing or
    mistyped value is not looked at; a text that is no JSON (or null) is one fault at $; an empty table has none.
    """
    parsed = documents.select("document", F.try_parse_json("json").alias("v"))
    root = parsed.select("document", F.when(F.schema_of_variant("v").rlike(KINDS["object"]), _text(F.col("v"), "schema")).alias("version"), F.lit("$").alias("where"), F.array().cast("array<int>").alias("places"), F.col("v").alias("owner"), "v")
    seen: dict[tuple[str, ...], DataFrame] = {(): root.where("v is not null")}

    def at(steps: tuple[str, ...]) -> DataFrame:
        if steps not in seen:
            seen[steps] = _down(at(steps[:-1]), steps[-1])
        return seen[steps]

    def named(rows: DataFrame, rule: int, expected: str) -> DataFrame:
        return rows.select("document", F.lit(rule).alias("rule"), "places", "where", F.lit(expected).alias("expected"))

    found = [named(root.where("v is null"), -1, "valid JSON")]
    for i, e in enumerate(expectations):
        rows = at(tuple(_steps(e.path)))
        if e.versions:
            rows = rows.where(F.col("version").isin(*e.versions))
        for beside, holds in ((e.when, True), (e.unless, False)):
            if beside:
                rows = rows.where(F.coalesce(_text(F.col("owner"), beside[0]).isin(*beside[1]), F.lit(False)) == holds)
        absent = F.col("v").isNull()
        wrong = F.when(absent, F.lit(not e.optional)).otherwise(~F.coalesce(_is(F.col("v"), e.kind), F.lit(False)))
        found.append(named(rows.where(wrong), i, e.kind if isinstance(e.kind, str) else "one of " + ", ".join(e.kind)))
    if fields:
        name = F.substring("where", 3, 1 << 30)
        may = reduce(Column.__or__, [(name == k) & (F.col("version").isin(*v) if v else F.lit(True)) for k, v in fields.items()])
        found.append(named(at(("*",)).where(~F.coalesce(may, F.lit(False))), len(expectations), "no field of this name"))
    for i, path in enumerate(unique, len(expectations) + 1):
        texts = at(tuple(_steps(path))).withColumn("t", _text(F.col("v"))).where("t is not null")
        first = texts.groupBy("document", "t").agg(F.min("places").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("document").alias("d"), F.col("t").alias("u"), "first")
        again = texts.join(first, (F.col("document") == F.col("d")) & (F.col("t") == F.col("u")) & (F.col("places") > F.col("first")))
        found.append(named(again, i, "unique"))
    return reduce(DataFrame.unionByName, found)


def first_faults(found: DataFrame) -> DataFrame:
    """document, where, expected: of each document that has faults, the first by expectation, then by place."""
    least = found.groupBy("document").agg(F.min(F.struct("rule", "places", "where", "expected")).alias("f"))
    return least.select("document", "f.where", "f.expected")


def compatible(pairs: DataFrame) -> DataFrame:
    """pairs (document, current, baseline: JSON) as document, problem (null if they can be compared) and rules_changed.

    The structure policies are equal; rules were used by both or by neither; another digest of them, or none, is only marked.
    """
    cur, base = F.try_parse_json("current"), F.try_parse_json("baseline")
    policy = lambda v: F.try_variant_get(v, "$.dependency_network.structure_policy", "string")
    digest = lambda v: F.try_variant_get(v, "$.coverage.architecture_rules.rules_sha256", "string")
    rules = lambda v: F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.coverage.architecture_rules", "variant")) != "VOID", F.lit(False))
    problem = F.when(~policy(cur).eqNullSafe(policy(base)), "structure_policy differs").when(rules(cur) != rules(base), "architecture rules were used by only one")
    changed = rules(cur) & rules(base) & (digest(base).isNull() | ~digest(cur).eqNullSafe(digest(base)))
    return pairs.select("document", problem.alias("problem"), changed.alias("rules_changed"))
