"""Architecture rules: layers by globs, which layers and external names a layer may use, and what breaks them.

A document (a mapping, as read from JSON or YAML) becomes rows (kind, layer, entry), which Spark joins:
path and package globs select a layer's files; allow and forbid name layers; allow_external and forbid_external name
globs, or groups of globs as "group:NAME". A list under allow that is empty allows nothing.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.paths import name_glob, path_glob
from strandline.session import written

#: The document's keys and the prefix of groups. Fixed values.
KEYS = ("version", "layers", "allow", "forbid", "external", "allow_external")
GROUP = "group:"
_NAME = re.compile(r"[A-Za-z][A-Za-z0-9_-]*")


class RulesError(ValueError):
    """A document of rules that cannot be read."""


@dataclass(frozen=True)
class Rules:
    layers: tuple[str, ...]
    rows: tuple[tuple[str, str, str], ...]
    empty: tuple[tuple[str, str], ...] = ()

    def of(self, kind: str) -> dict[str, list[str]]:
        found: dict[str, list[str]] = {layer: [] for k, layer in self.empty if k == kind}
        for k, layer, entry in self.rows:
            if k == kind:
                found.setdefault(layer, []).append(entry)
        return {k: sorted(set(v)) for k, v in sorted(found.items())}

    def digest(self) -> str:
        """SHA-256 of the rules in a canonical JSON: order and repetition in the document do not matter."""
        paths, packages = self.of("paths"), self.of("packages")
        whole = {"version": 1, "layers": {x: {"paths": paths.get(x, []), "packages": packages.get(x, [])} for x in self.layers}}
        whole |= {k: self.of(k) for k in ("allow", "forbid", "external", "forbid_external", "allow_external")}
        return hashlib.sha256(json.dumps(whole, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def _need(holds: bool, what: str) -> None:
    if not holds:
        raise RulesError(what)


def _texts(value: object, where: str, may_be_empty: bool = False) -> list[str]:
    _need(isinstance(value, list) and (bool(value) or may_be_empty) and all(isinstance(x, str) and x for x in value), f"{where} must be a list of texts")
    return value


def parse_rules(document: object) -> Rules:
    """Rules from a document; RulesError says what is wrong with it."""
    _need(isinstance(document, dict), "rules must be a mapping")
    _need(set(document) <= set(KEYS), f"unknown keys: {sorted(map(str, set(document) - set(KEYS)))}")
    _need(document.get("version") == 1 and not isinstance(document.get("version"), bool), "version must be 1")
    rows: list[tuple[str, str, str]] = []
    empty: list[tuple[str, str]] = []

    def named(key: str, required: bool = False) -> dict:
        value = document.get(key, {})
        _need(isinstance(value, dict) and (bool(value) or key not in document and not required), f"{key} must be a mapping that is not empty")
        return value

    layers, groups = named("layers", True), named("external")
    for name, own in [*layers.items(), *groups.items()]:
        _need(isinstance(name, str) and _NAME.fullmatch(name) is not None, f"a name must match {_NAME.pattern}: {name!r}")
    for name, own in layers.items():
        _need(isinstance(own, dict) and bool(own) and set(own) <= {"paths", "packages"}, f"layer {name} must have paths or packages and nothing else")
        for kind, globs in own.items():
            for g in _texts(globs, f"{name}.{kind}"):
                whole = all(s == "**" or "**" not in s for s in g.split("/"))
                _need(kind == "packages" or (whole and not g.startswith("/")), f"{name}: {g!r} must be relative, with ** as whole segments only")
                rows.append((kind, name, g))
    for name, globs in groups.items():
        rows += [("external", name, g) for g in _texts(globs, f"external.{name}")]

    def use(kind: str, layer: object, entries: object, where: str, may_be_empty: bool) -> None:
        _need(isinstance(layer, str) and layer in layers, f"{where}: no layer {layer!r}")
        found = _texts(entries, where, may_be_empty)
        for e in found:
            if kind.endswith("external"):
                _need(not e.startswith(GROUP) or e[len(GROUP) :] in groups, f"{where}: no group {e!r}")
            else:
                _need(e in layers and e != layer, f"{where}: {e!r} is no other layer")
        rows.extend((kind, layer, e) for e in found)
        if not found:
            empty.append((kind, layer))

    for key in ("allow", "allow_external"):
        value = document.get(key, {})
        _need(isinstance(value, dict), f"{key} must be a mapping")
        for layer, entries in value.items():
            use(key, layer, entries, f"{key}.{layer}", True)
    forbidden = document.get("forbid", [])
    _need(isinstance(forbidden, list), "forbid must be a list")
    for i, x in enumerate(forbidden):
        keys = set(x) if isinstance(x, dict) else set()
        _need("from" in keys and len(keys) > 1 and keys <= {"from", "to", "to_external"}, f"forbid[{i}] must have from, and to or to_external")
        for key, kind in (("to", "forbid"), ("to_external", "forbid_external")):
            if key in keys:
                use(kind, x["from"], x[key], f"forbid[{i}].{key}", False)
    return Rules(tuple(sorted(layers)), tuple(rows), tuple(empty))


def _table(spark: SparkSession, rules: Rules, *kinds: str) -> DataFrame:
    """Rows of some kinds, those of externals with their groups' globs, as patterns. As long as the document."""
    groups = rules.of("external")
    out = []
    for kind, layer, entry in rules.rows:
        if kind in kinds:
            for glob in groups[entry[len(GROUP) :]] if entry.startswith(GROUP) and kind.endswith("external") else [entry]:
                out.append((kind, layer, entry, path_glob(glob) if kind == "paths" else name_glob(glob)))
    return F.broadcast(spark.createDataFrame(out, "kind string, rule_layer string, entry string, pattern string"))


def assign_layers(files: DataFrame, packages: DataFrame, rules: Rules) -> DataFrame:
    """path, layer of the files (path) that a layer selects by path or by one of their packages (path, package).

    A file of several layers is an error. Distinct packages meet the globs, not each file's.
    """
    spark = files.sparkSession
    by_path = files.select("path").join(_table(spark, rules, "paths"), F.regexp_like("path", F.col("pattern"))).select("path", F.col("rule_layer").alias("layer"))
    hit = packages.select(F.col("package").alias("p")).distinct().join(_table(spark, rules, "packages"), F.regexp_like("p", F.col("pattern"))).select("p", F.col("rule_layer").alias("layer"))
    by_package = files.select(F.col("path").alias("f")).distinct().join(packages, F.col("f") == F.col("path")).join(hit, F.col("package") == F.col("p")).select("path", "layer")
    found = by_path.unionByName(by_package).groupBy("path").agg(F.sort_array(F.collect_set("layer")).alias("l"))
    overlap = F.raise_error(F.concat(F.lit("layers overlap: "), F.col("path"), F.lit(" -> "), F.array_join("l", ", ")))
    return found.select("path", F.when(F.size("l") > 1, overlap).otherwise(F.element_at("l", 1)).alias("layer"))


def layer_counts(files: DataFrame, layers: DataFrame, rules: Rules) -> DataFrame:
    """layer, files: also of layers that no file is in; null for files in none."""
    every = files.sparkSession.createDataFrame([(x,) for x in rules.layers], "name string")
    counted = files.select("path").join(layers.withColumnRenamed("path", "k"), F.col("path") == F.col("k"), "left").groupBy("layer").agg(F.count("*").alias("n"))
    named = every.join(counted.where("layer is not null"), F.col("name") == F.col("layer"), "left").select(F.col("name").alias("layer"), F.coalesce("n", F.lit(0)).alias("files"))
    return named.unionByName(counted.where("layer is null").select("layer", F.col("n").alias("files")))


def pair_violations(pairs: DataFrame, layers: DataFrame, rules: Rules) -> DataFrame:
    """src, dst, from_layer, to_layer, rule_type of pairs (src, dst) between layers: forbid, or allow where the source's
    layer has a list without the other. A pair that breaks both has two rows."""
    spark = pairs.sparkSession
    a, b = layers.select(F.col("path").alias("ka"), F.col("layer").alias("from_layer")), layers.select(F.col("path").alias("kb"), F.col("layer").alias("to_layer"))
    between = pairs.select("src", "dst").join(a, F.col("src") == F.col("ka")).join(b, F.col("dst") == F.col("kb")).where("from_layer <> to_layer").select("src", "dst", "from_layer", "to_layer")
    allow, forbid = rules.of("allow"), rules.of("forbid")
    broken = [(x, y, kind) for x in rules.layers for y in rules.layers if x != y for kind, bad in (("allow", x in allow and y not in allow[x]), ("forbid", y in forbid.get(x, ()))) if bad]
    table = spark.createDataFrame(broken, "fl string, tl string, rule_type string")
    return between.join(F.broadcast(table), (F.col("from_layer") == F.col("fl")) & (F.col("to_layer") == F.col("tl"))).drop("fl", "tl")


def name_violations(uses: DataFrame, layers: DataFrame, rules: Rules) -> DataFrame:
    """path, layer, name, rule_type, matched, uses of external names (path, name): forbidden ones with the entries they
    match, and those outside their layer's allowed ones. Distinct (layer, name) pairs meet the globs."""
    spark = uses.sparkSession
    used = written(uses.join(layers.select(F.col("path").alias("k"), "layer"), F.col("path") == F.col("k")).groupBy("path", "layer", "name").agg(F.count("*").alias("uses")), "names")
    named = used.select(F.col("layer").alias("l"), F.col("name").alias("x")).distinct()
    hits = named.join(_table(spark, rules, "forbid_external", "allow_external"), (F.col("l") == F.col("rule_layer")) & F.regexp_like("x", F.col("pattern")))
    hits = hits.groupBy("l", "x", "kind").agg(F.sort_array(F.collect_set("entry")).alias("matched"))
    forbidden = hits.where("kind = 'forbid_external'").select("l", "x", F.lit("forbid_external").alias("rule_type"), "matched")
    limited = F.broadcast(spark.createDataFrame([(x,) for x in rules.of("allow_external")], "has string"))
    free = named.join(limited, F.col("l") == F.col("has"), "left_semi").join(hits.where("kind = 'allow_external'").select(F.col("l").alias("l2"), F.col("x").alias("x2")), (F.col("l") == F.col("l2")) & (F.col("x") == F.col("x2")), "left_anti")
    bad = forbidden.unionByName(free.select("l", "x", F.lit("allow_external").alias("rule_type"), F.array().cast("array<string>").alias("matched")))
    return used.join(bad, (F.col("layer") == F.col("l")) & (F.col("name") == F.col("x"))).select("path", "layer", "name", "rule_type", "matched", "uses")
