"""Baselines and reports: each kind of fault is named by its path."""

import copy
import json

import pytest

from strandline.operators import documents as d

BASE = {
    "schema": "bottlenecks.v8",
    "granularity": "file",
    "snapshot": {"file_count": 2, "git_commit": None},
    "dependency_network": {"structure_policy": "p", "package_dependencies": {"s": [{"from_id": "a", "to_id": "b", "tier": "certain"}] * 12}, "package_metrics": {"s": {"a": {"instability": None}, "b": {"instability": 0.5}}}},
    "candidates": [{"id": "1", "kind": "large_node", "target": "t", "metrics": {}}, {"id": "2", "kind": "package_cycle", "structure": {}, "evidence": []}, {"id": "3", "kind": "rule_violation", "structure": {}}],
    "coverage": {"architecture_rules": {"rules_sha256": "x"}},
}
REPORT = BASE | {"edge_weights": {}, "versions": {}, "limitations": ["l"], "candidates": [{"id": i, "kind": "large_node", "target": "t", "metrics": {"m": 1}, "evidence": [], "coverage": "c", "status": "static_candidate"} for i in "ab"]}


def changed(doc, path, value):
    doc = copy.deepcopy(doc)
    at = doc
    for k in path[:-1]:
        at = at[k]
    if value is ...:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return json.dumps(doc)


N = "dependency_network"
BASELINES = {
    "ok": (json.dumps(BASE), None),
    "text": ("{", "$"),
    "none": (None, "$"),
    "list": ("[]", "$"),
    "schema": (changed(BASE, ["schema"], "bottlenecks.v1"), "$.schema"),
    "count": (changed(BASE, ["snapshot", "file_count"], True), "$.snapshot.file_count"),
    "commit": (changed(BASE, ["snapshot", "git_commit"], 3), "$.snapshot.git_commit"),
    "no commit": (changed(BASE, ["snapshot", "git_commit"], ...), None),
    "network": (changed(BASE, [N], ...), f"$.{N}"),
    "from": (changed(BASE, [N, "package_dependencies", "s", 11, "from_id"], ...), f"$.{N}.package_dependencies.s[0].from_id"),
    "tier": (changed(BASE, [N, "package_dependencies", "s"], [{"from_id": "a", "to_id": "b", "tier": "certain"}] * 2 + [{"from_id": "a", "to_id": "b", "tier": "x"}]), f"$.{N}.package_dependencies.s[2].tier"),
    "instability": (changed(BASE, [N, "package_metrics", "s", "b", "instability"], "high"), f"$.{N}.package_metrics.s.b.instability"),
    "target": (changed(BASE, ["candidates", 0, "target"], ...), "$.candidates[0].target"),
    "evidence": (changed(BASE, ["candidates", 1, "evidence"], {}), "$.candidates[1].evidence"),
    "structure": (changed(BASE, ["candidates", 2, "structure"], None), "$.candidates[2].structure"),
    "rules": (changed(BASE, ["coverage", "architecture_rules"], None), "$.coverage.architecture_rules"),
    "v9": (changed(BASE, ["schema"], "bottlenecks.v9"), f"$.{N}.file_ids"),
    "many": (json.dumps(json.loads(changed(BASE, ["candidates", 0, "target"], 1)) | {"granularity": "x"}), "$.granularity"),
}
REPORTS = {
    "ok": (json.dumps(REPORT), None),
    "unknown": (changed(REPORT, ["more"], 1), "$.more"),
    "delta too early": (json.dumps(REPORT | {"schema": "bottlenecks.v7", "delta": {}}), "$.delta"),
    "delta": (json.dumps(REPORT | {"delta": {}}), None),
    "oldest": (json.dumps({k: v for k, v in REPORT.items() if k != "granularity"} | {"schema": "bottlenecks.v6"}), None),
    "twice": (changed(REPORT, ["candidates", 1, "id"], "a"), "$.candidates[1].id"),
    "status": (changed(REPORT, ["candidates", 1, "status"], "x"), "$.candidates[1].status"),
    "metric": (changed(REPORT, ["candidates", 0, "metrics", "m"], "1"), "$.candidates[0].metrics.m"),
    "ranking": (changed(REPORT, [N, "rankings"], {"r": [{"node_id": "n", "value": 1}, {"node_id": "n", "value": None}]}), f"$.{N}.rankings.r[1].value"),
    "limitation": (changed(REPORT, ["limitations"], ["a", 2]), "$.limitations[1]"),
}


@pytest.mark.parametrize("cases,check", [(BASELINES, lambda t: d.faults(t, d.baseline_expectations())), (REPORTS, lambda t: d.faults(t, d.report_expectations(("large_node",)), d.REPORT_FIELDS, ("$.candidates[].id",)))], ids=["baseline", "report"])
def test_first_fault_by_path(spark, cases, check):
    table = spark.createDataFrame([(k, v) for k, (v, _) in cases.items()], "document string, json string")
    got = {r.document: r.where for r in d.first_faults(check(table)).collect()}
    assert got == {k: w for k, (_, w) in cases.items() if w is not None}


def test_compatible_pairs(spark):
    off = changed(BASE, ["coverage"], {})
    rows = [("same", json.dumps(BASE), json.dumps(BASE)), ("policy", changed(BASE, [N, "structure_policy"], "q"), json.dumps(BASE)), ("rules", json.dumps(BASE), off), ("digest", changed(BASE, ["coverage", "architecture_rules", "rules_sha256"], "y"), json.dumps(BASE)), ("neither", off, off)]
    got = {r.document: (r.problem, r.rules_changed) for r in d.compatible(spark.createDataFrame(rows, "document string, current string, baseline string")).collect()}
    assert got == {"same": (None, False), "policy": ("structure_policy differs", False), "rules": ("architecture rules were used by only one", False), "digest": (None, True), "neither": (None, False)}
