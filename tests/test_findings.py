"""Findings and their changes on small tables."""

import pytest

from strandline.operators import findings as N
from strandline.operators.checks import InputError


def test_hubs_and_isolation(spark):
    nodes = spark.createDataFrame([("a", "production"), ("b", "production"), ("c", "production"), ("t", "test"), ("d", "production")], "id string, category string")
    edges = spark.createDataFrame(
        [("t", "a", "TESTS", "static_certain", "exact"), ("t", "b", "TESTS", "static_inferred", "ambiguous"), ("a", "b", "CALLS", "dynamic_required", "unresolved"), ("c", "c", "CALLS", "static_certain", "exact"), ("a", "t", "CALLS", "static_certain", "unique_name"), ("d", "b", "CALLS", "static_inferred", "ambiguous")],
        "from_id string, to_id string, relation string, confidence string, resolution string",
    )
    scores = spark.createDataFrame([("a", 0.5), ("b", 0.3), ("c", 0.3), ("d", 0.1), ("t", 0.9)], "id string, score double")
    assert {tuple(r) for r in N.untested_hubs(nodes, edges, scores, 3).collect()} == {("b", 2, 1), ("c", 3, 0)}
    got = {tuple(r) for r in N.isolated_nodes(nodes.where("category = 'production'"), edges).collect()}
    assert got == {("b", 0, 1, 2), ("c", 0, 0, 0), ("d", 0, 0, 1)}
    assert {tuple(r) for r in N.unreferenced(nodes, edges, "category").collect()} == {("production", 1)}
    assert {tuple(r) for r in N.unresolved_boundaries(edges, "relation").collect()} == {("CALLS", 1, 1)}


def test_changes_of_findings(spark):
    s = "kind string, target string, m int"
    now = spark.createDataFrame([("x", "a", 3), ("x", "b", 2), ("x", "c", 1), ("y", "a", 1)], s)
    then = spark.createDataFrame([("x", "a", 2), ("x", "b", 2), ("x", "c", 5), ("x", "d", 1)], s)
    assert {tuple(r) for r in N.changed_findings(now, then, "m").collect()} == {("x", "a", "strengthened", 2, 3), ("y", "a", "new", None, 1), ("x", "d", "resolved", 1, None)}
    e = "kind string, target string, signature string"
    now, then = spark.createDataFrame([("x", "a", "1"), ("x", "a", "2"), ("x", "a", "2"), ("z", "q", "9")], e), spark.createDataFrame([("x", "a", "1")], e)
    assert [tuple(r) for r in N.added_evidence(now, then).collect()] == [("x", "a", 1)]


def test_graphs_merge_in_order(spark):
    g = [spark.createDataFrame(rows, "a string, b string, w int") for rows in ([("x", "y", 1), ("x", "y", 2), ("q", None, 1)], [("x", "y", 3), ("y", "z", 4), ("q", None, 2)], [("y", "z", 5)])]
    assert sorted(map(str, map(tuple, N.merge_graphs(g, ["a", "b"]).collect()))) == ["('q', None, 1)", "('x', 'y', 1)", "('x', 'y', 2)", "('y', 'z', 4)"]


def test_nodes_of_several_analyzers_must_agree(spark):
    a = spark.createDataFrame([("x", "class", None), ("y", "def", 1)], "id string, kind string, line int")
    b = spark.createDataFrame([("x", "class", None), ("z", None, 2)], "id string, kind string, line int")
    assert sorted(r.id for r in N.merge_nodes([a, b, a], "id", ["kind", "line"]).collect()) == ["x", "y", "z"]
    for other in ([("x", "class", 1)], [("x", None, None)], [("z", None, 2), ("z", "class", 2)]):
        with pytest.raises(InputError, match="has several definitions"):
            N.merge_nodes([a, spark.createDataFrame(other, "id string, kind string, line int")], "id", ["kind", "line"])
