"""Rules and checks on small tables, with every kind of violation and of mistake."""

import pytest

from strandline.operators import checks as C
from strandline.operators import rules as R

DOCUMENT = {
    "version": 1,
    "layers": {"api": {"paths": ["app/api/**"], "packages": ["web.*"]}, "data": {"paths": ["app/db/*.py"]}, "core": {"paths": ["core/**"]}, "none": {"paths": ["x/**"]}},
    "allow": {"core": [], "api": ["core", "data"]},
    "forbid": [{"from": "data", "to": ["api"]}, {"from": "data", "to_external": ["group:net"]}],
    "external": {"net": ["requests", "http*"]},
    "allow_external": {"core": ["json"]},
}


def frames(spark):
    files = spark.createDataFrame([(p,) for p in ("app/api/a.py", "app/db/m.py", "app/db/deep/n.py", "core/c.py", "lib/w.py", "other.py")], "path string")
    packages = spark.createDataFrame([("lib/w.py", "web.views"), ("other.py", "misc"), ("gone.py", "web.x")], "path string, package string")
    return files, packages


def test_layers_and_pairs(spark):
    rules = R.parse_rules(DOCUMENT)
    files, packages = frames(spark)
    layers = R.assign_layers(files, packages, rules)
    assert {tuple(r) for r in layers.collect()} == {("app/api/a.py", "api"), ("lib/w.py", "api"), ("app/db/m.py", "data"), ("core/c.py", "core")}
    assert {tuple(r) for r in R.layer_counts(files, layers, rules).collect()} == {("api", 2), ("data", 1), ("core", 1), ("none", 0), (None, 2)}
    pairs = spark.createDataFrame([("app/db/m.py", "lib/w.py"), ("app/api/a.py", "core/c.py"), ("core/c.py", "app/db/m.py"), ("app/api/a.py", "lib/w.py"), ("other.py", "core/c.py")], "src string, dst string")
    got = {tuple(r) for r in R.pair_violations(pairs, layers, rules).collect()}
    assert got == {("app/db/m.py", "lib/w.py", "data", "api", "forbid"), ("core/c.py", "app/db/m.py", "core", "data", "allow")}


def test_external_names(spark):
    rules = R.parse_rules(DOCUMENT)
    layers = R.assign_layers(*frames(spark), rules)
    uses = spark.createDataFrame([("app/db/m.py", "httpx"), ("app/db/m.py", "httpx"), ("app/db/m.py", "os"), ("core/c.py", "json"), ("core/c.py", "os"), ("app/api/a.py", "requests"), ("other.py", "requests")], "path string, name string")
    got = {(r.path, r.name, r.rule_type, tuple(r.matched), r.uses) for r in R.name_violations(uses, layers, rules).collect()}
    assert got == {("app/db/m.py", "httpx", "forbid_external", ("group:net",), 2), ("core/c.py", "os", "allow_external", (), 1)}


def test_overlapping_layers_are_an_error(spark):
    rules = R.parse_rules({"version": 1, "layers": {"a": {"paths": ["**"]}, "b": {"paths": ["core/**"]}}})
    with pytest.raises(Exception, match="layers overlap: core/c.py -> a, b"):
        R.assign_layers(*frames(spark), rules).collect()


def test_digests_do_not_depend_on_order():
    other = dict(reversed(DOCUMENT.items())) | {"allow": {"api": ["data", "core", "core"], "core": []}}
    assert R.parse_rules(other).digest() == R.parse_rules(DOCUMENT).digest()
    assert R.parse_rules(DOCUMENT | {"allow": {"api": ["core", "data"]}}).digest() != R.parse_rules(DOCUMENT).digest()


@pytest.mark.parametrize(
    "wrong",
    [
        [], {"version": 1}, {"version": True, "layers": DOCUMENT["layers"]}, DOCUMENT | {"more": 1}, DOCUMENT | {"layers": {}}, DOCUMENT | {"layers": {"1a": {"paths": ["x"]}}}, DOCUMENT | {"layers": {"a": {"paths": ["/x"]}}},
        DOCUMENT | {"layers": {"a": {"paths": ["x**/y"]}}}, DOCUMENT | {"layers": {"a": {"files": ["x"]}}}, DOCUMENT | {"allow": {"api": ["api"]}}, DOCUMENT | {"allow": {"zzz": []}}, DOCUMENT | {"forbid": [{"from": "api"}]},
        DOCUMENT | {"forbid": [{"from": "api", "to": []}]}, DOCUMENT | {"forbid": [{"from": "api", "to_external": ["group:no"]}]}, DOCUMENT | {"external": {}}, DOCUMENT | {"allow_external": {"core": [1]}},
    ],
)
def test_wrong_documents(wrong):
    with pytest.raises(R.RulesError):
        R.parse_rules(wrong)


def test_snapshots(spark):
    rows = [("a.py", "x"), ("a.py", "y"), ("/b", "x"), ("c/../d", "x"), ("e//f", "x"), ("./g", "x"), ("", "x"), ("ok/.h", "x"), ("n", None), (None, "x")]
    got = {(r.check, r.what) for r in C.check_snapshot(spark.createDataFrame(rows, "path string, content string")).collect()}
    plain = "path is not a plain relative path"
    assert got == {("path is not unique", "a.py"), ("no content", "n"), *((plain, p) for p in ("/b", "c/../d", "e//f", "./g", "", "null"))}
    with pytest.raises(C.InputError, match="no content: n"):
        C.require(C.check_snapshot(spark.createDataFrame([("n", None)], "path string, content string")))


def test_graphs_shares_and_groups(spark):
    nodes = spark.createDataFrame([("a", "f", 1, 3, 5), ("b", "f", 2, 9, 0), ("b", None, None, None, None), ("", "gone", 1, 1, -1)], "id string, file string, start_line int, end_line int, token_estimate long")
    edges = spark.createDataFrame([("a", "b", ["zz"], 0.5), ("a", "y", None, 1.0), ("a", "b", None, 2.0), ("b", "a", [], None)], "from_id string, to_id string, candidates array<string>, share double")
    files = spark.createDataFrame([("f", 4)], "path string, lines int")
    got = sorted((r.check, r.what) for r in C.check_graph(nodes, edges, files).collect())
    assert got == [("cost is negative", ""), ("edge leads to no node", "y"), ("edge leads to no node", "zz"), ("id is empty", ""), ("id is not unique", "b"), ("span is outside its file", ""), ("span is outside its file", "b")]
    assert sorted(r.what for r in C.check_shares(edges).collect()) == ["a -> b", "a -> b"]
    e = spark.createDataFrame([(1, "ambiguous", "g1"), (2, "ambiguous", "no"), (3, "ambiguous", None), (4, "exact", "g2"), (5, "exact", None)], "id int, resolution string, group_id string")
    g = spark.createDataFrame([("g1", ["x", "y"]), ("g2", ["x", "x"]), ("g3", ["x", "y"])], "group_id string, targets array<string>")
    got = sorted((r.check, r.what) for r in C.check_groups(e, g).collect())
    assert got == [("ambiguous edge without a group", "2"), ("ambiguous edge without a group", "3"), ("group has no choice", "g2"), ("group is not used", "g3"), ("group of an edge that is not ambiguous", "4")]


def test_weights():
    C.check_weights({"a": 1.0, "b": 0.3}, {"a", "b"}, {"top": 10})
    for w, t in (({"a": 1.0}, {}), ({"a": 1.0, "b": 0.0}, {}), ({"a": True, "b": 1.0}, {}), ({"a": float("nan"), "b": 1.0}, {}), ({"a": 1.0, "b": 1.0}, {"top": 0})):
        with pytest.raises(C.InputError):
            C.check_weights(w, {"a", "b"}, t)
