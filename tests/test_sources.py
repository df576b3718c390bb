"""Snapshots and Python sources, over this repository and small given files."""

import os

import pytest
from pyspark.sql import functions as F

from strandline.functions.paths import ScanPolicy
from strandline.operators import candidates, checks
from strandline.sources import python_source, reports, repository

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

FILES = {
    "pkg/__init__.py": "from .a import f\n",
    "pkg/a.py": "import os\n\n\ndef f(x):\n    if x and os:\n        return [y for y in x if y]\n    return g()\n\n\ndef g():\n    return len([])\n",
    "pkg/b.py": "from pkg.a import f as h\n\n\nclass C:\n    def m(self):\n        h(1)\n        self.only()\n        self.twice()\n\n    def only(self):\n        pass\n\n    def twice(self):\n        pass\n\n\ndef twice():\n    C()\n",
    "tests/test_a.py": "import pytest\n\n\ndef test_x():\n    assert 1 == 1\n    assert 2\n    with pytest.raises(ValueError):\n        f()\n",
    "pkg/up.py": "from pkg import f as again\nfrom pkg.b import C\nimport pkg.a\nimport json as j\n\n\n@again\nclass D(C):\n    def k(self, x: C, run) -> 'C':\n        self.only()\n        self.k(1)\n        run()\n        x.twice()\n        pkg.a.g()\n        j.dumps(1)\n        for again in x:\n            again()\n",
    "loop/a.py": "from loop.b import z\nz()\n\n\ndef own():\n    z()\n",
    "loop/b.py": "from loop.a import z\n",
    "bad.py": "def (:\n",
    "notes.txt": "text",
}


@pytest.fixture(scope="module")
def rows(spark):
    return python_source.extract(spark.createDataFrame(list(FILES.items()), "path string, content string")).cache()


def test_symbols_imports_and_failures(rows):
    got = {(r.module, r.name): (r.kind, r.branches, r.strong, r.weak) for r in rows.where("row = 'symbol'").collect()}
    assert got[("pkg.a", "f")] == ("function", 3, 0, 0) and got[("pkg.b", "C.m")][0] == "method" and got[("pkg.b", "C")][0] == "class"
    assert got[("tests.test_a", "test_x")] == ("function", 0, 2, 1)
    assert {r.path for r in rows.where("kind = 'failed'").collect()} == {"bad.py"}
    assert ("pkg.b", "pkg.a.f", "h") in {(r.module, r.name, r.owner) for r in rows.where("row = 'import'").collect()}


def test_references_are_resolved_in_order(rows):
    got = {(r.from_id.removeprefix("py:"), r.to_id.removeprefix("py:"), r.relation): (r.confidence, r.resolution, r.candidates) for r in candidates.listed(*python_source.relations(rows)).collect()}
    exact = ("static_certain", "exact", [])
    for key in (
        ("pkg.a#f", "pkg.a#g", "CALLS"),
        ("pkg.b#C.m", "pkg.a#f", "CALLS"),
        ("pkg.b#C.m", "pkg.b#C.only", "CALLS"),
        ("pkg.b#C.m", "pkg.b#C.twice", "CALLS"),
        ("pkg.b#twice", "pkg.b#C", "INSTANTIATES"),
        ("pkg.up#D", "pkg.b#C", "INHERITS"),
        ("pkg.up#D", "pkg.a#f", "DECORATES"),
        ("pkg.up#D.k", "pkg.b#C", "TYPE_USES"),
        ("pkg.up#D.k", "pkg.b#C.only", "CALLS"),
        ("pkg.up#D.k", "pkg.up#D.k", "CALLS"),
        ("pkg.up#D.k", "pkg.a#g", "CALLS"),
        ("pkg.up", "pkg.a#f", "IMPORTS_SYMBOL"),
        ("pkg.up", "pkg.b", "IMPORTS"),
        ("pkg.up", "pkg.a", "IMPORTS"),
        ("pkg", "pkg.a#f", "RE_EXPORTS"),
        ("pkg.b", "pkg.b#C", "CONTAINS"),
    ):
        assert got[key] == exact, key
    assert got[("pkg.up#D.k", "pkg.b#C.twice", "CALLS")] == ("static_inferred", "ambiguous", ["py:pkg.b#twice"])
    assert got[("pkg.up#D.k", "external:json.dumps", "CALLS")] == ("dynamic_required", "unresolved", [])
    assert got[("pkg.up", "external:json", "IMPORTS")] == ("dynamic_required", "unresolved", [])
    assert got[("pkg.up#D.k", "unresolved:?", "CALLS")] == ("dynamic_required", "unresolved", [])
    assert got[("pkg.a#g", "unresolved:len", "CALLS")] == ("dynamic_required", "unresolved", [])
    assert got[("tests.test_a#test_x", "pkg.a#f", "CALLS")] == ("static_inferred", "unique_name", [])
    assert got[("loop.a#own", "unresolved:z", "CALLS")][1] == "unresolved"
    assert not any(k[2] == "RE_EXPORTS" and k[0] != "pkg" for k in got)


CASES = """import unittest
from unittest import mock
import pytest
m = mock.Mock()


@mock.patch("x")
@unittest.skipIf(True, "")
class TestA(unittest.TestCase):
    @mock.patch.object
    def test_a(self, p):
        self.assertEqual(1, 1)
        self.assertTrue(p)
        check_all()
        assert p is None
        assert p

        def inner():
            assert p == 2
            MagicMock()

    def helper(self):
        assert 1 == 1


def test_b(monkeypatch):
    with pytest.raises(ValueError):
        monkeypatch.setattr("a", "b")
    pytest.skip("x")


@pytest.mark.xfail
def test_c():
    pass


def test_d():
    assert_called_once()
"""


def test_cases_with_assertions_mocks_and_skips(spark):
    rows = python_source.extract(spark.createDataFrame([("t.py", CASES)], "path string, content string"))
    got = {r.name: (r.strong, r.weak, r.mocks, r.skipped) for r in python_source.cases_of_tests(rows).collect()}
    assert got == {"TestA.test_a": (4, 2, 4, True), "test_b": (1, 0, 2, True), "test_c": (0, 0, 1, True), "test_d": (0, 1, 1, False)}


def test_this_repository(spark):
    paths = repository.tracked_paths(ROOT)
    files = repository.read_files(spark, ROOT, paths)
    kept, gone = repository.snapshot(files, ScanPolicy(max_file_bytes=30_000))
    names = {r.path for r in kept.select("path").collect()}
    assert "strandline/functions/paths.py" in names and not any(n.startswith(".git/") for n in names)
    assert all(r.reason in ("too_large", "generated_marker") for r in gone.collect())
    rows = python_source.extract(kept)
    assert rows.where("kind = 'failed'").isEmpty()
    edges, groups = python_source.relations(rows)
    assert checks.check_groups(edges.withColumn("id", F.monotonically_increasing_id()), groups).isEmpty()
    assert not edges.where("to_id = 'py:strandline.functions.paths#exclusion_reason' and resolution = 'exact'").isEmpty()


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "é"), ("b", 1, "y"), ("b", 2, "z")], "kind string, rank int, id string")
    assert reports.canonical_json(df, ["kind", "rank"], 2) == '[{"id":"é","kind":"a","rank":1},{"id":"y","kind":"b","rank":1}]\n'
    assert reports.hand_out(df, "T", "kind", most=1) == "# T\n\n## a\n\n- id é\n\n## b\n\n- id y\n"
    assert reports.gate({"x": df, "y": df.limit(0)}, ("y",)) == 0 and reports.gate({"x": df}, ("x",)) == 3
    reports.write_sections({"s": df}, f"file://{tmp_path}/out")
    assert spark.read.parquet(f"file://{tmp_path}/out/s").count() == 3
