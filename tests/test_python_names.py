"""Scopes, flags, test cases, groups of candidates and inherited members of Python sources, against other ways to find them."""

import ast
import heapq
import os
import random
import symtable
import textwrap

import pytest
from pyspark.sql import functions as F

from strandline.operators import candidates, checks, inheritance
from strandline.sources import python_source
from strandline.sources.python_scopes import File

SCOPES = """
A = 1
B = list(a for a in range(A) if a)
import os as O

def f(x, y=A):
    global B
    B = x
    z = A
    def g():
        nonlocal z
        z = B + y + C
        return [z for z in (A, O, q) if D]
    h = lambda x: x + A + w
    return [(i, A) for i in z if (seen := i)] + [seen, h, g]

class K(Base):
    A = 2
    C = A + B
    def m(self):
        return A, C, self.C, K
    class L:
        def n(self, K):
            del K
            try:
                pass
            except A as e:
                return e
            match self:
                case {"a": A, **rest}:
                    return A, rest
                case [D, *E]:
                    return D, E, F

def later():
    v = u
    u = 1
    for os in O:
        import json as A
    with A as t, B:
        t += 1
    return t, os, (k := 1), k

def shadow(A):
    def inner():
        return A, B
    class C:
        A = A
        def m(self):
            return A
    return inner
"""


def by_symtable(source):
    """(owner, name, kind) of the module's names that definitions read or write, by the compiler's own tables."""
    found = set()

    def visit(table, owner, prefix):
        kind = str(table.get_type()).rsplit(".", 1)[-1].lower()
        name = table.get_name()
        if kind != "module" and name not in ("lambda", "listcomp", "setcomp", "dictcomp", "genexpr"):
            owner = prefix + name
            prefix = f"{owner}." if kind == "class" else f"{owner}.<locals>."
        for s in table.get_symbols():
            ours = kind == "module" or s.is_global()
            if ours and s.is_referenced() and s.get_name() != ".0":
                found.add((owner, s.get_name(), "read"))
            if kind != "module" and s.is_declared_global() and s.is_assigned():
                found.add((owner, s.get_name(), "write"))
        for child in table.get_children():
            visit(child, owner, prefix)

    visit(symtable.symtable(source, "x.py", "exec"), "", "")
    return found


@pytest.mark.parametrize("source", [SCOPES, *(open(m.__file__).read() for m in (heapq, textwrap))], ids=["made", "heapq", "textwrap"])
def test_names_of_the_module_equal_the_compilers(source):
    file = File(ast.parse(source))
    assert {k for k in file.refs if k[2] in ("read", "write")} == by_symtable(source)


ALIASES = {
    "from importlib import import_module as im": ("im(n)", 'im("pkg.mod")', "dynamic_import"),
    "import importlib as il": ("il.import_module(n)", 'il.import_module("pkg.mod")', "dynamic_import"),
    "from builtins import eval as e": ("e(n)", 'e("pkg.mod")', "dynamic_eval"),
    "import builtins as b": ("b.eval(n)", 'b.eval("pkg.mod")', "dynamic_eval"),
}
PLACES = ["{a}\n\ndef run(n):\n    return {c}\n", "if True:\n    {a}\n\ndef run(n):\n    return {c}\n", "try:\n    {a}\nexcept ImportError:\n    pass\n\ndef run(n):\n    return {c}\n", "def run(n):\n    {a}\n    return {c}\n"]


@pytest.mark.parametrize("alias", ALIASES)
@pytest.mark.parametrize("place", PLACES)
def test_aliases_of_importlib_and_builtins(alias, place):
    computed, literal, flag = ALIASES[alias]
    for call in (computed, literal):
        file = File(ast.parse(place.format(a=alias, c=call)))
        assert file.flags == {"run": {flag}}
        assert [k for k in file.refs if k[2] == "dynamic"] == ([("run", "pkg.mod", "dynamic")] if call == literal and flag == "dynamic_import" else [])


@pytest.mark.parametrize(
    ("body", "flags"),
    [
        ("from importlib import import_module as im\n\ndef run(n, f):\n    im = f\n    return im(n)", {}),
        ("def other():\n    from builtins import eval as e\n\ndef run(n):\n    return e(n)", {}),
        ("from m import eval as e\n\ndef run(n):\n    return e(n)", {}),
        ("from builtins import len as eval\n\ndef run(c):\n    return eval(c)", {"run": {"dynamic_eval"}}),
        ("import builtins\n\ndef run(o, n):\n    return builtins.getattr(o, n)", {"run": {"dynamic_attr"}}),
        ('import builtins\n\ndef run(o):\n    return builtins.getattr(o, "x")', {}),
        ("def run(o, n):\n    return o.eval(n), o.getattr(n)", {}),
        ("def run(o, n):\n    return o.__dict__[n]", {"run": {"dynamic_attr"}}),
        ('def run(o, v):\n    o.__dict__["x"] = v', {}),
        ("def run(o):\n    del o.__dict__[1]", {"run": {"dynamic_attr"}}),
        ("def run(o, n):\n    return o.mapping[n]", {}),
        ("class A:\n    class B:\n        async def __setattr__(self, n, v): pass", {"A.B": {"dynamic_attr"}}),
        ("def __getattr__(n): pass\n\nclass A:\n    def __getattribute__(self, n): pass", {"": {"dynamic_attr"}, "A": {"dynamic_attr"}}),
        ("def __setattr__(n, v): pass\n\ndef __dir__(): pass", {}),
        ("import importlib\n\ndef run(n):\n    eval(n)\n    return importlib.import_module(n)", {"run": {"dynamic_eval", "dynamic_import"}}),
        ("setattr(o, n, 1)", {"": {"dynamic_attr"}}),
    ],
)
def test_flags(body, flags):
    assert File(ast.parse(body)).flags == flags


def made(spark, files):
    return python_source.extract(spark.createDataFrame(list(files.items()), "path string, content string")).cache()


def edges_of(rows):
    edges, groups = python_source.relations(rows)
    assert checks.check_groups(edges.withColumn("id", F.monotonically_increasing_id()), groups).isEmpty()
    return {(r.from_id, r.to_id, r.relation): r for r in edges.collect()}, groups


CASES = """import pytest
m = Mock()


def test_a():
    assert check(1)
    assert verify(1) == 2
    assert Mock()


def helper():
    def test_inner():
        assert 1 == 1


if True:
    def test_under():
        assert 1


def test_a():
    assert 1 is 1
    with raises(ValueError):
        expect_this(lambda: assertTrue(1))


@patch("x")
class TestB:
    made = Mock()

    class TestC:
        @pytest.mark.skip
        @patch
        def test_x(self, p=Mock()):
            def test_in():
                self.assertEqual(1, 1)
                self.skipTest("")
            class T:
                def test_y(self):
                    assert 0

    def test_z(self):
        pass


@unittest.skipIf(MagicMock(), "")
class TestD(TestB):
    async def test_w(self):
        assert a, verify(1)
"""


def test_cases_of_definitions_in_the_module_and_its_classes(spark):
    rows = made(spark, {"t.py": CASES, "u.py": "def test_q(): pass\n"})
    got = sorted(tuple(r) for r in python_source.cases_of_tests(rows).collect())
    at = lambda name, k=0: [i + 1 for i, x in enumerate(CASES.splitlines()) if f"def {name}(" in x][k]
    assert got == [
        ("t", "TestB.TestC.test_x", at("test_x"), 1, 1, 4, True),
        ("t", "TestB.test_z", at("test_z"), 0, 0, 2, False),
        ("t", "TestD.test_w", at("test_w"), 0, 1, 2, True),
        ("t", "test_a", at("test_a"), 1, 2, 2, False),
        ("t", "test_a", at("test_a", 1), 3, 1, 1, False),
        ("u", "test_q", 1, 0, 0, 0, False),
    ]


def test_files_that_no_parser_can_take_are_failed_rows(spark):
    deep = {"minus.py": "-" * 100_000 + "1\n", "plus.py": "x = 1" + " + 1" * 20_000 + "\n", "dots.py": "x" + ".y" * 5_000 + "()\n", "brackets.py": "[" * 5_000, "null.py": "a\0b", "good.py": "x = 1\n"}
    rows = made(spark, deep)
    kinds = {r.path: r.kind for r in rows.where("row = 'file'").collect()}
    assert set(kinds) == set(deep) and kinds["minus.py"] == kinds["brackets.py"] == kinds["null.py"] == "failed" and kinds["good.py"] == "complete"
    assert len(edges_of(rows)[0]) >= 1


PACKAGE = {
    "conf.py": "TIMEOUT = 30\n__all__ = ['TIMEOUT', '_x']\n_x = 1\nother = 2\n",
    "mod.py": "from conf import TIMEOUT\nLOCAL = 1\n\n\ndef read_it():\n    return LOCAL, TIMEOUT, len\n\n\ndef write_it():\n    global LOCAL\n    LOCAL = 2\n\n\ndef shadow():\n    LOCAL = 3\n    return LOCAL\n\n\ndef outer():\n    def inner():\n        return 1\n    return inner()\n",
    "json2.py": "try:\n    import json\nexcept ImportError:\n    import simplejson as json\n\n\ndef f():\n    json.loads('')\n",
    "base.py": "class Top:\n    level = 1\n    def m(self): pass\n    def only_top(self): pass\nclass Base(Top):\n    def m(self): pass\nclass Side(Top):\n    def m(self): pass\n    def side(self): pass\n",
    "sub.py": "from base import Base, Side\nimport base\n\n\nclass C(Base, Side):\n    def k(self):\n        self.m()\n        self.side()\n        self.only_top()\n        Base.only_top(self)\n        C.side(self)\n        base.Top.m(self)\n        self.nowhere()\n\n\nclass R1(R2): pass\nclass R2(R1):\n    def q(self):\n        self.z()\n",
    "pkg/__init__.py": "'''doc'''\nfrom conf import TIMEOUT\n__all__ = ['TIMEOUT']\n",
    "other/__init__.py": "from conf import TIMEOUT\nx = 1\n",
    "dyn.py": "import importlib\n\n\ndef load():\n    importlib.import_module('pkg')\n    __import__('nowhere')\n",
}


def test_reads_writes_bindings_and_inherited_members(spark):
    rows = made(spark, PACKAGE)
    got, _ = edges_of(rows)
    exact = lambda k: got[k].resolution == "exact" and got[k].confidence == "static_certain"
    for key in (
        ("py:mod#read_it", "py:mod#LOCAL", "READS"),
        ("py:mod#read_it", "py:conf#TIMEOUT", "READS"),
        ("py:mod#write_it", "py:mod#LOCAL", "WRITES"),
        ("py:mod#outer", "py:mod#outer.<locals>.inner", "CALLS"),
        ("py:sub#C.k", "py:base#Base.m", "CALLS"),
        ("py:sub#C.k", "py:base#Side.side", "CALLS"),
        ("py:sub#C.k", "py:base#Top.only_top", "CALLS"),
        ("py:sub#C.k", "py:base#Top.m", "CALLS"),
        ("py:pkg", "py:conf#TIMEOUT", "RE_EXPORTS"),
        ("py:other", "py:conf#TIMEOUT", "IMPORTS_SYMBOL"),
    ):
        assert exact(key), key
    assert got[("py:sub#C.k", "py:base#Top.only_top", "CALLS")].n == 2 and got[("py:sub#C.k", "py:base#Side.side", "CALLS")].n == 2
    assert not any(k[0] == "py:mod#shadow" for k in got)
    assert {k[1] for k in got if k[0] == "py:json2#f"} == {"external:simplejson.loads"}
    assert {k[1] for k in got if k[0] == "py:json2"} >= {"external:json", "external:simplejson"}
    assert ("py:sub#C.k", "unresolved:self.nowhere", "CALLS") in got and ("py:sub#R2.q", "unresolved:self.z", "CALLS") in got
    assert got[("py:dyn#load", "py:pkg", "IMPORTS")].confidence == "dynamic_required" and ("py:dyn#load", "py:nowhere", "IMPORTS") not in got
    assert {(r.id, r.flag) for r in python_source.dynamic_flags(rows).collect()} == {("py:dyn#load", "dynamic_import"), ("py:pkg", "reexport")}
    kinds = {(r.module, r.name): (r.kind, r.exported) for r in rows.where("row = 'symbol'").collect()}
    assert kinds[("conf", "TIMEOUT")] == ("constant", True) and kinds[("conf", "_x")] == ("constant", True) and kinds[("conf", "other")] == ("constant", False)
    assert kinds[("base", "Top.level")] == ("field", False) and ("conf", "__all__") not in kinds


def test_a_name_defined_and_called_two_thousand_times_is_one_group(spark):
    files = {f"d{i}.py": "\n".join(f"class C{k}:\n    def get(self): pass" for k in range(100)) for i in range(20)}
    files |= {f"u{i}.py": "\n".join(f"def f{k}(x):\n    x.get()" for k in range(100)) for i in range(20)}
    edges, groups = python_source.relations(made(spark, files))
    calls = edges.where("relation = 'CALLS'")
    assert calls.count() == 2000 and calls.select("group_id", "resolution").distinct().collect() == [(calls.first().group_id, "ambiguous")]
    assert groups.count() == 2000
    assert checks.check_groups(calls.withColumn("id", F.col("from_id")), groups).isEmpty()
    shares = candidates.project(calls.limit(3), groups)
    assert shares.count() == 6000 and shares.agg(F.sum("share")).first()[0] == pytest.approx(3.0)


def test_lists_are_interned_whatever_their_order(spark):
    rows = [(1, 5, [7, 6, 7], "ambiguous", None), (2, 6, [5, 7, None], "ambiguous", None), (3, 5, [], "ambiguous", None), (4, 5, None, "exact", 0.5), (5, 9, [8], "ambiguous", None), (6, 5, [7], "unresolved", None)]
    edges, groups = candidates.intern(spark.createDataFrame(rows, "from_id long, to_id long, candidates array<long>, resolution string, share double").withColumn("confidence", F.lit("static_certain")))
    of = {r.from_id: r.group_id for r in edges.collect()}
    assert of[1] == of[2] != of[5] and of[5] and not any(of[i] for i in (3, 4, 6))
    assert sorted(r.target for r in groups.where(F.col("group_id") == of[1]).collect()) == [5, 6, 7] and groups.count() == 5
    assert {r.from_id: r.candidates for r in candidates.listed(edges, groups).collect()}[2] == [5, 7]
    got = sorted((r.from_id, r.target, round(r.share, 6)) for r in candidates.project(edges, groups).collect())
    assert got == [(1, 5, 0.333333), (1, 6, 0.333333), (1, 7, 0.333333), (2, 5, 0.333333), (2, 6, 0.333333), (2, 7, 0.333333), (3, 5, 1.0), (4, 5, 0.5), (5, 8, 0.5), (5, 9, 0.5), (6, 5, 1.0)]


def test_first_definers_equal_a_depth_first_walk(spark):
    rnd = random.Random(11)
    bases = {c: rnd.sample(range(30), rnd.randint(0, 3)) for c in range(30)}
    own = {(c, m) for c in range(30) for m in "ab" if rnd.random() < 0.12}

    def walk(c, m, seen):
        if c in seen:
            return None
        seen.add(c)
        if (c, m) in own:
            return f"{c}.{m}"
        return next((f for b in bases[c] if (f := walk(b, m, seen))), None)

    asked = spark.createDataFrame([(c, m) for c in range(30) for m in "ab"], "class int, member string")
    got = inheritance.first_definers(asked, spark.createDataFrame([(c, i, b) for c, bs in bases.items() for i, b in enumerate(bs)], "class int, place int, base int"), spark.createDataFrame([(c, m, f"{c}.{m}") for c, m in own], "class int, member string, id string"))
    want = {(c, m): f for c in range(30) for m in "ab" if (f := walk(c, m, set()))}
    assert {(r["class"], r.member): r.id for r in got.collect()} == want and len(want) > 20
