"""One Python file as facts: its symbols, lexical scopes, what each name stands for, and test cases. One walk, no recursion."""

from __future__ import annotations

import ast
from collections.abc import Iterator
from dataclasses import dataclass, field

FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.match_case)
COMPREHENSIONS = (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)

#: Calls and definitions that make names dynamic. Fixed values.
IMPORTERS = ("import_module", "__import__")
ATTRIBUTE_CALLS = ("getattr", "setattr", "hasattr", "delattr")
EVALUATORS = ("eval", "exec", "globals", "locals", "vars", "compile")
HOOKS = ("__getattr__", "__getattribute__", "__setattr__", "__delattr__")
ALIASED = ("importlib", "builtins")

#: Names of assertions, mocks and skips in Python tests. Fixed values.
STRONG = (
    "assertEqual assertEquals assertIs assertIsNone assertDictEqual assertListEqual assertCountEqual assertSequenceEqual assertTupleEqual assertSetEqual "
    "assertMultiLineEqual assertAlmostEqual assertRaises assertRaisesRegex assert_called_once_with assert_called_with assert_any_call assert_has_calls assert_not_called"
).split()
WEAK = (
    "assertTrue assertFalse assertIsNotNone assertIn assertNotIn assertGreater assertGreaterEqual assertLess assertLessEqual assertNotEqual assertIsInstance "
    "assertIsNot assertNotAlmostEqual assertRegex assert_called assert_called_once"
).split()
LIKE_ASSERTIONS = ("assert", "check", "verify", "expect")
MOCK_CLASSES = ("Mock", "MagicMock", "AsyncMock", "NonCallableMock", "PropertyMock", "create_autospec")
PATCHES = ("patch", "patch.object", "patch.dict", "patch.multiple")
PATCH_PREFIXES = ("unittest.mock.", "mock.", "mocker.")
MONKEYPATCHES = ("monkeypatch.setattr", "monkeypatch.setitem")
SKIPS = (
    "pytest.mark.skip", "pytest.mark.skipif", "pytest.mark.xfail", "mark.skip", "mark.skipif", "mark.xfail", "unittest.skip", "skip",
    "unittest.skipIf", "skipIf", "unittest.skipUnless", "skipUnless", "unittest.expectedFailure", "expectedFailure",
)


def dotted(x: ast.AST) -> str | None:
    """a.b.c as text; ?.c where what stands before is no plain name."""
    parts = []
    while isinstance(x, ast.Attribute):
        parts.append(x.attr)
        x = x.value
    if not isinstance(x, ast.Name) and not parts:
        return None
    return ".".join([x.id if isinstance(x, ast.Name) else "?", *reversed(parts)])


def annotated(x: ast.AST | None) -> Iterator[tuple[str, int]]:
    """The names in an annotation, each as long as it goes, those in quotes too."""
    todo = [x] if x is not None else []
    while todo:
        y = todo.pop()
        if isinstance(y, (ast.Name, ast.Attribute)):
            if name := dotted(y):
                yield name, y.lineno
        elif isinstance(y, ast.Constant) and isinstance(y.value, str):
            if all(p.isidentifier() for p in y.value.split(".")):
                yield y.value, y.lineno
        else:
            todo.extend(ast.iter_child_nodes(y))


@dataclass
class Scope:
    """A module, class, function or comprehension. owner: the symbol its statements belong to ('' for the module, None in
    definitions that are no symbols). bound: how each name of it is bound; outer: names declared global or nonlocal."""

    kind: str
    owner: str | None
    prefix: str
    up: Scope | None = None
    bound: dict[str, set[str]] = field(default_factory=dict)
    outer: dict[str, str] = field(default_factory=dict)
    imports: dict[str, tuple[str, str | None]] = field(default_factory=dict)
    made: dict[str, str] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=lambda: {"branches": 0, "strong": 0, "weak": 0})

    def bind(self, name: str, how: str) -> None:
        self.bound.setdefault(name, set()).add(how)

    def home(self, name: str) -> Scope:
        """The scope whose name it is; the module for all that no scope around binds. Classes show their names to their own
        statements only, not to functions in them."""
        here = self
        while here.up is not None:
            how = here.outer.get(name)
            if how == "global":
                break
            if how is None and name in here.bound and (here is self or here.kind != "class"):
                return here
            here = here.up
        while here.up is not None:
            here = here.up
        return here


@dataclass
class Tally:
    """Assertions, mocks and skips of a test, or mocks and skips before a class; `around` are the tallies of its classes. Code
    of definitions that are no tests has one that nobody reads."""

    name: str = ""
    line: int = 0
    test: bool = False
    around: tuple[Tally, ...] = ()
    strong: int = 0
    weak: int = 0
    mocks: int = 0
    skipped: bool = False


def _is_patch(name: str | None) -> bool:
    for prefix in PATCH_PREFIXES:
        if name and name.startswith(prefix):
            return name[len(prefix) :] in PATCHES
    return name in PATCHES


class File:
    """The facts of a parsed file. symbols: (name, owner, kind, first and last line, scope or None, exported); refs: (owner, name, kind) ->
    (count, first line, place); imports: (name, alias, kind, line, place); flags: owner -> dynamic flags; cases: Tally."""

    def __init__(self, tree: ast.Module):
        self.module = Scope("module", "", "")
        self.symbols: list[tuple] = []
        self.refs: dict[tuple[str, str, str], list[int]] = {}
        self.imports: list[tuple] = []
        self.flags: dict[str, set[str]] = {}
        self.cases: list[Tally] = []
        self.module_mocks = 0
        self.names: list[tuple[Scope, str, str, int]] = []
        self._calls: list[tuple[Scope, ast.Call]] = []
        self.exported = self._exports(tree)
        # node, its scope, how it stands (3: in the body of the module or its classes, 2: in another body, 1: in an if or try of one,
        # 0: elsewhere, where definitions are no symbols), tally, whether inside an assert
        self.todo: list[tuple] = [(x, self.module, 3, None, False) for x in reversed(tree.body)]
        while self.todo:
            self._visit(*self.todo.pop())
        for scope, name, ctx, line in self.names:
            self._use(scope, name, ctx, line)
        for scope, call in self._calls:
            self._call(scope, call)
        classes = {s[0] for s in self.symbols if s[2] == "class"}
        for name, owner, kind, *_, direct in self.symbols:
            if kind in ("function", "method") and direct and name.rpartition(".")[2] in (HOOKS if owner in classes else HOOKS[:1] if owner == "" else ()):
                self.flags.setdefault(owner, set()).add("dynamic_attr")

    @staticmethod
    def _exports(tree: ast.Module) -> list[str] | None:
        for x in tree.body:
            if isinstance(x, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in x.targets) and isinstance(x.value, (ast.List, ast.Tuple)):
                return [e.value for e in x.value.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)]
        return None

    def refer(self, owner: str | None, name: str | None, kind: str, line: int, place: int = 0) -> None:
        if name and owner is not None:
            self.refs.setdefault((owner, name, kind), [0, line, place])[0] += 1

    def _symbol(self, scope: Scope, x: ast.AST, name: str, kind: str, inner: Scope | None, direct: bool) -> None:
        exported = scope.kind == "module" and (name in self.exported if self.exported is not None else not name.startswith("_"))
        self.symbols.append((scope.prefix + name, scope.owner, kind, x.lineno, x.end_lineno, inner, exported, direct))

    def _push(self, nodes, scope: Scope, stands: int, tally: Tally | None, asserted: bool = False) -> None:
        self.todo.extend((x, scope, stands, tally, asserted) for x in nodes if x is not None)

    def _visit(self, x: ast.AST, scope: Scope, stands: int, tally: Tally | None, asserted: bool) -> None:
        if isinstance(x, (*FUNCTIONS, ast.ClassDef)):
            return self._definition(x, scope, stands, tally)
        own = scope
        while own.kind == "comprehension" and own.up is not None:
            own = own.up
        own.counts["branches"] += isinstance(x, BRANCHES) + (len(x.values) - 1 if isinstance(x, ast.BoolOp) else 0)
        if isinstance(x, ast.Lambda):
            inner = Scope("function", scope.owner, scope.prefix, scope, counts=own.counts)
            self._parameters(x.args, inner)
            self._push([*x.args.defaults, *x.args.kw_defaults], scope, 0, tally, asserted)
            return self._push([x.body], inner, 0, tally, asserted)
        if isinstance(x, COMPREHENSIONS):
            inner = Scope("comprehension", scope.owner, scope.prefix, scope)
            self._push([x.generators[0].iter], scope, 0, tally, asserted)
            for i, g in enumerate(x.generators):
                own.counts["branches"] += len(g.ifs)
                self._push([g.target, *g.ifs, *([g.iter] if i else [])], inner, 0, tally, asserted)
            return self._push([x.key, x.value] if isinstance(x, ast.DictComp) else [x.elt], inner, 0, tally, asserted)
        if isinstance(x, ast.Name):
            if not isinstance(x.ctx, ast.Load):
                scope.bind(x.id, "store")
            self.names.append((scope, x.id, type(x.ctx).__name__, x.lineno))
        elif isinstance(x, ast.NamedExpr):
            self._push([x.target], own, 0, tally, asserted)
            return self._push([x.value], scope, 0, tally, asserted)
        elif isinstance(x, (ast.Global, ast.Nonlocal)):
            scope.outer.update(dict.fromkeys(x.names, "global" if isinstance(x, ast.Global) else "nonlocal"))
        elif isinstance(x, (ast.Import, ast.ImportFrom)):
            self._import(x, scope)
        elif isinstance(x, (ast.ExceptHandler, ast.MatchAs, ast.MatchStar)) and x.name:
            scope.bind(x.name, "store")
        elif isinstance(x, ast.MatchMapping) and x.rest:
            scope.bind(x.rest, "store")
        elif isinstance(x, ast.Call):
            self._calls.append((scope, x))
            self._count(x, scope, own, tally, asserted)
        elif isinstance(x, ast.Subscript) and isinstance(x.value, ast.Attribute) and x.value.attr == "__dict__" and not (isinstance(x.slice, ast.Constant) and isinstance(x.slice.value, str)):
            self._flag(scope, "dynamic_attr")
        elif isinstance(x, ast.Assert):
            exact = isinstance(x.test, ast.Compare) and len(x.test.ops) == 1 and isinstance(x.test.ops[0], (ast.Eq, ast.Is))
            own.counts["strong" if exact else "weak"] += 1
            if tally is not None and not asserted:
                tally.strong, tally.weak = tally.strong + exact, tally.weak + (not exact)
            asserted = True
        elif isinstance(x, (ast.Assign, ast.AnnAssign)):
            targets = [x.target] if isinstance(x, ast.AnnAssign) else x.targets
            if isinstance(x, ast.AnnAssign):
                for name, line in annotated(x.annotation):
                    self.refer(scope.owner, name, "type", line)
            if stands and scope.kind in ("module", "class"):
                for t in targets:
                    if isinstance(t, ast.Name) and t.id != "__all__":
                        self._symbol(scope, x, t.id, "field" if scope.kind == "class" else "constant", None, stands >= 2)
        stays = 1 if stands and isinstance(x, (ast.If, ast.Try, ast.ExceptHandler)) else 0
        self._push(reversed(list(ast.iter_child_nodes(x))), scope, stays, tally, asserted)
        return None

    @staticmethod
    def _parameters(args: ast.arguments, inner: Scope) -> list[ast.arg]:
        every = [*args.posonlyargs, *args.args, *args.kwonlyargs, *filter(None, (args.vararg, args.kwarg))]
        for a in every:
            inner.bind(a.arg, "parameter")
        return every

    def _definition(self, x: ast.AST, scope: Scope, stands: int, tally: Tally | None) -> None:
        """Decorators, defaults, annotations and bases belong to the scope around, the body to a scope of its own."""
        is_class, registered = isinstance(x, ast.ClassDef), bool(stands) and scope.owner is not None
        name = scope.prefix + x.name
        scope.bind(x.name, "def")
        owner = name if registered else None
        inner = Scope("class" if is_class else "function", owner, f"{name}." if is_class else f"{name}.<locals>.", scope)
        for t in getattr(x, "type_params", []):
            inner.bind(t.name, "parameter")
        if registered:
            scope.made[x.name] = name
            self._symbol(scope, x, x.name, "class" if is_class else "method" if scope.kind == "class" else "function", inner, stands >= 2)
        outside: list[ast.AST | None] = []
        for d in x.decorator_list:
            self.refer(owner, dotted(d.func if isinstance(d, ast.Call) else d), "decorator" if isinstance(d, ast.Call) else "bare", d.lineno)
        if is_class:
            for i, base in enumerate(x.bases):
                b = base
                while isinstance(b, (ast.Call, ast.Subscript)):
                    b = b.func if isinstance(b, ast.Call) else b.value
                self.refer(owner, dotted(b), "base", base.lineno, i)
            outside += [*x.bases, *x.keywords]
        else:
            args = self._parameters(x.args, inner)
            for at, line in [n for a in args for n in annotated(a.annotation)] + list(annotated(x.returns)):
                self.refer(owner, at, "type", line)
            outside += [*x.args.defaults, *x.args.kw_defaults, *(a.annotation for a in args), x.returns]
        inside = tally if tally is not None and tally.test else Tally()
        before = inside
        around = tally.around if tally is not None else ()
        bare = [dotted(d.func if isinstance(d, ast.Call) else d) for d in x.decorator_list]
        skipped = any(b in SKIPS for b in bare)
        mocks = sum(_is_patch(b) and not isinstance(d, ast.Call) for b, d in zip(bare, x.decorator_list, strict=True))
        if stands == 3 and is_class:  # what stands before a class counts for all tests in it
            before = Tally(x.name, x.lineno, False, (), mocks=mocks, skipped=skipped)
            inside = Tally(around=(*around, before))
        elif stands == 3 and x.name.startswith("test"):
            before = inside = Tally(".".join([*(t.name for t in around), x.name]), x.lineno, True, around, mocks=mocks, skipped=skipped)
            self.cases.append(inside)
        self._push(x.decorator_list, scope, 0, before)
        self._push(outside, scope, 0, inside)
        self._push(reversed(x.body), inner, 3 if is_class and stands == 3 else 2, inside)

    def _import(self, x: ast.Import | ast.ImportFrom, scope: Scope) -> None:
        for a in x.names:
            local = a.asname or (a.name.split(".")[0] if isinstance(x, ast.Import) else a.name)
            if a.name != "*":
                scope.bind(local, "import")
                if isinstance(x, ast.Import):
                    scope.imports[local] = (a.name if a.asname else local, None)
                elif not x.level and x.module:
                    scope.imports[local] = (x.module, a.name)
            self.imports.append((x, a, local, x.lineno, len(self.imports)))

    def _flag(self, scope: Scope, flag: str) -> None:
        if scope.owner is not None:
            self.flags.setdefault(scope.owner, set()).add(flag)

    def _count(self, call: ast.Call, scope: Scope, own: Scope, tally: Tally | None, asserted: bool) -> None:
        """Assertions are counted where they are not part of an assert; mocks and skips everywhere."""
        name = dotted(call.func)
        plain = None if name is None or name.startswith("?") else name
        last = None if name is None else name.rpartition(".")[2]
        own.counts["strong"] += plain == "pytest.raises"
        mock = last in MOCK_CLASSES or _is_patch(plain) or plain in MONKEYPATCHES
        if tally is None:
            self.module_mocks += mock
            return
        tally.mocks += mock
        if not tally.test:
            return
        tally.skipped |= plain == "pytest.skip" or last == "skipTest"
        if not asserted and last is not None:
            strong = plain in ("pytest.raises", "raises") or last in STRONG or (last not in WEAK and last.startswith(LIKE_ASSERTIONS))
            tally.strong, tally.weak = tally.strong + strong, tally.weak + (not strong and last in WEAK)

    def _use(self, scope: Scope, name: str, ctx: str, line: int) -> None:
        """Names of the module that are read, or written from inside a definition."""
        if scope.home(name).kind == "module":
            if ctx == "Load":
                self.refer(scope.owner, name, "read", line)
            elif scope.owner:
                self.refer(scope.owner, name, "write", line)

    def _call(self, scope: Scope, call: ast.Call) -> None:
        func, name = call.func, dotted(call.func)
        if name is not None:
            head, _, rest = name.partition(".")
            home = scope.home(head) if head != "?" else self.module
            ways = home.bound.get(head, set())
            kind = "call"
            if home.kind != "module" and not (head in ("self", "cls") and rest and ways == {"parameter"}) and ways != {"import"}:
                made = home.made.get(head) if ways == {"def"} else None
                name, kind = (made + (f".{rest}" if rest else ""), "call") if made else (name, "local")
            self.refer(scope.owner, name, kind, call.lineno)
        self._dynamic(scope, call, func)

    def _dynamic(self, scope: Scope, call: ast.Call, func: ast.AST) -> None:
        """Flags by the called name as it stands, and by what an alias of importlib or builtins stands for."""
        receiver, last = None, func.id if isinstance(func, ast.Name) else func.attr if isinstance(func, ast.Attribute) else ""
        if isinstance(func, ast.Attribute) and isinstance(func.value, (ast.Name, ast.Attribute)):
            receiver = func.value.id if isinstance(func.value, ast.Name) else func.value.attr
        asked = [(last, receiver is None)]
        first = func.id if isinstance(func, ast.Name) else func.value.id if isinstance(func, ast.Attribute) and isinstance(func.value, ast.Name) else None
        if first is not None:
            home = scope.home(first)
            module, symbol = home.imports.get(first, (None, None)) if home.bound.get(first) == {"import"} else (None, None)
            if isinstance(func, ast.Name) and module in ALIASED and symbol:
                asked.append((symbol, True))
            elif isinstance(func, ast.Attribute) and (module in ALIASED and symbol is None or first == "builtins"):
                asked.append((last, (module or first) == "builtins"))
        sent = False
        constant = lambda i: len(call.args) > i and isinstance(call.args[i], ast.Constant) and isinstance(call.args[i].value, str)
        for name, free in asked:
            if name in IMPORTERS:
                self._flag(scope, "dynamic_import")
                if constant(0) and not sent:
                    self.refer(scope.owner, call.args[0].value, "dynamic", call.lineno)
                    sent = True
            elif free and name in ATTRIBUTE_CALLS and not constant(1):
                self._flag(scope, "dynamic_attr")
            elif free and name in EVALUATORS:
                self._flag(scope, "dynamic_eval")
