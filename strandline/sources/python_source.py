"""Symbols, imports, references, flags and test cases of Python files: one walk over each file, names joined by Spark."""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.candidates import digest_parts, group_id
from strandline.operators.inheritance import first_definers
from strandline.session import written
from strandline.sources.python_scopes import File

ROWS = (
    "path string, module string, row string, name string, owner string, kind string, line int, end_line int, branches int, strong int, weak int, "
    "mocks int, skipped boolean, exported boolean, flags array<string>, place long, n long"
)
#: Rows that a task hands on at once.
CHUNK = 20_000


def module_of(path: str) -> str:
    parts = path.removesuffix(".py").split("/")
    parts = parts[:-1] if parts[-1] == "__init__" else parts
    return ".".join(parts) or "__init__"


def _only_hands_on(tree: ast.Module) -> bool:
    """Whether a package's file has imports and nothing else but texts, pass and __all__."""
    for x in tree.body:
        targets = x.targets if isinstance(x, ast.Assign) else [x.target] if isinstance(x, ast.AnnAssign) else []
        listed = bool(targets) and all(isinstance(t, ast.Name) and t.id == "__all__" for t in targets)
        if not (isinstance(x, (ast.Import, ast.ImportFrom, ast.Pass)) or isinstance(x, ast.Expr) and isinstance(x.value, ast.Constant) or listed):
            return False
    return any(isinstance(x, (ast.Import, ast.ImportFrom)) for x in tree.body)


def parse(path: str, content: str) -> list[dict]:
    """Rows of one file; a file that cannot be parsed, or is nested too deeply for the parser, is one row of kind failed."""
    module = module_of(path)
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(content)
            file = File(tree)
    except (SyntaxError, ValueError, MemoryError, RecursionError):
        return [{"path": path, "module": module, "row": "file", "name": module, "kind": "failed"}]
    package = path.rpartition("/")[2] == "__init__.py"
    at = {"path": path, "module": module}
    hands_on = ["reexport"] if package and _only_hands_on(tree) else []
    rows = [at | {"row": "file", "name": module, "kind": "complete", "line": 1, "end_line": content.count("\n") + 1, "branches": file.module.counts["branches"], "flags": hands_on + sorted(file.flags.get("", ()))}]
    for name, owner, kind, line, end_line, scope, exported, _ in file.symbols:
        rows.append(at | {"row": "symbol", "name": name, "owner": owner or None, "kind": kind, "line": line, "end_line": end_line, "exported": exported, "flags": sorted(file.flags.get(name, ())), **(scope.counts if scope else {})})
    for (owner, name, kind), (n, line, place) in file.refs.items():
        rows.append(at | {"row": "ref", "name": name, "owner": owner or None, "kind": kind, "line": line, "place": place, "n": n})
    for x, a, local, line, place in file.imports:
        if isinstance(x, ast.Import):
            rows.append(at | {"row": "import", "name": a.name, "owner": local, "kind": "module", "line": line, "place": place})
        else:
            up = module.split(".") if package else module.split(".")[:-1]
            base = ".".join([*up[: len(up) - x.level + 1], *([x.module] if x.module else [])]) if x.level else x.module or ""
            rows.append(at | {"row": "import", "name": f"{base}.{a.name}" if base else a.name, "owner": local, "kind": "symbol", "line": line, "place": place})
    for c in file.cases:
        mocks = file.module_mocks + c.mocks + sum(t.mocks for t in c.around)
        rows.append(at | {"row": "case", "name": c.name, "line": c.line, "strong": c.strong, "weak": c.weak, "mocks": mocks, "skipped": c.skipped or any(t.skipped for t in c.around)})
    return rows


def extract(files: DataFrame) -> DataFrame:
    """Rows (see ROWS) of all .py files of files (path, content); a task hands them on in chunks, so that it holds the
    facts of few files. Row kinds: file (complete or failed), symbol (class, function, method, constant, field), ref (call, local, base,
    decorator, bare, type, read, write, dynamic), import (module, symbol) and case.

    Names are looked up lexically in the file: what a function, comprehension or lambda binds is not the module's (reads and writes
    are of module names only), a global statement makes it so, class bodies are not seen from their methods, and a
    definition in an enclosing function is named by its path (f.<locals>.g)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
        schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ROWS.split(", "))])
        rows: list[dict] = []
        for b in batches:
            for p, c in zip(b.column(0), b.column(1), strict=True):
                rows += parse(p.as_py(), c.as_py() or "")
                if len(rows) >= CHUNK:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return files.where(F.col("path").endswith(".py")).select("path", "content").mapInArrow(run, ROWS)


def cases_of_tests(rows: DataFrame) -> DataFrame:
    """module, name, line, strong, weak, mocks, skipped: a row for each definition of a test.

    Tests are functions of the module or of its classes (not inside others, nor under if) whose names begin with test. What is
    defined inside counts with them. An assert is one assertion, strong if it compares for equality or identity; calls
    inside it are none. Mocks are calls that make one, anywhere in the test, before its classes and at the top of the module, and bare
    decorators that patch; a skip is a decorator of the test or its classes, or a call in the test.
    """
    return rows.where("row = 'case'").select("module", "name", "line", "strong", "weak", "mocks", "skipped")


def dynamic_flags(rows: DataFrame) -> DataFrame:
    """id, flag: modules and symbols whose own statements import, look up attributes or evaluate by computed names
    (dynamic_import, dynamic_attr, dynamic_eval), and package files that only hand names on (reexport)."""
    own = rows.where("row in ('file', 'symbol')").select(F.when(F.col("row") == "file", F.concat(F.lit("py:"), "module")).otherwise(_id("module", "name")).alias("id"), F.explode("flags").alias("flag"))
    return own.distinct()


def _id(module: str, name: str) -> Column:
    return F.concat(F.lit("py:"), F.col(module), F.lit("#"), F.col(name))


def _or_module(name: str) -> Column:
    return F.when(F.col(name).isNull(), F.concat(F.lit("py:"), "module")).otherwise(_id("module", name))


def bindings(rows: DataFrame) -> DataFrame:
    """module, alias, full: what each imported name stands for, by its last import in the file, followed through the modules
    that import it from elsewhere.

    A name that comes back to one it has been is left there. The rounds are the longest chain of such modules.
    """
    whole = F.when((F.col("kind") == "module") & (F.col("owner") == F.substring_index("name", ".", 1)), F.col("owner")).otherwise(F.col("name"))
    i = rows.where("row = 'import' and owner <> '*'").groupBy("module", F.col("owner").alias("alias")).agg(F.max_by(whole, F.struct("place", "name")).alias("full"))
    step = written(i.where("full <> concat(module, '.', alias)").groupBy(F.concat("module", F.lit("."), "alias").alias("known")).agg(F.min("full").alias("next")), "step")
    now = written(i.select("module", "alias", "full", F.array("full").alias("seen")), "bound")
    while True:
        moved = now.join(step, F.col("full") == F.col("known"), "left").withColumn("go", F.col("next").isNotNull() & ~F.array_contains("seen", F.coalesce("next", F.lit(""))))
        now = written(moved.select("module", "alias", F.when(F.col("go"), F.col("next")).otherwise(F.col("full")).alias("full"), F.when(F.col("go"), F.array_append("seen", F.col("next"))).otherwise(F.col("seen")).alias("seen"), "go"), "bound")
        if now.where("go").isEmpty():
            return now.select("module", "alias", "full")
        now = now.drop("go")


def _resolved(refs: DataFrame, symbols: DataFrame, bound: DataFrame) -> DataFrame:
    """refs (module, owner, name, ...) with `exact`: the one symbol that a name certainly means; `full`: the name behind
    an import; `class` and `member`, where it asks a class (its own, or one by name) for a member that this class has not
    itself. First the own class's member, then the own module, then what is imported."""
    around = F.expr("substring(owner, 1, length(owner) - length(substring_index(owner, '.', -1)) - 1)")
    mine, pair = F.col("name").rlike(r"^(self|cls)\.[^.]+$"), F.col("name").rlike(r"^[^.?]+\.[^.]+$")
    keys = symbols.select(F.concat("module", F.lit("#"), "name").alias("k"), "id", (F.col("kind") == "class").alias("is_class")).groupBy("k").agg(F.min("id").alias("id"), F.max("is_class").alias("is_class"))
    fq = symbols.groupBy(F.concat("module", F.lit("."), "name").alias("q")).agg(F.min("id").alias("fq_id"), F.max(F.col("kind") == "class").alias("fq_class"))
    key = lambda k, v: keys.select(F.col("k").alias(k), F.col("id").alias(v), F.col("is_class").alias(f"{v}_class"))
    last = F.substring_index("name", ".", -1)
    r = refs.withColumns({"own": F.when(mine, F.concat("module", F.lit("#"), around)), "local": F.concat("module", F.lit("#"), "name"), "head": F.substring_index("name", ".", 1)})
    r = r.withColumns({"own_member": F.concat("own", F.lit("."), last), "head_key": F.when(pair & ~mine, F.concat("module", F.lit("#"), "head"))})
    for column, k, v in (("own_member", "k1", "own_id"), ("local", "k2", "local_id"), ("own", "k3", "own_class"), ("head_key", "k4", "head")):
        v = f"{v}_" if v == "head" else v
        r = r.join(key(k, v), F.col(column) == F.col(k), "left")
    r = r.join(bound.select(F.col("module").alias("m3"), "alias", F.col("full").alias("base")), (F.col("module") == F.col("m3")) & (F.col("head") == F.col("alias")), "left")
    r = r.withColumn("full", F.concat("base", F.expr("substring(name, length(head) + 1)"))).join(fq, F.col("full") == F.col("q"), "left")
    r = r.join(fq.select(F.col("q").alias("q2"), F.col("fq_id").alias("base_id"), F.col("fq_class").alias("base_class")), pair & ~mine & (F.col("base") == F.col("q2")), "left")
    exact = F.coalesce("own_id", "local_id", "fq_id")
    of = F.when(F.col("own_class_class"), F.col("own_class")).when(F.col("head__class"), F.col("head_")).when(F.col("base_class") & F.col("head_").isNull(), F.col("base_id"))
    return r.withColumn("exact", exact).select(*refs.columns, "full", "exact", F.when(exact.isNull(), of).alias("class"), F.when(exact.isNull() & of.isNotNull(), last).alias("member"))


def relations(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, groups): edges (from_id, to_id, relation, confidence, resolution, group_id, n) of all files' rows, and the
    candidate groups (group_id, target) of the ambiguous ones (see operators.candidates), each list once however often it is meant.

    CONTAINS, IMPORTS, IMPORTS_SYMBOL (RE_EXPORTS for package files that only hand names on), INHERITS, DECORATES, TYPE_USES, CALLS,
    INSTANTIATES (calls of classes), READS (of constants and fields) and WRITES (of constants). A name is looked up in
    its own class, its module and its imports (through re-exports); a member of a class in the classes above it, of which the first in
    the order of their writing that has it counts; else by its last part in the whole repository: one match is unique, several are
    ambiguous (to_id: the least), none leaves it unresolved. What is imported from elsewhere is external. Modules that a
    literal names in a dynamic import are IMPORTS that are dynamic_required.
    """
    symbols = written(rows.where("row = 'symbol'").select("module", "name", "owner", "kind", _id("module", "name").alias("id"), F.substring_index("name", ".", -1).alias("simple")).distinct(), "symbols")
    kinds = symbols.groupBy(F.col("id").alias("kid")).agg(F.max("kind").alias("target_kind"))
    bound = bindings(rows)
    local = F.col("kind") == "local"
    name = F.when(local, F.concat(F.lit("?"), F.expr("substring(name, length(substring_index(name, '.', 1)) + 1)"))).otherwise(F.col("name"))
    kind = F.when(local, "call").otherwise(F.col("kind"))
    refs = rows.where("row = 'ref' and kind <> 'dynamic'").select("module", "owner", name.alias("name"), kind.alias("kind"), F.when(F.col("kind") == "base", F.col("place")).alias("place"), "n").groupBy("module", "owner", "name", "kind", "place").agg(F.sum("n").alias("n"))
    met = written(_resolved(refs, symbols, bound), "met")
    # all symbols of one last name: a group, of which only the least and the digest travel with the references
    named = symbols.select("simple", F.col("id").alias("t")).distinct().groupBy("simple").agg(*digest_parts(F.col("t")))
    named = named.select(F.col("simple").alias("s"), F.col("least").alias("first_named"), F.when(F.col("n_targets") > 1, group_id()).alias("named_group"))
    met = met.join(named, F.col("exact").isNull() & ~F.col("name").isin("?") & (F.substring_index("name", ".", -1) == F.col("s")), "left").drop("s")
    bases = met.where("kind = 'base'").select(_or_module("owner").alias("class"), "place", F.coalesce("exact", "first_named").alias("base")).join(kinds, F.col("base") == F.col("kid")).where("target_kind = 'class'").select("class", "place", "base")
    members = symbols.where("owner is not null").select(_id("module", "owner").alias("class"), F.col("simple").alias("member"), "id")
    above = first_definers(met.where("class is not null").select("class", "member"), bases, members)
    met = met.join(above.select(F.col("class").alias("c"), F.col("member").alias("m"), F.col("id").alias("above")), (F.col("class") == F.col("c")) & (F.col("member") == F.col("m")), "left")
    met = met.withColumn("exact", F.coalesce("exact", "above"))
    modules = rows.where("row = 'file'").select(F.substring_index("module", ".", 1).alias("root")).distinct()
    j = met.join(modules, F.substring_index("full", ".", 1) == F.col("root"), "left")
    outside = F.col("full").isNotNull() & F.col("root").isNull()
    to = F.when(F.col("exact").isNotNull(), F.col("exact")).when(outside, F.concat(F.lit("external:"), "full")).otherwise(F.coalesce("first_named", F.concat(F.lit("unresolved:"), "name")))
    resolution = F.when(F.col("exact").isNotNull(), "exact").when(outside | F.col("first_named").isNull(), "unresolved").when(F.col("named_group").isNotNull(), "ambiguous").otherwise("unique_name")
    j = j.withColumns({"to_id": to, "resolution": resolution}).join(kinds, F.col("to_id") == F.col("kid"), "left")
    reads = F.col("target_kind").isin("constant", "field")
    j = j.where(~F.col("kind").isin("read", "write") | F.coalesce((F.col("kind") == "read") & reads, F.lit(False)) | F.coalesce((F.col("kind") == "write") & (F.col("resolution") == "exact") & (F.col("target_kind") == "constant"), F.lit(False)))
    relation = F.when(F.col("kind") == "base", "INHERITS").when(F.col("kind").isin("decorator", "bare"), "DECORATES").when(F.col("kind") == "type", "TYPE_USES").when(F.col("kind") == "read", "READS")
    relation = relation.when(F.col("kind") == "write", "WRITES").when(F.col("target_kind") == "class", "INSTANTIATES").otherwise("CALLS")
    confidence = F.when(F.col("resolution") == "exact", "static_certain").when(F.col("resolution") == "unresolved", "dynamic_required").otherwise("static_inferred")
    used = j.select(_or_module("owner").alias("from_id"), "to_id", relation.alias("relation"), confidence.alias("confidence"), "resolution", F.when(F.col("resolution") == "ambiguous", F.col("named_group")).alias("group_id"), "n")
    used = written(used.groupBy("from_id", "to_id", "relation", "confidence", "resolution", "group_id").agg(F.sum("n").alias("n")), "used")
    wanted = used.where("group_id is not null").select(F.col("group_id").alias("g")).distinct()
    names = named.join(wanted, F.col("named_group") == F.col("g")).select(F.col("s").alias("simple"), F.col("g").alias("group_id"))
    groups = symbols.join(names, "simple").select("group_id", F.col("id").alias("target")).distinct()
    return _contained(symbols).unionByName(_imported(rows, symbols, bound)).unionByName(_dynamic_imports(rows)).unionByName(used), groups


def _certain(df: DataFrame, relation: Column, resolution: Column | str = "exact") -> DataFrame:
    r = F.lit(resolution) if isinstance(resolution, str) else resolution
    return df.select("from_id", "to_id", relation.alias("relation"), F.when(r == "exact", "static_certain").otherwise("dynamic_required").alias("confidence"), r.alias("resolution"), F.lit(None).cast("string").alias("group_id"), "n")


def _contained(symbols: DataFrame) -> DataFrame:
    return _certain(symbols.select(_or_module("owner").alias("from_id"), F.col("id").alias("to_id")).distinct().withColumn("n", F.lit(1).cast("long")), F.lit("CONTAINS"))


def _dynamic_imports(rows: DataFrame) -> DataFrame:
    modules = rows.where("row = 'file'").select(F.col("module").alias("known")).distinct()
    asked = rows.where("row = 'ref' and kind = 'dynamic'").join(modules, F.col("name") == F.col("known"))
    asked = asked.select(_or_module("owner").alias("from_id"), F.concat(F.lit("py:"), "name").alias("to_id"), "n").groupBy("from_id", "to_id").agg(F.sum("n").alias("n"))
    return _certain(asked, F.lit("IMPORTS")).withColumn("confidence", F.lit("dynamic_required"))


def _imported(rows: DataFrame, symbols: DataFrame, bound: DataFrame) -> DataFrame:
    """Modules import modules (the longest part of the name that is one, else something external) and symbols."""
    i = rows.where("row = 'import'").groupBy("module", "path", F.col("owner").alias("alias"), "name", "kind").agg(F.count("*").alias("n"))
    parts = F.split("name", r"\.")
    tries = i.select("module", "path", "alias", "name", "kind", "n", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("d"), parts.alias("p")).withColumn("try", F.array_join(F.slice("p", F.lit(1), F.col("d")), "."))
    files = rows.where("row = 'file'")
    modules = files.select(F.col("module").alias("known")).distinct()
    best = tries.join(modules, F.col("try") == F.col("known"), "left").groupBy("module", "name", "kind", "alias", "n").agg(F.max(F.when(F.col("known").isNotNull(), F.struct("d", "known"))).alias("b"))
    hit = F.col("b").isNotNull()
    to = best.select(F.concat(F.lit("py:"), "module").alias("from_id"), F.when(hit, F.concat(F.lit("py:"), F.col("b.known"))).otherwise(F.concat(F.lit("external:"), "name")).alias("to_id"), hit.alias("hit"), "n")
    to = to.groupBy("from_id", "to_id", "hit").agg(F.sum("n").alias("n"))
    mods = _certain(to, F.lit("IMPORTS"), F.when(F.col("hit"), "exact").otherwise("unresolved"))
    fq = symbols.groupBy(F.concat("module", F.lit("."), "name").alias("q")).agg(F.min("id").alias("to_id"))
    named = i.where("kind = 'symbol'").groupBy(F.col("module").alias("m"), "alias").agg(F.sum("n").alias("n"))
    named = named.join(bound.select("module", F.col("alias").alias("al"), "full"), (F.col("m") == F.col("module")) & (F.col("alias") == F.col("al"))).join(fq, F.col("full") == F.col("q")).drop("module")
    named = named.join(files.where(F.array_contains("flags", "reexport")).select(F.col("module").alias("hm"), F.lit(True).alias("hands_on")).distinct(), F.col("m") == F.col("hm"), "left")
    named = named.select(F.concat(F.lit("py:"), "m").alias("from_id"), "to_id", "n", F.when(F.col("hands_on"), "RE_EXPORTS").otherwise("IMPORTS_SYMBOL").alias("relation"))
    return mods.unionByName(_certain(named.groupBy("from_id", "to_id", "relation").agg(F.sum("n").alias("n")), F.col("relation")))
