"""Web applications in Python files: apps, routers, endpoints with their full paths, dependencies in use, and schemas."""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators import graph as G
from strandline.operators.candidates import intern
from strandline.operators.ordered_walk import first_ways
from strandline.session import written
from strandline.sources.python_scopes import FUNCTIONS, dotted
from strandline.sources.python_source import module_of

ROWS = "path string, module string, row string, name string, method string, at string, target string, prefix string, names array<string>, requests array<string>, place long"

#: Fixed values.
METHODS = ("get", "post", "put", "delete", "patch", "options", "head", "trace", "api_route")
SCHEMA_BASES = ("BaseModel", "SQLModel", "Schema", "GenericModel")
SCHEMA_FOLDERS = ("models", "schemas", "entities")
SECURITY = ("OAuth2", "Security", "HTTPBearer")
USED_MODULES = ("dep", "security", "auth")


def _text(x: ast.AST | None) -> str | None:
    return str(x.value) if isinstance(x, ast.Constant) and x.value is not None else None


def _named(x: ast.AST | None) -> str | None:
    """The dotted name of what is called or meant."""
    while isinstance(x, (ast.Call, ast.Subscript)):
        x = x.func if isinstance(x, ast.Call) else x.value
    return dotted(x) if x is not None else None


def _asked(x: ast.AST | None, aliases: dict[str, ast.AST], depth: int = 20) -> str | None:
    """What a default, annotation or alias depends on: the argument of Depends or Security, in a call or in the parts of
    an annotation, also behind names of the file; a name that is none of the file's is left to other files as '=name'."""
    if isinstance(x, ast.Call) and (_named(x.func) or "").rpartition(".")[2] in ("Depends", "Security"):
        return _named(x.args[0]) if x.args else _named(x.func)
    if isinstance(x, ast.Subscript) and isinstance(x.slice, ast.Tuple):
        return next((d for e in x.slice.elts[1:] if (d := _asked(e, aliases, depth)) and not d.startswith("=")), None)
    if isinstance(x, ast.Name) and depth:
        return _asked(aliases[x.id], aliases, depth - 1) if x.id in aliases else f"={x.id}"
    return None


def _keyword(call: ast.Call, name: str) -> ast.AST | None:
    return next((k.value for k in call.keywords if k.arg == name), None)


def _listed(x: ast.AST | None, aliases: dict[str, ast.AST]) -> list[str]:
    return [d for e in x.elts if (d := _asked(e, aliases))] if isinstance(x, (ast.List, ast.Tuple)) else []


def _parameters(f: ast.AST, aliases: dict[str, ast.AST]) -> tuple[list[str], list[str]]:
    """What the parameters depend on, and the types of those that do not, each once, in order."""
    a = f.args
    first = len(a.args) - len(a.defaults)
    pairs = [(x, a.defaults[i - first] if i >= first else None) for i, x in enumerate(a.args)] + list(zip(a.kwonlyargs, a.kw_defaults, strict=True))
    asked, types = {}, {}
    for x, default in pairs:
        found = _asked(x.annotation, aliases)
        if found is None or found.startswith("="):
            found = (d if (d := _asked(default, aliases)) else None) or found
        if found:
            asked[found] = None
        if not (found and not found.startswith("=")) and x.annotation is not None:
            inner = x.annotation
            while isinstance(inner, ast.Subscript) and (_named(inner.value) or "").rpartition(".")[2] in ("Optional", "List", "list"):
                inner = inner.slice
            if (t := dotted(inner)) is not None:
                types[t.rpartition(".")[2]] = None
    return list(asked), list(types)


def parse(path: str, content: str) -> list[dict]:
    """Rows of one file: app, router, endpoint, inclusion, dependency, scheme, alias, import, schema. None for files that do not parse."""
    module = module_of(path)
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            body = ast.parse(content).body
    except (SyntaxError, ValueError, MemoryError, RecursionError):
        return []
    rows: list[dict] = []
    aliases = {t.id: x.value for x in body if isinstance(x, ast.Assign) for t in x.targets if isinstance(t, ast.Name)}

    def add(row: str, name: str | None, x: ast.AST, **more) -> None:
        rows.append({"path": path, "module": module, "row": row, "name": name, "place": x.lineno * 10_000 + min(x.col_offset, 9_999)} | more)

    def called(x: ast.AST) -> None:
        if isinstance(x, ast.Call) and isinstance(x.func, ast.Attribute) and x.func.attr == "include_router" and x.args and (target := _named(x.args[0])):
            add("inclusion", None, x, at=_named(x.func.value), target=target, prefix=_text(_keyword(x, "prefix")) or "", names=_listed(_keyword(x, "dependencies"), aliases))

    for x in body:
        if isinstance(x, ast.Import):
            for a in x.names:
                add("import", a.asname or a.name, x, target=a.name, method="module")
        elif isinstance(x, ast.ImportFrom):
            package = module.split(".")[: -x.level or None] if x.level and not path.endswith("__init__.py") else module.split(".")[: len(module.split(".")) - x.level + 1]
            base = ".".join([*package, *([x.module] if x.module else [])]) if x.level else x.module or ""
            for a in x.names:
                add("import", a.asname or a.name, x, target=a.name, at=base, method="symbol")
        elif isinstance(x, ast.Assign):
            for t in x.targets:
                if not isinstance(t, ast.Name):
                    continue
                kind = (_named(x.value.func) or "").rpartition(".")[2] if isinstance(x.value, ast.Call) else ""
                if (asked := _asked(x.value, aliases)) and not asked.startswith("="):
                    add("alias", t.id, x, target=asked)
                if any(s in kind for s in SECURITY):
                    add("scheme", t.id, x, method=kind)
                elif "FastAPI" in kind or kind == "get_application":
                    add("app", t.id, x)
                elif "APIRouter" in kind or kind == "router":
                    add("router", t.id, x, prefix=_text(_keyword(x.value, "prefix")) or "", names=_listed(_keyword(x.value, "dependencies"), aliases))
        elif isinstance(x, ast.ClassDef):
            bases = [(_named(b) or "").rpartition(".")[2] for b in x.bases]
            if any(b in SCHEMA_BASES or "Schema" in b or "Model" in b for b in bases) or set(path.split("/")) & set(SCHEMA_FOLDERS):
                fields = {n.rpartition(".")[2]: None for i in x.body if isinstance(i, ast.AnnAssign) for y in ast.walk(i.annotation) if isinstance(y, (ast.Name, ast.Attribute)) and (n := dotted(y))}
                add("schema", x.name, x, names=list(fields))
        elif isinstance(x, FUNCTIONS):
            asked, types = _parameters(x, aliases)
            route = next((d for d in x.decorator_list if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.func.attr.lower() in METHODS), None)
            if route is None:
                add("dependency", x.name, x, names=asked)
                continue
            said = _text(_keyword(route, "path")) or (_text(route.args[0]) if route.args else None) or "/"
            answer = _named(_keyword(route, "response_model"))
            add("endpoint", x.name, x, method=route.func.attr.upper(), at=_named(route.func.value), prefix=said, names=list(dict.fromkeys(asked + _listed(_keyword(route, "dependencies"), aliases))), requests=types, target=answer and answer.rpartition(".")[2])
        elif isinstance(x, ast.Expr):
            called(x.value)
        elif isinstance(x, ast.If):
            for y in x.body:
                if isinstance(y, ast.Expr):
                    called(y.value)
    return rows


def extract(files: DataFrame) -> DataFrame:
    """Rows (see ROWS) of the .py files of files (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "long": pa.int64(), "array<string>": pa.list_(pa.string())}
        schema = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in ROWS.split(", "))])
        for b in batches:
            for p, c in zip(b.column(0), b.column(1), strict=True):
                if rows := parse(p.as_py(), c.as_py() or ""):
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return files.where(F.col("path").endswith(".py")).select("path", "content").mapInArrow(run, ROWS)


def _path(*parts: Column) -> Column:
    """All parts as one path with single slashes."""
    return F.concat(F.lit("/"), F.array_join(F.filter(F.split(F.concat_ws("/", *parts), "/"), lambda p: p != ""), "/"))


def _key(row: str, module: str = "module", name: str = "name") -> Column:
    return F.concat(F.lit(f"{row}_"), F.col(module), F.lit("_"), F.col(name))


def inclusions(rows: DataFrame, root: str | None = None) -> DataFrame:
    """owner, place, router, prefix: which router an app or router includes at that place. The target is looked up behind the
    file's imports (a submodule before a name of the module; the project's own name `root` in front may be missing in module
    names); in its module the variable's router, else the last one, else the least router of a module that ends so."""
    files = rows.select("module").distinct()
    head, var = F.substring_index("target", ".", 1), F.substring_index("target", ".", -1)
    inc = rows.where("row = 'inclusion'").select("module", F.col("at").alias("owner_var"), "target", "prefix", "place", head.alias("head"), var.alias("var"))
    imports = rows.where("row = 'import'").groupBy("module", F.col("name").alias("head")).agg(F.max_by(F.struct("target", "at", "method"), "place").alias("i"))
    inc = inc.join(imports, ["module", "head"], "left")
    bare = lambda c: F.when(c.startswith(f"{root}."), F.substring(c, len(root) + 2, 1 << 30)).when(c == root, "") if root else F.lit(None).cast("string")
    whole = F.when(F.col("i.method") == "module", F.col("i.target")).otherwise(F.concat_ws(".", F.when(F.col("i.at") != "", F.col("i.at")), "i.target"))
    base = F.when(F.col("i.method") == "module", F.col("i.target")).otherwise(F.col("i.at"))
    longer = F.when(F.size(F.split("target", r"\.")) > 1, F.expr("substring(target, 1, length(target) - length(var) - 1)"))
    tries = F.when(F.col("i").isNull(), F.array(longer, F.col("module"))).otherwise(F.array(whole, bare(whole), base, bare(base)))
    inc = inc.select("module", "owner_var", "place", "prefix", "var", base.alias("said"), F.posexplode(tries).alias("k", "try"))
    inc = inc.join(files.withColumnRenamed("module", "known"), F.col("try") == F.col("known"), "left")
    inc = inc.groupBy("module", "owner_var", "place", "prefix", "var", "said").agg(F.min(F.when(F.col("known").isNotNull(), F.struct("k", "try"))).alias("b")).withColumn("of", F.coalesce("b.try", "said"))
    routers = rows.where("row = 'router'").select(F.col("module").alias("rm"), F.col("name").alias("rn"), "place", _key("router").alias("router"))
    exact = routers.groupBy("rm", "rn").agg(F.max("router").alias("exact"))
    last = routers.groupBy(F.col("rm").alias("lm")).agg(F.max_by("router", "place").alias("last"))
    parts = F.split("rm", r"\.")
    ends = routers.select("router", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "."))).alias("suffix")).groupBy("suffix").agg(F.min("router").alias("ending"))
    inc = inc.join(exact, (F.col("of") == F.col("rm")) & (F.col("var") == F.col("rn")), "left").join(last, F.col("of") == F.col("lm"), "left").join(ends, F.col("of") == F.col("suffix"), "left")
    owners = rows.where("row in ('app', 'router')").groupBy(F.col("module").alias("om"), F.col("name").alias("on")).agg(F.min(F.struct("row", _key("app").alias("a"), _key("router").alias("r"))).alias("o"))
    inc = inc.join(owners, (F.col("module") == F.col("om")) & (F.col("owner_var") == F.col("on")))
    return inc.select(F.when(F.col("o.row") == "app", F.col("o.a")).otherwise(F.col("o.r")).alias("owner"), "place", F.coalesce("exact", "last", "ending").alias("router"), "prefix").where("router is not null")


def endpoints(rows: DataFrame, root: str | None = None) -> DataFrame:
    """endpoint, method, path, full_path, module, function, router of every endpoint.

    From each app, in the order of files and lines, then from each router that includes others, inclusions are followed depth first as
    they are written, each router once; paths are joined along the way (of the inclusion, then of the router). The endpoints of a
    router's module take its path; of several such walks the last counts. What no walk comes to keeps its own path.
    """
    routers = rows.where("row = 'router'").select(_key("router").alias("router"), F.col("module").alias("rm"), F.col("prefix").alias("own"), "path", "place")
    inc = written(inclusions(rows, root), "inclusions")
    steps = inc.join(routers.select("router", "own"), "router").select(F.col("owner").alias("src"), "place", F.col("router").alias("dst"), F.concat_ws("/", "prefix", "own").alias("label"))
    apps = rows.where("row = 'app'").select(F.lit(0).alias("kind"), "path", "place", _key("app").alias("root"), F.lit("").alias("start"))
    others = routers.join(inc.select("owner").distinct(), F.col("router") == F.col("owner")).select(F.lit(1).alias("kind"), "path", "place", F.col("router").alias("root"), F.col("own").alias("start"))
    roots = written(apps.unionByName(others), "roots")
    ways = first_ways(roots.select("root", F.col("root").alias("node")), steps).where(F.size("way") > 0)
    ways = ways.join(roots, "root").join(routers.select(F.col("router").alias("node"), "rm"), "node")
    order = F.struct("kind", "path", "place", "root", "way")
    taken = ways.groupBy("rm").agg(F.max_by(F.struct(F.concat_ws("/", "start", F.array_join("labels", "/")).alias("before"), F.col("node").alias("router")), order).alias("t"))
    e = rows.where("row = 'endpoint'").select(F.concat(F.lit("ep_"), "module", F.lit("_"), "name", F.lit("_"), "method").alias("endpoint"), "method", F.col("prefix").alias("path"), "module", F.col("name").alias("function"), _key("router", name="at").alias("own_router"))
    e = e.join(taken, F.col("module") == F.col("rm"), "left")
    return e.select("endpoint", "method", "path", F.when(F.col("t").isNull(), _path(F.col("path"))).otherwise(_path(F.col("t.before"), F.col("path"))).alias("full_path"), "module", "function", F.coalesce("t.router", "own_router").alias("router"))


def _dependencies(rows: DataFrame) -> DataFrame:
    kind = F.when(F.col("row") == "scheme", "sec_").otherwise("dep_")
    return rows.where("row in ('dependency', 'scheme')").select(F.concat(kind, "module", F.lit("_"), "name").alias("id"), "name", "module", "row", F.coalesce("names", F.array().cast("array<string>")).alias("names"))


def _behind(asks: DataFrame, rows: DataFrame) -> DataFrame:
    """asks (id, module, ask) with `asked`, the last part of the name; names of other files' aliases stand for what those ask."""
    by_module = rows.where("row = 'alias'").groupBy(F.col("module").alias("am"), F.col("name").alias("an")).agg(F.max_by("target", "place").alias("means"))
    anywhere = by_module.groupBy(F.col("an").alias("gn")).agg(F.min_by("means", "am").alias("somewhere"))
    imports = rows.where("row = 'import' and method = 'symbol'").groupBy(F.col("module").alias("im"), F.col("name").alias("il")).agg(F.max_by(F.struct("at", "target"), "place").alias("i"))
    other = F.col("ask").startswith("=")
    a = asks.withColumn("plain", F.when(other, F.substring("ask", 2, 1 << 30)).otherwise(F.col("ask")))
    a = a.join(imports, other & (F.col("module") == F.col("im")) & (F.col("plain") == F.col("il")), "left")
    a = a.join(by_module, (F.col("i.at") == F.col("am")) & (F.col("i.target") == F.col("an")), "left").join(anywhere, other & (F.col("plain") == F.col("gn")), "left")
    name = F.when(other, F.coalesce("means", "somewhere")).otherwise(F.col("plain"))
    return a.select("id", F.substring_index(name, ".", -1).alias("asked")).where("asked is not null").distinct()


def active_dependencies(rows: DataFrame) -> DataFrame:
    """id, name, module, row of the dependencies in use: those that endpoints and routers name, security schemes, functions of modules
    whose names say so, and all that these name in turn, by last names; several of one name are all in use."""
    d = _dependencies(rows)
    asks = rows.where("row in ('endpoint', 'router')").select(F.lit("").alias("id"), "module", F.explode("names").alias("ask"))
    by_place = d.where((F.col("row") == "scheme") | F.lower("module").rlike("|".join(USED_MODULES))).select(F.col("name").alias("id"))
    seeds = _behind(asks, rows).select(F.col("asked").alias("id")).unionByName(by_place)
    subs = _behind(d.select(F.col("name").alias("id"), "module", F.explode("names").alias("ask")), rows).select(F.col("id").alias("src"), F.col("asked").alias("dst"))
    used = G.reach(written(subs, "subs"), seeds).select(F.col("id").alias("used"))
    return d.join(used, F.col("name") == F.col("used")).select("id", "name", "module", "row").distinct()


def relations(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, groups): DEPENDS_ON from endpoints, SUB_DEPENDENCY among dependencies in use (never to themselves), REQUEST_BODY and
    RESPONSE_MODEL from endpoints to schemas, SCHEMA_FIELD from schemas to others that their fields name. A name that several have
    is ambiguous, with all of them as candidates; names that nothing has make no edge."""
    active = written(active_dependencies(rows), "active")
    schemas = rows.where("row = 'schema'").select(_key("schema").alias("id"), "name").distinct()
    ep = rows.where("row = 'endpoint'").withColumn("id", F.concat(F.lit("ep_"), "module", F.lit("_"), "name", F.lit("_"), "method"))
    subs = _dependencies(rows).join(active.select(F.col("id").alias("k")), F.col("id") == F.col("k"))
    named = (
        _behind(ep.select("id", "module", F.explode("names").alias("ask")), rows).withColumn("relation", F.lit("DEPENDS_ON"))
        .unionByName(_behind(subs.select("id", "module", F.explode("names").alias("ask")), rows).withColumn("relation", F.lit("SUB_DEPENDENCY")))
    )
    bodies = ep.select("id", F.explode("requests").alias("asked"), F.lit("REQUEST_BODY").alias("relation")).unionByName(ep.where("target is not null").select("id", F.col("target").alias("asked"), F.lit("RESPONSE_MODEL").alias("relation")))
    fields = rows.where("row = 'schema'").select(_key("schema").alias("id"), F.explode("names").alias("asked"), F.lit("SCHEMA_FIELD").alias("relation"))
    meant = named.join(active.select(F.col("id").alias("to"), "name"), F.col("asked") == F.col("name")).unionByName(bodies.unionByName(fields).join(schemas.select(F.col("id").alias("to"), "name"), F.col("asked") == F.col("name")))
    meant = meant.where("id <> to").groupBy(F.col("id").alias("from_id"), "relation", "asked").agg(F.sort_array(F.collect_set("to")).alias("to"))
    many = F.size("to") > 1
    edges = meant.select("from_id", F.col("to")[0].alias("to_id"), "relation", F.lit("framework_inferred").alias("confidence"), F.when(many, "ambiguous").otherwise("unique_name").alias("resolution"), F.slice("to", 2, 1 << 30).alias("candidates")).distinct()
    return intern(edges)
