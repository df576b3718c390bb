"""Build files: modules and what they declare to depend on (Gradle, npm workspaces), and path aliases of tsconfig files."""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS = "path string, dir string, row string, name string, value string, configuration string, line int, place long"
GRADLE = ("settings.gradle.kts", "settings.gradle", "build.gradle.kts", "build.gradle")
#: Calls around a project that do not name the configuration, and the dependency fields of package.json. Fixed values.
WRAPPERS = ("platform", "enforcedPlatform", "testFixtures")
FIELDS = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")

_CODE = re.compile(r"""("(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)|//[^\n]*|/\*.*?(?:\*/|\Z)""", re.DOTALL)
_JSON = re.compile(r'("(?:\\.|[^"\\])*"?)|//[^\n]*|/\*.*?(?:\*/|\Z)', re.DOTALL)
_COMMA = re.compile(r'("(?:\\.|[^"\\])*"?)|,(?=\s*[}\]])', re.DOTALL)
_TEXT = r"""["']([^"'\r\n]*)["']"""
_INCLUDE = re.compile(rf"""(?<![\w.])include\s*\(?\s*((?:["'][^"'\r\n]*["']\s*,?\s*)+)""")
_PROJECT = re.compile(rf"(?<![\w.])project\s*\(\s*(?:path\s*[:=]\s*)?{_TEXT}|(?<![\w.])projects((?:\.[A-Za-z_]\w*)+)")


def without_comments(text: str) -> str:
    """Comments of a build script as blanks, so that offsets and lines stay; those in texts are none."""
    return _CODE.sub(lambda m: m[1] if m[1] is not None else re.sub(r"[^\n]", " ", m[0]), text)


def tolerant_json(text: str):
    """JSON with comments and commas at the end of lists and objects; ValueError for all else."""
    plain = _JSON.sub(lambda m: m[1] if m[1] is not None else " ", text.lstrip("\ufeff"))
    try:
        return json.loads(_COMMA.sub(lambda m: m[1] or "", plain))
    except RecursionError as deep:
        raise ValueError("nested too deeply") from deep


def _around(text: str) -> Iterator[tuple[int, list[tuple[str, int]]]]:
    """Each place at which a project is named, with the brackets that are open there."""
    named = {m.start(): m for m in _PROJECT.finditer(text)}
    open_: list[tuple[str, int]] = []
    for m in re.finditer(r"[(){}]", text):
        for at in sorted(k for k in named if k <= m.start()):
            yield at, list(open_)
            del named[at]
        if m[0] in "({":
            open_.append((m[0], m.start()))
        elif open_:
            open_.pop()
    for at in sorted(named):
        yield at, list(open_)


def _configuration(text: str, at: int, open_: list[tuple[str, int]]) -> str | None:
    """The call that encloses a place, wrappers left out; in a block, the word before it on its line."""
    for bracket, where in reversed(open_):
        if bracket == "{":
            break
        word = re.search(r"([A-Za-z_]\w*)\s*$", text[:where])
        if word is None:
            return None
        if word[1] not in WRAPPERS:
            return word[1]
        at = word.start(1)
    word = re.search(r"([A-Za-z_]\w*)\s*\(?\s*$", text[text.rfind("\n", 0, at) + 1 : at])
    return word[1] if word and word[1] not in WRAPPERS else None


def parse(path: str, content: str) -> list[dict]:
    folder, _, name = path.rpartition("/")
    own = {"path": path, "dir": folder}
    if name in GRADLE:
        text = without_comments(content)
        if name.startswith("settings"):
            raws = [r for m in _INCLUDE.finditer(text) for r in re.findall(_TEXT, m[1])]
            return [own | {"row": "settings", "name": name}] + [own | {"row": "include", "name": name, "value": ":" + r.strip().strip(":")} for r in raws if r.strip().strip(":")]
        rows = [own | {"row": "build", "name": name}]
        for at, open_ in _around(text):
            m = _PROJECT.match(text, at)
            path_of = None if m[1] is None else m[1].strip().strip(":")
            if path_of != "" and (configuration := _configuration(text, at, open_)):
                rows.append(own | {"row": "uses", "name": f":{path_of}" if m[2] is None else None, "value": m[2] and m[2][1:], "configuration": configuration, "line": text.count("\n", 0, at) + 1, "place": at})
        return rows
    if name == "package.json":
        try:
            data = json.loads(content)
        except (ValueError, RecursionError):
            data = None
        data = data if isinstance(data, dict) else None
        rows = [own | {"row": "package", "name": data["name"] if data and isinstance(data.get("name"), str) and data["name"] else None}]
        spaces = (data or {}).get("workspaces")
        spaces = spaces.get("packages") if isinstance(spaces, dict) else spaces
        if isinstance(spaces, list) and all(isinstance(s, str) for s in spaces):
            rows += [own | {"row": "workspaces"}] + [own | {"row": "workspace", "value": s.strip().removeprefix("./").rstrip("/"), "place": i} for i, s in enumerate(spaces)]
        for field in FIELDS:
            declared = (data or {}).get(field)
            for i, key in enumerate(declared if isinstance(declared, dict) else ()):
                start = max(content.find(json.dumps(field)), 0)
                found = content.find(json.dumps(key), start)
                rows.append(own | {"row": "needs", "value": key, "configuration": field, "line": content.count("\n", 0, max(found, 0)) + 1, "place": i})
        return rows
    if re.fullmatch(r"tsconfig.*\.json", name):
        try:
            data = tolerant_json(content)
            options = data.get("compilerOptions", {})
            paths, base = options.get("paths", {}), options.get("baseUrl")
            if not isinstance(paths, dict) or not isinstance(base, (str, type(None))):
                raise ValueError("paths or baseUrl")
        except (ValueError, AttributeError) as wrong:
            return [own | {"row": "failed", "value": str(wrong)}]
        rows = [own | {"row": "alias", "name": "prefix" if key.endswith("*") else "exact", "value": key.removesuffix("*"), "place": i} for i, key in enumerate(paths) if key != "*"]
        if base is not None:
            root = posixpath.normpath(base)
            rows.append(own | {"row": "base", "value": "" if root == "." else root})
        return rows
    return []


def extract(files: DataFrame) -> DataFrame:
    """Rows (see ROWS) of the Gradle scripts, package.json and tsconfig files of files (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
        schema = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in ROWS.split(", "))])
        for b in batches:
            for p, c in zip(b.column(0), b.column(1), strict=True):
                if rows := parse(p.as_py(), c.as_py() or ""):
                    yield pa.RecordBatch.from_pylist(rows, schema)

    last = F.substring_index("path", "/", -1)
    return files.where(last.isin(*GRADLE, "package.json") | last.rlike(r"^tsconfig.*\.json$")).select("path", "content").mapInArrow(run, ROWS)


def gradle_modules(rows: DataFrame) -> DataFrame:
    """module, dir, file: the root and what the settings file includes; without one, each folder with a build script. file is the
    module's build script, the Kotlin one first, null if it has none."""
    settings = rows.where("dir = '' and row in ('settings', 'include')").withColumn("kts", F.col("name").endswith(".kts"))
    chosen = settings.agg(F.max("kts").alias("best"))
    root = settings.where("row = 'settings'").select(F.lit(":").alias("module")).distinct()
    included = settings.where("row = 'include'").join(F.broadcast(chosen), F.col("kts") == F.col("best")).select(F.col("value").alias("module"))
    listed = root.unionByName(included).distinct().select("module", F.translate(F.trim(F.regexp_replace("module", "^:+|:+$", "")), ":", "/").alias("dir"))
    found = rows.where("row = 'build'").select(F.when(F.col("dir") == "", ":").otherwise(F.concat(F.lit(":"), F.translate("dir", "/", ":"))).alias("module"), "dir").distinct()
    bare = found.join(F.broadcast(chosen.where("best is not null").select(F.lit(True).alias("has"))), F.lit(True), "left_anti")
    builds = rows.where("row = 'build'").groupBy(F.col("dir").alias("bd")).agg(F.max_by("path", "name").alias("file"))
    return listed.unionByName(bare).join(builds, F.col("dir") == F.col("bd"), "left").select("module", "dir", "file")


def _camel(path: Column) -> Column:
    """The accessor of a module: its segments with what follows - or _ in upper case, joined by points."""
    upper = lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30)))
    return F.array_join(F.transform(F.split(F.regexp_replace(path, "^:+|:+$", ""), ":"), lambda s: F.array_join(F.transform(F.split(s, "[-_]"), upper), "")), ".")


def _declared(df: DataFrame, exact: Column) -> DataFrame:
    hit = F.when(exact, "exact").otherwise("unresolved")
    return df.select("from_id", "to_id", F.lit("DECLARES_DEPENDENCY").alias("relation"), F.lit("static_certain").alias("confidence"), hit.alias("resolution"), "configuration", "file", "line")


def gradle_relations(rows: DataFrame) -> DataFrame:
    """from_id, to_id, relation, confidence, resolution, configuration, file, line: a row for each pair of modules and configuration, with
    its first place. What is named but not a module is unresolved; a module does not depend on itself."""
    m = gradle_modules(rows)
    accessors = m.where("module <> ':'").groupBy(_camel(F.col("module")).alias("accessor")).agg(F.max("module").alias("meant"))
    uses = rows.where("row = 'uses'").select(F.col("path").alias("file"), "name", "value", "configuration", "line", "place")
    uses = uses.join(m.select("module", F.col("file").alias("f")), F.col("file") == F.col("f")).join(accessors, F.col("value") == F.col("accessor"), "left")
    uses = uses.withColumn("target", F.coalesce("name", "meant", F.concat(F.lit("projects."), "value"))).where("target <> module")
    first = uses.groupBy("module", "target", "configuration", "file").agg(F.min_by("line", "place").alias("line"))
    first = first.join(m.select(F.col("module").alias("k")).distinct(), F.col("target") == F.col("k"), "left")
    ident = lambda c: F.concat(F.lit("build-module:gradle:"), c)
    return _declared(first.withColumns({"from_id": ident(F.col("module")), "to_id": ident(F.col("target"))}), F.col("k").isNotNull())


def _folders(globs: list[str]) -> str | None:
    """One expression for folders: ** stands for any number of segments, also none, * for a part of one."""
    def one(glob: str) -> str:
        out = ""
        for s in glob.split("/"):
            out += "(?:/[^/]*)*" if s == "**" else "/" + re.escape(s).replace(r"\*", "[^/]*")
        return out
    return "^(?:" + "|".join(map(one, globs)) + ")$" if globs else None


def npm_modules(rows: DataFrame) -> DataFrame:
    """id, dir, file of the root package and the packages in its workspaces: the folders that a pattern names and none with ! in front.
    The least folder of a name has it as id, others their folder. Nothing without workspaces; their patterns, from one file, come to the driver."""
    said = rows.where("dir = '' and row in ('workspaces', 'workspace')").orderBy("place").select("row", "value").collect()
    patterns = [r.value for r in said if r.row == "workspace" and r.value]
    wanted = _folders([p for p in patterns if not p.startswith("!")])
    barred = _folders([p[1:].lstrip("/").removeprefix("./") for p in patterns if p.startswith("!") and p[1:]])
    at = F.concat(F.lit("/"), "dir")
    inside = (F.col("dir") == "") | ((at.rlike(wanted) if wanted else F.lit(False)) & (~at.rlike(barred) if barred else F.lit(True)))
    packages = rows.where("row = 'package'").where(inside & F.lit(bool(said))).select("name", "dir", F.col("path").alias("file"))
    first = packages.where("name is not null").groupBy(F.col("name").alias("n")).agg(F.min("dir").alias("owner"))
    packages = packages.join(first, (F.col("name") == F.col("n")) & (F.col("dir") == F.col("owner")), "left")
    return packages.select(F.when(F.col("n").isNotNull(), F.col("n")).when(F.col("dir") == "", "(root)").otherwise(F.col("dir")).alias("id"), F.col("n").isNotNull().alias("claimed"), "dir", "file")


def npm_relations(rows: DataFrame) -> DataFrame:
    """As gradle_relations, between packages of the workspaces; other packages make no row."""
    m = npm_modules(rows)
    needs = rows.where("row = 'needs'").select(F.col("path").alias("p"), "value", "configuration", "line", "place")
    needs = m.select(F.col("id").alias("module"), "file").join(needs, F.col("file") == F.col("p")).join(m.where("claimed").select(F.col("id").alias("target")), F.col("value") == F.col("target")).where("module <> target")
    first = needs.groupBy("module", "target", "configuration", "file").agg(F.min_by("line", "place").alias("line"))
    ident = lambda c: F.concat(F.lit("build-module:npm:"), c)
    return _declared(first.withColumns({"from_id": ident(F.col("module")), "to_id": ident(F.col("target"))}), F.lit(True))


def aliases(rows: DataFrame, sources: DataFrame, tsconfig: str = "tsconfig.json") -> DataFrame:
    """kind (exact, prefix, root), key: what a specifier must be, begin with or have as its first segment to be the project's own, by one
    tsconfig file and, for its baseUrl, the paths of sources (path)."""
    own = rows.where(F.col("path") == tsconfig)
    base = own.where("row = 'base'").select(F.when(F.col("value") == "", "").otherwise(F.concat("value", F.lit("/"))).alias("under"))
    below = sources.join(F.broadcast(base), F.col("path").startswith(F.col("under"))).select(F.expr("substring(path, length(under) + 1)").alias("rest"))
    bare = F.regexp_replace("rest", r"(?<=[^.])\.[^.]*$", "")
    roots = below.select(F.lit("root").alias("kind"), F.when(F.contains("rest", F.lit("/")), F.substring_index("rest", "/", 1)).otherwise(bare).alias("key"))
    return own.where("row = 'alias'").select(F.col("name").alias("kind"), F.col("value").alias("key")).unionByName(roots).distinct()


def with_alias(imports: DataFrame, known: DataFrame, specifier: str = "specifier") -> DataFrame:
    """imports with `alias`, the key that makes the specifier the project's own (an exact one, else the longest prefix, else its first
    segment), or null. A specifier meets keys by equality only: its beginnings of all lengths are looked up."""
    asked = imports.select(F.col(specifier).alias("__s")).where("__s is not null").distinct()
    heads = asked.select("__s", F.explode(F.sequence(F.lit(0), F.length("__s"))).alias("n")).select("__s", "n", F.substring("__s", F.lit(1), F.col("n")).alias("key"), F.lit("prefix").alias("kind"))
    exact = asked.select("__s", F.length("__s").alias("n"), F.col("__s").alias("key"), F.lit("exact").alias("kind"))
    root = asked.select("__s", F.lit(-1).alias("n"), F.substring_index("__s", "/", 1).alias("key"), F.lit("root").alias("kind"))
    hit = heads.unionByName(exact).unionByName(root).join(known, ["kind", "key"]).groupBy("__s").agg(F.max_by("key", F.struct((F.col("kind") == "exact").alias("e"), "n")).alias("alias"))
    return imports.join(hit, F.col(specifier) == F.col("__s"), "left").drop("__s")
