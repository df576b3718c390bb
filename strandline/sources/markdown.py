"""References in Markdown documents: links and code spans are read line by line, and resolved by joins.

Links go to paths of an inventory, with fallbacks; spans are build modules, paths or names of symbols.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.paths import dirname
from strandline.session import written

#: What counts as a document, a fence, a link, a definition, and what is tried behind a link. Fixed values.
SUFFIXES = (".md", ".mdx", ".markdown")
FENCE = re.compile(r" {0,3}(?P<mark>`{3,}|~{3,})(?P<info>.*)", re.DOTALL)
LINK = re.compile(r"!?\[[^\[\]]*\]\([ \t]*(<[^<>]*>|[^\s)]+)")
DEFINITION = re.compile(r" {0,3}\[(?!\^)([^\]\[]+)\]:[ \t]*(<[^<>]*>|\S+)")
FALLBACKS = ("", ".md", ".mdx", "/README.md", "/index.md", "/index.mdx")
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
NO_PATH = r"[\s*?<>{}\[\]$|]"
EXTENSION = r"\.[A-Za-z0-9]{1,5}$"
BUILD_MODULE = r"^:[A-Za-z0-9_.-]+(:[A-Za-z0-9_.-]+)*$"
IDENTIFIER = r"^[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)*$"
#: A run of backticks up to the next run of as many.
SPAN = re.compile(r"(?<!`)(`+)(?!`)(.*?)(?<!`)\1(?!`)")


def prose(text: str) -> Iterator[tuple[int, str]]:
    """Lines outside of fenced blocks, with their numbers. A fence ends with a bare one of its kind, no shorter."""
    opened = ""
    for number, line in enumerate(text.split("\n"), 1):
        line = line.removesuffix("\r")
        m = FENCE.fullmatch(line)
        if opened:
            if m and m["mark"].startswith(opened) and not m["info"].strip(" \t"):
                opened = ""
        elif m and not (m["mark"][0] == "`" and "`" in m["info"]):
            opened = m["mark"]
        else:
            yield number, line


def references_of(text: str) -> Iterator[tuple[int, int, str, str]]:
    """line, column, kind (link or span) and text of what a document refers to; spans of one backtick only, and no links inside of spans."""
    for number, line in prose(text):
        bare = line
        for m in SPAN.finditer(line):
            bare = bare[: m.start()] + " " * (m.end() - m.start()) + bare[m.end() :]
            if len(m[1]) == 1 and m[2]:
                yield number, m.start(), "span", m[2]
        if m := DEFINITION.match(bare):
            yield number, m.start(2), "link", m[2]
        for m in LINK.finditer(bare):
            yield number, m.start(), "link", m[1]


def extract(files: DataFrame) -> DataFrame:
    """doc, line, col, kind, text of all Markdown files (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, *r) for p, c in zip(b["path"], b["content"], strict=True) for r in references_of(c or "")]
            yield pd.DataFrame(rows, columns=["doc", "line", "col", "kind", "text"])

    wanted = F.lower("path").rlike("(" + "|".join(re.escape(s) for s in SUFFIXES) + ")$")
    return files.where(wanted).select("path", "content").mapInPandas(run, "doc string, line int, col int, kind string, text string")


def plain_path(base: Column, relative: Column) -> Column:
    """relative from base without empty, . and .. segments; null if it leaves the root."""
    segments = F.split(F.concat(base, F.lit("/"), relative), "/")
    up = lambda acc: F.when(F.size(acc) > 0, F.when(F.element_at(acc, -1) == "..", F.array_append(acc, F.lit(".."))).otherwise(F.slice(acc, F.lit(1), F.size(acc) - 1))).otherwise(F.array(F.lit("..")))
    folded = F.aggregate(segments, F.array().cast("array<string>"), lambda acc, s: F.when(s.isin("", "."), acc).when(s == "..", up(acc)).otherwise(F.array_append(acc, s)))
    return F.when(F.get(folded, F.lit(0)) == "..", F.lit(None)).otherwise(F.array_join(folded, "/"))


def decoded(target: Column) -> Column:
    """Percent escapes as characters; a plus and a percent sign without two digits stay."""
    kept = F.regexp_replace(F.replace(target, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(kept), target)


def with_directories(paths: DataFrame) -> DataFrame:
    """path, directory: all paths, and every directory above one; the root is the empty path."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    dirs = paths.select(F.explode(above).alias("path")).distinct().join(paths.select(F.col("path").alias("k")), F.col("path") == F.col("k"), "left_anti")
    return paths.select("path", F.lit(False).alias("directory")).distinct().unionByName(dirs.select("path", F.lit(True).alias("directory")))


def resolve_links(refs: DataFrame, inventory: DataFrame) -> DataFrame:
    """doc, line, col, text, status (resolved, dangling or site_route), target of the links that stay in the repository.

    inventory: path, directory. Fragments and queries go; a link tries its path as it is and with FALLBACKS behind it,
    the first that is there counts; links from the root that are not there may be routes of a site.
    """
    raw = F.regexp_replace(F.trim("text"), r"^<(.*)>$", "$1")
    inner = F.trim(raw)
    links = refs.where("kind = 'link'").withColumn("text", inner).where((F.col("text") != "") & ~F.col("text").rlike(SCHEME) & ~F.col("text").startswith("#"))
    links = links.withColumn("to", decoded(F.regexp_extract("text", r"^([^#?]*)", 1))).where("to <> ''")
    absolute = F.col("to").startswith("/")
    links = links.withColumn("full", F.when(absolute, plain_path(F.lit(""), F.col("to"))).otherwise(plain_path(dirname(F.col("doc")), F.col("to"))))
    links = links.withColumn("full", F.when(absolute & (F.col("full") == ""), F.lit(None)).otherwise(F.col("full")))
    tries = links.where("full is not null").select("full").distinct().select("full", F.posexplode(F.array(*[F.lit(x) for x in FALLBACKS])).alias("k", "ending")).where("full <> '' or k = 0")
    hit = tries.select("full", "k", F.concat("full", "ending").alias("try")).join(inventory.select("path"), F.col("try") == F.col("path"))
    best = written(hit.groupBy(F.col("full").alias("f")).agg(F.min_by("path", "k").alias("target")), "links")
    found = links.join(best, F.col("full") == F.col("f"), "left")
    status = F.when(F.col("target").isNotNull(), "resolved").when(absolute, "site_route").otherwise("dangling")
    return found.select("doc", "line", "col", "text", status.alias("status"), "target")


def resolve_spans(refs: DataFrame, inventory: DataFrame, symbols: DataFrame, modules: DataFrame, most: int = 10) -> DataFrame:
    """doc, line, col, notation (gradle_module, code_path or identifier), text, status, target, candidates, candidate_total.

    modules: module_path, id; symbols: id, label, symbol_path (a dotted name counts by its every ending). A span with a
    slash is a path if its first segment is there or it ends in an extension; one without if it is there. Paths are
    looked up beside the document, then from the root. What is none of these is left out. At most `most` candidates of
    an ambiguous name are listed; the total counts all.
    """
    s = written(refs.where("kind = 'span'").select("doc", "line", "col", "text"), "spans")
    build = F.col("text").rlike(BUILD_MODULE)
    gradle = s.where(build).join(modules.groupBy(F.col("module_path").alias("m")).agg(F.min("id").alias("target")), F.col("text") == F.col("m"), "left").select("doc", "line", "col", F.lit("gradle_module").alias("notation"), "text", F.when(F.col("target").isNull(), "dangling").otherwise("resolved").alias("status"), "target")
    may = s.where(~build & ~F.col("text").rlike(NO_PATH) & ~F.col("text").rlike(SCHEME))
    rel = F.rtrim(F.when(F.col("text").startswith("/"), F.ltrim(F.col("text"), F.lit("/"))).otherwise(F.regexp_replace("text", r"^\./", "")), F.lit("/"))
    bases = F.when(F.col("text").startswith("/"), F.array(F.lit(""))).otherwise(F.array_distinct(F.array(dirname(F.col("doc")), F.lit(""))))
    tried = may.withColumn("rel", rel).where("rel <> ''").select("doc", "line", "col", "text", "rel", F.posexplode(bases).alias("k", "base"))
    tried = tried.withColumns({"full": plain_path(F.col("base"), F.col("rel")), "first": plain_path(F.col("base"), F.substring_index("rel", "/", 1))})
    there = inventory.select(F.col("path").alias("p")).distinct()
    met = tried.join(there, F.col("full") == F.col("p"), "left").join(there.withColumnRenamed("p", "q"), F.col("first") == F.col("q"), "left")
    one = met.groupBy("doc", "line", "col", "text").agg(F.min_by("p", F.when(F.col("p").isNotNull(), F.col("k"))).alias("target"), F.max(F.col("q").isNotNull()).alias("near"))
    is_path = F.col("target").isNotNull() | (F.contains("text", F.lit("/")) & (F.col("near") | F.col("text").rlike(EXTENSION)))
    paths = written(one.where(is_path).select("doc", "line", "col", F.lit("code_path").alias("notation"), "text", F.when(F.col("target").isNull(), "dangling").otherwise("resolved").alias("status"), "target"), "paths")
    named = s.where(~build).join(paths.select("doc", "line", "col"), ["doc", "line", "col"], "left_anti").withColumn("name", F.regexp_replace("text", r"\(\)$", "")).where(F.col("name").rlike(IDENTIFIER))
    parts = F.split("symbol_path", r"\.")
    endings = symbols.where("symbol_path is not null").select("id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("n")).where("contains(n, '.')")
    have = endings.unionByName(symbols.where("label is not null and not contains(label, '.')").select("id", F.col("label").alias("n")))
    have = have.join(named.select("name").distinct(), F.col("n") == F.col("name"), "left_semi").groupBy("n").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    names = named.join(have, F.col("name") == F.col("n")).select("doc", "line", "col", F.lit("identifier").alias("notation"), "text", F.when(F.size("ids") == 1, "resolved").otherwise("ambiguous").alias("status"), F.when(F.size("ids") == 1, F.col("ids")[0]).alias("target"), F.when(F.size("ids") > 1, F.slice("ids", 1, most)).alias("candidates"), F.when(F.size("ids") > 1, F.size("ids")).alias("candidate_total"))
    return gradle.unionByName(paths).unionByName(names, allowMissingColumns=True)
