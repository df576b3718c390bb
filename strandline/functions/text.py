"""Text: sizes, spans, names and routes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def token_estimate(text: Column) -> Column:
    """At least 1: a token for each four characters that are no digits, and for each three of a run of ASCII digits."""
    others = F.length(F.regexp_replace(text, "[0-9]+", ""))
    digits = F.aggregate(F.regexp_extract_all(text, F.lit("([0-9]+)"), F.lit(1)), F.lit(0), lambda a, d: a + F.ceil(F.length(d) / 3).cast("int"))
    return F.greatest(F.lit(1), F.ceil(others / 4).cast("int") + digits).cast("long")


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def line_count(text: Column) -> Column:
    return F.when(F.length(text) == 0, 0).otherwise(newlines(text) + 1).cast("long")


def module_end_line(text: Column) -> Column:
    return F.greatest(F.lit(1), newlines(text) + F.when(text.endswith("\n") | (F.length(text) == 0), 0).otherwise(1)).cast("long")


def lines(text: Column) -> Column:
    """Lines at newlines only; the last one only if it is not empty."""
    parts = F.split(text, "\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def span_text(text: Column, start: int, end: int) -> Column:
    return F.array_join(F.slice(lines(text), start, end - start + 1), "\n")


def package_of_specifier(specifier: Column) -> Column:
    """The package of a module specifier: two segments of a scoped one, else the first."""
    return F.when(specifier.startswith("@"), F.substring_index(specifier, "/", 2)).otherwise(F.substring_index(specifier, "/", 1))


def squeeze_signature(signature: Column) -> Column:
    """Without white space and trailing separators, one kind of quote: what a formatter changes is gone."""
    bare = F.regexp_replace(signature, r"\s+", "")
    return F.translate(F.regexp_replace(bare, r"[,;]+([)\]}>])", "$1"), "'", '"')


def visibility(name: Column, prefix: Column) -> Column:
    """private for names with _ or # in front, or with a restricting word before them."""
    words = F.split(F.trim(F.regexp_replace(prefix, r"\s+", " ")), " ")
    restricted = F.arrays_overlap(words, F.array(*[F.lit(w) for w in ("private", "protected", "internal")]))
    return F.when(name.startswith("_") | name.startswith("#") | restricted, "private").otherwise("public")


def normalize_route(url: Column) -> Column:
    """The path of a route with placeholders as {}; null for empty input."""
    bare = F.regexp_extract(F.trim(url), r"^([^?#]*)", 1)
    bare = F.regexp_replace(bare, r"^(?i)https?://[^/]*", "")
    bare = F.regexp_replace(bare, r"^\$\{[^/]*", "")
    segments = F.filter(F.split(bare, "/"), lambda s: s != "")
    named = F.transform(segments, lambda s: F.when((s.startswith("{") & s.endswith("}")) | s.startswith(":") | s.contains("${"), "{}").otherwise(s))
    return F.when(url.isNull() | (url == ""), F.lit(None)).otherwise(F.concat(F.lit("/"), F.array_join(named, "/")))


def normalize_table(name: Column) -> Column:
    """The last part of a dotted table name, in lower case and without quotes of one kind around it; null if there is
    none. A part is quoted, or a run of characters that are neither blank nor a dot."""
    parts = F.regexp_extract_all(F.trim(name), F.lit(r'(?U)("[^"]*"|`[^`]*`|\[[^\]]*\]|[^\s.]+)'), F.lit(1))
    last = F.when(F.size(parts) > 0, F.element_at(parts, -1))
    bare = F.regexp_replace(last, r'(?s)^"(.*)"$|^`(.*)`$|^\[(.*)\]$', "$1$2$3")
    return F.nullif(F.lower(F.trim(bare)), F.lit(""))


def module_name(path: Column) -> Column:
    """Dotted module of a Python path; a package's __init__ is the package, the root's is __init__."""
    dotted = F.translate(F.regexp_replace(path, r"\.py$", ""), "/", ".")
    return F.when(dotted == "__init__", dotted).otherwise(F.regexp_replace(dotted, r"\.__init__$", ""))
