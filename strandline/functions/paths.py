"""Paths: flags, categories, exclusions and globs."""

from __future__ import annotations

import fnmatch
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that mark directories and files. Fixed values.
GENERATED_NAME = r"(_pb2(_grpc)?\.pyi?|\.g\.(dart|kt)|\.freezed\.dart|_generated\.[a-z]+)$"
GENERATED_DIRS = ("migrations", "__generated__", "generated")
VENDORED_PARTS = ("vendor", "vendored", "third_party", "thirdparty", "node_modules", "site-packages")
TEST_PARTS = ("test", "tests", "__tests__", "spec")
TEST_NAME = r"^(test_.*\.py|.+_test\.py|.+\.(test|spec)\.(ts|tsx|js|jsx|mjs|cjs)|.+Test\.kt)$"


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/", 1)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def _any_of(parts: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(parts, F.array(*[F.lit(n) for n in names]))


def is_generated(path: Column) -> Column:
    lowered = F.split(F.lower(dirname(path)), "/")
    alembic = F.regexp_like(F.concat(F.lit("/"), F.lower(dirname(path)), F.lit("/")), F.lit("/(alembic|migrations)/versions/"))
    schema = F.array_contains(lowered, "schemas") & F.regexp_like(basename(path), F.lit(r"^[0-9]+\.json$"))
    return F.regexp_like(basename(path), F.lit(GENERATED_NAME)) | _any_of(lowered, GENERATED_DIRS) | alembic | schema


def is_vendored(path: Column) -> Column:
    return _any_of(F.split(F.lower(path), "/"), VENDORED_PARTS)


def is_test(path: Column) -> Column:
    return F.regexp_like(basename(path), F.lit(TEST_NAME)) | _any_of(F.split(F.lower(dirname(path)), "/"), TEST_PARTS)


def path_flags(path: Column) -> Column:
    named = ((is_generated(path), "generated"), (is_vendored(path), "vendored"), (is_test(path), "test"))
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in named]))


def category(path: Column) -> Column:
    return F.when(is_vendored(path), "vendored").when(is_generated(path), "generated").when(is_test(path), "test").otherwise("production")


def cost_ticks(category_: Column) -> Column:
    """Ten times the share of a node's cost that counts: none of vendored, a tenth of generated ones."""
    return F.when(category_ == "vendored", 0).when(category_ == "generated", 1).otherwise(10)


#: A glob's parts: whole segments of two stars, which take in their slash, single wildcards, and plain text.
_GLOB_PARTS = re.compile(r"(?P<deep>(?<![^/])(?:(?:\*\*/)+|\*\*\Z))|(?P<wild>[*?])|(?P<text>[^*?]+)")


def path_glob(glob: str) -> str:
    """A regular expression for a path glob: ** is any number of segments, * and ? stay within one."""

    def meaning(part: re.Match) -> str:
        if part["deep"]:
            return "(?:[^/]*/)*" if part["deep"].endswith("/") else ".*"
        return {"*": "[^/]*", "?": "[^/]"}[part["wild"]] if part["wild"] else re.escape(part["text"])

    return f"(?s)\\A(?:{_GLOB_PARTS.sub(meaning, glob)})(?![\\s\\S])"


def name_glob(glob: str) -> str:
    """A regular expression for a shell glob over a whole name."""
    return "(?s)\\A" + fnmatch.translate(glob).removeprefix("(?s:").replace(r")\z", "").replace(r")\Z", "") + r"(?![\s\S])"


@dataclass(frozen=True)
class ScanPolicy:
    """What a snapshot leaves out. Fixed default values."""

    max_file_bytes: int = 1048576
    marker_lines: int = 8
    lockfiles: tuple[str, ...] = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "Pipfile.lock")
    vendor_globs: tuple[str, ...] = ("vendor/**", "node_modules/**", "third_party/**")
    generated_globs: tuple[str, ...] = ("build/**", "dist/**", "*.min.js")
    markers: tuple[str, ...] = ("generated file", "do not edit")
    outputs: tuple[str, ...] = ()
    agent_docs: tuple[str, ...] = ()


def exclusion_reason(path: Column, content: Column, policy: ScanPolicy = ScanPolicy()) -> Column:
    """Why a file is left out (the first reason that holds), or null."""
    def any_glob(globs):
        return F.regexp_like(path, F.lit("|".join(name_glob(g) for g in globs)))

    output = F.lit(False)
    for o in policy.outputs:
        output = output | (path == o) | path.startswith(o.rstrip("/") + "/")
    head = F.array_join(F.slice(F.split(content, "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), 1, policy.marker_lines), "\n")
    found = F.when(output, "explicit_output").when(basename(path).isin(*policy.lockfiles), "lockfile")
    found = found.when(any_glob(policy.vendor_globs), "vendored").when(any_glob(policy.generated_globs), "generated_path")
    found = found.when(content.isNull(), "unreadable").when(F.octet_length(content) > policy.max_file_bytes, "too_large")
    found = found.when(F.instr(F.substring(content, 1, 8192), "\0") > 0, "binary").when(F.regexp_like(head, F.lit("(?i)" + "|".join(policy.markers))), "generated_marker")
    return found.when(basename(path).isin(*policy.agent_docs), "agent_document_disabled") if policy.agent_docs else found
