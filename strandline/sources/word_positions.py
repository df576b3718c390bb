"""Where words stand in files: an index of positions, and lookups in ranges by halving, without reading texts again."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"\w+")
#: Rows that a task hands on at once.
CHUNK = 50_000


def index(files: DataFrame) -> DataFrame:
    """path, word, offsets of files (path, content): the ascending offsets, in characters, at which each word (\\w+) begins.

    Null contents have no words; of a path that comes twice each content has rows of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("word", pa.string()), ("offsets", pa.list_(pa.int32()))])
        rows: list[dict] = []
        for b in batches:
            for p, c in zip(b.column(0), b.column(1), strict=True):
                at: dict[str, list[int]] = {}
                for m in _WORD.finditer(c.as_py() or ""):
                    at.setdefault(m[0], []).append(m.start())
                rows += [{"path": p.as_py(), "word": w, "offsets": o} for w, o in at.items()]
                if len(rows) >= CHUNK:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("path", "content").mapInArrow(run, "path string, word string, offsets array<int>")


def count_below(offsets: Column, x: Column) -> Column:
    """How many of the ascending offsets are less than x, in 31 steps that halve the range."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(31))])
    n = F.size(offsets)
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at.cast("long") + step <= n) & (F.get(offsets, at + step - 1) < x), at + step).otherwise(at))


def in_ranges(positions: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (path, word, start, end, ...) with n, how often the word stands wholly in the characters from start to before end, and
    first, its first offset there or null. Words that a file has not, and empty or null ranges, have n 0."""
    p = positions.select(F.col("path").alias("__p"), F.col("word").alias("__w"), "offsets")
    j = asked.join(p, (F.col("path") == F.col("__p")) & (F.col("word") == F.col("__w")), "left")
    low = count_below(F.col("offsets"), F.col("start"))
    high = count_below(F.col("offsets"), F.col("end") - F.length("word") + 1)
    j = j.withColumns({"__low": low, "__high": high}).withColumn("n", F.coalesce(F.greatest(F.col("__high") - F.col("__low"), F.lit(0)), F.lit(0)))
    return j.withColumn("first", F.when(F.col("n") > 0, F.get("offsets", F.col("__low")))).drop("__p", "__w", "offsets", "__low", "__high")
