"""Helpers shared by the training-data operators: written tables, key ranges, words and batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import BROADCAST_ROWS, Scratch, shared_dir, written, written_alone

__all__ = ["BROADCAST_ROWS", "Scratch", "shared_dir", "written", "written_alone"]

#: Ranges whose bounds are literals in a plan; of more of them, these are the coarse ones and the others a table.
COARSE_RANGES = 2048
#: Bounds, of eight bytes, that are broadcast at most: 64 MB.
BROADCAST_BOUNDS = 8_000_000
#: Tasks that a table is dealt to by ranges at most; beyond, a task has several neighbouring ranges.
MOST_TASKS = 32_768

#: Bytes of text that a Python task works on at once.
SLICE_BYTES = 3 << 20


def small_side(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df, hinted for broadcast when its counted rows are few enough; else the join shuffles."""
    return F.broadcast(df) if rows <= limit else df


def scan_rows(batches, text_col: str, keys: list[str], slice_bytes: int = SLICE_BYTES):
    """Yields (key columns, texts), both Arrow arrays, in slices of bounded size (or of one longer text)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        text = batch.column(batch.schema.get_field_index(text_col))
        if not pa.types.is_large_string(text.type):
            if text.offset:  # the cast of a slice has offsets that start above 0, which pyarrow's ascii_lower reads wrongly
                text = text.take(pa.array(np.arange(len(text))))
            text = text.cast(pa.large_string())
        cols = [batch.column(batch.schema.get_field_index(k)) for k in keys]
        ends = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
        at = 0
        while at < len(text):
            to = int(np.searchsorted(ends, ends[at] + slice_bytes, side="right")) - 1
            to = min(max(to, at + 1), len(text))
            yield [c.slice(at, to - at) for c in cols], text.slice(at, to - at)
            at = to
        pa.default_memory_pool().release_unused()


def words_of(text: str | None) -> list[bytes]:
    """Runs of [^\\x20\\x09-\\x0D], in UTF-8. bytes.split() parts at exactly these six bytes."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_words_of(text: str | None) -> list[bytes]:
    """As words_of, with A-Z lower-cased; bytes.lower() leaves all else."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_codes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The words of all texts as words_of or lower_words_of have them, by Arrow: each one's text and code, and the
    distinct words. Nothing is remembered from one call to the next."""
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    own = coded.dictionary.cast(pa.large_binary()).to_pylist()
    if b"" in own:  # around white space at either end
        on = codes != own.index(b"")
        codes, doc = codes[on], doc[on]
    return doc, codes, own


def word_hashes(words: list[bytes], seed: int = 0) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words) if seed else map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def text_hashes(texts: pa.Array | list, lower: bool, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of every word, one text after another, and how many words each text has."""
    if isinstance(texts, list):
        texts = pa.array(texts, pa.large_string())
    doc, codes, own = word_codes(texts, lower)
    return word_hashes(own, seed)[codes] if len(codes) else np.empty(0, np.uint64), np.bincount(doc, minlength=len(texts))


_MUL = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive word hashes; shorter by k - 1."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for i in range(k):
            out = out * _MUL + h[i : i + n]
    return mix(out)


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal neighbours."""
    if not len(sorted_values):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))
    return starts, np.diff(np.append(starts, len(sorted_values)))


def flat_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of range(s, s + n) over all pairs."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def range_bounds(df: DataFrame, key: str, buckets: int, cells: int = 1024) -> list[int]:
    """Ascending lower bounds that cut an integer key into ranges of about equal row counts.

    Counts are exact and the outcome depends only on the rows: equal-width cells are counted in Spark, cells with more
    than their share are cut again, and neighbours are joined up to the share. The driver holds the cells' counts: no more
    than 64 new cells for each range asked for, a round. Nulls are left out (range_of puts them into range 0).
    """
    keys = df.select(F.col(key).cast("long").alias("k")).where("k is not null")
    n, lo, hi = keys.agg(F.count("*"), F.min("k"), F.max("k")).first()
    if not n or buckets <= 1 or lo == hi:
        return []
    share = max(1, -(-n // buckets))
    width = max(1, -(-(hi - lo + 1) // cells))
    bounds = list(range(lo, hi + 1, width))
    while True:
        counts = dict(keys.groupBy(range_of("k", bounds[1:]).alias("b")).count().collect())
        ends = bounds[1:] + [hi + 1]
        heavy = {i for i, c in counts.items() if c > share and ends[i] - bounds[i] > 1}
        if not heavy:
            break
        finer = []
        for i, (a, b) in enumerate(zip(bounds, ends, strict=True)):
            finer.extend(range(a, b, max(1, -(-(b - a) // 64))) if i in heavy else [a])
        bounds = finer
    out, held = [], 0
    for i, a in enumerate(bounds):
        c = counts.get(i, 0)
        if held and c and held + c > share:
            out.append(a)
            held = 0
        held += c
    return out


def long_array(values: list[int | None]) -> Column:
    """A literal array<bigint>, in one expression however long."""
    return F.expr("array(" + ", ".join("CAST(NULL AS BIGINT)" if v is None else f"CAST('{v}' AS BIGINT)" for v in values) + ")")


def range_of(key: str | Column, bounds: list[int]) -> Column:
    """The number of bounds at or below the key, by binary search in a literal array; null keys get 0."""
    k = F.col(key) if isinstance(key, str) else key
    if not bounds:
        return F.when(k.isNull(), F.lit(0)).otherwise(F.lit(0))
    arr = long_array(bounds)
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    found = F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, step: F.when((at + step <= len(bounds)) & (F.get(arr, at + step - 1) <= k.cast("long")), at + step).otherwise(at),
    )
    return F.when(k.isNull(), F.lit(0)).otherwise(found)


def bounds_table(df: DataFrame, key: str, buckets: int, coarse: list[int]) -> DataFrame:
    """__r (number of a coarse range), __first (number of its first range) and __bounds (ascending lower bounds of its
    other ranges), written: ranges of about equal row counts within each coarse one, cut by Spark.

    Keys are counted before they are sorted, each coarse range by itself; the rows of a key stay together. Only one row for
    each coarse range comes to one place.
    """
    keys = df.select(F.col(key).cast("long").alias("k")).where("k is not null")
    share = max(1, -(-df.count() // buckets))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("__r").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = keys.groupBy("k").agg(F.count("*").alias("n")).withColumn("__r", range_of("k", coarse)).select("__r", "k", F.floor(before / share).alias("cut"))
    least = cut.groupBy("__r", "cut").agg(F.min("k").alias("k")).groupBy("__r").agg(F.sort_array(F.collect_list("k")).alias("k"))
    earlier = Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    return written(least.select("__r", F.coalesce(F.sum(F.size("k")).over(earlier), F.lit(0)).alias("__first"), F.expr("slice(k, 2, size(k))").alias("__bounds")), "bounds")


def numbered_ranges(df: DataFrame, key: str, buckets: int, out: str, coarse: int = COARSE_RANGES) -> tuple[DataFrame, int]:
    """df with out (int), the number of its key's range, ascending with the key, and how many ranges there are.

    Up to `coarse` ranges are bounds in the plan. Of more, that many are, and the others come from a table, a row for each
    coarse range, which is broadcast up to BROADCAST_BOUNDS bounds; beyond, rows meet it by coarse range. Nulls are in the
    first one. Names of df other than __at and __ranges do not matter.
    """
    if buckets <= coarse:
        bounds = range_bounds(df, key, buckets)
        return df.withColumn(out, range_of(key, bounds).cast("int")), len(bounds) + 1
    first = range_bounds(df, key, coarse)
    table = bounds_table(df, key, buckets, first)
    total = table.agg(F.max(F.col("__first") + F.size("__bounds") + 1)).first()[0] or 1
    k, at = F.col(key).cast("long"), F.col("__ranges.__bounds")
    # the number of bounds at or below the key: halves of what is left, as many times as the longest list needs
    steps = int(table.agg(F.max(F.size("__bounds"))).first()[0] or 0).bit_length()
    found = F.aggregate(
        F.array(*[F.lit(1 << i) for i in reversed(range(steps))]).cast("array<int>"),
        F.lit(0),
        lambda n, step: F.when((n + step <= F.size(at)) & (F.get(at, n + step - 1) <= k), n + step).otherwise(n),
    )
    number = F.when(k.isNull(), F.lit(0)).otherwise(F.col("__ranges.__first") + found)
    lists = small_side(table.select(F.struct("*").alias("__ranges")), total, BROADCAST_BOUNDS)
    joined = df.withColumn("__at", range_of(key, first)).join(lists, F.col("__at") == F.col("__ranges.__r"), "left")
    return joined.withColumn(out, number.cast("int")).drop("__at", "__ranges"), int(total)


def dealt(df: DataFrame, number: str, numbers: int, most: int = MOST_TASKS) -> DataFrame:
    """df with a task for each number from 0 to numbers - 1, or for some neighbouring ones where there are more than `most`."""
    tasks = max(1, min(numbers, most))
    if tasks == numbers:
        return df.repartitionById(tasks, number)
    return df.repartitionById(tasks, F.floor(F.col(number).cast("long") * tasks / numbers).cast("int"))
