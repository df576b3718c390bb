"""Periodic runs of words: texts are split at words too rare to repeat until nothing changes, and what is left is scanned by lags."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import SLICE_BYTES, flat_ranges, scan_rows, word_codes

#: Lags below this are scanned word by word, the others an octave at a time.
NARROW = 32

RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


def surviving_segments(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, shortest: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the segments in which every word may be part of a run.

    A run of period q within a segment is at least twice as long as q, so that each of its words occurs again q words
    away, at most half the segment. A word that occurs but once in its segment, or not within half of it, is in no run and
    splits the segment; so do, in turn, the words that became too rare in the parts. Parts shorter than `shortest` go.
    """
    done: list[tuple[np.ndarray, np.ndarray]] = []
    on = ends - starts >= shortest
    starts, ends = starts[on], ends[on]
    values = np.int64(codes.max(initial=0)) + 1
    while len(starts):
        n = ends - starts
        at, seg = flat_ranges(starts, n), np.repeat(np.arange(len(starts)), n)
        key = seg * values + codes[at]
        order = np.argsort(key, kind="stable")
        left, right = order[:-1], order[1:]
        near = (key[left] == key[right]) & (at[right] - at[left] <= n[seg[left]] // 2)
        fit = np.zeros(len(at), bool)
        fit[left[near]] = True
        fit[right[near]] = True
        whole = np.bincount(seg[~fit], minlength=len(n)) == 0
        done.append((starts[whole], ends[whole]))
        # stretches of fit words in the segments that lost some
        cut = np.zeros(len(at) + 1, np.int8)
        cut[:-1] = fit & ~whole[seg]
        first = np.cumsum(n) - n
        edge = np.flatnonzero(np.diff(cut, prepend=np.int8(0)) != 0)
        inner = first[1:][(cut[first[1:]] == 1) & (cut[first[1:] - 1] == 1)]  # two segments that touch
        begin = np.sort(np.concatenate([edge[cut[edge] == 1], inner]))
        end = np.sort(np.concatenate([edge[cut[edge] == 0], inner]))
        long_ = end - begin >= shortest
        begin, end = begin[long_], end[long_]
        starts, ends = at[begin], at[end - 1] + 1
    if not done:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    s, e = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(s)
    return s[order], e[order]


def _narrow(w: np.ndarray, longest: int, shortest: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Stretches that equal themselves q words on, for each lag q below NARROW."""
    found = []
    for q in range(1, min(NARROW - 1, longest // 2) + 1):
        same = np.zeros(len(w) - q + 2, np.int8)
        same[1:-1] = w[:-q] == w[q:]
        edge = np.flatnonzero(np.diff(same))
        s, e = edge[::2], edge[1::2]
        on = e - s >= max(shortest - q, q)
        found.append((s[on], e[on] + q, np.full(int(on.sum()), q)))
    return found


def _octave(names: list[np.ndarray], starts: np.ndarray, ends: np.ndarray, g: int, shortest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for the lags from g to 2g - 1, from names of the windows of 1, 2, 4 ... g/2 words at each place.

    Such a stretch has g words at least, hence one of the windows of h = g/2 words that begin every h words of a segment.
    Only lags at which one of those occurs again are looked at; neighbouring windows of one lag are one stretch, and
    its ends are less than h words beyond them, found by halving.
    """
    h = g // 2
    name, size = names[-1], len(names[0])
    anchor = flat_ranges(np.zeros(len(starts), np.int64), (ends - starts) // h) * h
    anchor += np.repeat(starts, (ends - starts) // h)
    order = np.argsort(name, kind="stable")
    keys = name[order].astype(np.int64) * size + order
    base = name[anchor].astype(np.int64) * size
    lo = np.searchsorted(keys, base + np.minimum(anchor + g, size))
    hi = np.searchsorted(keys, base + np.minimum(anchor + 2 * g, size))
    j = np.repeat(anchor, hi - lo)
    q = order[flat_ranges(lo, hi - lo)] - j
    by = np.lexsort((j, q))
    j, q = j[by], q[by]
    joins = (q[1:] == q[:-1]) & (j[1:] == j[:-1] + h)
    x, y, q = j[np.append(True, ~joins)[: len(j)]], j[np.append(~joins, True)[: len(j)]] + h, q[np.append(True, ~joins)[: len(j)]]
    for level in reversed(range(len(names) - 1)):
        step, value = 1 << level, names[level]
        last = len(value) - 1
        on = (y + q <= last) & (value[np.minimum(y, last)] == value[np.minimum(y + q, last)])
        y = y + step * on
        on = (x >= step) & (value[np.maximum(x - step, 0)] == value[np.clip(x - step + q, 0, last)]) & (x - step + q <= last)
        x = x - step * on
    on = y - x >= np.maximum(shortest - q, q)
    return x[on], (y + q)[on], q[on]


def _doubled(name: np.ndarray, step: int) -> np.ndarray:
    """Names of the windows of twice `step` words."""
    rank = name.astype(np.int64) - int(name.min())
    return np.unique(rank[: len(rank) - step] * (int(rank.max()) + 1) + rank[step:], return_inverse=True)[1].astype(np.int32)


def lag_scan(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, shortest: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of every run in the given segments (maximal, of length max(shortest, 2 * period)).

    All lags are covered. Windows are named by their words (pairs of names of halves), not hashed, so nothing has to be
    verified. Work is n log n for each octave of lags that segments are long enough for.
    """
    none = np.empty(0, np.int64)
    if not len(starts):
        return none, none, none
    n = ends - starts
    # segments one after another, each followed by a word that occurs nowhere else
    first = np.cumsum(n + 1) - (n + 1)
    w, back = np.empty(int((n + 1).sum()), np.int64), np.full(int((n + 1).sum()), -1, np.int64)
    at = flat_ranges(first, n)
    back[at] = flat_ranges(starts, n)
    w[at] = codes[back[at]]
    w[first + n] = -1 - np.arange(len(n))
    found = [(back[s], e - s, q) for s, e, q in _narrow(w, int(n.max()), shortest)]
    names, g = [w], NARROW
    while 2 * g <= int(n.max(initial=0)):
        keep = n >= 2 * g
        if not keep.all():  # segments in which no such lag fits go
            stay = np.repeat(keep, n + 1)
            names = [x[stay[: len(x)]] for x in names]
            back, n = back[stay], n[keep]
            first = np.cumsum(n + 1) - (n + 1)
        while 1 << (len(names) - 1) < g // 2:
            names.append(_doubled(names[-1], 1 << (len(names) - 1)))
        s, e, q = _octave(names, first, first + n, g, shortest)
        found.append((back[s], e - s, q))
        g *= 2
    s, length, q = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((q, length, s))
    s, length, q = s[order], length[order], q[order]
    new = np.append(True, (s[1:] != s[:-1]) | (length[1:] != length[:-1]))[: len(s)]
    return s[new], length[new], q[new]


def runs_of(codes: np.ndarray, sizes: np.ndarray, shortest: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of texts given as word codes, one text after another: start in `codes`, length and period, by start and length."""
    ends = np.cumsum(sizes)
    return lag_scan(codes, *surviving_segments(codes, ends - sizes, ends, shortest), shortest)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 12, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Finds and collapses the periodic runs of words in whole texts.

    Words are [^\\x20\\x09-\\x0D]+, numbered from 0. A run is a stretch with smallest period q and max(shortest, 2 * q)
    words or more that no neighbouring word extends. `collapsed` has the words that no run holds after its first q ones,
    joined by a space. Texts are worked on in slices of slice_bytes (or one longer text); a text needs some 16 bytes a word and
    four more for each octave of lags that its segments are long enough for.
    Returns id_col, n_words long, runs (array of start, length, period, by start and period) and collapsed. Null and empty
    texts have no words, no runs and an empty text; repeated rows are worked on each; other columns are left out.
    """
    src = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    schema = f"__id {src.schema['__id'].dataType.simpleString()}, n_words long, runs {RUN}, collapsed string"

    def run(batches):
        for (keys,), texts in scan_rows(batches, "__text", ["__id"], slice_bytes):
            doc, codes, own = word_codes(texts, lower=False)
            sizes = np.bincount(doc, minlength=len(texts))
            ends = np.cumsum(sizes)
            start, length, period = runs_of(codes, sizes, shortest)
            of = np.searchsorted(ends, start, side="right")
            by = np.lexsort((period, start))
            start, length, period, of = start[by], length[by], period[by], of[by]
            fields = [start - (ends - sizes)[of], length, period]
            items = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in fields], ["start", "length", "period"])
            bounds = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(texts)))))
            runs = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), items)
            # words after the first period of some run
            over = np.zeros(len(codes) + 1, np.int64)
            np.add.at(over, start + period, 1)
            np.add.at(over, start + length, -1)
            kept = np.cumsum(over[:-1]) == 0
            held = np.concatenate(([0], np.cumsum(np.bincount(doc[kept], minlength=len(texts)))))
            words = pa.array(own, pa.binary()).cast(pa.string()).take(pa.array(codes[kept].astype(np.int64)))
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array(held.astype(np.int32)), words), " ")
            yield pa.RecordBatch.from_arrays([keys, pa.array(sizes.astype(np.int64)), runs, text], ["__id", "n_words", "runs", "collapsed"])

    return src.mapInArrow(run, schema).withColumnRenamed("__id", id_col)


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and text_col, where every tenth text (by crc32 of its id, h) repeats itself from word a = h / 10 mod n on,
    with period 1 + (n - a) / (3 + h / 10 mod 8); its words are then parted by one space. Others are as they were."""
    h = F.crc32(F.col("__id").cast("string").cast("binary"))
    ws = F.expr("filter(split(__text, '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> '')")
    d = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    d = d.withColumn("__g", F.when((h % 10 == 0) & F.col("__text").isNotNull(), F.floor(h / 10)))
    d = d.withColumn("__ws", F.when(F.col("__g").isNotNull(), ws)).withColumn("__n", F.size("__ws").cast("long"))
    d = d.withColumn("__a", F.when(F.col("__n") > 0, F.expr("__g % __n"))).withColumn("__p", F.expr("1 + (__n - __a) div (3 + __g % 8)"))
    place = F.when(F.col("__n") > 0, F.sequence(F.lit(0).cast("long"), F.col("__n") - 1))
    again = F.array_join(F.transform(place, lambda i: F.get("__ws", F.when(i < F.col("__a"), i).otherwise(F.expr("__a") + (i - F.col("__a")) % F.col("__p")).cast("int"))), " ")
    return d.select(F.col("__id").alias(id_col), F.when(F.col("__n") > 0, again).otherwise(F.col("__text")).alias(text_col))


def run_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row a text of periodic_runs(): how many runs, its longest one (earliest, then of least period), and digests."""
    line = lambda r: F.concat_ws("", r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    found = found.withColumn("__best", best).withColumn("__length", -F.col("__best.less"))
    return found.select(
        id_col,
        F.size("runs").cast("long").alias("n_runs"),
        F.col("__best.start").alias("start"),
        F.col("__length").alias("length"),
        F.col("__best.period").alias("period"),
        F.expr("1000 * __length div __best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
