"""Packing of token sequences by a configuration linear program.

Only the histogram of piece lengths (at most `size` numbers) is solved on the driver. A configuration is a multiset of
lengths that fits into one sequence; the program covers the histogram by the least total of configurations. Every length
has a weight that falls with the share of its pieces covered so far; a knapsack dynamic program finds the
configurations of greatest weight, and they are used more. The same prices bound every cover from below (a length's
price over the greatest price of a configuration is a dual solution), so that the rounds end when the best average so
far is within `gap` of the best bound; at the latest when all lengths are covered ln(lengths) / eps times, where the
method's error is of the order of eps. The best fit's sequences are the first configurations, and prices in proportion
to length the first ones: where these close the gap, no weight has to move. The cover is rounded down with a carry, and
pieces left over go best fit into the room that is left. Spark then ranks the pieces of each length and looks up their
places.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.bpe import load
from strandline.llm.common import scan_rows, written

#: Bytes of text that a task encodes at once; a worker's memory is some 230 MB beside a multiple of it.
SLICE = 1 << 20
#: Fragments, and characters of them, that a worker remembers here: other stages' memory is in the same executors.
ENTRIES, CHARACTERS = 400_000, 16 << 20


Configuration = tuple[int, ...]


class Knapsack:
    """The best sets of lengths for every room, given prices: over the sums that the lengths can make, up to size."""

    def __init__(self, lengths: np.ndarray, size: int):
        made = np.zeros(size + 1, bool)
        made[0] = True
        for c in range(1, size + 1):
            made[c] = made[c - lengths[lengths <= c]].any()
        self.size, self.lengths, self.sums = size, lengths, np.flatnonzero(made)
        self.below = np.searchsorted(self.sums, np.arange(size + 1), side="right") - 1
        # of each sum: the lengths that may come last, and the sums before them
        self.steps = []
        for c in self.sums.tolist():
            last = np.flatnonzero(lengths <= c)
            last = last[made[c - lengths[last]]]
            self.steps.append((last, np.searchsorted(self.sums, c - lengths[last])))

    def solve(self, prices: np.ndarray) -> None:
        value = np.zeros(len(self.sums))
        self.last = np.full(len(self.sums), -1)
        for k, (last, before) in enumerate(self.steps[1:], 1):
            v = prices[last] + value[before]
            j = int(v.argmax())
            value[k], self.last[k] = v[j], last[j]
        # within a room: the best sum at or below it
        self.best = np.maximum.accumulate(value)
        self.at = np.maximum.accumulate(np.where(value >= self.best, np.arange(len(value)), 0))

    def within(self, room: np.ndarray) -> np.ndarray:
        return self.best[self.below[room]]

    def choice(self, room: int) -> list[int]:
        """Numbers of the lengths of the best configuration within the room."""
        k, out = int(self.at[self.below[room]]), []
        while self.last[k] >= 0:
            out.append(int(self.last[k]))
            k = int(self.steps[k][1][np.searchsorted(self.steps[k][0], out[-1])])
        return out


def cover(histogram: np.ndarray, size: int, eps: float | None = None, gap: float = 0.01) -> tuple[dict[Configuration, float], float]:
    """A fractional cover of the histogram by configurations (lengths, longest first), and a bound below all covers.

    eps: no round covers more than this share of a length's pieces (by default 0.1, and 0.2 for more than 64 lengths);
    4 ln(lengths) / eps ** 2 rounds are made unless the gap is closed before.
    """
    lengths = np.flatnonzero(histogram)
    if not len(lengths):
        return {}, 0.0
    eps = eps or (0.1 if len(lengths) <= 64 else 0.2)
    h = histogram[lengths].astype(float)
    first = {tuple(c): float(n) for c, n in best_fit(histogram, size)}
    total = sum(first.values())
    upper, lower = total, float((lengths * h).sum()) / size
    used, best = dict(first), (dict(first), 1.0)
    covered, mean, rounds = np.ones(len(lengths)), np.zeros(len(lengths)), 0
    bag = Knapsack(lengths, size) if upper > lower * (1 + gap) else None
    while upper > lower * (1 + gap) and rounds < 4 * math.log(len(lengths) + 1) / eps**2:
        prices = np.exp(-(covered - covered.min())) / h
        prices /= (h * prices).sum()
        mean, rounds = mean + prices, rounds + 1
        if rounds % 8 == 0:  # the mean of all rounds' prices is often the better bound
            bag.solve(mean)
            lower = max(lower, rounds / bag.within(np.array([size]))[0])
        bag.solve(prices)
        top = bag.within(np.array([size]))[0]
        lower = max(lower, 1 / top)
        # the best configuration with each length; all near the greatest price are used, no length by more than eps
        gained = np.zeros(len(lengths))
        with_each = prices + bag.within(size - lengths)
        for i in np.argsort(-with_each, kind="stable").tolist():
            if with_each[i] < (1 - eps) * top:
                break
            if gained[i] > 0.9 * eps:
                continue
            counts = Counter([i, *bag.choice(size - int(lengths[i]))])
            chosen = np.array(sorted(counts))
            copies = np.array([counts[k] for k in chosen.tolist()])
            amount = float(((eps - gained[chosen]) * h[chosen] / copies).min())
            if amount > 1e-9:
                gained[chosen] += amount * copies / h[chosen]
                c = tuple(np.repeat(lengths[chosen], copies)[::-1].tolist())
                used[c] = used.get(c, 0.0) + amount
                total += amount
        covered += gained
        if total / covered.min() < upper:
            upper = total / float(covered.min())
            best = (dict(used), float(covered.min()))
    return {c: x / best[1] for c, x in best[0].items()}, lower


def best_fit(counts: np.ndarray, size: int, opened: list[tuple[Configuration, int]] = ()) -> list[tuple[list[int], int]]:
    """Best fit, longest first, over counts: (lengths in a sequence, number of such sequences), those opened before among them."""
    rooms: dict[int, list[tuple[Configuration, int]]] = {}
    for content, n in opened:
        rooms.setdefault(size - sum(content), []).append((content, n))
    for length in range(size, 0, -1):
        k = int(counts[length])
        while k:
            room = min((r for r in rooms if r >= length and rooms[r]), default=None)
            if room is None:
                each = size // length
                n = max(1, k // each)
                take = min(k, each)
                rooms.setdefault(size - take * length, []).append(((length,) * take, n))
                k -= take * n
                continue
            content, n = rooms[room].pop()
            each = min(room // length, k)
            m = min(n, k // each)
            if m < n:
                rooms[room].append((content, n - m))
            rooms.setdefault(room - each * length, []).append((content + (length,) * each, m))
            k -= m * each
    return [(list(c), n) for groups in rooms.values() for c, n in groups if n]


def plan(histogram: np.ndarray, size: int, eps: float | None = None, gap: float = 0.01) -> list[tuple[list[int], int]]:
    """Sequences to build, as (lengths, number): the rounded cover, most used configurations first, and the rest best fit."""
    left = histogram.astype(np.int64).copy()
    opened, carry = [], 0.0
    amounts, _ = cover(histogram, size, eps, gap)
    for c, x in sorted(amounts.items(), key=lambda i: (-i[1], i[0])):
        own, copies = np.unique(c, return_counts=True)
        carry += x
        n = min(int(carry + 1e-6), int((left[own] // copies).min()))
        if n > 0:
            left[own] -= copies * n
            carry -= n
            opened.append((c, n))
    return best_fit(left, size, opened)


def places(planned: list[tuple[list[int], int]]) -> tuple[np.ndarray, ...]:
    """For each slot, ascending by (length, first rank): length, first rank, first sequence, offset."""
    rows, base, ranks = [], 0, {}
    for lengths, n in planned:
        at = 0
        for length in lengths:
            r = ranks.get(length, 0)
            rows.append((length, r, base, at))
            ranks[length] = r + n
            at += length
        base += n
    rows.sort()
    return tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else tuple(np.empty(0, np.int64) for _ in range(4))


def cut_pieces(docs: DataFrame, vocab: str, size: int, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2) -> DataFrame:
    """Token pieces of at most size: each text's ids and end_id; only longer texts are cut, and there all pieces but
    the first are full. Returns __id, piece, start, length, ids_crc32."""
    src = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    schema = f"__id {src.schema['__id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"

    def run(batches):
        bpe = load(vocab)
        bpe.most_entries, bpe.most_bytes = ENTRIES, CHARACTERS
        for (keys,), texts in scan_rows(batches, "__text", ["__id"], SLICE):
            ids, counts = bpe.encode_batch(texts)
            row, piece, start, length, crc = [], [], [], [], []
            at = 0
            for i, n in enumerate(counts.tolist()):
                own = np.append(ids[at : at + n], np.uint32(end_id)).astype("<u4")
                at += n
                a, b = 0, (n + 1) - (n // size) * size
                k = 0
                while a <= n:
                    row.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(own[a:b].tobytes()))
                    a, b, k = b, b + size, k + 1
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["__id", "piece", "start", "length", "ids_crc32"],
            )

    return src.mapInArrow(run, schema)


def assign(pieces: DataFrame, size: int, length_col: str = "length", order_cols: list[str] | None = None) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces with lengths from 1 to size.

    Pieces of one length are interchangeable, so that a place depends only on a piece's rank among them. Ranks are
    counted in buckets of each length, however common the length is, and the buckets' sums are added up before it.
    """
    order_cols = order_cols or [c for c in pieces.columns]
    n = pieces.count()
    buckets = max(1, min(1 << 16, n // 4000))
    keyed = pieces.withColumn("__b", F.pmod(F.xxhash64(*order_cols), F.lit(buckets)).cast("int"))
    sums = written(keyed.groupBy(length_col, "__b").agg(F.count("*").alias("__n")), "pack")
    histogram = np.zeros(size + 1, np.int64)
    for length, total in sums.groupBy(length_col).agg(F.sum("__n")).collect():
        histogram[length] = total
    slot_len, slot_rank, slot_seq, slot_at = places(plan(histogram, size))
    before = Window.partitionBy(length_col).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(length_col).alias("__l"), F.col("__b").alias("__c"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    ranked = (
        keyed.withColumn("__r", F.row_number().over(Window.partitionBy(length_col, "__b").orderBy(*order_cols)) - 1)
        .join(sums, (F.col(length_col) == F.col("__l")) & (F.col("__b") == F.col("__c")))
        .withColumn("__rank", F.col("__r") + F.col("__before"))
        .drop("__b", "__r", "__l", "__c", "__before")
    )
    keys = slot_len << np.int64(44) | slot_rank
    own = pieces.columns

    def run(batches):
        for b in batches:
            length = b.column(b.schema.get_field_index(length_col)).to_numpy(zero_copy_only=False)
            rank = b.column(b.schema.get_field_index("__rank")).to_numpy(zero_copy_only=False)
            slot = np.searchsorted(keys, length.astype(np.int64) << np.int64(44) | rank, side="right") - 1
            seq = slot_seq[slot] + rank - slot_rank[slot]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in own), pa.array(seq), pa.array(slot_at[slot])], [*own, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocab: str, size: int = 1024, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2) -> DataFrame:
    """Packs all documents into as few sequences of at most `size` tokens as the method finds.

    Returns id_col, piece, start, length, ids_crc32, sequence_id, offset: one row a piece. Null and empty texts are one
    piece with the end id alone; texts longer than a sequence are cut into full pieces after a shorter first one;
    repeated rows are packed each; an empty table gives an empty result; other columns are left out.
    """
    pieces = written(cut_pieces(docs, vocab, size, id_col, text_col, end_id), "pieces")
    return assign(pieces, size, "length", ["__id", "piece", "start", "ids_crc32"]).withColumnRenamed("__id", id_col)
