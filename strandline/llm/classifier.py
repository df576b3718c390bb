"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader, sparse dot products."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import SLICE_BYTES, flat_ranges, mix, runs, scan_rows, written

_MUL = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.arange(256)
#: 0 for white space, 1 for letters, digits and all beyond ASCII, 2 for other marks.
_KIND = np.where((_BYTE == 32) | ((_BYTE >= 9) & (_BYTE <= 13)), 0, np.where((_BYTE >= 128) | ((_BYTE >= 48) & (_BYTE <= 57)) | (((_BYTE | 32) >= 97) & ((_BYTE | 32) <= 122)), 1, 2)).astype(np.int8)


@dataclass(frozen=True)
class Settings:
    """bits: of the hashed features; orders: lengths of n-grams; max_rows: labelled documents to learn from at most;
    epochs: passes over them; alpha, beta: learning rate of each weight; l1, l2: what pulls weights to 0."""

    bits: int = 18
    orders: tuple[int, ...] = (1, 2)
    max_rows: int = 10_000
    epochs: int = 4
    alpha: float = 5.0
    beta: float = 1.0
    l1: float = 0.1
    l2: float = 0.0

    @property
    def width(self) -> int:
        """Weights: the features and, last, a constant one."""
        return (1 << self.bits) + 1


def word_spans(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words in texts that end at `ends`: runs of letters and digits, or of other marks."""
    kind = _KIND[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0] = edge[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
    edge[ends] = True
    at = np.flatnonzero(edge)
    on = kind[at[:-1]] != 0
    return at[:-1][on], at[1:][on]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span: a sum over its bytes, each times a power of its place."""
    n = ends - starts
    if not len(n):
        return np.empty(0, np.uint64)
    first = np.cumsum(n) - n
    at = flat_ranges(starts, n)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(n.max()), _MUL))
        value = (data[at].astype(np.uint64) + np.uint64(1)) * power[np.arange(len(at)) - np.repeat(first, n)]
        return mix(np.add.reduceat(value, first) + n.astype(np.uint64))


def features(texts: pa.Array, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows, one a text: sizes, features ascending within a row, and values log(1 + count) over the row's length.

    Counts are of the n-grams of words (case kept) whose hash is the feature. Texts without words have empty rows.
    """
    texts = texts.fill_null("") if texts.null_count else texts
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data, ends = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]], at[1:] - at[0]
    if not len(data):
        return np.zeros(len(texts), np.int64), np.empty(0, np.int64), np.empty(0)
    start, end = word_spans(data, ends)
    doc, h = np.searchsorted(ends, start, side="right"), span_hashes(data, start, end)
    mask, keys = np.uint64((1 << s.bits) - 1), []
    for order in s.orders:
        with np.errstate(over="ignore"):
            gram = np.zeros(max(0, len(h) - order + 1), np.uint64)
            for i in range(order):
                gram = gram * _MUL + h[i : i + len(gram)]
            gram = mix(gram + np.uint64(order))
        on = doc[: len(gram)] == doc[order - 1 :][: len(gram)]
        keys.append((doc[: len(gram)][on] << s.bits) | (gram[on] & mask).astype(np.int64))
    key = np.sort(np.concatenate(keys))
    first, count = runs(key)
    key, value = key[first], np.log1p(count)
    sizes = np.bincount(key >> s.bits, minlength=len(texts))
    norm = np.sqrt(np.bincount(key >> s.bits, weights=value * value, minlength=len(texts)))
    return sizes, key & int(mask), value / np.repeat(norm, sizes)


class Model:
    """Weights of follow-the-regularised-leader with a rate for each: z and n are its sums, the last place is the constant."""

    def __init__(self, s: Settings, z: np.ndarray | None = None, n: np.ndarray | None = None):
        self.s = s
        self.z = np.zeros(s.width) if z is None else z
        self.n = np.zeros(s.width) if n is None else n

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n, s = self.z[at], self.n[at], self.s
        pull = np.full(self.s.width, s.l1)
        pull[-1] = 0.0
        return np.where(np.abs(z) <= pull[at], 0.0, -(z - np.sign(z) * pull[at]) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))

    def learn(self, idx: np.ndarray, value: np.ndarray, label: int) -> None:
        s, at, x = self.s, np.append(idx, self.s.width - 1), np.append(value, 1.0)
        z, n = self.z[at], self.n[at]
        pull = np.full(len(at), s.l1)
        pull[-1] = 0.0
        w = np.where(np.abs(z) <= pull, 0.0, -(z - np.sign(z) * pull) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))
        g = (1.0 / (1.0 + math.exp(-max(-35.0, min(35.0, float(w @ x))))) - label) * x
        self.z[at] = z + g - (np.sqrt(n + g * g) - np.sqrt(n)) / s.alpha * w
        self.n[at] = n + g * g


def learning(id_col: str | Column, folds: int = 3, held: int = 1) -> Column:
    """Whether a row may be learned from: crc32 of its id as text, modulo folds, is not `held`. Null for null ids."""
    return F.crc32((F.col(id_col) if isinstance(id_col, str) else id_col).cast("string").cast("binary")) % folds != held


def examples(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, s: Settings, slice_bytes: int) -> DataFrame:
    """order, label, idx, value of at most s.max_rows labelled documents, those whose ids have the least hashes."""
    one = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).where(learning("__id") & F.col("__y").isin(0, 1))
    one = one.groupBy("__id").agg(F.min("__y").alias("label"), F.max("__y").alias("__other")).where("label = __other")
    one = one.select("__id", "label", F.xxhash64(F.col("__id").cast("string")).alias("order")).orderBy("order", "__id").limit(s.max_rows)
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")).join(F.broadcast(one), "__id")
    texts = texts.groupBy("__id", "order", "label").agg(F.min(F.coalesce("__text", F.lit(""))).alias("__text"))

    def run(batches):
        for (order, label), rows in scan_rows(batches, "__text", ["order", "label"], slice_bytes):
            sizes, idx, value = features(rows, s)
            ends = np.cumsum(sizes)
            cut = lambda x, kind: pa.array([x[a:b].astype(kind).tobytes() for a, b in zip(ends - sizes, ends, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([order, label, cut(idx, np.int32), cut(value, np.float32)], ["order", "label", "idx", "value"])

    return texts.select("order", "label", "__text").mapInArrow(run, "order long, label int, idx binary, value binary")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", settings: Settings = Settings(), slice_bytes: int = SLICE_BYTES) -> Model:  # noqa: B008
    """A model of the labels of documents that may be learned from (see learning()).

    At most settings.max_rows documents are used (those with the least hashes of their ids): each epoch is one task
    that streams their rows in the order of these hashes, so that its memory is the weights and a batch, whatever the number
    and length of texts. Ids with both labels are left out; of several texts of an id the least counts.
    The result depends on the rows only, not on how they are dealt.
    """
    s = settings
    rows = written(examples(docs, labels, id_col, text_col, label_col, s, slice_bytes), "examples")
    model = Model(s)
    for _ in range(s.epochs):
        z, n = model.z, model.n

        def run(batches, z=z, n=n):
            m = Model(s, z.copy(), n.copy())
            for b in batches:
                for label, idx, value in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                    m.learn(np.frombuffer(idx.as_buffer(), np.int32), np.frombuffer(value.as_buffer(), np.float32).astype(float), label)
            yield pa.RecordBatch.from_arrays([pa.array([m.z.tobytes()], pa.binary()), pa.array([m.n.tobytes()], pa.binary())], ["z", "n"])

        got = rows.repartition(1).sortWithinPartitions("order", "label", "idx", "value").select("label", "idx", "value").mapInArrow(run, "z binary, n binary").collect()
        if got:
            model = Model(s, np.frombuffer(bytes(got[0].z)), np.frombuffer(bytes(got[0].n)))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """id_col and score, from 0 to 1, of every row: the sparse dot product of its features with the weights.

    Whole texts count; null and empty texts get the constant's score; other columns are left out.
    """
    s, w = model.s, model.weights()
    src = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    sent = docs.sparkSession.sparkContext.broadcast(w)

    def run(batches):
        w = sent.value
        for (keys,), texts in scan_rows(batches, "__text", ["__id"], slice_bytes):
            sizes, idx, value = features(texts, s)
            dot = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=w[idx] * value, minlength=len(sizes)) + w[-1]
            yield pa.RecordBatch.from_arrays([keys, pa.array(1.0 / (1.0 + np.exp(-np.clip(dot, -35.0, 35.0))))], ["__id", "score"])

    return src.mapInArrow(run, f"__id {src.schema['__id'].dataType.simpleString()}, score double").withColumnRenamed("__id", id_col)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", settings: Settings = Settings(), slice_bytes: int = SLICE_BYTES) -> DataFrame:  # noqa: B008
    """Learns from the labelled documents that are not held out and scores all: id_col, held_out, score, predicted.

    held_out is whether crc32 of the id as text, modulo 3, is 1 (false for null ids, which are never learned from). Without any label all scores are 0.5.
    Nothing but the text goes into a score. Repeated rows are scored each; other columns are left out.
    """
    model = train(docs, labels, id_col, text_col, label_col, settings, slice_bytes)
    held = F.coalesce(~learning(id_col), F.lit(False))
    return score(docs, model, id_col, text_col, slice_bytes).select(id_col, held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
