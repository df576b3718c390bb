"""The quality classifier against a plain version of its updates, held-out accuracy, and what may not leak into a score."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandline.llm import classifier as C
from tests.llm import odd

SMALL = C.Settings(bits=12, epochs=3)


def plain_words(t):
    """Runs of letters, digits and what is not ASCII, or of other marks."""
    kind = lambda b: 0 if b in b" \t\n\v\f\r" else 1 if b >= 128 or chr(b).isalnum() else 2
    out, last = [], 0
    for b in t.encode():
        k = kind(b)
        if k and k == last:
            out[-1] += bytes([b])
        elif k:
            out.append(bytes([b]))
        last = k
    return out


def plain_features(t, s):
    """Feature -> value of one text, from the hashes of single words."""
    w = plain_words(t)
    one = lambda x: C.span_hashes(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)]))[0]
    h, count, m, full = [int(one(x)) for x in w], {}, int(C._MUL), (1 << 64) - 1
    for order in s.orders:
        for i in range(len(h) - order + 1):
            g = 0
            for x in h[i : i + order]:
                g = (g * m + x) & full
            f = int(C.mix(np.array([(g + order) & full], np.uint64))[0]) & ((1 << s.bits) - 1)
            count[f] = count.get(f, 0) + 1
    value = {f: math.log(1 + c) for f, c in count.items()}
    norm = math.sqrt(sum(v * v for v in value.values()))
    return {f: v / norm for f, v in sorted(value.items())}


def plain_model(rows, s):
    """Weights after all epochs, one weight at a time."""
    z, n = {}, {}

    def weight(i):
        pull = s.l1 if i >= 0 else 0.0
        if abs(z.get(i, 0.0)) <= pull:
            return 0.0
        return -(z[i] - math.copysign(pull, z[i])) / ((s.beta + math.sqrt(n.get(i, 0.0))) / s.alpha + s.l2)

    for _ in range(s.epochs):
        for x, y in rows:
            x = {f: float(np.float32(v)) for f, v in x.items()} | {-1: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / s.alpha
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return weight


def test_features_equal_a_plain_count():
    texts = [t for t in odd.texts()]
    sizes, idx, value = C.features(pa.array(texts, pa.large_string()), SMALL)
    ends = np.cumsum(sizes)
    for t, a, b in zip(texts, ends - sizes, ends, strict=True):
        want = plain_features(t or "", SMALL)
        assert idx[a:b].tolist() == list(want) and np.allclose(value[a:b], list(want.values()))


def corpus(n=240):
    rnd = random.Random(4)
    good, bad = ["the", "of", "sun", "tree", "Wall,", "ende", "is"], ["###", "$$buy", "NOW!!", "the%%", "click|"]
    rows = []
    for i in range(n):
        y = int(rnd.random() < 0.6)
        rows.append((i, " ".join(rnd.choices(good, k=rnd.randint(3, 30)) + rnd.choices(bad, k=0 if y else rnd.randint(1, 12))), y))
    return rows


def tables(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t, _ in rows], "doc_id long, text string, lang string, source string").withColumns({"score": F.lit("clash"), "label": F.lit("x"), "order": F.lit("y")}).repartition(5)
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))
    return docs, labels


@pytest.mark.parametrize("s", [SMALL, C.Settings(bits=10, orders=(1, 3), alpha=1.5, l1=0.3, l2=0.2, beta=0.5, epochs=2)])
def test_scores_equal_the_plain_updates(spark, s):
    rows = corpus(90)
    docs, labels = tables(spark, rows)
    got = {r.doc_id: r for r in C.classify(docs, labels, settings=s, slice_bytes=300).collect()}
    order = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64(F.col("doc_id").cast("string")).alias("h")).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, _, _ in rows}
    weight = plain_model([(plain_features(t, s), y) for i, t, y in sorted(rows, key=lambda r: order[r[0]]) if not held[i]], s)
    for i, t, _ in rows:
        p = 1 / (1 + math.exp(-weight(-1) - sum(weight(f) * v for f, v in plain_features(t, s).items())))
        assert got[i].score == pytest.approx(p, abs=1e-5) and got[i].held_out == held[i] and got[i].predicted == int(got[i].score >= 0.5)


def test_held_out_accuracy_and_no_leaks(spark):
    rows = corpus()
    docs, labels = tables(spark, rows)
    first = {r.doc_id: r for r in C.classify(docs, labels, settings=SMALL).collect()}
    held = [(first[i].predicted, y) for i, _, y in rows if first[i].held_out]
    assert len(held) > 50 and sum(p == y for p, y in held) / len(held) > 0.95
    # labels of held-out rows, languages and sources are not looked at
    out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    other = labels.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = C.classify(docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string")}), other, settings=SMALL).collect()
    assert {r.doc_id: r.score for r in again} == {i: r.score for i, r in first.items()}


def test_at_most_max_rows_are_learned_from(spark):
    docs, labels = tables(spark, corpus())
    found = C.examples(docs, labels, "doc_id", "text", "quality", C.Settings(bits=12, max_rows=50), 1000)
    assert found.count() == 50


def test_odd_documents_labels_and_empty_tables(spark):
    docs = odd.frame(spark)
    labels = spark.createDataFrame([(i * 3, i % 2) for i in range(20)] * 2 + [(0, 1), (None, 1), (6, None), (99, 1)], "doc_id long, quality int")
    got = C.classify(docs, labels, settings=SMALL, slice_bytes=10)
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = got.collect()
    assert len(rows) == len(odd.rows()) and all(0 <= r.score <= 1 for r in rows) and [r.held_out for r in rows if r.doc_id is None] == [False]
    none = C.classify(docs, labels.where("doc_id < 0"), settings=SMALL).collect()
    assert {r.score for r in none} == {0.5} and len(none) == len(rows)
    assert C.classify(odd.frame(spark, empty=True), labels, settings=SMALL).count() == 0
