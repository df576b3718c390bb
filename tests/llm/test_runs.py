"""Periodic runs against brute force: random words, odd documents and several slices."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import repetition
from tests.llm import odd


def brute(w, shortest=12):
    """Start, length and period of every run, by comparing all words at all lags."""
    best = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - s >= max(shortest - q, q):
                best.setdefault((s, i + q - s), q)
    return sorted((s, length, q) for (s, length), q in best.items())


def made(rnd):
    n = rnd.choice([0, 5, 12, 13, 40, 90, 200])
    d = [rnd.randrange(rnd.choice([1, 2, 2, 3, 5, 30])) for _ in range(n)]
    if n and rnd.random() < 0.7:
        a = rnd.randrange(n)
        p = 1 + (n - a) // rnd.randint(2, 7)
        d = [d[i] if i < a else d[a + (i - a) % p] for i in range(n)]
    return d + d[: rnd.randint(0, n)] if rnd.random() < 0.3 else d


@pytest.mark.parametrize("narrow", [4, 16, 32])
@pytest.mark.parametrize("shortest", [2, 12, 40])
def test_runs_of_random_words(monkeypatch, narrow, shortest):
    monkeypatch.setattr(repetition, "NARROW", narrow)
    rnd = random.Random(narrow + shortest)
    for _ in range(150):
        texts = [made(rnd) for _ in range(rnd.randint(1, 4))]
        sizes = np.array([len(t) for t in texts])
        at = np.cumsum(sizes) - sizes
        got = list(zip(*(x.tolist() for x in repetition.runs_of(np.array(sum(texts, []), np.int32), sizes, shortest)), strict=True))
        assert sorted(got) == sorted((int(o) + s, length, q) for o, t in zip(at, texts, strict=True) for s, length, q in brute(t, shortest))


def test_long_texts_of_few_words_stay_cheap():
    a, b = [0], [0, 1]
    while len(b) < 60_000:
        a, b = b, b + a
    start, length, period = repetition.runs_of(np.array(b, np.int32), np.array([len(b)]))
    w = np.array(b)
    assert len(start) > 1000
    for s, n, q in list(zip(start, length, period, strict=True))[::97]:
        assert n >= max(12, 2 * q) and (w[s : s + n - q] == w[s + q : s + n]).all()
        assert (s == 0 or w[s - 1] != w[s - 1 + q]) and (s + n == len(w) or w[s + n] != w[s + n - q])
    assert [x.tolist() for x in repetition.runs_of(np.zeros(50_000, np.int32), np.array([50_000]))] == [[0], [50_000], [1]]


def test_segments_split_at_words_that_are_too_rare():
    w = [9] + [1, 2, 3] * 5 + [8] + [4, 5] * 5 + [7, 1, 2] + [6] * 12
    s, e = repetition.surviving_segments(np.array(w), np.array([0]), np.array([len(w)]))
    assert list(zip(s.tolist(), e.tolist(), strict=True)) == [(1, 16), (len(w) - 12, len(w))]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def digests(i, w):
    runs = brute(w)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    runs.sort(key=lambda r: (r[0], r[2]))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (i, len(runs), s, n, q, runs and 1000 * n // q or None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


@pytest.mark.parametrize("slice_bytes", [1, 3 << 20])
def test_documents_with_planted_runs(spark, slice_bytes):
    more = [(100 + i, " ".join(str(random.Random(i).randrange(4)) for _ in range(i)), "en", "s", 0, *["clash"] * 11) for i in range(80)]
    rows = odd.rows() + more
    docs = spark.createDataFrame(rows, odd.SCHEMA).withColumns({"runs": F.lit("clash"), "start": F.lit("x"), "__g": F.lit("y")})
    got = repetition.run_digests(repetition.periodic_runs(repetition.with_planted_runs(docs), slice_bytes=slice_bytes)).collect()
    want = []
    for i, t, *_ in rows:
        w = words(t)
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))]
        want.append(digests(i, w))
    key = lambda r: str(tuple(r))
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert any(r.n_runs for r in got)


def test_an_empty_table_and_the_operator_itself(spark):
    assert repetition.run_digests(repetition.periodic_runs(repetition.with_planted_runs(odd.frame(spark, empty=True)))).count() == 0
    docs = spark.createDataFrame([(1, "x a b c a b c a b c a b c\ta y y"), (None, None), (2, "")], "id long, body string")
    got = {r.id: r for r in repetition.periodic_runs(docs, "id", "body").collect()}
    assert [tuple(r) for r in got[1].runs] == [(1, 13, 3)] and got[1].collapsed == "x a b c y y" and got[1].n_words == 16
    assert got[None].runs == [] and got[None].collapsed == "" and got[2].n_words == 0
