"""Transducers, and the audit of sources against a plain computation with exact integers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import divergence
from strandline.llm.transducer import Transducer
from tests.llm import odd


def looked_up(t, words):
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words]).astype(np.int64)
    return t.ordinals(data, np.append(0, ends[:-1]).astype(np.int64), ends).tolist()


@pytest.mark.parametrize("seed", range(6))
def test_ordinals_are_places_in_the_sorted_list(seed):
    rnd = random.Random(seed)
    words = sorted({"".join(rnd.choices("abé", k=rnd.randint(0 if seed else 1, 7))).encode() for _ in range(300)})
    t = Transducer.from_bytes(Transducer.build(words).to_bytes())
    assert looked_up(t, words) == list(range(len(words))) and [t.word(i) for i in range(len(words))] == words
    others = [w for w in ({"".join(rnd.choices("abcé", k=rnd.randint(1, 9))).encode() for _ in range(300)}) if w not in set(words)]
    assert looked_up(t, others) == [-1] * len(others)
    with pytest.raises(IndexError):
        t.word(len(words))


def test_the_automaton_is_minimal():
    rnd = random.Random(1)
    words = sorted({"".join(rnd.choices("ab", k=rnd.randint(1, 6))).encode() for _ in range(60)})
    prefixes = {w[:i] for w in words for i in range(len(w) + 1)}
    futures = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in prefixes}
    assert len(Transducer.build(words).final) == len(futures)


def test_lists_without_order_are_refused_and_empty_ones_have_no_words():
    for bad in ([b"b", b"a"], [b"a", b"a"]):
        with pytest.raises(ValueError):
            Transducer.build(bad)
    assert looked_up(Transducer.build([]), [b"", b"a"]) == [-1, -1]
    assert looked_up(Transducer.build([b""]), [b"", b"a"]) == [0, -1]


def brute(rows, least, top):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    df, count, groups = Counter(), defaultdict(Counter), set()
    for text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(low))
        df.update((lang or "", t) for t in set(terms))
        count[lang or "", source or ""].update(terms)
        groups.add((lang or "", source or ""))
    out = []
    for lang, source in groups:
        kept = sorted(t for (g, t), n in df.items() if g == lang and n >= least)
        mine = sorted(s for g, s in groups if g == lang)

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = shares(count[lang, source]), shares(sum((count[lang, s] for s in mine), Counter()))
        pairs = [(-sum(f(p[t], x[t]) for t in kept), s.encode()) for s in mine if s != source for x in [shares(count[lang, s])]]
        terms = [(-f(p[t], q[t]), t.encode()) for t in kept if count[lang, source][t] and p[t] > q[t]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
            out += [(lang, source, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(found)]
    return sorted(out)


def cells(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize(("sizes", "least", "top"), [({}, 3, 10), ({"terms": 7, "volume": 1, "sources": 2, "wide": 5, "slice_bytes": 50}, 2, 4), ({"terms": 1, "sources": 1, "wide": 1000}, 3, 2)])
def test_sources_against_exact_integers(spark, sizes, least, top):
    rnd = random.Random(5)
    some = [f"{a}{b}" for a in "abcÉx" for b in ("", "a", "ß", "Zz")]
    rows = [(" ".join(rnd.choices(some, k=rnd.randint(0, 12))) + rnd.choice(["", "-1 a_b", "\x7f"]), rnd.choice(["en", "fr", "", None]), rnd.choice(["s1", "s2", "ſ3", "s10", None, ""])) for _ in range(90)]
    rows += [("only few", "xx", "s1"), (None, "xx", "s2"), ("", "xx", None), rows[0], rows[0]]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({"n": F.lit("clash"), "term": F.lit("x"), "total": F.lit("y"), "bucket": F.lit("z")}).repartition(3)
    assert cells(divergence.source_divergence(docs, least_docs=least, top=top, **sizes)) == brute(rows, least, top)


def test_odd_documents_and_an_empty_table(spark):
    got = cells(divergence.source_divergence(odd.frame(spark), least_docs=2))
    assert got == brute([(r[1], r[2], r[3]) for r in odd.rows()], 2, 10) and got
    assert divergence.source_divergence(odd.frame(spark, empty=True)).count() == 0


def test_shares_of_large_counts_are_exact(spark):
    rows = [(9_300_000_000_000, 9_300_000_000_001, 3), (0, 0, 1), (5, 9_000_000_000_000_000, 7), (123_456_789_012, 777_777_777_777_777, 1000)]
    got = spark.createDataFrame(rows, "n long, t long, v long").select(divergence.share(F.col("n"), F.col("t"), F.col("v")).alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (n + 2) // (t + 2 * v) for n, t, v in rows]
