"""Fingerprints, URL rules, archives, scoring and the pipeline, against brute force and round trips."""

import hashlib
import math
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandline.llm import fingerprint, lattice_lm, url_filter, warc
from strandline.llm.common import COARSE_RANGES, dealt, numbered_ranges, range_bounds, range_of, scan_rows, shared_dir, word_codes
from tests.llm import odd
from tests.llm.test_groups import words


def canonical(t):
    fold = lambda x: unicodedata.normalize("NFKC", x)
    return re.sub(r"\s+", " ", fold(fold(t or "").casefold())).strip()


def weak(c):
    """A hash with many collisions."""
    return F.length(c).cast("long") % 3, F.lit(0).cast("long")


@pytest.mark.parametrize("make", [fingerprint.digest, weak])
def test_fingerprints_are_equal_just_for_equal_canonical_texts(spark, make):
    rows = odd.rows()
    got = fingerprint.fingerprint_documents(odd.frame(spark).select("doc_id", F.col("text")), make=make).collect()
    assert Counter(Counter(canonical(r[1]) for r in rows).values()) == Counter(Counter(g.fingerprint for g in got).values())


@pytest.mark.parametrize("make", [fingerprint.digest, weak])
def test_edited_texts(spark, make):
    rows = sorted(odd.rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, same = [], defaultdict(set)
    got = [r.asDict() for r in fingerprint.compare_edited(odd.frame(spark), make=make).collect()]
    for i, r in enumerate(rows):
        t, n = r[1] or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(t) // 2
        e = t[: len(t) - half] + n[:half]
        want.append(str((r[0], len(t), hashlib.sha256(e.encode()).hexdigest(), float(canonical(t) == canonical(e)), float(canonical(t) == canonical(n)))))
        for g in got:
            if (g["doc_id"], g["n_chars"], g["edited_sha256"]) == (r[0], len(t), hashlib.sha256(e.encode()).hexdigest()):
                same[canonical(e)].add(g["edited_fingerprint"])
    keys = ("doc_id", "n_chars", "edited_sha256", "near_edited", "near_next")
    assert sorted(want) == sorted(str(tuple(g[k] for k in keys)) for g in got)
    assert all(len(v) == 1 for v in same.values()) and len(same) == len(set.union(*same.values()))
    assert fingerprint.compare_edited(odd.frame(spark, empty=True)).count() == 0
    one = fingerprint.compare_edited(odd.frame(spark).where("doc_id = 21").limit(1)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_ranges_hold_about_equal_counts(spark):
    ids = [*range(1000), *range(10**12, 10**12 + 1000), -(2**62), 2**62]
    df = spark.createDataFrame([(i,) for i in ids], "k long")
    bounds = range_bounds(df, "k", 20, cells=16)
    assert bounds == sorted(bounds)
    got = df.select("k", range_of("k", bounds).alias("b")).collect()
    assert all(r.b == np.searchsorted(bounds, r.k, side="right") for r in got)
    assert max(Counter(r.b for r in got).values()) <= 2 * len(ids) / 20
    assert range_bounds(df.limit(0), "k", 4) == []


@pytest.mark.parametrize("texts", [["A b c", "d E", "", "x " * 170, "q"] * 8, [None, "A b c", None, "x  y"] * 10, [None] * 8 + ["A b", "c d e"] * 16])
@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_words_of_slices_of_a_batch(texts, kind):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, kind)], ["id", "t"])
    for at in range(len(texts)):
        for slice_bytes in (1, 1 << 20):
            got = []
            for (ids,), part in scan_rows([batch.slice(at, 9)], "t", ["id"], slice_bytes):
                doc, codes, own = word_codes(part)
                got += [(i, [own[c] for c in codes[doc == k]]) for k, i in enumerate(ids.to_pylist())]
            assert got == [(i, (texts[i] or "").lower().encode().split()) for i in range(at, min(at + 9, len(texts)))]


def test_more_ranges_than_a_plan_holds(spark):
    ids = [None, *range(1000), *range(10**12, 10**12 + 1000), *[7] * 300, -(2**62), 2**62]
    df = spark.createDataFrame([(i, str(i)) for i in ids], "k long, __first string")
    numbered, n = numbered_ranges(df.withColumnRenamed("__first", "first"), "k", 100, "b", coarse=6)
    got = numbered.collect()
    assert sorted((r.k is not None, r.k or 0, r.first) for r in got) == sorted((i is not None, i or 0, str(i)) for i in ids)
    got.sort(key=lambda r: (r.k is not None, r.k or 0))
    assert [r.b for r in got] == sorted(r.b for r in got) and got[0].b == 0
    assert {r.b for r in got} == set(range(n)) and 100 - 14 <= n <= 112  # the rows of 7 fill 14 ranges' shares, and stay together
    assert all(c <= 2 * len(ids) / 100 for b, c in Counter(r.b for r in got if r.k not in (None, 7)).items())
    assert len({r.b for r in got if r.k == 7}) == 1
    assert numbered_ranges(df.limit(0), "k", 100, "b", coarse=6)[0].count() == 0


def test_hundred_thousand_ranges_have_a_short_plan(spark):
    df = spark.range(0, 900_000, 1, 4).select((F.col("id") * F.col("id")).alias("k"))
    numbered, n = numbered_ranges(df, "k", 100_000, "b")
    assert 100_000 <= n <= 100_000 + COARSE_RANGES
    plan = numbered._jdf.queryExecution().toString()
    assert len(plan) < 1 << 20
    sizes = numbered.groupBy("b").agg(F.count("*").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi")).orderBy("b").collect()
    assert [r.b for r in sizes] == list(range(n)) and max(r.n for r in sizes) <= 9
    assert all(a.hi < b.lo for a, b in zip(sizes, sizes[1:]))
    assert dealt(numbered, "b", n, most=8).rdd.getNumPartitions() == 8


def test_archives_and_scores_with_ranges_from_a_table(spark, monkeypatch):
    df = odd.frame(spark)
    pages = df.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://h/"), F.col("doc_id").cast("string")).alias("url"), F.col("text").alias("html"))
    model = public_tokenizers.path("piece_bpe_32k.model")

    def rows():
        out = f"{shared_dir(spark)}/warc-{len(calls)}"
        records = warc.archive_round_trip(pages, out, file_bytes=700, shard_bytes=500).collect()
        scores = lattice_lm.score_documents(df, model).collect()
        scores = sorted((str(tuple(r)[:5]), *tuple(r)[5:]) for r in scores)
        return sorted(str(tuple(r)) for r in records), [r[0] for r in scores], np.array([r[1:] for r in scores])

    calls = []
    monkeypatch.setattr(lattice_lm, "CHUNK_BYTES", 500)
    want = rows()
    for module in (warc, lattice_lm):
        monkeypatch.setattr(module, "numbered_ranges", lambda *a: calls.append(a) or numbered_ranges(*a, coarse=3))
        monkeypatch.setattr(module, "dealt", lambda *a: dealt(*a, most=2))
    calls.append(None)
    got = rows()
    assert got[:2] == want[:2] and np.allclose(got[2], want[2], rtol=1e-9, atol=0) and len(calls) == 3


URLS = [None, "", "no scheme", "http://EXAMPLE.org/es/x?y#z", "https://a.example.org/en/1", "https://example.org/en/2", "http://x.com/fr/", "http://x.com/de/1", "http://x.com", "https://spam-farm.example.net/en/1", "http://notexample.org/es/", "http://org/", "ftp://h.net?sessionid=1", "http://casino.net/", "http://a.casino.net/", "http://b.net/wp-login.php", "http://x.com/fr", "a://b://c.org/", "http://x.COM/de/"]


def test_url_verdicts_against_all_rules(spark):
    rows = [(i, u, "clash", "clash") for i, u in enumerate(URLS)] + [(3, URLS[3], "x", "y"), (None, URLS[4], "x", "y")]
    got = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string, rule string")).collect()
    want = []
    for i, u, *_ in rows:
        rest = (u or "").split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate({c: c + 32 for c in range(65, 91)})
        fit = [r for r in url_filter.SITE_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fit, key=lambda r: len(r.name), default=None)
        pattern = next((r for r in url_filter.PATTERN_RULES if u and re.search(r.pattern, u.lower())), None) if best is None else None
        want.append((i, host, path, best and best.name, (best or pattern).verdict if best or pattern else "allow", pattern and pattern.pattern))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_hot_and_missing_urls_and_rules_in_a_table(spark):
    rows = [(i, "http://a.example.org/es/x") for i in range(300)] + [(1000 + i, None) for i in range(300)] + [(2000, "http://q/")]
    given = url_filter.rule_table(spark, (url_filter.Rule("block", "example.org", "/es/"), url_filter.Rule("block", pattern="//q/", literals=("q",))))
    got = {r.page_id: (r.host, r.rule, r.verdict) for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), given).collect()}
    assert got == {i: ("a.example.org", "example.org/es/", "block") for i in range(300)} | {1000 + i: ("", None, "allow") for i in range(300)} | {2000: ("q", None, "block")}


def test_rules_are_indexed_by_their_rarest_literal(spark):
    urls = spark.createDataFrame([(["www", "com", "fr"],), (["www", "com"],), (["www"],)], "tokens array<string>")
    rules = (url_filter.Rule("block", pattern="x", literals=("www", "com", "fr")), url_filter.Rule("block", pattern="y", literals=("www", "com")), url_filter.Rule("block", pattern="z"))
    got = {r.rule_id: r.token for r in url_filter.index_rules(urls, url_filter.rule_table(spark, rules)).collect()}
    assert got == {0: "fr", 1: "com", 2: None}


def test_a_token_that_a_pattern_leaves_open_does_not_hide_a_rule(spark):
    """php is the rarest of the words here, but no token of /wp-login.php5."""
    urls = ["http://h.net/wp-login.php5", "http://h.net/wp-login.phps", "http://h.net/wp/login", "http://h.net/wp/login/2", "http://a.ads.net/", "http://loads.net/ads"]
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert got == {0: "block", 1: "block", 2: "allow", 3: "allow", 4: "block", 5: "allow"}
    rules = url_filter.rule_table(spark, url_filter.PATTERN_RULES)
    assert all(r.literals for r in rules.collect())


def test_each_shard_is_written_by_a_task_of_its_own(spark):
    df = spark.createDataFrame([(i, f"http://h/{i}", chr(97 + i) * 1000) for i in range(20)], "page_id long, url string, html string")
    spark.sparkContext.setJobGroup("warc-tasks", "")
    try:
        manifest = warc.write_archives(df, f"{shared_dir(spark)}/warc-tasks", shard_bytes=2000)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    status = spark.sparkContext.statusTracker()
    stages = [status.getStageInfo(k) for j in status.getJobIdsForGroup("warc-tasks") for k in status.getJobInfo(j).stageIds]
    assert 10 in {s.numTasks for s in stages if s} and manifest.agg({"records": "sum"}).first()[0] == 20


def test_a_task_that_runs_again_and_leftovers_do_no_harm(spark):
    """A second run writes the same files over the first one's; what a lost task left is removed; a cut file is noticed."""
    from pyarrow import fs

    df = spark.createDataFrame(pages(), "page_id long, url string, html string, x string")
    out = f"{shared_dir(spark)}/warc-again"
    first = sorted(map(tuple, warc.write_archives(df, out, file_bytes=700, shard_bytes=2000).collect()))
    store, base = fs.FileSystem.from_uri(out)
    store.create_dir(f"{base}/_temporary")
    with store.open_output_stream(f"{base}/_temporary/lost-part-000000-00000.warc.gz", compression=None) as f:
        f.write(b"half a rec")
    with store.open_output_stream(f"{base}/part-999999-00000.warc.gz", compression=None) as f:
        f.write(b"not in the manifest")
    assert sorted(map(tuple, warc.write_archives(df, out, file_bytes=700, shard_bytes=2000).collect())) == first
    assert store.get_file_info(f"{base}/_temporary").type == fs.FileType.NotFound
    assert warc.read_archives(spark, out).count() == len(pages())
    name = f"{base}/{first[0][0]}"
    data = store.open_input_stream(name, compression=None).read()
    with store.open_output_stream(name, compression=None) as f:
        f.write(data[:-5])
    with pytest.raises(Exception, match="is not as the manifest has it"):
        warc.read_archives(spark, out).count()


def pages():
    big, other = "é" * 600, "z" * 999
    html = [None, "", "small", "small", big, big, "x" + big, other, other, "z" * 1000, "z" * 1000, "\r\n\r\nWARC/1.1\r\n" + "q" * 5000, "z" * 1000]
    return [(i * 2, f"http://h/{i}\r\nX: y" if i % 3 else None, h, "clash") for i, h in enumerate(html)] + [(None, "http://n/", "z" * 1000, "c"), (0, None, "again", "c")]


def test_archives_round_trip(spark):
    df = spark.createDataFrame(pages(), "page_id long, url string, html string, record_type string")
    out = f"{shared_dir(spark)}/warc-a"
    got = warc.archive_round_trip(df, out, file_bytes=700, shard_bytes=2000).collect()
    keep = {}
    for i, _, h, _ in pages():
        if len((h or "").encode()) >= 1000 and i is not None:
            keep[h] = max(keep.get(h, -1), i)
    want = []
    for i, _, h, _ in pages():
        b = (h or "").encode()
        to = keep.get(h) if keep.get(h) != i else None
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if to is not None else "response", to))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
    full = {(r.page_id, r.payload) for r in warc.read_archives(spark, out).where("record_type = 'response'").collect()}
    assert full == {(i, h or "") for (i, _, h, _), w in zip(pages(), want, strict=True) if w[3] == "response"}


def test_archives_are_the_same_each_time(spark):
    df = spark.createDataFrame(pages(), "page_id long, url string, html string, x string")
    a = warc.write_archives(df, f"{shared_dir(spark)}/warc-b", file_bytes=700, shard_bytes=2000)
    b = warc.write_archives(df.orderBy(F.rand()).repartition(3), f"{shared_dir(spark)}/warc-c", file_bytes=700, shard_bytes=2000)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) and a.count() > 3
    assert warc.archive_round_trip(df.limit(0), f"{shared_dir(spark)}/warc-d").count() == 0


MODEL = public_tokenizers.path("piece_bpe_32k.model")


def all_segmentations(lat, logp):
    """The sum over all segmentations of a word, without a lattice."""
    known = dict(zip(lat.pieces, np.exp(logp), strict=True))
    brute = lambda w: 1.0 if not w else sum(known[w[:k]] * brute(w[k:]) for k in range(1, len(w) + 1) if w[:k] in known)
    return brute


def test_the_lattice_sums_over_all_segmentations():
    lat = lattice_lm.lattice(MODEL)
    logp = lat.weights((0.5, 1.0, 2.0))
    assert np.allclose(np.exp(logp[lat.begins]).sum(axis=0), 1.0) and np.allclose(np.exp(logp[~lat.begins]).sum(axis=0), 0.5)
    # the law is the file's scores' alone
    a, b = (lat.pieces.index(x) for x in (b" the", b" and"))
    assert np.allclose((logp[a] - logp[b]) / (math.log(10 + lat.ranks[b]) - math.log(10 + lat.ranks[a])), (0.5, 1.0, 2.0))
    for k in range(3):
        brute = all_segmentations(lat, logp[:, k])
        for w in (b"the", b"theaon", "été".encode(), b"x", b"wordwords"):
            assert abs(lat.log_probability([w], logp)[0, k] - math.log(0.5 * brute(b" " + w))) < 1e-9
    long_ = b"inging" * 30
    assert np.allclose(lat.log_probability([long_], logp)[0], math.log(0.5) + lat.forward(np.frombuffer(b" " + long_, np.uint8)[None], logp)[0, -1])


@pytest.mark.parametrize("chunk_bytes", [24 << 20, 300])
def test_scores(spark, monkeypatch, chunk_bytes):
    """Everything from definitions, the score by all segmentations; also with many unequal chunks and split lists."""
    monkeypatch.setattr(lattice_lm, "CHUNK_BYTES", chunk_bytes)
    monkeypatch.setattr(lattice_lm, "LISTED", 3)
    rows = odd.rows()
    got = lattice_lm.score_documents(odd.frame(spark), MODEL).collect()
    out = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    tokens = [[*(w.lower() for w in words(r[1])), None] for r in rows]
    c = Counter(w for r, t in zip(rows, tokens, strict=True) if not out(r[0]) for w in t)
    n, v = sum(c.values()), len(c)
    lat = lattice_lm.lattice(MODEL)
    logp = lat.weights(lattice_lm.SLOPES)
    every = sorted({w for t in tokens for w in t if w is not None})
    by_word = dict(zip(every, lat.log_probability(every, logp), strict=True))
    slope = int(np.argmax(sum(k * by_word[w] for w, k in c.items() if w is not None)))
    brute, sums = all_segmentations(lat, logp[:, slope]), {}
    for w in every:
        sums[w] = math.log(0.5 * brute(b" " + w)) if len(w) < 13 else float(by_word[w][slope])
    more, end = math.log((n - c[None] + 1) / (n + 2)), math.log((c[None] + 1) / (n + 2))
    want = []
    for r, t in zip(rows, tokens, strict=True):
        score = float(sum(sums[w] + more for w in t[:-1]) + end) / math.log(10)
        want.append((r[0], out(r[0]), len(t), sum(w in c for w in t), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6), round(score, 5)))
    assert sorted(map(str, want)) == sorted(str((*tuple(r)[:5], round(r.base_score, 6), round(r.score, 5))) for r in got)
    assert all(math.isfinite(r.word_score) and r.word_score < 0 for r in got)
    assert lattice_lm.score_documents(odd.frame(spark, empty=True), MODEL).count() == 0


def test_scores_of_unseen_texts_are_better_than_chance(spark):
    """Held-out texts of the trained kind are likelier, for each character, than shuffled letters."""
    rng = np.random.default_rng(0)
    syllables = ["tion", "ing", "the", "re", "on", "er", "an", "st"]
    text = lambda: " ".join("".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(80))
    rows = [(i, text()) for i in range(150)]
    shuffled = [(i + 1000, "".join(rng.permutation(list(t)))) for i, t in rows[:30]]
    got = {r.doc_id: r.score / len(t) for r, t in ((r, dict(rows + shuffled)[r.doc_id]) for r in lattice_lm.score_documents(spark.createDataFrame(rows + shuffled, "doc_id long, text string"), MODEL).where("held_out").collect())}
    assert np.mean([s for i, s in got.items() if i < 1000]) > np.mean([s for i, s in got.items() if i >= 1000] or [-9]) + 0.2


def test_learned_pieces_are_expected_uses():
    """Forward and backward against the posterior of every segmentation; long words as short ones."""
    lat = lattice_lm.lattice(MODEL)
    logp = lat.weights((1.0,))[:, 0]
    p = dict(zip(lat.pieces, np.exp(logp), strict=True))

    def segmentations(w):
        if not w:
            yield ()
        for k in range(1, len(w) + 1):
            if w[:k] in p:
                for more in segmentations(w[k:]):
                    yield (w[:k], *more)

    want = Counter()
    some = [b"the", b"onion", "été".encode(), b"x"]
    for w in some:
        ways = [(s, math.prod(p[x] for x in s)) for s in segmentations(b" " + w)]
        for s, q in ways:
            for x in s:
                want[x] += q / sum(y for _, y in ways)
    got = lat.expected(some, logp)
    assert {lat.pieces[i]: round(float(got[i]), 9) for i in np.flatnonzero(got > 1e-9)} == {x: round(n, 9) for x, n in want.items() if n > 1e-9}
    long_ = np.zeros(len(logp))
    lat._expected_long(b" onion", logp, long_)
    assert np.allclose(long_, lat.expected([b"onion"], logp))


def test_held_out_scores_are_near_the_base(spark, tmp_path):
    """The query's score learns from the training texts: unseen words of seen syllables cost little more than the base
    gives them without spelling, and seen words hardly more at all; repeated texts of the training kind are likelier."""
    from strandline.llm import queries

    rng = np.random.default_rng(1)
    syllables = ["tion", "ing", "the", "re", "on", "er", "an", "st"]
    rows = [(i, " ".join("".join(rng.choice(syllables, rng.integers(1, 5))) for _ in range(120))) for i in range(150)]
    spark.createDataFrame([*rows, (150, None), (151, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op5_lm_scoring(spark, str(tmp_path)).collect()
    assert len(got) == 152 and all(r.score is not None and math.isfinite(r.score) and r.score < 0 for r in got)
    out = [r for r in got if r.held_out and r.n_tokens > 1]
    assert sum(r.n_known < r.n_tokens for r in out) > 5
    per_token = lambda c: sum(r[c] for r in out) / sum(r.n_tokens for r in out)
    assert per_token("score") > 1.1 * per_token("base_score") > per_token("lattice_score")


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    from tests.llm.test_groups import brute_groups, brute_repeats, shingles

    docs = odd.frame(spark, doubled=False)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard_join", "substring_dedup", "best_fit_packing"]
    got = docs
    texts = {r[0]: r[1] for r in odd.rows(False)}
    for name, stage in corpus_pipeline.STAGES[:3]:
        got = stage(spark, got, str(tmp_path))
        assert got.columns == docs.columns
        rows = sorted((i, t) for i, t in texts.items() if t is not None)
        if name == "quality_rules":
            def fails(t):
                w = words(t)
                c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
                cover = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
                return len(w) < 10 or 100 * len(cover) > 20 * len(w)

            texts = {i: t for i, t in rows if not fails(t)}
        elif name == "ngram_jaccard_join":
            alone = set(brute_groups(rows, 5, 80))
            texts = {i: t for i, t in rows if str((i, len(shingles(t, 5)), i)) in alone}
        else:
            want = brute_repeats(rows, 50)
            texts = {i: want[(i, t)][3] if want[(i, t)][1] else t for i, t in rows}
        assert {r.doc_id: r.text for r in got.collect()} == texts
    assert {r.n_chars for r in got.collect()} == {len(t) for t in texts.values()}
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == set(texts)


def test_stages_leave_one_table_each(spark, tmp_path):
    """What a stage wrote on its way is gone once its result is written; repeated passages and groups are as before."""
    import os

    from strandline.llm import jaccard, substring
    from strandline.session import CLEANUP, shared_dir, written, written_alone

    shared = shared_dir(spark).removeprefix("file://")
    tables = lambda: set(os.listdir(shared)) if os.path.isdir(shared) else set()
    docs, before = odd.frame(spark, doubled=False), spark.conf.get(CLEANUP)
    for stage, left in ((lambda: jaccard.keep_one_of_each(docs), "gone"), (lambda: substring.without_repeats(docs, 50), "changed")):
        held = tables()
        out = stage()
        assert [x.split("-")[1] for x in tables() - held] == [left]
        assert out.count() <= docs.count()
    held = tables()
    outer = written_alone(lambda: written_alone(lambda: written(docs, "a"), "b").limit(1), "c")
    assert [x.split("-")[1] for x in tables() - held] == ["c"] and outer.count() == 1
    held = tables()
    with pytest.raises(ZeroDivisionError):
        written_alone(lambda: written(docs, "a").limit(1 // 0))
    assert tables() == held and spark.conf.get(CLEANUP) == before


def test_every_operator_has_a_query():
    from strandline.llm import queries

    names = list(queries.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(names)
    for sql in queries.oracle_sql().values():
        duckdb.extract_statements(sql)
