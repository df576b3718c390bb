"""Similarity groups, repeated passages and quality rules, against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from strandline.llm import jaccard, quality, substring
from tests.llm import odd


def words(t):
    return (t or "").encode().split()


def shingles(t, n):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_groups(rows, n, percent):
    """Rows of one id are one document; a null id links with nothing."""
    sets = [(i, shingles(t, n)) for i, t in rows if i is not None]
    up = {i: i for i, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (a, s) in enumerate(sets):
        for b, t in sets[:k]:
            o = len(s & t)
            if s and t and (a == b or 100 * o >= percent * (len(s) + len(t) - o)):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return sorted(str((i, len(shingles(t, n)), None if i is None else root(i))) for i, t in rows)


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_similarity_groups(spark, n, percent):
    rnd = random.Random(n)
    pairs = [(r[0], r[1]) for r in odd.rows()]
    for g in range(6):
        base = [f"g{g}x{rnd.randint(0, 300)}" for _ in range(rnd.choice((6, 12, 30, 120)))]
        for k in range(12):
            own = list(base)
            for _ in range(rnd.randint(0, max(1, len(own) // 12))):
                own[rnd.randrange(len(own))] = f"new{rnd.random()}"
            pairs.append((1000 + g * 50 + k, " ".join(own)))
    got = jaccard.similarity_groups(spark.createDataFrame(pairs, "doc_id long, text string"), n, percent).collect()
    assert sorted(str(tuple(r)) for r in got) == brute_groups(pairs, n, percent)
    assert jaccard.similarity_groups(odd.frame(spark, empty=True)).count() == 0


def chained():
    """Texts of phrases that many others have too, in other company, and a near copy of every fourth."""
    rnd = random.Random(8)
    phrases = [" ".join(f"p{p}x{j}" for j in range(7)) for p in range(40)]
    rows = []
    for i in range(300):
        own = [rnd.choice(phrases) if rnd.random() < 0.6 else " ".join(f"d{i}x{s}x{j}" for j in range(7)) for s in range(12)]
        rows.append((i, " ".join(own)))
        if i % 4 == 0:
            w = rows[-1][1].split()
            w[rnd.randrange(len(w))] = "other"
            rows.append((1000 + i, " ".join(w)))
    return rows


def test_chance_meetings_do_not_chain_sets_to_large_blocks(spark, monkeypatch):
    """Blocks of many chunks are dealt again: they become smaller, and no link is lost."""
    seen = []
    refined = jaccard._refined

    def spy(src, blocks, n, percent):
        out = refined(src, blocks, n, percent)
        seen.append([{r.node: r.block for r in b.collect()} for b in (blocks, out)])
        return out

    monkeypatch.setattr(jaccard, "_refined", spy)
    monkeypatch.setattr(jaccard, "CHUNK_SETS", 5)
    rows = chained()
    got = jaccard.similarity_groups(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()
    assert sorted(str(tuple(r)) for r in got) == brute_groups(rows, 5, 80)
    before, after = ({k: list(b.values()).count(k) for k in b.values()} for b in seen[0])
    assert max(before.values()) > 100 and max(after.values()) <= jaccard.FEW_CHUNKS * jaccard.CHUNK_SETS
    linked = [(i, 1000 + i) for i in range(0, 300, 4)]
    assert all(seen[0][1][a] == seen[0][1][b] for a, b in linked)


def test_dealings_share_a_key_for_each_link():
    rnd = np.random.default_rng(3)
    for seed in range(4):
        for size in (1, 2, 5, 9, 40, 300):
            a = np.unique(rnd.integers(0, 1 << 63, size).astype(np.uint64))
            more = (len(a) * 20) // 80  # 80 % of the union is shared
            b = np.unique(np.concatenate([a, rnd.integers(0, 1 << 63, more).astype(np.uint64)]))
            c = a[: max(1, -(-len(a) * 8 // 10))]
            for x, y in ((a, b), (a, c)):
                k = [set(jaccard.block_keys(z, np.array([len(z)]), 80, seed)[0].tolist()) for z in (x, y)]
                assert k[0] & k[1]


def test_keys_are_gone_before_sets_are_compared(spark):
    import os

    from strandline.session import shared_dir

    shared = shared_dir(spark).removeprefix("file://")
    held = set(os.listdir(shared)) if os.path.isdir(shared) else set()
    assert jaccard.similarity_groups(odd.frame(spark)).count()
    assert not {"sets", "keys"} & {x.split("-")[1] for x in set(os.listdir(shared)) - held}


@pytest.mark.parametrize("copies", [240, 480])
def test_near_copies_get_fewer_links_than_sets_from_each_batch(copies):
    rnd = random.Random(6)
    base, texts = [f"b{i}" for i in range(200)], []
    for _ in range(copies):
        own = list(base)
        own[rnd.randrange(200)] = own[rnd.randrange(200)] = f"n{rnd.random()}"
        texts.append(" ".join(own))
    batches = []
    for at in range(0, copies, 24):
        g, sizes = jaccard.shingle_sets(texts[at : at + 24], 5)
        lists = jaccard._list_of(*jaccard.block_keys(g, sizes, 80), len(sizes))
        batches.append(jaccard.pa.RecordBatch.from_arrays([jaccard.pa.array(range(at, at + len(sizes))), lists], ["__id", "keys"]))
    rows = jaccard.pa.Table.from_batches(jaccard._local_stars(batches)).sort_by([("local", "ascending"), ("a", "ascending")]).combine_chunks()
    links = [x for b in jaccard._stars(rows.to_batches()) for x in zip(b["a"].to_pylist(), b["b"].to_pylist(), strict=True)]
    # each of its keys linked a set with another one
    assert sorted({x for link in links for x in link}) == list(range(copies)) and len(links) < copies, len(links)


def test_links_in_batches_lead_where_keys_do():
    """Any cut of sets into batches, and of rows sorted by key into batches, links what share keys, one way or another."""
    r = np.random.default_rng(3)
    for _ in range(60):
        lists = [np.unique(r.integers(0, 40, r.integers(0, 4))) for _ in range(30)]
        ids = r.permutation(1000)[:30]
        batches = []
        for part in np.array_split(np.arange(30), r.integers(1, 7)):
            own = np.repeat(np.arange(len(part)), [len(lists[i]) for i in part])
            keys = np.concatenate([lists[i] for i in part]).astype(np.uint64)
            batches.append(jaccard.pa.RecordBatch.from_arrays([jaccard.pa.array(ids[part]), jaccard._list_of(keys, own, len(part))], ["__id", "keys"]))
        sent = list(jaccard._local_stars(batches))
        for b in sent:
            local, nodes = np.array(b["local"]), np.array(b["a"])
            assert len(set(nodes[local].tolist())) == local.sum()
        rows = jaccard.pa.Table.from_batches(sent).sort_by([("local", "ascending"), ("a", "ascending")]).combine_chunks().to_batches()[0]
        cuts = [0, *sorted(r.integers(0, len(rows), 3).tolist()), len(rows)]
        links = [x for b in jaccard._stars([rows.slice(x, y - x) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]) for x in zip(b["a"].to_pylist(), b["b"].to_pylist(), strict=True)]
        want = [(int(ids[i]), int(ids[j])) for i in range(30) for j in range(i) if set(lists[i].tolist()) & set(lists[j].tolist())]
        least = lambda pairs: {k: v for k, v in zip(*(x.tolist() for x in jaccard._least_reached(*np.array(pairs, np.int64).T)), strict=True)}
        assert least(links) == least(want)


def test_large_blocks_are_cut_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK_SETS", 7)
    rnd = random.Random(5)
    base = [f"b{i}" for i in range(80)]
    pairs = []
    for k in range(60):
        own = list(base)
        for _ in range(rnd.randint(0, 3)):
            own[rnd.randrange(80)] = f"n{rnd.random()}"
        pairs.append((k, " ".join(own)))
    got = jaccard.similarity_groups(spark.createDataFrame(pairs, "doc_id long, text string"), 4, 85).collect()
    assert sorted(str(tuple(r)) for r in got) == brute_groups(pairs, 4, 85)


def test_chunks_of_several_components_meet(spark, monkeypatch):
    """Drifting texts: neighbours are similar, distant ones are not; chunks are far smaller than the blocks."""
    monkeypatch.setattr(jaccard, "CHUNK_SETS", 5)
    rnd = random.Random(8)
    pairs = []
    for g in range(3):
        own = [f"w{rnd.randint(0, 2000)}" for _ in range(60)]
        for k in range(40):
            if k % 13 == 12:
                own[rnd.randrange(60)] = own[rnd.randrange(60)] = f"m{rnd.random()}"
            own[rnd.randrange(60)] = f"n{rnd.random()}"
            pairs.append((rnd.randrange(10**6), " ".join(own)))
    pairs += [(10**7 + i, t) for i, (_, t) in enumerate(pairs[:30])]
    got = jaccard.similarity_groups(spark.createDataFrame(pairs, "doc_id long, text string"), 4, 85).collect()
    want = brute_groups(pairs, 4, 85)
    assert sorted(str(tuple(r)) for r in got) == want and 1 < len({w.split(", ")[2] for w in want}) < 100


@pytest.mark.parametrize("two", [False, True])
def test_tree_join_finds_all_links(two):
    rng = np.random.default_rng(2)
    for _ in range(25):
        base = rng.choice(10**6, rng.integers(1, 60), replace=False)
        sets = []
        for _ in range(rng.integers(2, 25)):
            s = set(base.tolist())
            for x in rng.choice(base, rng.integers(0, max(1, len(base) // 4) + 1)):
                s.discard(int(x))
            s |= set(rng.integers(10**7, 10**8, rng.integers(0, 4)).tolist())
            sets.append(np.array(sorted(s or {1}), np.uint64))
        side = rng.integers(0, 2, len(sets)) if two else np.zeros(len(sets), np.int64)
        links = jaccard.tree_join(np.arange(len(sets)), sets, side, 85, rng.integers(0, 5, jaccard.CELLS))
        f, g = jaccard.Forest(len(sets)), jaccard.Forest(len(sets))
        for a, b in links:
            f.join(a, b)
        for a in range(len(sets)):
            for b in range(a):
                o = len(np.intersect1d(sets[a], sets[b]))
                if 100 * o >= 85 * (len(sets[a]) + len(sets[b]) - o) and (side[a] != side[b]) == two:
                    g.join(a, b)
        same = lambda x: [x.root(i) for i in range(len(sets))]
        assert same(f) == same(g)


def test_similar_sets_share_a_key():
    rng = np.random.default_rng(4)
    for _ in range(400):
        size = int(rng.integers(1, 300))
        x = rng.integers(0, 2**63, size).astype(np.uint64)
        drop = int(rng.integers(0, max(1, size * 8 // 100) + 1))
        y = np.concatenate([x[drop:], rng.integers(0, 2**63, int(rng.integers(0, drop + 1))).astype(np.uint64)])
        x, y = np.unique(x), np.unique(y)
        o = len(np.intersect1d(x, y))
        if not len(y) or 100 * o < 85 * (len(x) + len(y) - o):
            continue
        keys, owner = jaccard.block_keys(np.concatenate([x, y]), np.array([len(x), len(y)]), 85)
        assert set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist())


def test_keep_one(spark):
    docs = odd.frame(spark, doubled=False)
    kept = jaccard.keep_one_of_each(docs, 5, 80)
    assert kept.columns == docs.columns
    want = {i for i, t in ((r[0], r[1]) for r in odd.rows(False)) if str((i, len(shingles(t, 5)), i)) in brute_groups([(r[0], r[1]) for r in odd.rows(False)], 5, 80)}
    assert {r.doc_id for r in kept.collect()} == want


def brute_repeats(rows, k):
    """Rows of one id count in their texts' order, equal rows as one document, a null id comes first."""
    order = sorted({(i is not None, i or 0, t or "", t) for i, t in rows}, key=lambda x: x[:3])
    seen, out = set(), {}
    for _, _, _, t in order:
        pass
    for has, i, _, t in order:
        w = words(t)
        gone = [False] * len(w)
        for a in range(len(w) - k + 1):
            key = tuple(w[a : a + k])
            if key in seen:
                gone[a : a + k] = [True] * k
            seen.add(key)
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[(i if has else None, t)] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode())
    return out


@pytest.mark.parametrize("k", [5, 20])
def test_dedup_substrings(spark, k):
    rows = [(r[0], r[1]) for r in odd.rows()]
    want = brute_repeats(rows, k)
    got = substring.dedup_substrings(odd.frame(spark), k).collect()
    assert sorted(str((i, *want[(i, t)][:3])) for i, t in rows) == sorted(str(tuple(r)) for r in got)
    assert substring.dedup_substrings(odd.frame(spark, empty=True), k).count() == 0


def test_without_repeats_keeps_rows_and_columns(spark):
    docs = odd.frame(spark)
    got = substring.without_repeats(docs, 20)
    assert got.columns == docs.columns
    want = brute_repeats([(r[0], r[1]) for r in odd.rows()], 20)
    texts = [(r[0], want[(r[0], r[1])][3] if want[(r[0], r[1])][1] else r[1]) for r in odd.rows()]
    assert sorted(map(str, texts)) == sorted(str((r.doc_id, r.text)) for r in got.select("doc_id", "text").collect())


def test_colliding_hashes_are_found(spark):
    docs = spark.createDataFrame([(1, " ".join(f"a{i}" for i in range(40))), (2, " ".join(f"b{i}" for i in range(30))), (3, "x " + " ".join(f"a{i}" for i in range(5, 35)))], "doc_id long, text string")
    want = {1: 0, 2: 0, 3: 30}
    assert {r.doc_id: r.n_removed for r in substring.dedup_substrings(docs, attempts=(0, 64)).collect()} == want
    with pytest.raises(ValueError, match="collided"):
        substring.dedup_substrings(docs, attempts=(0,))


def test_repeated_spans_lead_to_equal_words(spark):
    rows = {r[0]: words(r[1]) for r in odd.rows(False)}
    spans = substring.repeated_spans(odd.frame(spark, doubled=False), 20).collect()
    assert spans
    for s in spans:
        assert s.length >= 20
        assert rows[s.doc_id][s.start : s.start + s.length] == rows[s.source_id][s.source_start : s.source_start + s.length]
        assert (s.source_id, s.source_start) < (s.doc_id, s.start)


def test_quality_features_against_brute_force():
    for t in odd.texts() + ["a b c d e a b c d e f", "l\nl\n l\nm"]:
        f = quality.features([t, "other text"])
        w = words(t)
        c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        cover = [False] * len(w)
        for i in range(len(w) - 4):
            if c[tuple(w[i : i + 5])] > 1:
                cover[i : i + 5] = [True] * 5
        lines = [x for x in (t or "").split("\n") if words(x)]
        want = [len(w), sum(len(x.decode()) for x in w), sum((t or "").count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), sum(cover)]
        assert [int(f[k][0]) for k in quality.FEATURES[:5]] == want


def test_binomial_tail():
    from math import comb

    for n, k, p in ((10, 3, 0.2), (50, 0, 0.01), (7, 7, 0.5), (200, 4, 0.03)):
        assert abs(quality.binomial_tail(k, n, p) - sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))) < 1e-9


def test_certified_cutoffs_reject_few_good_documents():
    rng = np.random.default_rng(0)
    grid = quality.SHARES
    broken = 0
    for _ in range(200):
        good, bad = rng.beta(1, 30, 4000), rng.beta(4, 10, 500)
        cells = lambda x: np.bincount([sum(v > c for c in grid) for v in x], minlength=len(grid) + 1)
        cut = quality.choose(grid, cells(good), cells(bad), 0.01, 0.05, 1.0)
        if cut is not None:
            broken += (1 - cut) ** 30 > 0.01  # the true share above the cutoff
    assert broken <= 20
    assert quality.choose(grid, np.zeros(len(grid) + 1, int), np.zeros(len(grid) + 1, int), 0.01, 0.05, 1.0) is None


def test_verdicts_and_filter_agree(spark):
    docs = odd.frame(spark, doubled=False)
    labels = spark.createDataFrame([(i * 3, i % 2, 0) for i in range(20)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    v = {r.doc_id: r.kept for r in quality.quality_verdicts(docs, labels).collect()}
    assert len(v) == docs.count()
    kept = quality.filter_documents(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, x in v.items() if x}
    empty = odd.frame(spark, empty=True)
    assert quality.quality_verdicts(empty, labels).count() == 0 and quality.filter_documents(empty, labels).count() == 0
    assert quality.quality_verdicts(docs, labels.limit(0)).count() == docs.count()


def _labelled(spark, counts):
    """Documents and labels of strata: as many good ones as given, a tenth as many of symbols that the base passes."""
    rows, marks = [], []
    for lang, n in counts:
        for i in range(n + n // 10):
            junk = i >= n
            rows.append((len(rows), " ".join(f"{'#$%&*' if junk else 'text'}{'ab'[i % 2]}{k}" for k in range(12)), lang))
            marks.append((len(marks), 0 if junk else 1, 0))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("counts", "ruled"), [([("en", 320)], {"en"}), ([("en", 600), ("de", 500), ("fr", 500), ("es", 200)], {"en", "de", "fr"}), ([("de", 200), ("fr", 200)], {"de", "fr"}), ([("de", 100), ("fr", 100)], set())])
def test_rules_are_certified_for_the_labels_there_are(spark, counts, ruled):
    """The whole risk on the union of rules, the error shared by strata, small strata pooled."""
    docs, labels = _labelled(spark, counts)
    rejected = {}
    for r in quality.quality_verdicts(docs, labels).join(labels, "doc_id").join(docs, "doc_id").collect():
        assert not r.base_failed and (r.kept or r.quality == 0)
        rejected.setdefault(r.lang, []).append(not r.kept)
    assert {lang for lang, x in rejected.items() if any(x)} == ruled
    assert quality.filter_documents(docs, labels).count() == docs.count() - sum(n // 10 for lang, n in counts if lang in ruled)


def test_labels_needed():
    for level in (0.05, 0.0125, 0.003):
        n = quality.labels_needed(0.01, level)
        assert quality.binomial_tail(0, n, 0.01) <= level < quality.binomial_tail(0, n - 1, 0.01)


def test_certified_cutoffs_reject_what_the_definitions_say(spark):
    """End to end: strata of 500, 450 and 40 good labels; every step of the path by exact integers, the verdicts by hand."""
    from fractions import Fraction
    from math import comb

    rnd = random.Random(3)
    rows, labels = [], []
    for lang, good, bad in (("en", 500, 60), ("de", 450, 40), ("fr", 40, 10), (None, 5, 5)):
        for k in range(good + bad):
            body = [f"{rnd.choice('abcdef')}{rnd.randint(0, 10**6)}" for _ in range(40)]
            signs = rnd.randint(8, 30) if k >= good else rnd.choice((0,) * 60 + (1, 3))
            body[0] += "#" * signs
            rows.append((len(rows), " ".join(body), lang))
            labels.append((len(labels), int(k < good), 0))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    f = quality.features([r[1] for r in rows])
    s = quality.scores(f)
    steps = range(len(quality.SHARES))
    fails = lambda i, k: any(s[r][i] > grid[k] for r, grid in quality.RULES.items())

    def tail(k, n):
        return sum(comb(n, i) * Fraction(1, 100) ** i * Fraction(99, 100) ** (n - i) for i in range(k + 1))

    groups = {"en": ["en"], "de": ["de"], "pool": ["fr", None]}
    cut = {}
    for g, langs in groups.items():
        good = [i for i, r in enumerate(rows) if r[2] in langs and labels[i][1]]
        bad = [i for i, r in enumerate(rows) if r[2] in langs and not labels[i][1]]
        best, use = None, 0.0
        for k in steps:
            lost = sum(fails(i, k) for i in good)
            if tail(lost, len(good)) > Fraction(1, 20) / 3:
                break
            if (gain := sum(fails(i, k) for i in bad) - 2.0 * lost) > use:
                best, use = k, gain
        cut[g] = best
    assert cut["en"] is not None and cut["de"] is not None and cut["pool"] is None
    failed = quality.base_failed(f)
    want = {i: not failed[i] and not (r[2] in cut and fails(i, cut[r[2]])) for i, r in enumerate(rows)}
    got = {r.doc_id: r.kept for r in quality.quality_verdicts(docs, marks).collect()}
    assert got == want and sum(not k for k in want.values()) > 60
    assert {r.doc_id for r in quality.filter_documents(docs, marks).collect()} == {i for i, k in want.items() if k}
