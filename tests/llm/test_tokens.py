"""Encoding, counts by section and packing, against the tokenizers library and brute force."""

import json
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from strandline.llm import bpe, packing, token_counts
from tests.llm import odd

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_random_strings_are_encoded_as_by_the_library(library):
    rnd = random.Random(3)
    parts = ["a", " ", "  ", "\n", "\t", "<|endoftext|>", "é", "'s", "'t", "12", "Ⅷ", "¼", " ", "　", "\x1c", "\x85", "!", "_", "日本", "🙂", "th", "the ", "ing", "\r\n", "ﬁ", "​", "́"]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 14))) for _ in range(3000)] + [None, "z" * 3000, "ab" * 900]
    own = bpe.ByteBPE(PATH)
    ids, counts = own.encode_batch(pa.array(texts))
    ends = np.cumsum(counts)
    for text, n, e in zip(texts, counts, ends):
        assert library.encode(text or "", add_special_tokens=False).ids == ids[e - n : e].tolist(), repr(text)
        assert own.decode(ids[e - n : e]).decode() == (text or "")


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 5)
    own = bpe.ByteBPE(PATH)
    for text in odd.texts() * 2:
        ids, _ = own.encode_batch(pa.array([text], pa.string()))
        assert ids.tolist() == library.encode(text or "", add_special_tokens=False).ids


def test_documents(spark, library):
    got = sorted(bpe.encode_documents(odd.frame(spark), PATH, with_ids=True).collect(), key=str)
    want = []
    for r in odd.rows():
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest(), ids))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
    assert bpe.encode_documents(odd.frame(spark, empty=True), PATH).count() == 0


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_section_counts(spark, library, rule):
    own = bpe.ByteBPE(PATH)
    want = []
    for r in odd.rows():
        text = r[1] or ""
        lines = text.split("\n")
        lines = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] or len(lines) == 1 else [])
        bounds, at = [], 0
        for x in lines:
            bounds.append((at, at + len(x.encode())))
            at = bounds[-1][1]
        n, over, at = [0] * len(lines), [0] * len(lines), 0
        for i in library.encode(text, add_special_tokens=False).ids:
            size = int(own.piece_len[i])
            held = [min(at + size, b) - max(at, a) for a, b in bounds]
            hit = [k for k, h in enumerate(held) if h > 0]
            k = hit[0] if rule == "first" else hit[-1] if rule == "last" else max(hit, key=lambda j: (held[j], -j))
            n[k] += 1
            over[k] += len(hit) > 1
            at += size
        c = 0
        for k, x in enumerate(lines):
            want.append((r[0], k, c, c + len(x), n[k], over[k]))
            c += len(x)
    got = token_counts.count_tokens(odd.frame(spark), PATH, rule=rule).collect()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)


def test_a_token_over_a_boundary_is_given_by_the_rule():
    # three tokens of 2, 5 and 1 bytes over sections [0, 3), [3, 6), [6, 8)
    a, b = np.array([0, 2, 7]), np.array([2, 7, 8])
    s, e = np.array([0, 3, 6]), np.array([3, 6, 8])
    assert [token_counts.allocate(a, b, s, e, r)[0].tolist() for r in token_counts.RULES] == [[0, 0, 2], [0, 2, 2], [0, 1, 2]]


def test_packing_rows(spark, library):
    size = 64
    got = [r.asDict() for r in packing.pack_documents(odd.frame(spark), PATH, size=size).collect()]
    want = []
    for r in odd.rows():
        ids = library.encode(r[1] or "", add_special_tokens=False).ids + [2]
        first = len(ids) - (len(ids) - 1) // size * size
        cuts = [0, *range(first, len(ids) + 1, size)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.append((r[0], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted(map(str, want)) == sorted(str((g["doc_id"], g["piece"], g["start"], g["length"], g["ids_crc32"])) for g in got)
    by = defaultdict(list)
    for g in got:
        by[g["sequence_id"]].append((g["offset"], g["length"]))
    for places in by.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= size
    assert packing.pack_documents(odd.frame(spark, empty=True), PATH).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plans_hold_every_piece_and_few_sequences(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(rng.lognormal(6, 1, (40, 400, 3000, 20000)[seed]).astype(int) + 1, 1024)
    h = np.bincount(lengths, minlength=1025)
    plan = packing.plan(h, 1024)
    held = np.zeros(1025, int)
    for seq, n in plan:
        assert sum(seq) <= 1024
        np.add.at(held, seq, n)
    assert (held == h).all()
    least = -(-int(lengths.sum()) // 1024)
    assert sum(n for _, n in plan) <= least * 1.01 + 2


def test_knapsack_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(40):
        size = 24
        lengths = np.sort(rng.choice(np.arange(1, size + 1), rng.integers(1, 8), replace=False))
        prices = np.round(rng.random(len(lengths)), 3)
        bag = packing.Knapsack(lengths, size)
        bag.solve(prices)
        best = [0.0] * (size + 1)
        for c in range(1, size + 1):
            best[c] = max([best[c - 1]] + [best[c - n] + p for n, p in zip(lengths.tolist(), prices.tolist(), strict=True) if n <= c])
        assert np.allclose(bag.within(np.arange(size + 1)), best)
        for room in range(size + 1):
            own = bag.choice(room)
            assert lengths[own].sum() <= room and abs(prices[own].sum() - best[room]) < 1e-9


@pytest.mark.parametrize(("lengths", "saved"), [((342, 350, 500, 530, 1024), 0), ((341, 342, 343, 170, 171, 172, 512, 513), 200), ((300, 310, 420, 410, 256, 250), 500)])
def test_moving_weights_save_sequences(lengths, saved):
    """No worse than best fit, better where lengths must be combined, and within a fiftieth of the bound below all covers.
    Without weights that move only the best fit's sequences would be left."""
    h = np.bincount(np.random.default_rng(1).choice(lengths, 20000), minlength=1025)
    amounts, bound = packing.cover(h, 1024)
    covered = np.zeros(1025)
    for c, x in amounts.items():
        assert sum(c) <= 1024 and x > 0
        np.add.at(covered, list(c), x)
    assert (covered[list(lengths)] >= h[list(lengths)] * (1 - 1e-9)).all() and bound <= sum(amounts.values())
    n, plain = (sum(k for _, k in p) for p in (packing.plan(h, 1024), packing.best_fit(h, 1024)))
    assert n <= plain - saved and n <= bound * 1.02 + 1


def test_closed_gaps_end_the_rounds():
    h = np.bincount(np.random.default_rng(0).integers(1, 40, 5000), minlength=1025)
    amounts, bound = packing.cover(h, 1024)
    assert sum(amounts.values()) <= bound * 1.01 + 1 and packing.cover(np.zeros(1025, int), 1024) == ({}, 0.0) and packing.plan(np.zeros(1025, int), 1024) == []


@pytest.mark.parametrize(
    ("where", "key", "value"),
    [
        ((), "normalizer", {"type": "Lowercase"}),
        (("model",), "ignore_merges", True),
        (("model",), "end_of_word_suffix", "</w>"),
        (("pre_tokenizer",), "add_prefix_space", True),
        (("pre_tokenizer",), "type", "Metaspace"),
        (("added_tokens", 0), "lstrip", True),
        (("added_tokens", 0), "single_word", True),
        ((), "truncation", {"max_length": 8}),
    ],
)
def test_files_with_other_settings_are_refused(tmp_path, where, key, value):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    at = spec
    for k in where:
        at = at[k]
    at[key] = value
    (tmp_path / "v.json").write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError, match=key):
        bpe.ByteBPE(str(tmp_path / "v.json"))


def test_what_is_remembered_is_bounded_by_characters_too():
    b = bpe.ByteBPE(public_tokenizers.path("byte_bpe_50k.json"))
    b.most_bytes = 1000
    texts = [f"{'ab' * 300}{i} c{i}" for i in range(20)]
    want = [b.encode_batch(pa.array(texts, pa.large_string()))[0].tolist() for _ in range(1)][0]
    got = []
    for t in texts:
        got += b.encode_batch(pa.array([t], pa.large_string()))[0].tolist()
        assert b._held < 1000 + 700
    assert got == want
