"""Byte-level BPE encoding and decoding. Merges are found by a segment tree over the ranks of adjacent pairs.

Each pre-token is a row of leaves, one for each adjacent pair, holding (rank, position); inner nodes hold the least of
their children, so that the root is the leftmost pair of lowest rank. A merge rewrites three leaves (the merged pair
and its two neighbours), each in a logarithmic number of steps, until the root is empty. Rows of like length go through
NumPy together; the tree is the same for one row or a hundred thousand.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import flat_ranges, scan_rows

#: Pre-tokens of the byte-level family; a fixed value of the vocabulary's format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_split = regex.compile(PATTERN)
#: A space between white space: there, and only there, a space does not begin a pre-token (RE2 syntax).
_ODD_SPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}] ([\t-\r\x1c-\x20\x{85}\p{Z}]|$)"
#: Fragments that a worker remembers before it starts afresh.
MEMORY = 400_000
#: Characters of them.
MEMORY_BYTES = 32 << 20
#: Bytes of text encoded at once: the longer, the fewer fragments are looked up twice.
SLICE = 8 << 20


def _byte_letters() -> dict[str, int]:
    """The format's letter for each byte: itself if printable, else the next unused code point from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def check_settings(spec: dict) -> None:
    """ValueError for a vocabulary file with settings that ByteBPE does not follow; it would encode otherwise than the library."""
    model, before = spec.get("model") or {}, spec.get("pre_tokenizer") or {}
    wrong = [k for k in ("normalizer", "post_processor", "truncation", "padding") if spec.get(k)]
    wrong += ["model.type"] if model.get("type", "BPE") != "BPE" else []
    wrong += [f"model.{k}" for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
    wrong += ["pre_tokenizer.type"] if before.get("type") != "ByteLevel" else []
    wrong += ["pre_tokenizer.add_prefix_space"] if before.get("add_prefix_space", True) else []
    wrong += ["pre_tokenizer.use_regex"] if not before.get("use_regex", True) else []
    wrong += ["decoder"] if spec.get("decoder") and spec["decoder"].get("type") != "ByteLevel" else []
    wrong += [f"added_tokens.{k} of {t['content']}" for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized") if t.get(k)]
    if wrong:
        raise ValueError(f"settings of the vocabulary file that are not followed here: {', '.join(wrong)}")


class ByteBPE:
    """A vocabulary file of the tokenizers library (model BPE, byte level, no normaliser; see check_settings).

    Fragments between spaces are remembered with their ids until there are more than most_entries of them, or they are longer than
    most_bytes together; then all are forgotten at once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_settings(spec)
        self.most_entries, self.most_bytes = MEMORY, MEMORY_BYTES
        letters = _byte_letters()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("|".join(f"({re.escape(s)})" for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        size = max([*vocab.values(), *self.special.values()]) + 1
        piece: list[bytes] = [b""] * size
        for s, i in vocab.items():
            piece[i] = bytes(letters[c] for c in s)
        for s, i in self.special.items():
            piece[i] = s.encode()
        self.piece_len = np.array([len(p) for p in piece], np.int64)
        self.piece_at = np.cumsum(self.piece_len) - self.piece_len
        self.piece_bytes = np.frombuffer(b"".join(piece), np.uint8)
        self.byte_id = np.array([vocab[c] for c in sorted(letters, key=letters.get)], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        # The pair to (rank, merged id), in a table of open addresses
        self._mask = (1 << 18) - 1
        self._slots = np.full(self._mask + 1, -1, np.int64)
        self._ranks = np.full(self._mask + 1, -1, np.int64)
        self._rank_made = made
        left = np.arange(len(keys))
        at = self._slot(keys)
        while len(left):
            free = self._slots[at[left]] < 0
            first = left[free]
            _, take = np.unique(at[first], return_index=True)
            won = first[take]
            self._slots[at[won]] = keys[won]
            self._ranks[at[won]] = won
            left = np.setdiff1d(left, won)
            at[left] = (at[left] + 1) & self._mask
        digits = [f"{i}," for i in range(size)]
        self._digit_len = np.array([len(d) for d in digits], np.int64)
        self._digit_at = np.cumsum(self._digit_len) - self._digit_len
        self._digits = np.frombuffer("".join(digits).encode(), np.uint8)
        self._forget()

    def _forget(self) -> None:
        self._spaced: dict[str, int] = {}
        self._bare: dict[str, int] = {}
        self._ids = np.empty(1 << 20, np.uint32)
        self._used = 0
        self._at = np.zeros(1 << 18, np.int64)
        self._n = np.zeros(1 << 18, np.int64)
        self._entries = 0
        self._held = 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.int64(0x5851F42D4C957F2D)) >> np.int64(40)) & self._mask

    def _rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1. Symbols below 0 have no pairs."""
        keys = left << np.int64(20) | right
        at = self._slot(keys)
        got = self._slots[at]
        out = np.where(got == keys, self._ranks[at], np.int64(-1))
        todo = np.flatnonzero((got != keys) & (got >= 0))
        at = at[todo]
        while len(todo):
            at = (at + 1) & self._mask
            got = self._slots[at]
            hit = got == keys[todo]
            out[todo[hit]] = self._ranks[at[hit]]
            go = ~hit & (got >= 0)
            todo, at = todo[go], at[go]
        out[(left < 0) | (right < 0)] = -1
        return out

    def merge(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens, one after another, and how many each has."""
        sizes = np.array([len(t) for t in tokens], np.int64)
        flat = np.frombuffer(b"".join(tokens), np.uint8)
        first = np.cumsum(sizes) - sizes
        symbols = self.byte_id[flat]
        keep = np.ones(len(flat), bool)
        levels = np.zeros(len(sizes), np.int64)
        many = sizes > 1
        levels[many] = np.ceil(np.log2(np.maximum(sizes[many] - 1, 1))).astype(np.int64)
        for level in np.unique(levels[many]):
            rows = np.flatnonzero(many & (levels == level))
            step = max(1, (1 << 21) >> int(level))
            for i in range(0, len(rows), step):
                self._merge_rows(rows[i : i + step], int(level), sizes, first, symbols, keep)
        return symbols[keep].astype(np.uint32), np.add.reduceat(keep, first).astype(np.int64) if len(tokens) and sizes.all() else np.array([keep[a : a + n].sum() for a, n in zip(first, sizes, strict=True)], np.int64)

    def _merge_rows(self, rows, level, sizes, first, symbols, keep) -> None:
        leaves = 1 << level  # pairs; a row has up to leaves + 1 symbols
        width = leaves + 2
        n = sizes[rows]
        sym = np.full((len(rows), width), -1, np.int64)
        col = np.arange(width)
        inside = col < n[:, None]
        src = (first[rows][:, None] + col)[inside]
        sym[inside] = symbols[src]
        kind = np.int32 if level <= 14 else np.int64
        none = np.iinfo(kind).max
        shift = kind(level)
        ranks = self._rank_of(sym[:, :leaves].ravel(), sym[:, 1 : leaves + 1].ravel()).reshape(len(rows), leaves).astype(kind)
        grown = np.empty((len(rows), 2 * leaves), kind)
        grown[:, leaves:] = np.where(ranks >= 0, ranks << shift | col[:leaves].astype(kind), none)
        for d in reversed(range(level)):
            a, b = 1 << d, 2 << d
            np.minimum(grown[:, b : 2 * b : 2], grown[:, b + 1 : 2 * b : 2], out=grown[:, a:b])
        # rows lie one after another in flat arrays from here on
        tree, sym = grown.ravel(), sym.ravel()
        after = np.tile(col + 1, len(rows))
        before = np.tile(col - 1, len(rows))
        gone = np.zeros(len(sym), bool)
        live = np.flatnonzero(tree[1 :: 2 * leaves] < none)
        low = kind((1 << level) - 1)
        while len(live):
            tree_at, sym_at = live * (2 * leaves), live * width
            root = tree[tree_at + 1]
            at = (root & low).astype(np.int64)
            nxt = after[sym_at + at]
            third = after[sym_at + nxt]
            prev = before[sym_at + at]
            merged = self._rank_made[root >> shift]
            sym[sym_at + at] = merged
            gone[sym_at + nxt] = True
            after[sym_at + at] = third
            end = third < width
            before[(sym_at + third)[end]] = at[end]
            has = prev >= 0
            right = np.where(end, sym[sym_at + np.minimum(third, width - 1)], -1)
            left = np.where(has, sym[sym_at + np.maximum(prev, 0)], -1)
            rank = self._rank_of(np.concatenate([merged, left]), np.concatenate([right, merged])).astype(kind)
            pos = np.concatenate([at, prev])
            leaf = np.where(rank >= 0, rank << shift | pos.astype(kind), none)
            inner, held = nxt < leaves, np.concatenate([at < leaves, has])
            base = np.concatenate([np.concatenate([tree_at, tree_at])[held], tree_at[inner]])
            node = np.concatenate([pos[held], nxt[inner]]) + leaves
            tree[base + node] = np.concatenate([leaf[held], np.full(int(inner.sum()), none, kind)])
            for _ in range(level):
                node >>= 1
                under = base + 2 * node
                tree[base + node] = np.minimum(tree[under], tree[under + 1])
            live = live[tree[tree_at + 1] < none]
        symbols[src] = sym.reshape(-1, width)[inside]
        keep[src] = ~gone.reshape(-1, width)[inside]

    def _enter(self, ids: np.ndarray, counts: np.ndarray) -> int:
        """Keeps the ids of new entries; returns the number of the first."""
        need, k = self._used + len(ids), self._entries + len(counts)
        if need > len(self._ids):
            self._ids = np.concatenate([self._ids, np.empty(max(need, len(self._ids)), np.uint32)])
        if k > len(self._at):
            grow = np.zeros(max(k, len(self._at)), np.int64)
            self._at, self._n = np.concatenate([self._at, grow]), np.concatenate([self._n, grow])
        self._ids[self._used : need] = ids
        self._at[self._entries : k] = self._used + np.cumsum(counts) - counts
        self._n[self._entries : k] = counts
        start, self._used, self._entries = self._entries, need, k
        return start

    def learn(self, fragments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all fragments, one after another, and how many each has."""
        parts = [[s] if s[1:].isalpha() and (s[0] == " " or s[0].isalpha()) else _split.findall(s) for s in fragments]
        k = np.fromiter(map(len, parts), np.int64, len(parts))
        known: dict[str, int] = {}
        each = np.fromiter((known.setdefault(p, len(known)) for ps in parts for p in ps), np.int64, int(k.sum()))
        ids, counts = self.merge([p.encode("utf-8", "surrogatepass") for p in known])
        n = counts[each]
        ends = np.concatenate(([0], np.cumsum(n)))
        upto = np.cumsum(k)
        return ids[flat_ranges((np.cumsum(counts) - counts)[each], n)], ends[upto] - ends[upto - k]

    def _known(self, fragments: pa.Array, known: dict[str, int], lead: str) -> np.ndarray:
        """The entry of each fragment; those not seen before are learned first."""
        coded = fragments.dictionary_encode()
        own = coded.dictionary.to_pylist()
        at = np.fromiter((known.get(s, -1) for s in own), np.int64, len(own))
        new = np.flatnonzero(at < 0)
        if len(new):
            missing = [own[i] for i in new.tolist()]
            self._held += sum(map(len, missing))
            start = self._enter(*self.learn([lead + s for s in missing]))
            known.update(zip(missing, range(start, start + len(missing)), strict=True))
            at[new] = np.arange(start, start + len(missing))
        return at[coded.indices.to_numpy(zero_copy_only=False)]

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after another, and how many each text has. Null counts as empty."""
        if self._entries > self.most_entries or self._held > self.most_bytes:
            self._forget()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, _ODD_SPACE).to_numpy(zero_copy_only=False)
        for s in self.special:
            odd |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        pieces = pc.split_pattern(pc.if_else(pa.array(odd), "", texts) if odd.any() else texts, " ")
        starts = pieces.offsets.to_numpy().astype(np.int64)
        values = pieces.flatten()
        starts -= starts[0]
        heads = starts[:-1]
        entry = self._known(values, self._spaced, " ") if len(values) else np.empty(0, np.int64)
        entry[heads] = self._known(values.take(pa.array(heads)), self._bare, "")
        n = self._n[entry]
        ids = self._ids[flat_ranges(self._at[entry], n)]
        ends = np.concatenate(([0], np.cumsum(n)))
        counts = ends[starts[1:]] - ends[heads]
        if not odd.any():
            return ids, counts
        out = [ids[ends[a] : ends[b]] for a, b in zip(heads, starts[1:], strict=True)]
        for i in np.flatnonzero(odd).tolist():
            text = texts[i].as_py()
            parts = [p for p in self._special.split(text) if p] if self._special else [text]
            tokens = [(p, t) for p in parts for t in ([p] if p in self.special else _split.findall(p))]
            got = self._known(pa.array([t for p, t in tokens if p not in self.special], pa.large_string()), self._bare, "").tolist()
            got.reverse()
            own = [np.array([self.special[p]], np.uint32) if p in self.special else self._ids[self._at[e := got.pop()] : self._at[e] + self._n[e]] for p, _ in tokens]
            out[i] = np.concatenate(own)
            counts[i] = len(out[i])
        return np.concatenate(out), counts

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids' pieces; special tokens count as their text."""
        return self.piece_bytes[flat_ranges(self.piece_at[ids], self.piece_len[ids])].tobytes()

    def decimal(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by commas."""
        return self._digits[flat_ranges(self._digit_at[ids], self._digit_len[ids])].tobytes()[:-1]


_loaded: dict[str, ByteBPE] = {}


def load(path: str) -> ByteBPE:
    """The vocabulary, read once for each worker process."""
    if path not in _loaded:
        _loaded[path] = ByteBPE(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encodes every whole text and decodes it again.

    Returns id_col, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256 (of the decoded text in
    UTF-8) and, if asked for, token_ids. Null and empty texts have no tokens; repeated rows stay; other columns are
    left out. Equal to the tokenizers library with add_special_tokens=False, special tokens in the text included.
    """
    src = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    schema = f"__id {src.schema['__id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids

    def run(batches):
        bpe = load(vocab)
        for (keys,), texts in scan_rows(batches, "__text", ["__id"], SLICE):
            ids, counts = bpe.encode_batch(texts)
            ends = np.cumsum(counts)
            sums, decoded, lists = [], [], []
            for n, e in zip(counts.tolist(), ends.tolist(), strict=True):
                own = ids[e - n : e]
                sums.append(hashlib.sha256(bpe.decimal(own)).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(own).decode("utf-8", "replace").encode()).hexdigest())
                if with_ids:
                    lists.append(own.astype(np.int32))
            cols = [keys, pa.array(counts), pa.array(sums, pa.string()), pa.array(decoded, pa.string())]
            names = ["__id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols.append(pa.array(lists, pa.list_(pa.int32())))
                names.append("token_ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    return src.mapInArrow(run, schema).withColumnRenamed("__id", id_col)
