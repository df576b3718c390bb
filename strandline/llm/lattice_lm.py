"""Document likelihood under a unigram model over subwords: all segmentations count, by recursion over the lattice.

The vocabulary and its scores are given (a public tokenizer's pieces). A word is a blank and its bytes: a piece that
begins with the blank, further pieces, and a stop; its probability is the sum over all its segmentations. The file's
scores weigh them: a score s, which is minus the piece's rank, counts as (10 - s) ** -slope, normalised among the pieces
that begin a word and among the others, where the stop has as much as all of them. The slope is learned: of a few, the
one under which the training texts are most probable. A text's probability is the product of its words' and the end's,
whose share of all tokens is learned too.

The fuller model starts there and learns from the training texts: their distinct words pass the lattice forward and
backward, and the expected uses of each piece are its weight, with the law's shares as a twentieth more. In each word's
lattice there is one more arc for the word as a whole, with its discounted frequency in the training texts; the
discounts are what all segmentations together share. So a word that the training texts lack costs its spelling.

Words and counts are gathered from all texts. Each chunk of texts (a range of ids) asks for the words it holds and
gets back their counts and probabilities, so that a task holds the words of one chunk, however large the corpus is.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import dealt, numbered_ranges, scan_rows, word_codes, word_hashes, written

#: Bytes of text that share a dictionary, and distinct words that a task counts before it sends them on.
CHUNK_BYTES = 24 << 20
COUNTED = 400_000
#: Chunks that one row of a word lists at most; a word of more chunks has more rows.
LISTED = 1024
#: Slopes of the law that turns the vocabulary's ranks into probabilities.
SLOPES = (0.5, 0.75, 1.0, 1.25, 1.5)
#: The law's shares count, beside the training words that pieces are learned from, as this share of them more.
LAW_SHARE = 0.05
#: Words up to this many bytes pass the lattice together with others of their length.
SHORT = 48
_NEG = -1e30


class Lattice:
    """Pieces as byte strings in a trie; a word is a blank and its bytes. Every single byte is a piece."""

    def __init__(self, model: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        scores: dict[bytes, float] = {}
        for i in range(sp.get_piece_size()):
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i):
                continue
            piece = sp.id_to_piece(i).replace("▁", " ").encode()
            scores[piece] = max(scores.get(piece, -math.inf), sp.get_score(i))
        # bytes that are no pieces come after all of them
        for b in range(256):
            scores.setdefault(bytes([b]), min(-float(sp.get_piece_size()), sp.get_score(sp.piece_to_id(f"<0x{b:02X}>"))))
        self.pieces = sorted(scores)
        self.ranks = -np.array([scores[x] for x in self.pieces])
        self.begins = np.array([x.startswith(b" ") for x in self.pieces])
        self.longest = max(map(len, self.pieces))
        step: list[dict[int, int]] = [{}]
        self._end: list[int] = [-1]
        for k, piece in enumerate(self.pieces):
            node = 0
            for byte in piece:
                if byte not in step[node]:
                    step[node][byte] = len(step)
                    step.append({})
                    self._end.append(-1)
                node = step[node][byte]
            self._end[node] = k
        self._step = step
        arcs = sorted((node << 8 | byte, child) for node, to in enumerate(step) for byte, child in to.items())
        self._arcs = np.array([a for a, _ in arcs], np.int64)
        self._child = np.array([c for _, c in arcs], np.int64)
        self._piece = np.array(self._end, np.int64)

    def _edges(self, codes: np.ndarray):
        """(start, end, rows, pieces) of the lattice of words of one length, ascending by start."""
        n, size = codes.shape
        for i in range(size):
            rows, state = np.arange(n), np.zeros(n, np.int64)
            for j in range(i, min(size, i + self.longest)):
                arc = state << 8 | codes[rows, j]
                at = np.minimum(np.searchsorted(self._arcs, arc), len(self._arcs) - 1)
                on = self._arcs[at] == arc
                rows, state = rows[on], self._child[at[on]]
                if not len(rows):
                    break
                piece = self._piece[state]
                full = piece >= 0
                if full.any():
                    yield i, j + 1, rows[full], piece[full]

    def weights(self, slopes: tuple[float, ...]) -> np.ndarray:
        """Natural logs of the pieces' probabilities under each slope (columns). The stop has log 1/2."""
        w = -np.outer(np.log(10.0 + self.ranks), slopes)
        for own, share in ((self.begins, 1.0), (~self.begins, 0.5)):
            top = w[own].max(axis=0)
            w[own] += math.log(share) - top - np.log(np.exp(w[own] - top).sum(axis=0))
        return w

    def expected(self, words: list[bytes], logp: np.ndarray) -> np.ndarray:
        """Expected uses of every piece in the words, over all their segmentations; logp is one column."""
        out = np.zeros(len(self.pieces))
        for at, codes in self._by_length([b" " + w for w in words]):
            if codes is None:
                for w in at:
                    self._expected_long(w, logp, out)
                continue
            edges = list(self._edges(codes))
            alpha = self.forward(codes, logp[:, None], edges)[:, :, 0]
            beta = np.full(alpha.shape, _NEG)
            beta[:, -1] = 0.0
            for i, j, rows, piece in reversed(edges):
                through = logp[piece] + beta[rows, j]
                beta[rows, i] = np.logaddexp(beta[rows, i], through)
                out += np.bincount(piece, weights=np.exp(alpha[rows, i] + through - alpha[rows, -1]), minlength=len(out))
        return out

    def _expected_long(self, word: bytes, logp: np.ndarray, out: np.ndarray) -> None:
        alpha = self._long(word, logp[:, None])[:, 0]
        beta = np.full(len(word) + 1, _NEG)
        beta[-1] = 0.0
        for i in range(len(word) - 1, -1, -1):
            node = 0
            for j in range(i, min(len(word), i + self.longest)):
                node = self._step[node].get(word[j], 0)
                if not node:
                    break
                k = self._end[node]
                if k >= 0:
                    through = logp[k] + beta[j + 1]
                    beta[i] = np.logaddexp(beta[i], through)
                    out[k] += math.exp(alpha[i] + through - alpha[-1])

    def forward(self, codes: np.ndarray, logp: np.ndarray, edges: list | None = None) -> np.ndarray:
        """Log-probability of every prefix of every word: alpha[:, j] sums over all segmentations of the first j bytes."""
        alpha = np.full((len(codes), codes.shape[1] + 1, logp.shape[1]), _NEG)
        alpha[:, 0] = 0.0
        for i, j, rows, piece in self._edges(codes) if edges is None else edges:
            alpha[rows, j] = np.logaddexp(alpha[rows, j], alpha[rows, i] + logp[piece])
        return alpha

    def _long(self, word: bytes, logp: np.ndarray) -> np.ndarray:
        alpha = np.full((len(word) + 1, logp.shape[1]), _NEG)
        alpha[0] = 0.0
        for i in range(len(word)):
            node = 0
            for j in range(i, min(len(word), i + self.longest)):
                node = self._step[node].get(word[j], 0)
                if not node:
                    break
                k = self._end[node]
                if k >= 0:
                    alpha[j + 1] = np.logaddexp(alpha[j + 1], alpha[i] + logp[k])
        return alpha

    @staticmethod
    def _by_length(words: list[bytes]):
        """(places, their bytes as rows) of words of one length, some thousands at once; (words, None) of long ones."""
        sizes = np.array([len(w) for w in words], np.int64)
        for size in np.unique(sizes).tolist():
            same = np.flatnonzero(sizes == size)
            if size > SHORT:
                yield [words[i] for i in same.tolist()], None
                continue
            for a in range(0, len(same), 8000):
                at = same[a : a + 8000]
                yield at, np.frombuffer(b"".join([words[i] for i in at.tolist()]), np.uint8).reshape(-1, size)

    def log_probability(self, words: list[bytes], logp: np.ndarray) -> np.ndarray:
        """Natural log of each word's marginal probability, its stop among it, under each column of logp."""
        words = [b" " + w for w in words]
        out = np.empty((len(words), logp.shape[1]))
        sizes = np.array([len(w) for w in words], np.int64)
        for size in np.unique(sizes).tolist():
            same = np.flatnonzero(sizes == size)
            for a in range(0, len(same), 8000):
                at = same[a : a + 8000]
                if size > SHORT:
                    out[at] = [self._long(words[i], logp)[-1] for i in at.tolist()]
                else:
                    codes = np.frombuffer(b"".join([words[i] for i in at.tolist()]), np.uint8).reshape(-1, size)
                    out[at] = self.forward(codes, logp)[:, -1]
        return out + math.log(0.5)


_loaded: dict[str, Lattice] = {}


def lattice(model: str) -> Lattice:
    if model not in _loaded:
        _loaded[model] = Lattice(model)
    return _loaded[model]


def held_out(id_: Column) -> Column:
    """crc32 of the id as text is divisible by ten; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def _count_words(src: DataFrame) -> DataFrame:
    """(word, h, chunk, c): the chunk holds the word, c times in training texts. A task adds up what it has read."""

    def run(batches):
        held: dict[int, dict[bytes, int]] = {}

        def send():
            for k, found in held.items():
                words = list(found)
                h = word_hashes(words).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(h), pa.array(np.full(len(words), k, np.int32)), pa.array(list(found.values()), pa.int64())], ["word", "h", "chunk", "c"])
            held.clear()

        for (chunk, out), texts in scan_rows(batches, "__text", ["__chunk", "__out"]):
            doc, codes, own = word_codes(texts)
            chunk, train = chunk.to_numpy(), ~out.to_numpy(zero_copy_only=False)
            for k in np.unique(chunk).tolist():
                on = chunk[doc] == k
                c = np.bincount(codes[on], weights=train[doc[on]], minlength=len(own)).astype(np.int64)
                there = np.flatnonzero(np.bincount(codes[on], minlength=len(own)))
                found = held.setdefault(k, {})
                for i, n in zip(there.tolist(), c[there].tolist(), strict=True):
                    found[own[i]] = found.get(own[i], 0) + n
            if sum(map(len, held.values())) > COUNTED:
                yield from send()
        yield from send()

    return src.mapInArrow(run, "word binary, h long, chunk int, c long")


def learn_slope(words: DataFrame, model: str, slopes: tuple[float, ...] = SLOPES) -> float:
    """The slope under which the training texts' words (word, c) are most probable; the first one without any."""

    def run(batches):
        lat = lattice(model)
        logp, total = lat.weights(slopes), np.zeros(len(slopes))
        for b in batches:
            total += b.column("c").to_numpy() @ lat.log_probability(b.column("word").to_pylist(), logp)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(slopes))), pa.array(total)], ["k", "lp"])

    sums = words.where("c > 0").select("word", "c").mapInArrow(run, "k long, lp double").groupBy("k").agg(F.sum("lp").alias("lp")).collect()
    return slopes[max(sums, key=lambda r: (r.lp, -r.k)).k] if sums else slopes[0]


def learn_pieces(words: DataFrame, model: str, slope: float) -> tuple[np.ndarray, float]:
    """Natural logs of the pieces' probabilities and of the stop's: expected uses in the distinct training words
    (word, c) under the law of the slope, and the law's shares. Without training words, the law."""

    def run(batches):
        lat = lattice(model)
        logp, total, n = lat.weights((slope,))[:, 0], np.zeros(len(lat.pieces)), 0
        for b in batches:
            total += lat.expected(b.column("word").to_pylist(), logp)
            n += b.num_rows
        at = np.flatnonzero(total)
        # the words themselves, each of which has a stop, under the number -1
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], float(n)))], ["k", "n"])

    uses = dict(map(tuple, words.where("c > 0").select("word").mapInArrow(run, "k long, n double").groupBy("k").agg(F.sum("n")).collect()))
    lat = lattice(model)
    seen = uses.pop(-1, 0.0)
    law = max(1.0, LAW_SHARE * seen)
    n = law * np.exp(lat.weights((slope,))[:, 0])
    at = np.fromiter(uses, np.int64, len(uses))
    n[at] += np.fromiter(uses.values(), float, len(uses))
    stops = seen + 0.5 * law
    inner = n[~lat.begins].sum() + stops
    return np.log(n / np.where(lat.begins, n[lat.begins].sum(), inner)), math.log(stops / inner)


def score_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", slopes: tuple[float, ...] = SLOPES) -> DataFrame:
    """Log10-probabilities of every whole text, learned from those that held_out() leaves.

    Returns id_col, held_out, n_tokens (words and one end), n_known (tokens seen in training), train_tokens,
    base_score (smoothed frequencies of words), score (the lattice's under the file's law: the sum over all segmentations)
    and word_score (the fuller model's: a word's discounted training frequency as one more arc, and the lattice under
    learned pieces with what all words gave up). A-Z are lower-cased;
    null and empty texts are an end alone; a null id is held out; repeated rows are scored and learned each; with no
    training text all words are unknown, the first slope counts and an end is one of two tokens; an empty table gives an
    empty result; other columns are left out. Words meet their counts by 64-bit hashes.
    """
    src = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"), held_out(F.col(id_col)).alias("__out"))
    size = src.agg(F.sum(F.octet_length("__text")), F.sum(F.when(~F.col("__out"), 1).otherwise(0))).first()
    n_train = int(size[1] or 0)
    chunks = max(1, -(-int(size[0] or 0) // CHUNK_BYTES))
    kind = docs.schema[id_col].dataType.typeName()
    if kind in ("long", "integer", "short", "byte"):
        src, chunks = numbered_ranges(src, "__id", chunks, "__chunk")
    else:
        src = src.withColumn("__chunk", F.pmod(F.xxhash64("__id"), F.lit(chunks)).cast("int"))
    listed = written(_count_words(src).groupBy("word", "h", F.floor(F.col("chunk") / LISTED).alias("part")).agg(F.sum("c").alias("c"), F.collect_set("chunk").alias("chunks")), "words")
    words = written(listed.groupBy("word", "h").agg(F.sum("c").alias("c")), "counts")
    n_words, distinct, once, twice = words.agg(F.sum("c"), *[F.sum(F.when(F.expr(f"c {x}"), 1).otherwise(0)) for x in ("> 0", "= 1", "= 2")]).first()
    total = int(n_words or 0) + n_train
    v = int(distinct or 0) + (1 if n_train else 0)
    slope = learn_slope(words, model, slopes)
    learned, stop = learn_pieces(words, model, slope)
    # the share of words among tokens, and what a seen word gives up to all segmentations together
    more = math.log((int(n_words or 0) + 1) / (total + 2))
    discount = min(0.95, max(0.1, (once or 0) / max(1, (once or 0) + 2 * (twice or 0))))
    rest = math.log(discount * v / total) if total else 0.0

    def weigh(batches):
        lat = lattice(model)
        logp = np.column_stack([lat.weights((slope,)), learned])
        for b in batches:
            lp, spelled = lat.log_probability(b.column("word").to_pylist(), logp).T
            whole = np.maximum(b.column("c").to_numpy() - discount, 0.0) / max(total, 1)
            mixed = np.logaddexp(spelled - math.log(0.5) + stop + rest, np.where(whole > 0, np.log(np.maximum(whole, 1e-300)), -np.inf))
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("c"), pa.array((lp + more) / math.log(10)), pa.array(mixed / math.log(10))], ["h", "c", "lp", "mixed"])

    # a word of very many chunks has several rows of lists, each with a copy of its weights
    weighed = written(words.mapInArrow(weigh, "h long, c long, lp double, mixed double"), "weights").withColumnRenamed("h", "k")
    answers = listed.select("h", "chunks").join(weighed, F.col("h") == F.col("k")).select(F.explode("chunks").alias("chunk"), F.lit(0).alias("kind"), "h", "c", "lp", "mixed")
    asked = src.select(F.col("__chunk").alias("chunk"), F.lit(1).alias("kind"), F.col("__id"), "__text", "__out")
    meeting = dealt(answers.unionByName(asked, allowMissingColumns=True), "chunk", chunks).sortWithinPartitions("chunk", "kind")
    id_type = src.schema["__id"].dataType.simpleString()
    denominator = total + 0.1 * (v + 1)
    end_base, end_score, end_mixed = math.log10((n_train + 0.1) / denominator), math.log10((n_train + 1) / (total + 2)), math.log10(max(n_train - discount, 0.05) / max(total, 1))

    def run(batches):
        parts: list = []
        keys = base = lp = mixed = known = None
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            chunk = batch.column("chunk").to_numpy()
            cut = np.flatnonzero((kind[1:] != kind[:-1]) | (chunk[1:] != chunk[:-1])) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(kind)], strict=True):
                if a == b:
                    continue
                t = batch.slice(a, b - a)
                if kind[a] == 0:
                    if keys is not None:
                        parts, keys = [], None
                    if parts and parts[0][0] != chunk[a]:
                        parts = []
                    parts.append((chunk[a], t.column("h").to_numpy().view(np.uint64), t.column("c").to_numpy(), t.column("lp").to_numpy(), t.column("mixed").to_numpy()))
                    continue
                if keys is None:
                    own = [p for p in parts if p[0] == chunk[a]]
                    keys = np.concatenate([p[1] for p in own]) if own else np.empty(0, np.uint64)
                    order = np.argsort(keys)
                    keys = keys[order]
                    c = np.concatenate([p[2] for p in own])[order] if own else np.empty(0)
                    lp, mixed = (np.concatenate([p[x] for p in own])[order] if own else np.empty(0) for x in (3, 4))
                    base, known, parts = np.log10((c + 0.1) / denominator), c > 0, []
                for (ids, outs), texts in scan_rows([t], "__text", ["__id", "__out"]):
                    doc, codes, own = word_codes(texts)
                    n = np.bincount(doc, minlength=len(texts))
                    h = word_hashes(own)
                    at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
                    sums = [np.bincount(doc, weights=x[at][codes], minlength=len(texts)) if len(codes) else np.zeros(len(texts)) for x in (base, lp, known, mixed)]
                    yield pa.RecordBatch.from_arrays(
                        [ids, outs, pa.array(n + 1), pa.array(sums[2].astype(np.int64) + (n_train > 0)), pa.array(np.full(len(n), total)), pa.array(sums[0] + end_base), pa.array(sums[1] + end_score), pa.array(sums[3] + end_mixed)],
                        ["__id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "word_score"],
                    )

    out = meeting.mapInArrow(run, f"__id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, word_score double")
    return out.withColumnRenamed("__id", id_col)
