"""Removal of long word sequences that occur earlier in the corpus, on a compacted graph of word k-mers.

A window of k words is an edge of the De Bruijn graph of the corpus. Edges are dealt out by the least hash of the
six-word grams inside them (their minimizer), which equal windows share; runs of edges under one minimizer travel as
one row. Only minimizers that occur again are followed. Where edges meet, all but the earliest occurrence of each are
repeats, and neighbouring repeats with neighbouring sources are compacted at once. A Spark join then glues the pieces
that continue each other, in the text and in their source, into maximal nonbranching paths with source coordinates.
Every path is then verified: the words at its own and at its source coordinates must have the same 128-bit digest. If one
path fails, 64-bit hashes have collided, and all is done again with other hashes.
Occurrences are reduced in every slice before they are sent, so that a passage that all documents share is no group of
all documents: a slice sends its earliest occurrence only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import Scratch, flat_ranges, runs, scan_rows, text_hashes, window_hashes, words_of, written, written_alone

GRAM = 6
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)
_PIECE = ("d", "o", "start", "n", "sd", "so", "ss")
_NO_ID = -(1 << 63)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with __sl_d (the id, nulls as the least), __sl_o (a text's rank among rows of one id, mostly 0) and __sl_text."""
    d = F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID))
    src = docs.withColumns({"__sl_d": d, "__sl_text": F.col(text_col).cast("string")})
    twice = docs.select(d.alias("__sl_t")).groupBy("__sl_t").count().where("count > 1").drop("count")
    if twice.isEmpty():
        return src.withColumn("__sl_o", F.lit(0))
    twice = written(twice, "twice")
    again = src.join(twice, F.col("__sl_d") == F.col("__sl_t"), "left_semi")
    once = src.join(twice, F.col("__sl_d") == F.col("__sl_t"), "left_anti").withColumn("__sl_o", F.lit(0))
    rank = F.dense_rank().over(Window.partitionBy("__sl_d").orderBy("__sl_text")) - 1
    return once.unionByName(again.withColumn("__sl_o", rank))


class Slice:
    """Word hashes of some texts, one after another, with each window's minimizer."""

    def __init__(self, texts: pa.Array, k: int, seed: int, bits: int):
        self.h, self.counts = text_hashes(texts, lower=False, seed=seed)
        if bits < 64:
            self.h = self.h & np.uint64((1 << bits) - 1)
        self.first = np.cumsum(self.counts) - self.counts
        self.k = k
        windows = np.maximum(self.counts - k + 1, 0)
        self.at = flat_ranges(self.first, windows)  # starts of the windows, as places in h
        self.doc = np.repeat(np.arange(len(texts)), windows)
        gram = min(GRAM, k)
        self.grams = window_hashes(self.h, gram)
        if len(self.at):
            least = self.grams[self.at]
            self.arg = self.at.copy()
            for s in range(1, k - gram + 1):
                v = self.grams[self.at + s]
                less = v < least
                least = np.where(less, v, least)
                self.arg[less] = self.at[less] + s
        else:
            self.arg = self.at

    def edges(self, keep: np.ndarray) -> np.ndarray:
        e = window_hashes(self.h, self.k)
        return e[self.at[keep]] if len(e) else np.empty(0, np.uint64)


def repeats(group: np.ndarray | None, e: np.ndarray, d: np.ndarray, o: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window whether an earlier one (by d, o, pos) in its group has its hash, and the earliest one's index."""
    order = np.lexsort((pos, o, d, e) if group is None else (pos, o, d, e, group))
    se = e[order]
    new = np.concatenate(([True], se[1:] != se[:-1])) if len(se) else np.empty(0, bool)
    if group is not None and len(se):
        g = group[order]
        new[1:] |= g[1:] != g[:-1]
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(se)), 0))] if len(se) else order
    source = np.empty(len(e), np.int64)
    source[order] = head
    later = (d != d[source]) | (o != o[source]) | (pos != pos[source])
    return later, source


def pieces_of(d, o, pos, source, later) -> dict[str, np.ndarray]:
    """Repeats as runs of neighbouring windows whose sources are neighbours too."""
    i = np.flatnonzero(later)
    i = i[np.lexsort((pos[i], pos[i] - pos[source[i]], o[source[i]], d[source[i]], o[i], d[i]))]
    s = source[i]
    cols = {"d": d[i], "o": o[i], "start": pos[i], "sd": d[s], "so": o[s], "ss": pos[s]}
    if not len(i):
        return cols | {"n": pos[i]}
    new = np.ones(len(i), bool)
    same = np.ones(len(i) - 1, bool)
    for c in ("d", "o", "sd", "so"):
        same &= cols[c][1:] == cols[c][:-1]
    same &= (cols["start"][1:] == cols["start"][:-1] + 1) & (cols["ss"][1:] == cols["ss"][:-1] + 1)
    new[1:] = ~same
    at = np.flatnonzero(new)
    return {c: v[at] for c, v in cols.items()} | {"n": np.diff(np.append(at, len(i)))}


def _minimizers(src: DataFrame, k: int, seed: int, bits: int) -> DataFrame:
    def run(batches):
        for (ds, os_), texts in scan_rows(batches, "__sl_text", ["__sl_d", "__sl_o"]):
            sl = Slice(texts, k, seed, bits)
            at = np.unique(sl.arg)
            doc = np.searchsorted(sl.first, at, side="right") - 1
            m, rows = sl.grams[at], pa.array(doc)
            # what occurs again in the slice is known to: one of each goes to the others' task, the rest anywhere
            order = np.argsort(m, kind="stable")
            starts, lengths = runs(m[order])
            again, salt = np.empty(len(m), bool), np.empty(len(m), np.int32)
            again[order] = np.repeat(lengths > 1, lengths)
            salt[order] = flat_ranges(np.zeros(len(starts), np.int64), lengths)
            salt = np.where(salt > 0, 1 + (at % 97), 0).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(m.view(np.int64)), pa.array(salt), pa.array(again), ds.take(rows), os_.take(rows), pa.array((at - sl.first[doc]).astype(np.int32))], ["m", "salt", "again", "d", "o", "pos"])

    return src.select("__sl_d", "__sl_o", "__sl_text").mapInArrow(run, "m long, salt int, again boolean, d long, o int, pos int")


def _only_repeated(batches):
    """Rows whose m occurs at least twice, from rows sorted by m and salt; holds one row between batches."""
    held, last, going = None, None, False
    for batch in batches:
        t = pa.Table.from_batches([held, batch] if held is not None else [batch])
        held = None
        m, salt, again = (t.column(c).to_numpy() for c in ("m", "salt", "again"))
        if not len(m):
            continue
        new = np.concatenate(([True], (m[1:] != m[:-1]) | (salt[1:] != salt[:-1])))
        starts = np.flatnonzero(new)
        lengths = np.diff(np.append(starts, len(m)))
        out = (lengths > 1) | again[starts]
        if going and (m[0], salt[0]) == last:
            out[0] = True
        last, going = (m[-1], salt[-1]), bool(out[-1])
        keep = np.repeat(out, lengths)
        if not out[-1]:
            held = t.slice(len(m) - 1).combine_chunks().to_batches()[0]
        yield from t.filter(pa.array(keep)).select(["d", "o", "pos"]).combine_chunks().to_batches()


_SENT = "kind int, m long, blob binary, d long, o int, start int, n int, sd long, so int, ss int, n_words long, sha string, text string"


def _send(src: DataFrame, repeated: DataFrame, k: int, seed: int, bits: int) -> DataFrame:
    """Of each document: what it has without any repeat (kind 2, with its text where repeats are possible), repeats
    found in its slice (kind 1) and the remaining edges under their minimizers (kind 0)."""
    found = repeated.groupBy("d", "o").agg(F.collect_set("pos").alias("__sl_at"))
    both = src.select("__sl_d", "__sl_o", "__sl_text").join(found, (F.col("__sl_d") == F.col("d")) & (F.col("__sl_o") == F.col("o")), "left").select("__sl_d", "__sl_o", "__sl_text", "__sl_at")
    schema = pa.schema([("kind", pa.int32()), ("m", pa.int64()), ("blob", pa.binary()), ("d", pa.int64()), ("o", pa.int32()), ("start", pa.int32()), ("n", pa.int32()), ("sd", pa.int64()), ("so", pa.int32()), ("ss", pa.int32()), ("n_words", pa.int64()), ("sha", pa.string()), ("text", pa.string())])

    def rows(size, **cols):
        return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(size, f.type) for f in schema], schema=schema)

    def run(batches):
        for (ds, os_, at_), texts in scan_rows(batches, "__sl_text", ["__sl_d", "__sl_o", "__sl_at"]):
            listed = texts.to_pylist()
            at = [x.values.to_numpy() if x.is_valid else None for x in at_]
            may = [i for i, x in enumerate(at) if x is not None]
            d, o = ds.to_numpy(), os_.to_numpy()
            counts, sha = [], []
            for t in listed:
                w = words_of(t)
                counts.append(len(w))
                sha.append(hashlib.sha256(b" ".join(w)).hexdigest())
            yield rows(len(listed), kind=np.full(len(listed), 2), d=d, o=o, n_words=counts, sha=sha, text=[listed[i] if at[i] is not None else None for i in range(len(listed))])
            if not may:
                continue
            sl = Slice(texts.take(pa.array(may)), k, seed, bits)
            marked = np.zeros(len(sl.h) + 1, bool)
            for j, i in enumerate(may):
                marked[sl.first[j] + at[i]] = True
            keep = np.flatnonzero(marked[sl.arg])
            if not len(keep):
                continue
            e, doc, arg = sl.edges(keep), sl.doc[keep], sl.arg[keep]
            pos = sl.at[keep] - sl.first[doc]
            own = np.array(may)[doc]
            later, source = repeats(None, e, d[own], o[own], pos)
            p = pieces_of(d[own], o[own], pos, source, later)
            if len(p["d"]):
                yield rows(len(p["d"]), kind=np.ones(len(p["d"]), np.int64), **{c: p[c] for c in _PIECE})
            left = np.flatnonzero(~later)
            new = np.ones(len(left), bool)
            new[1:] = (arg[left][1:] != arg[left][:-1]) | (pos[left][1:] != pos[left][:-1] + 1) | (doc[left][1:] != doc[left][:-1])
            starts = np.flatnonzero(new)
            n = np.diff(np.append(starts, len(left)))
            first = left[starts]
            data = e[left].tobytes()
            blobs = [data[8 * a : 8 * (a + c)] for a, c in zip(starts.tolist(), n.tolist(), strict=True)]
            yield rows(len(first), kind=np.zeros(len(first), np.int64), m=sl.grams[arg[first]].view(np.int64), blob=blobs, d=d[own[first]], o=o[own[first]], start=pos[first])

    return both.mapInArrow(run, _SENT)


def _meet(batches, limit: int = 200_000):
    """Repeats among the edges of each minimizer, from rows sorted by it. The last minimizer's edges are held, at most
    one occurrence of each edge once there are many."""
    held = None

    def found(m, e, d, o, pos):
        later, source = repeats(m, e, d, o, pos)
        p = pieces_of(d, o, pos, source, later)
        return later, pa.RecordBatch.from_arrays([pa.array(p["d"], pa.int64()), pa.array(p["o"], pa.int32()), pa.array(p["start"], pa.int32()), pa.array(p["n"], pa.int32()), pa.array(p["sd"], pa.int64()), pa.array(p["so"], pa.int32()), pa.array(p["ss"], pa.int32())], list(_PIECE))

    for batch in batches:
        if not batch.num_rows:
            continue
        blob = batch.column("blob").cast(pa.large_binary())
        ends = np.frombuffer(blob.buffers()[1], np.int64)[blob.offset : blob.offset + len(blob) + 1]
        n = np.diff(ends) // 8
        e = np.frombuffer(blob.buffers()[2], np.uint64, count=int(ends[-1] - ends[0]) // 8, offset=int(ends[0]))
        cols = [np.repeat(batch.column(c).to_numpy(), n) for c in ("m", "d", "o")]
        pos = flat_ranges(batch.column("start").to_numpy().astype(np.int64), n)
        now = [cols[0], e, cols[1], cols[2], pos]
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
        open_ = now[0] == now[0][-1]
        done = [x[~open_] for x in now]
        if len(done[0]):
            yield found(*done)[1]
        held = [x[open_] for x in now]
        if len(held[0]) > limit:
            later, out = found(*held)
            yield out
            held = [x[~later] for x in held]
            limit = max(limit, 2 * len(held[0]))
    if held is not None:
        yield found(*held)[1]


def glue(pieces: DataFrame) -> DataFrame:
    """Joins each piece with the one it continues, in its text and in its source, and sums up the unbroken paths."""
    p = pieces.distinct()
    before = p.select(F.col("d").alias("bd"), F.col("o").alias("bo"), F.col("sd").alias("bsd"), F.col("so").alias("bso"), (F.col("start") + F.col("n")).alias("bend"), (F.col("ss") + F.col("n")).alias("bsend")).distinct()
    on = (F.col("d") == F.col("bd")) & (F.col("start") == F.col("bend")) & (F.col("o") == F.col("bo")) & (F.col("sd") == F.col("bsd")) & (F.col("so") == F.col("bso")) & (F.col("ss") == F.col("bsend"))
    linked = p.join(before, on, "left").withColumn("head", F.when(F.col("bd").isNull(), 1).otherwise(0))
    w = Window.partitionBy("d", "o", "sd", "so", F.col("start") - F.col("ss")).orderBy("start", "n")
    path = linked.withColumn("path", F.sum("head").over(w))
    return path.groupBy("d", "o", "sd", "so", (F.col("start") - F.col("ss")).alias("shift"), "path").agg(F.min("start").alias("start"), F.sum("n").alias("n"), F.min("ss").alias("ss")).select(*_PIECE)


def _spans(src: DataFrame, k: int, seed: int, bits: int, edges: Scratch) -> tuple[DataFrame, DataFrame]:
    """What _send wrote, and all repeated paths: windows start .. start + n - 1 of a document occur earlier."""
    repeated = _minimizers(src, k, seed, bits).repartition("m", "salt").sortWithinPartitions("m", "salt").mapInArrow(_only_repeated, "d long, o int, pos int")
    sent = edges.write(_send(src, repeated, k, seed, bits))
    met = sent.where("kind = 0").select("m", "blob", "d", "o", "start").repartition("m").sortWithinPartitions("m").mapInArrow(_meet, "d long, o int, start int, n int, sd long, so int, ss int")
    return sent, written_alone(lambda: glue(written(sent.where("kind = 1").select(*_PIECE).unionByName(met), "pieces")), "spans")


_OWN = "array<struct<start:int,n:int,sd:bigint,so:int,ss:int>>"
_LENT = "array<struct<ss:int,n:int>>"


def _kept(sent: DataFrame, spans: DataFrame, k: int, with_text: bool) -> DataFrame:
    """d, o, n_words, n_removed, kept_sha256, kept of every document; own (its spans) and lent (spans elsewhere that have
    their source in it) with the digests of their words."""
    own = F.struct(F.col("start").cast("int").alias("start"), F.col("n").cast("int").alias("n"), "sd", "so", F.col("ss").cast("int").alias("ss"))
    lent = spans.select("sd", "so", F.col("ss").cast("int").alias("ss"), F.col("n").cast("int").alias("n")).distinct()
    sides = spans.select("d", "o", own.alias("own"), F.lit(None).cast("struct<ss:int,n:int>").alias("lent"))
    sides = sides.unionByName(lent.select(F.col("sd").alias("d"), F.col("so").alias("o"), F.lit(None).cast("struct<start:int,n:int,sd:bigint,so:int,ss:int>").alias("own"), F.struct("ss", "n").alias("lent")))
    by_doc = sides.groupBy(F.col("d").alias("__sl_sd"), F.col("o").alias("__sl_so")).agg(F.collect_list("own").alias("own"), F.collect_list("lent").alias("lent"))
    docs = sent.where("kind = 2").select("d", "o", "n_words", "sha", "text")
    none = lambda t: F.lit(None).cast(t)
    digests = "array<binary>"
    plain = docs.where("text is null").select("d", "o", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"), none("string").alias("kept"), none(_OWN).alias("own"), none(_LENT).alias("lent"), none(digests).alias("own_words"), none(digests).alias("lent_words"))
    joined = docs.where("text is not null").join(by_doc, (F.col("d") == F.col("__sl_sd")) & (F.col("o") == F.col("__sl_so")), "left").select("d", "o", "n_words", "sha", "text", "own", "lent")
    names = ["d", "o", "n_words", "n_removed", "kept_sha256", "kept", "own", "lent", "own_words", "lent_words"]

    def run(batches):
        for (d, o, n_words, sha, own_, lent_), texts in scan_rows(batches, "text", ["d", "o", "n_words", "sha", "own", "lent"]):
            removed, sums, kept, marks = [], [], [], ([], [])
            for i, text in enumerate(texts.to_pylist()):
                if not own_[i].is_valid:
                    removed.append(0)
                    sums.append(sha[i].as_py())
                    kept.append(None)
                    for m in marks:
                        m.append(None)
                    continue
                words = words_of(text)
                for m, spans_, at in zip(marks, (own_[i].values, lent_[i].values), ("start", "ss"), strict=True):
                    ends = zip(spans_.field(at).to_pylist(), spans_.field("n").to_pylist(), strict=True)
                    m.append([hashlib.blake2b(b" ".join(words[a : a + n + k - 1]), digest_size=16).digest() for a, n in ends])
                s = own_[i].values
                if not len(s):
                    removed.append(0)
                    sums.append(sha[i].as_py())
                    kept.append(None)
                    continue
                a = s.field("start").to_numpy()
                cover = np.zeros(len(words) + 1, np.int64)
                np.add.at(cover, a, 1)
                np.add.at(cover, a + s.field("n").to_numpy() + k - 1, -1)
                gone = np.cumsum(cover[:-1]) > 0
                left = b" ".join([words[j] for j in np.flatnonzero(~gone).tolist()])
                removed.append(int(gone.sum()))
                sums.append(hashlib.sha256(left).hexdigest())
                kept.append(left.decode("utf-8", "replace") if with_text else None)
            done = [pa.array(removed, pa.int64()), pa.array(sums, pa.string()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays([d, o, n_words, *done, own_, lent_, *(pa.array(m, pa.list_(pa.binary())) for m in marks)], names)

    changed = joined.mapInArrow(run, f"d long, o int, n_words long, n_removed long, kept_sha256 string, kept string, own {_OWN}, lent {_LENT}, own_words {digests}, lent_words {digests}")
    return plain.unionByName(changed)


def _all_equal(kept: DataFrame) -> bool:
    """Whether the words of every span have the digest of the words at its source. Spans of one source and one digest are
    one row before they are sent."""
    pair = lambda a, b: F.inline(F.arrays_zip(F.col(a).alias("s"), F.col(b).alias("words")))
    own = kept.select(pair("own", "own_words")).select("s.sd", "s.so", "s.ss", "s.n", "words").distinct()
    lent = kept.select("d", "o", pair("lent", "lent_words")).select("d", "o", F.col("s.ss").alias("ls"), F.col("s.n").alias("ln"), F.col("words").alias("source_words")).distinct()
    met = own.join(lent, (F.col("sd") == F.col("d")) & (F.col("so") == F.col("o")) & (F.col("ss") == F.col("ls")) & (F.col("n") == F.col("ln")), "left")
    return met.where(~F.col("words").eqNullSafe(F.col("source_words"))).isEmpty()


#: Bits of the word hashes of each attempt; each has hashes of its own.
ATTEMPTS = (64, 64, 64)


def _verified(src: DataFrame, k: int, with_text: bool, attempts: tuple[int, ...]) -> tuple[DataFrame, DataFrame]:
    """What _kept gives and the spans, by the first attempt whose spans all lead to equal words."""
    for seed, bits in enumerate(attempts):
        edges = Scratch(src.sparkSession, "edges")
        sent, spans = _spans(src, k, seed, bits, edges)
        kept = written(_kept(sent, spans, k, with_text), "kept")
        edges.keep(0)
        if _all_equal(kept):
            return kept, spans
    raise ValueError(f"hashes collided in {len(attempts)} attempts")


def repeated_spans(docs: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", attempts: tuple[int, ...] = ATTEMPTS) -> DataFrame:
    """The maximal repeated paths: id_col, start and length in words, source_id and source_start of an earlier
    occurrence. Texts and ids as in dedup_substrings."""
    _, spans = _verified(keyed(docs, id_col, text_col), k, False, attempts)
    null = lambda c: F.when(F.col(c) != _NO_ID, F.col(c))
    return spans.select(null("d").alias(id_col), "start", (F.col("n") + k - 1).alias("length"), null("sd").alias("source_id"), F.col("ss").alias("source_start"))


def dedup_substrings(docs: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", attempts: tuple[int, ...] = ATTEMPTS) -> DataFrame:
    """Removes each word in a window of k words that occurs earlier: in a document of smaller id, or before in its own.

    Returns id_col (an integer), n_words, n_removed, kept_sha256 (of the kept words joined by one space), one row for
    each row of docs. Null and empty texts have no words; a null id is less than all others; rows of one id with
    different texts count in the texts' order, equal rows as one document; an empty table gives an empty result; other
    columns are left out. Spans are removed only after their words have been compared with their source's, by digest; if
    64-bit hashes collide, other ones are tried, and ValueError says that all attempts (the bits of each) did.
    """
    out, _ = _verified(keyed(docs, id_col, text_col), k, False, attempts)
    return out.select(F.when(F.col("d") != _NO_ID, F.col("d")).alias(id_col), "n_words", "n_removed", "kept_sha256")


def without_repeats(docs: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns; texts that lose words become their kept words joined by one space, others stay as they are."""
    src = keyed(docs, id_col, text_col)
    changed = lambda: _verified(src, k, True, ATTEMPTS)[0].where("n_removed > 0")
    kept = written_alone(lambda: changed().select(F.col("d").alias("__sl_kd"), F.col("o").alias("__sl_ko"), F.col("kept").alias("__sl_kept")).distinct(), "changed")
    joined = src.drop("__sl_text").join(kept, (F.col("__sl_d") == F.col("__sl_kd")) & (F.col("__sl_o") == F.col("__sl_ko")), "left")
    return joined.withColumn(text_col, F.coalesce("__sl_kept", F.col(text_col).cast("string"))).select(*docs.columns)
