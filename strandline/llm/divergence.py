"""How the sources of a language differ in their vocabulary: kept terms as transducers, recounted for each source."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import SLICE_BYTES, scan_rows, word_codes, written
from strandline.llm.transducer import Transducer

#: Terms of a transducer at most; bytes of the transducers that a task holds at once.
TERMS, VOLUME = 50_000, 16 << 20
#: Sources and terms of a block of the comparison of all pairs.
SOURCES, WIDE = 32, 8192

_ASCII = np.arange(256, dtype=np.uint8)
_LETTER = ((_ASCII | 32) >= 97) & ((_ASCII | 32) <= 122)
#: ASCII letters in lower case, other ASCII as a space, all else as it is.
_FOLD = np.where(_ASCII >= 128, _ASCII, np.where(_LETTER, _ASCII | 32, 32)).astype(np.uint8)


def fold(texts: pa.Array) -> pa.Array:
    """Texts in which terms ([^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+, A-Z lower-cased) are what stands between spaces."""
    texts = texts.fill_null("") if texts.null_count else texts
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = _FOLD[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]]
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(np.ascontiguousarray(at - at[0])), pa.py_buffer(data))


def _codes(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = column.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def _tallied(*parts: np.ndarray, weights: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct combinations of small whole numbers, and how often (or with what weight) each occurs."""
    if not len(parts[0]):
        return list(parts), np.empty(0, np.int64)
    sizes = [int(p.max()) + 1 for p in parts]
    key = parts[0].astype(np.int64)
    for p, n in zip(parts[1:], sizes[1:], strict=True):
        key = key * n + p
    if weights is None:
        key, n = np.unique(key, return_counts=True)
    else:
        key, back = np.unique(key, return_inverse=True)
        n = np.bincount(back, weights=weights, minlength=len(key)).astype(np.int64)
    out = []
    for size in reversed(sizes[1:]):
        out.append(key % size)
        key = key // size
    return [key, *reversed(out)], n


def _source_rows(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    z = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    return docs.select(z(text_col, "__text"), z(lang_col, "__lang"), z(source_col, "__source"))


def document_frequencies(src: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """lang, term, n: in how many documents (rows) of the language the term occurs, added up in each slice first."""

    def run(batches):
        for (langs,), texts in scan_rows(batches, "__text", ["__lang"], slice_bytes):
            doc, codes, own = word_codes(fold(texts), lower=False)
            lang, names = _codes(langs)
            (d, c), _ = _tallied(doc, codes)
            (g, c), n = _tallied(lang[d], c)
            terms = pa.array(own, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([names.take(pa.array(g)), terms.take(pa.array(c)), pa.array(n)], ["lang", "term", "n"])

    return src.mapInArrow(run, "lang string, term string, n long").groupBy("lang", "term").agg(F.sum("n").alias("n"))


def build_vocabulary(kept: DataFrame, terms: int = TERMS) -> DataFrame:
    """Transducers over distinct (lang, term): lang, first (the first term), base (terms of the language before it), size and
    blob; and a row for each term with its ordinal and no blob.

    Terms are dealt into sorted ranges; each task builds one transducer for each language and `terms` terms of its range, so
    that no task holds a whole vocabulary. Bases are sums over the transducers, which are few.
    """
    parts = max(1, -(-kept.count() // terms))

    def run(batches):
        lang, held = None, []

        def out():
            made = Transducer.build(t.encode() for t in held)
            n = len(held)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (n + 1)), pa.array([held[0]] * (n + 1)), pa.array([None, *held], pa.string()), pa.array([n, *range(n)], pa.int64()), pa.array([made.to_bytes(), *[None] * n], pa.binary())],
                ["lang", "first", "term", "rank", "blob"],
            )

        for b in batches:
            for x, term in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if held and (x != lang or len(held) >= terms):
                    yield from out()
                    held = []
                lang = x
                held.append(term)
        if held:
            yield from out()

    ranged = kept.select("lang", "term").repartitionByRange(parts, "lang", "term").sortWithinPartitions("lang", "term")
    return ranged.mapInArrow(run, "lang string, first string, term string, rank long, blob binary")


def with_bases(built: DataFrame) -> DataFrame:
    """The transducers of build_vocabulary() with base, the count of the language's terms before their first."""
    before = Window.partitionBy("lang").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    some = built.where("blob is not null")
    base = some.select("lang", "first", F.coalesce(F.sum("rank").over(before), F.lit(0)).alias("base"))
    return some.select("lang", "first", F.col("rank").alias("size"), "blob").join(base, ["lang", "first"])


class Vocabulary:
    """Some transducers of one or several languages; a word is looked up in the one that its range leads to."""

    def __init__(self, rows: list[tuple[str, str, int, bytes]]):
        self.of: dict[str, tuple[list[bytes], list[int], list[Transducer]]] = {}
        for lang, first, base, blob in sorted(rows, key=lambda r: (r[0], r[1].encode())):
            firsts, bases, made = self.of.setdefault(lang, ([], [], []))
            firsts.append(first.encode())
            bases.append(base)
            made.append(Transducer.from_bytes(blob))

    def ordinals(self, lang: str, words: list[bytes]) -> np.ndarray:
        out = np.full(len(words), -1, np.int64)
        if lang not in self.of or not words:
            return out
        firsts, bases, made = self.of[lang]
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        starts = np.append(0, ends[:-1])
        which = np.zeros(len(words), np.int64) if len(made) == 1 else np.fromiter((bisect_right(firsts, w) - 1 for w in words), np.int64, len(words))
        for k, (base, t) in enumerate(zip(bases, made, strict=True)):
            on = np.flatnonzero(which == k)
            found = t.ordinals(data, starts[on], ends[on])
            out[on] = np.where(found < 0, -1, found + base)
        return out


def volumes(made: DataFrame, limit: int = VOLUME):
    """The transducers in groups of at most `limit` bytes (or one), read from the table group by group."""
    sizes = made.select("lang", "first", F.length("blob").alias("n")).orderBy("lang", "first").toLocalIterator()
    group, held = [], 0
    for r in sizes:
        if group and held + r.n > limit:
            yield group
            group, held = [], 0
        group.append((r.lang, r.first))
        held += r.n
    if group:
        yield group


def recount(src: DataFrame, made: DataFrame, limit: int = VOLUME, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """lang, source, ordinal, n: how often each kept term occurs in each source, by streaming all texts through the
    transducers. They go to the tasks in volumes of `limit` bytes; with several, there is a pass for each volume."""
    spark = src.sparkSession
    found = None
    for group in volumes(made, limit):
        asked = F.broadcast(spark.createDataFrame(group, "lang string, first string"))
        rows = [(r.lang, r.first, r.base, bytes(r.blob)) for r in made.join(asked, ["lang", "first"]).collect()]
        langs = sorted({r[0] for r in rows})
        sent = spark.sparkContext.broadcast(rows)

        def run(batches, sent=sent):
            vocabulary = Vocabulary(sent.value)
            for (of_lang, of_source), texts in scan_rows(batches, "__text", ["__lang", "__source"], slice_bytes):
                doc, codes, own = word_codes(fold(texts), lower=False)
                lang, lang_names = _codes(of_lang)
                source, source_names = _codes(of_source)
                (ln, so, c), n = _tallied(lang[doc], source[doc], codes)
                ordinal = np.full(len(c), -1, np.int64)
                for k, name in enumerate(lang_names.to_pylist()):
                    on = np.flatnonzero(ln == k)
                    here, back = np.unique(c[on], return_inverse=True)
                    ordinal[on] = vocabulary.ordinals(name, [own[i] for i in here.tolist()])[back]
                on = ordinal >= 0
                yield pa.RecordBatch.from_arrays(
                    [lang_names.take(pa.array(ln[on])), source_names.take(pa.array(so[on])), pa.array(ordinal[on]), pa.array(n[on])], ["lang", "source", "ordinal", "n"]
                )

        part = src.where(F.col("__lang").isin(langs)).mapInArrow(run, "lang string, source string, ordinal long, n long")
        part = written(part.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n")), "recount")
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], "lang string, source string, ordinal long, n long") if found is None else found


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 * (count + 2) / (total + 2 * kept)), by long division in steps of three digits: exact for totals up
    to some 9 * 10^15."""
    x, y = (count + 2).cast("long"), (total + 2 * kept).cast("long")
    whole, rest = F.call_function("div", x, y), x % y
    for _ in range(3):
        whole, rest = whole * 1000 + F.call_function("div", rest * 1000, y), (rest * 1000) % y
    return 1 + whole


def _pair_sums(cells: DataFrame) -> DataFrame:
    """lang, source, item, value: sums of floor((p - q)^2 / (p + q)) over the terms of blocks (lang, a, b, part) of cells.

    A block has the rows of its sources, each with `none`, the share of a term that does not occur there, and a row (place,
    p) for each term that does, place counting from the block's first of `width` terms.
    """

    def run(table: pa.Table) -> pa.Table:
        source, names = _codes(table.column("source").combine_chunks())
        get = lambda c: table.column(c).combine_chunks().to_numpy(zero_copy_only=False)
        place, p, mark = get("place"), get("p"), get("bucket")
        width, a, b = int(table.column("width")[0].as_py()), table.column("a")[0].as_py(), table.column("b")[0].as_py()
        head = place < 0
        grid = np.empty((len(names), width), np.int64)
        bucket = np.empty(len(names), np.int64)
        grid[source[head]] = p[head][:, None]
        bucket[source[head]] = mark[head]
        grid[source[~head], place[~head]] = p[~head]
        order = np.argsort(bucket, kind="stable")
        grid, bucket = grid[order], bucket[order]
        left, right, value = [], [], []
        for i in range(len(names)):
            j = np.arange(i + 1, len(names))
            if a != b:
                j = j[bucket[j] != bucket[i]]
            if len(j):
                off, both = grid[j] - grid[i], grid[j] + grid[i]
                left.append(np.full(len(j), order[i]))
                right.append(order[j])
                value.append((off * off // both).sum(axis=1))
        left, right, value = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right, value))
        n = len(left)
        lang = pa.array([table.column("lang")[0].as_py()] * (2 * n), pa.string())
        both = [np.concatenate([left, right]), np.concatenate([right, left])]
        names = names.cast(pa.string())
        return pa.Table.from_arrays([lang, names.take(pa.array(both[0])), names.take(pa.array(both[1])), pa.array(np.concatenate([value, value]))], ["lang", "source", "item", "value"])

    sums = cells.groupBy("lang", "a", "b", "part").applyInArrow(run, "lang string, source string, item string, value long")
    return sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def source_divergence(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 10, top: int = 10,
    terms: int = TERMS, volume: int = VOLUME, sources: int = SOURCES, wide: int = WIDE, slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """Compares the sources of each language by their shares of its kept terms.

    Terms are [^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+ with A-Z lower-cased; a language keeps the V terms in least_docs of its
    documents or more. The first pass over the texts counts documents for each term. Kept terms, sorted, become minimal
    transducers; the second pass streams the texts through them and counts ordinals for each (lang, source). A term's share
    in a group of N kept occurrences is p = 1 + floor(10^9 * (count + 2) / (N + 2 * V)), q is another's, and
    f = floor((p - q)^2 / (p + q)), all in whole numbers (exact for N up to some 9 * 10^15).
    Returns lang, source, part, item, value long, rank int: for part `pair` every other source of the language with f summed
    over all kept terms, for part `term` the `top` terms that the group has and whose p is over the language's q; ranked by value, then
    item (terms: by ordinal). All pairs of sources are the result itself; they are summed in blocks of some
    `sources` sources and `wide` terms, without a row for a pair and term. Null text, lang and source count as ''; a language
    without kept terms has pairs of value 0; repeated rows are documents each; an empty table gives no rows; other columns are left out.
    """
    src = _source_rows(docs, text_col, lang_col, source_col)
    kept = written(document_frequencies(src, slice_bytes).where(F.col("n") >= least_docs).select("lang", "term"), "kept")
    built = written(build_vocabulary(kept, terms), "vocabulary")
    made = written(with_bases(built), "transducers")
    counts = recount(src, made, volume, slice_bytes)
    groups = src.select(F.col("__lang").alias("lang"), F.col("__source").alias("source")).distinct()
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    v = made.groupBy("lang").agg(F.sum("size").alias("v"))
    groups = written(groups.join(totals, ["lang", "source"], "left").join(v, "lang", "left").na.fill(0, ["total", "v"]), "groups")
    groups = groups.join(groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.ceil(F.count("*") / F.lit(sources)).cast("int").alias("buckets")), "lang")
    groups = groups.withColumn("bucket", F.pmod(F.xxhash64("source"), F.col("buckets")).cast("int"))
    cells = counts.join(groups, ["lang", "source"])
    # terms of a group against the language
    of_lang = counts.groupBy("lang", "ordinal").agg(F.sum("n").alias("all"))
    p, q = share(F.col("n"), F.col("total"), F.col("v")), share(F.col("all"), F.col("lang_total"), F.col("v"))
    f = lambda a, b: F.call_function("div", (a - b) * (a - b), a + b)
    best = cells.join(of_lang, ["lang", "ordinal"]).withColumns({"p": p, "q": q}).where("p > q").select("lang", "source", "ordinal", f(F.col("p"), F.col("q")).alias("value"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ordinal")
    best = best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    words = built.where("term is not null").join(made.select("lang", "first", "base"), ["lang", "first"]).select("lang", (F.col("base") + F.col("rank")).alias("ordinal"), "term")
    best = best.join(words, ["lang", "ordinal"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    # every source against every other one
    w = F.lit(wide).cast("long")
    none = share(F.lit(0), F.col("total"), F.col("v"))
    last = F.greatest(F.call_function("div", F.col("v") - 1, w), F.lit(0))
    heads = groups.where("v > 0").select("lang", "source", "bucket", "buckets", "v", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("part"), F.lit(-1).cast("long").alias("place"), none.alias("p"))
    empty = groups.where("v = 0").select("lang", "source", "bucket", "buckets", "v", F.lit(0).cast("long").alias("part"), F.lit(-1).cast("long").alias("place"), F.lit(1).cast("long").alias("p"))
    full = cells.select("lang", "source", "bucket", "buckets", "v", F.call_function("div", F.col("ordinal"), w).alias("part"), (F.col("ordinal") % w).alias("place"), p.alias("p"))
    blocks = heads.unionByName(empty).unionByName(full).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)))
    blocks = blocks.select("lang", "source", F.least("bucket", "other").alias("a"), F.greatest("bucket", "other").alias("b"), "bucket", "part", "place", "p", F.least(w, F.col("v") - F.col("part") * w).alias("width"))
    pairs = _pair_sums(blocks)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return pairs.unionByName(best)
