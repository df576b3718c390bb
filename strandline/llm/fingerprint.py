"""Fingerprints of canonical texts: Unicode normalisation, case and white space folding, a 128-bit xxhash, and a
comparison of the bytes where hashes are equal. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import long_array, range_bounds, range_of, small_side, written

_WHITE = r"[\s\p{Z}\x{1C}-\x{1F}\x{85}]+"


def _icu(cls: str, method: str, text: Column) -> Column:
    return F.reflect(F.lit(f"com.ibm.icu.{cls}"), F.lit(method), text, F.lit(True))


def canonical(text: Column) -> Column:
    """NFKC, full case folding, NFKC again; runs of white space become one space, at the ends none.

    Texts of ASCII alone need no normalisation, and fold as lower case. Spark carries ICU for its collations; reflect()
    reaches its normaliser, as SQL has no function for it.
    """
    ascii_ = F.octet_length(text) == F.length(text)
    folded = F.when(ascii_, F.lower(text)).otherwise(_icu("text.Normalizer", "compose", _icu("lang.UCharacter", "foldCase", _icu("text.Normalizer", "compose", text))))
    return F.trim(F.regexp_replace(folded, _WHITE, " "))


def digest(canon: Column) -> tuple[Column, Column]:
    """Two 64-bit xxhashes with different seeds."""
    return F.xxhash64(canon), F.xxhash64(F.lit("strandline"), canon)


def _fingerprint(hi: Column, lo: Column, rank: Column) -> Column:
    """128 bits in hex; later texts of a bucket of several carry their number."""
    bits = F.concat(*[F.lpad(F.lower(F.hex(x)), 16, "0") for x in (hi, lo)])
    return F.when(F.coalesce(rank, F.lit(1)) > 1, F.concat(bits, F.lit("-"), rank.cast("string"))).otherwise(bits)


def with_next(docs: DataFrame, id_col: str, text_col: str, share: int = 500) -> DataFrame:
    """__id, __text and __next: the text of the next row by ascending (id, text), of the first one after the last.

    Rows are dealt by exact ranges of the id, and each range gets a copy of the first row of the range after it.
    """
    src = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    n = src.count()
    bounds = range_bounds(src, "__id", max(1, min(20_000, n // share)))
    ranged = src.withColumn("__b", range_of("__id", bounds))
    heads = ranged.groupBy("__b").agg(F.min("__id").alias("least"), F.max(F.col("__id").isNull()).alias("null")).collect()
    heads.sort(key=lambda r: r["__b"])
    own = F.struct(F.col("__b").cast("long").alias("b"), F.lit(0).alias("copy"))
    if heads:
        # the first id of each range, and the range before it (before the first comes the last)
        at = {r["__b"]: (None if r["null"] else r["least"], heads[i - 1]["__b"]) for i, r in enumerate(heads)}
        both = [at.get(i, (None, 0)) for i in range(heads[-1]["__b"] + 1)]
        least = long_array([x for x, _ in both])
        prior = long_array([x for _, x in both])
        is_head = F.col("__id").eqNullSafe(F.get(least, F.col("__b")))
        deal = F.when(is_head, F.array(own, F.struct(F.get(prior, F.col("__b")).alias("b"), F.lit(1).alias("copy")))).otherwise(F.array(own))
    else:
        deal = F.array(own)
    dealt = ranged.select("__id", "__text", F.explode(deal).alias("p")).select("__id", "__text", F.col("p.b").alias("__p"), F.col("p.copy").alias("__copy"))
    w = Window.partitionBy("__p").orderBy("__copy", "__id", "__text")
    return dealt.withColumn("__next", F.lead("__text").over(w)).where("__copy = 0").select("__id", "__text", F.coalesce("__next", "__text").alias("__next"))


def edited(text: Column, other: Column) -> Column:
    """text with its last half (rounded down, in code points) replaced by as many of the other's first, or all."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(other, F.lit(1), half))


def _collisions(src: DataFrame, keys: DataFrame, make: Callable[[Column], tuple[Column, Column]]) -> DataFrame | None:
    """Numbers for texts in buckets of equal hashes and different bytes: hi, lo, canon, rank; None if there are none.

    keys: (hi, lo) of buckets with several texts. Each bucket's least and greatest bytes are compared; partial
    aggregation keeps two texts of a bucket in a task, however common they are.
    """
    canon = src.select(canonical(F.col("__t")).alias("canon"))
    hi, lo = make(F.col("canon"))
    rows = canon.select("canon", hi.alias("hi"), lo.alias("lo")).join(small_side(keys, keys.count()), ["hi", "lo"], "left_semi")
    odd = written(rows.groupBy("hi", "lo").agg(F.min("canon").alias("a"), F.max("canon").alias("z")).where("a <> z").select("hi", "lo"), "odd")
    if odd.isEmpty():
        return None
    texts = rows.join(odd, ["hi", "lo"], "left_semi").distinct()
    return written(texts.withColumn("rank", F.row_number().over(Window.partitionBy("hi", "lo").orderBy("canon"))), "ranks")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", make: Callable[[Column], tuple[Column, Column]] = digest) -> DataFrame:
    """id_col and fingerprint of every row: equal exactly if the canonical texts are.

    Null texts count as empty; rows are taken each; other columns are left out.
    """
    src = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__t"))
    canon = src.select("__id", canonical(F.col("__t")).alias("canon"))
    hi, lo = make(F.col("canon"))
    marked = canon.select("__id", "canon", hi.alias("hi"), lo.alias("lo"))
    keys = written(marked.groupBy("hi", "lo").agg(F.count("*").alias("n")).where("n > 1").select("hi", "lo"), "keys")
    ranks = _collisions(src, keys, make)
    if ranks is None:
        return marked.select(F.col("__id").alias(id_col), _fingerprint(F.col("hi"), F.col("lo"), F.lit(1)).alias("fingerprint"))
    joined = marked.join(small_side(ranks, ranks.count()), ["hi", "lo", "canon"], "left")
    return joined.select(F.col("__id").alias(id_col), _fingerprint(F.col("hi"), F.col("lo"), F.col("rank")).alias("fingerprint"))


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", make: Callable[[Column], tuple[Column, Column]] = digest) -> DataFrame:
    """Fingerprints of every text and of its edited text (see edited; the next row by ascending id, then text).

    Returns id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next (1 if fingerprints
    are equal, else 0). Null texts count as empty; a null id comes first; a single row is its own next; rows are taken
    each; an empty table gives an empty result; other columns are left out.
    """
    rows = with_next(docs, id_col, text_col)
    both = rows.select("__id", "__text", "__next", edited(F.col("__text"), F.col("__next")).alias("__edited"))
    canon = both.select("__id", "__text", "__edited", F.length("__text").cast("long").alias("n_chars"), F.sha2("__edited", 256).alias("edited_sha256"), canonical(F.col("__text")).alias("c"), canonical(F.col("__edited")).alias("e"), "__next")
    (h, l), (eh, el) = make(F.col("c")), make(F.col("e"))
    hashed = canon.select("__id", "n_chars", "edited_sha256", h.alias("h"), l.alias("l"), eh.alias("eh"), el.alias("el"), (F.col("c") == F.col("e")).alias("same_edited"), F.col("c").alias("__c"), "__next")
    table = written(hashed.select("__id", "n_chars", "edited_sha256", "h", "l", "eh", "el", "same_edited", (F.col("__c") == canonical(F.col("__next"))).alias("same_next")), "fingerprints")
    each = table.select(F.explode(F.array(F.struct(F.col("h").alias("hi"), F.col("l").alias("lo")), F.struct(F.col("eh").alias("hi"), F.col("el").alias("lo")))).alias("x")).select("x.hi", "x.lo")
    keys = written(each.groupBy("hi", "lo").agg(F.count("*").alias("n")).where("n > 1").select("hi", "lo"), "keys")
    known = small_side(keys, keys.count())
    # texts in buckets of several: the documents' own where they are read, the edited ones where any is in a bucket
    own = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__t"))
    again = table.select("eh", "el").join(known, (F.col("eh") == F.col("hi")) & (F.col("el") == F.col("lo")), "left_semi")
    texts = own if again.isEmpty() else own.unionByName(both.select(F.col("__edited").alias("__t")))
    ranks = _collisions(texts, keys, make)
    one = F.lit(1)
    if ranks is None:
        out = table.withColumns({"fingerprint": _fingerprint(F.col("h"), F.col("l"), one), "edited_fingerprint": _fingerprint(F.col("eh"), F.col("el"), one)})
    else:
        by = ranks.select("hi", "lo", "canon", "rank")
        full = both.select("__id", canonical(F.col("__text")).alias("c"), canonical(F.col("__edited")).alias("e"), F.length("__text").cast("long").alias("n_chars"), F.sha2("__edited", 256).alias("edited_sha256"), canonical(F.col("__next")).alias("x"))
        full = full.select("__id", "n_chars", "edited_sha256", "c", "e", h.alias("h"), l.alias("l"), eh.alias("eh"), el.alias("el"), (F.col("c") == F.col("e")).alias("same_edited"), (F.col("c") == F.col("x")).alias("same_next"))
        full = full.join(by.toDF("h", "l", "c", "r"), ["h", "l", "c"], "left").join(by.toDF("eh", "el", "e", "er"), ["eh", "el", "e"], "left")
        out = full.withColumns({"fingerprint": _fingerprint(F.col("h"), F.col("l"), F.col("r")), "edited_fingerprint": _fingerprint(F.col("eh"), F.col("el"), F.col("er"))})
    return out.select(F.col("__id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", F.col("same_edited").cast("double").alias("near_edited"), F.col("same_next").cast("double").alias("near_next"))
