"""Quality rules whose cutoffs come with a guarantee on false rejections.

Each rule is a score, larger is worse; a document fails it above a cutoff. Cutoffs are chosen for each stratum from
labelled documents: step i of one path takes the i-th cutoff of every rule's descending grid, and is certified while the
exact binomial tail says that the share of good documents that any of the rules rejects is below the allowed risk. The
path is tested in its fixed order, which needs no correction; strata share the error level by Bonferroni's correction.
Strata with too few good labels for any certificate are tested together as one. With probability 1 - error no stratum
tested by itself, nor the pool as a whole, loses more than `risk` of its good documents. All certified steps hold at
once, so that the one of greatest use may be taken.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import BROADCAST_ROWS, mix, runs, scan_rows, small_side, text_hashes, window_hashes, written

SYMBOLS = b"#*$%&|<>"
_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Rules and their grids, greatest cutoff first.
SHARES = tuple(round(0.6 * 0.9**i, 6) for i in range(40))
RULES = {"symbols": SHARES, "dup_lines": SHARES, "repeats": SHARES, "word_length": tuple(round(40 * 0.95**i, 6) for i in range(40))}


def features(texts: list[str | None]) -> dict[str, np.ndarray]:
    """The base counts of every text; null has no words. Windows are found by 64-bit hashes of their words."""
    n = len(texts)
    out = {k: np.zeros(n, np.int64) for k in FEATURES}
    for i, text in enumerate(texts):
        if not text:
            continue
        data = text.encode("utf-8", "surrogatepass")
        out["word_chars"][i] = len(text) - (len(data) - len(data.translate(None, _SPACE)))
        out["n_symbols"][i] = len(data) - len(data.translate(None, SYMBOLS))
        lines = [x for x in data.split(b"\n") if x.strip()]
        out["n_lines"][i] = len(lines)
        out["n_dup_lines"][i] = len(lines) - len(set(lines))
    h, counts = text_hashes(texts, lower=False)
    out["n_words"] = counts
    doc = np.repeat(np.arange(n), counts)
    w = window_hashes(h, 5)
    if len(w):
        at = np.flatnonzero(doc[: len(w)] == doc[4:])
        with np.errstate(over="ignore"):
            key = mix(w[at] + doc[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        order = np.argsort(key, kind="stable")
        starts, lengths = runs(key[order])
        again = at[order[np.repeat(lengths > 1, lengths)]]
        covered = np.zeros(len(h) + 1, np.int64)
        np.add.at(covered, again, 1)
        np.add.at(covered, again + 5, -1)
        out["n_repeat_words"] = np.bincount(doc, weights=np.cumsum(covered[:-1]) > 0, minlength=n).astype(np.int64)
    return out


def scores(f: dict) -> dict[str, object]:
    """Each rule's score, of arrays or of columns."""
    if isinstance(f["n_words"], np.ndarray):
        one = lambda x: np.maximum(x, 1)
    else:
        one = lambda x: F.greatest(x, F.lit(1))
    return {
        "symbols": f["n_symbols"] / one(f["word_chars"]),
        "dup_lines": f["n_dup_lines"] / one(f["n_lines"]),
        "repeats": f["n_repeat_words"] / one(f["n_words"]),
        "word_length": f["word_chars"] / one(f["n_words"]),
    }


def base_failed(f: dict):
    return (f["n_words"] < 10) | (100 * f["n_repeat_words"] > 20 * f["n_words"])


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(at most k of n), each with probability p."""
    if k >= n:
        return 1.0
    if n == 0:
        return 1.0
    i = np.arange(k + 1)
    logs = math.lgamma(n + 1) - np.array([math.lgamma(x + 1) + math.lgamma(n - x + 1) for x in i.tolist()]) + i * math.log(p) + (n - i) * math.log1p(-p)
    top = logs.max()
    return min(1.0, float(np.exp(top) * np.exp(logs - top).sum()))


def choose(grid: tuple, good: np.ndarray, bad: np.ndarray, risk: float, level: float, price: float) -> float | None:
    """The certified cutoff of greatest use (bad documents caught less price times good ones lost), or None.

    good and bad count the labelled documents of each cell; cell j holds those whose score exceeds j of the cutoffs,
    which are the j least: grid[i] rejects the cells from len(grid) - i on.
    """
    n = int(good.sum())
    best, use = None, 0.0
    lost = np.cumsum(good[::-1])[::-1]
    caught = np.cumsum(bad[::-1])[::-1]
    for i, cutoff in enumerate(grid):
        j = len(grid) - i
        k = int(lost[j]) if j < len(lost) else 0
        if binomial_tail(k, n, risk) > level:
            break
        gain = (int(caught[j]) if j < len(caught) else 0) - price * k
        if gain > use:
            best, use = float(cutoff), gain
    return best


def labels_needed(risk: float, level: float) -> int:
    """The fewest good labels that can certify a step: none of them may be lost."""
    return math.ceil(math.log(level) / math.log1p(-risk))


#: Strata up to which their cutoffs come to the driver; more of them are an error of the caller's.
MOST_STRATA = 100_000


def select_cutoffs(measured: DataFrame, labels: DataFrame, risk: float, error: float, price: float) -> dict[str, dict[str, float]]:
    """{stratum: {rule: cutoff}} from labelled rows of measured (__id, __stratum, features).

    Only counts for each (stratum, grid cell) leave the join; only certified cutoffs reach the driver, of MOST_STRATA
    strata at most: ValueError beyond.
    """
    own = labels.groupBy(F.col("doc_id").alias("__label_id")).agg(F.max("quality").alias("__quality"))
    labelled = measured.join(own, F.col("__id") == F.col("__label_id")).where("__quality is not null")
    s = scores({k: F.col(k) for k in FEATURES})
    # a document is lost by step i if its score exceeds one of the i + 1 greatest cutoffs of any rule: the rule that it exceeds most of decides
    cell = F.greatest(*[sum((F.when(s[rule] > c, 1).otherwise(0) for c in grid), F.lit(0)) for rule, grid in RULES.items()])
    counted = (
        labelled.select("__stratum", "__quality", cell.alias("cell"))
        .groupBy("__stratum", "cell")
        .agg(F.sum(F.when(F.col("__quality") == 1, 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("__quality") == 0, 1).otherwise(0)).alias("bad"))
    )
    counted = written(counted, "cells")
    totals = counted.groupBy("__stratum").agg(F.sum("good").alias("n"))
    strata = totals.count()
    if not strata:
        return {}
    if strata > MOST_STRATA:
        raise ValueError(f"{strata} strata; a stratum is meant to be a language or the like")
    pooled = F.col("n") < labels_needed(risk, error / strata)
    groups = written(totals.select(F.col("__stratum").alias("stratum"), pooled.alias("pooled"), F.when(pooled, "").otherwise(F.col("__stratum")).alias("group")), "strata")
    level = error / groups.select("pooled", "group").distinct().count()
    steps = len(next(iter(RULES.values())))

    def certify(pdf: pd.DataFrame) -> pd.DataFrame:
        good, bad = np.zeros(steps + 1, np.int64), np.zeros(steps + 1, np.int64)
        np.add.at(good, pdf["cell"].to_numpy(), pdf["good"].to_numpy())
        np.add.at(bad, pdf["cell"].to_numpy(), pdf["bad"].to_numpy())
        step = choose(tuple(range(steps)), good, bad, risk, level, price)
        return pd.DataFrame({"pooled": [pdf["pooled"].iloc[0]], "group": [pdf["group"].iloc[0]], "step": [step]})[[step is not None]]

    cells = counted.join(groups, F.col("__stratum") == F.col("stratum")).select("pooled", "group", "cell", "good", "bad")
    found = cells.groupBy("pooled", "group").applyInPandas(certify, "pooled boolean, group string, step double")
    return {r.stratum: {rule: grid[int(r.step)] for rule, grid in RULES.items()} for r in groups.join(found, ["pooled", "group"]).collect()}


def measure(docs: DataFrame, id_col: str, text_col: str, stratum_col: str) -> DataFrame:
    """__id, __stratum and the features of every whole text."""
    src = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("__stratum"), F.col(text_col).cast("string").alias("__text"))
    schema = f"__id {src.schema['__id'].dataType.simpleString()}, __stratum string, " + ", ".join(f"{k} long" for k in FEATURES)

    def run(batches):
        for (ids, strata), texts in scan_rows(batches, "__text", ["__id", "__stratum"]):
            f = features(texts.to_pylist())
            yield pa.RecordBatch.from_arrays([ids, strata, *(pa.array(f[k]) for k in FEATURES)], ["__id", "__stratum", *FEATURES])

    return src.mapInArrow(run, schema)


def quality_verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", risk: float = 0.01, error: float = 0.05, price: float = 2.0) -> DataFrame:
    """Counts and verdicts of every document.

    Returns id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, kept (boolean):
    base_failed if there are fewer than ten words or over a fifth of them lie in repeated windows; kept if neither the
    base nor a certified rule of the document's stratum fails. labels: doc_id, quality (1 good, 0 bad; null: no label;
    of several the greatest). Null and empty texts have no words; a null stratum is one of its own; strata with few labels are
    judged by the cutoffs of their pool, and those whose labels certify nothing have none; repeated rows are judged each; other columns are left out.
    """
    measured = written(measure(docs, id_col, text_col, stratum_col), "quality")
    cutoffs = select_cutoffs(measured, labels, risk, error, price)
    f = {k: F.col(k) for k in FEATURES}
    s = scores(f)
    flat = [(k, *(v.get(r) for r in RULES)) for k, v in cutoffs.items()]
    limits = docs.sparkSession.createDataFrame(flat, "__s string, " + ", ".join(f"__cut_{r} double" for r in RULES))
    judged = measured.join(small_side(limits, len(flat)), F.col("__stratum") == F.col("__s"), "left")
    passes = F.lit(True)
    for r in RULES:
        passes = passes & F.coalesce(s[r] <= F.col(f"__cut_{r}"), F.lit(True))
    failed = base_failed(f)
    return judged.select(F.col("__id").alias(id_col), *FEATURES[:5], failed.alias("base_failed"), (~failed & passes).alias("kept"))


def filter_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", risk: float = 0.01, error: float = 0.05, price: float = 2.0) -> DataFrame:
    """The rows of docs, all columns, that quality_verdicts keeps. Texts are judged where they are read: no shuffle.

    Before that, only labelled documents are measured if their ids are few enough to be broadcast, else all of them.
    """
    ids = labels.select(F.col("doc_id").alias("__labelled")).distinct()
    n = ids.count()
    asked = docs.join(F.broadcast(ids), F.col(id_col) == F.col("__labelled"), "left_semi") if n <= BROADCAST_ROWS else docs
    cutoffs = select_cutoffs(written(measure(asked, id_col, text_col, stratum_col), "quality"), labels, risk, error, price)

    def run(batches):
        for batch in batches:
            strata = batch.column(batch.schema.get_field_index(stratum_col)).to_pylist()
            keep = []
            for _, texts in scan_rows([batch], text_col, []):
                f = features(texts.to_pylist())
                s = scores(f)
                ok = ~base_failed(f)
                at = len(keep)
                for i in np.flatnonzero(ok).tolist():
                    limits = cutoffs.get(str(strata[at + i]) if strata[at + i] is not None else "", {})
                    ok[i] = all(s[r][i] <= c for r, c in limits.items())
                keep.extend(ok.tolist())
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
