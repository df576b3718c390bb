"""Token counts for the sections of documents, from one encoding of each whole text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.bpe import SLICE, load
from strandline.llm.common import flat_ranges, scan_rows

RULES = ("first", "last", "most")


def section_starts(data: np.ndarray, ends: np.ndarray, separator: int = 10) -> np.ndarray:
    """Byte offsets at which sections begin: each text's start, and after each separator byte that is not its last."""
    cut = np.flatnonzero(data == separator) + 1
    begins = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    return np.unique(np.concatenate([begins[ends > begins], cut[~np.isin(cut, ends)]]))


def allocate(tok_from: np.ndarray, tok_to: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Joins token spans with the sections they overlap, both ascending; returns each token's section and whether it
    crosses a boundary. A crossing token goes to the section of its first or its last byte, or to the one that holds
    most of its bytes (the earliest of several)."""
    first = np.searchsorted(starts, tok_from, side="right") - 1
    last = np.searchsorted(starts, tok_to - 1, side="right") - 1
    crossing = first != last
    if rule == "last":
        return last, crossing
    own = first.copy()
    if rule == "most" and crossing.any():
        t = np.flatnonzero(crossing)
        n = (last - first)[t] + 1
        sec, tok = flat_ranges(first[t], n), np.repeat(t, n)
        held = np.minimum(tok_to[tok], ends[sec]) - np.maximum(tok_from[tok], starts[sec])
        order = np.lexsort((sec, -held, tok))
        own[t] = sec[order][np.cumsum(n) - n]
    return own, crossing


def count_tokens(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text", rule: str = "first") -> DataFrame:
    """Attributes the tokens of each whole text to its sections: its lines, each with its newline.

    The text is encoded once, so that a section's count is its part of the whole document's count, not that of the
    section encoded alone. A token over a boundary is given to one section by the rule ("first", "last" or "most":
    whose byte comes first, last, or who holds most bytes), so that counts add up to the document's.
    Returns id_col, section int (from 0), char_start, char_end, n_tokens, n_crossing (tokens of the section's that
    reach beyond it), all long. Null and empty texts have one section of no characters and no tokens; repeated rows
    are counted each; other columns are left out.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    src = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    schema = f"__id {src.schema['__id'].dataType.simpleString()}, section int, char_start long, char_end long, n_tokens long, n_crossing long"

    def run(batches):
        bpe = load(vocab)
        for (keys,), texts in scan_rows(batches, "__text", ["__id"], SLICE):
            texts = texts.fill_null("") if texts.null_count else texts
            ids, _ = bpe.encode_batch(texts)
            at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
            ends = at[1:] - at[0]
            starts = section_starts(data, ends)
            stops = np.append(starts[1:], len(data))[: len(starts)]
            tok_to = np.cumsum(bpe.piece_len[ids])
            own, crossing = allocate(tok_to - bpe.piece_len[ids], tok_to, starts, stops, rule)
            tokens = np.bincount(own, minlength=len(starts))
            over = np.bincount(own[crossing], minlength=len(starts))
            chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
            doc = np.searchsorted(ends, starts, side="right")
            base = chars[np.concatenate(([0], ends[:-1]))]
            number = np.arange(len(doc)) - np.searchsorted(doc, doc)
            empty = np.flatnonzero(np.diff(np.concatenate(([0], ends))) == 0)
            zero = np.zeros(len(empty), np.int64)
            rows = np.concatenate([doc, empty])
            cols = (
                np.concatenate([number, zero]).astype(np.int32),
                np.concatenate([chars[starts] - base[doc], zero]),
                np.concatenate([chars[stops] - base[doc], zero]),
                np.concatenate([tokens, zero]),
                np.concatenate([over, zero]),
            )
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows)), *map(pa.array, cols)], ["__id", "section", "char_start", "char_end", "n_tokens", "n_crossing"])

    return src.mapInArrow(run, schema).withColumnRenamed("__id", id_col)
