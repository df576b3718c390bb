"""Minimal acyclic transducers: sorted words in, each word's place in the order out."""

from __future__ import annotations

import io
from collections.abc import Iterable

import numpy as np


class Transducer:
    """The words of a sorted list as a minimal acyclic automaton whose arcs carry numbers; a word's numbers add up to its
    ordinal, the count of words before it.

    States are rows of arcs. Arcs are kept in arrays that ascend by state * 256 + byte, so that many words are looked up
    together, byte by byte. Children have smaller numbers than their parents; the last state is the root.
    """

    def __init__(self, keys: np.ndarray, to: np.ndarray, add: np.ndarray, final: np.ndarray, size: int):
        self.keys, self.to, self.add, self.final, self.size = keys, to, add, final, size

    @classmethod
    def build(cls, words: Iterable[bytes]) -> Transducer:
        """From distinct words in ascending order of their bytes; ValueError if they are not."""
        known: dict[tuple, int] = {}
        count: list[int] = []
        rows: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
        # the states of the last word, which may still get arcs: [final, arcs]
        path: list[list] = [[False, []]]
        last, size = b"", 0

        def freeze(down_to: int) -> None:
            """States of the last word beyond that depth get numbers, those of equal ones where there are any."""
            while len(path) > down_to + 1:
                final, arcs = path.pop()
                row = (final, tuple(arcs))
                at = known.get(row)
                if at is None:
                    at = known[row] = len(rows)
                    rows.append(row)
                    count.append(final + sum(count[t] for _, t in arcs))
                path[-1][1].append((last[len(path) - 1], at))

        for word in words:
            if size and word <= last:
                raise ValueError("words are not distinct and ascending")
            same = 0
            for x, y in zip(word, last, strict=False):
                if x != y:
                    break
                same += 1
            freeze(same)
            path.extend([False, []] for _ in word[same:])
            path[-1][0] = True
            last, size = word, size + 1
        freeze(0)
        rows.append((path[0][0], tuple(path[0][1])))
        sizes = [len(arcs) for _, arcs in rows]
        keys, to, add = np.empty(sum(sizes), np.int64), np.empty(sum(sizes), np.int32), np.empty(sum(sizes), np.int64)
        k = 0
        for state, (final, arcs) in enumerate(rows):
            before = int(final)
            for byte, target in arcs:
                keys[k], to[k], add[k] = state * 256 + byte, target, before
                before += count[target]
                k += 1
        return cls(keys, to, add, np.array([f for f, _ in rows]), size)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, keys=self.keys, to=self.to, add=self.add, final=self.final, size=self.size)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Transducer:
        held = np.load(io.BytesIO(data))
        return cls(held["keys"], held["to"], held["add"], held["final"], int(held["size"]))

    def ordinals(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The ordinal of each word data[start:end], -1 for words that are not in the list."""
        out = np.full(len(starts), -1, np.int64)
        on = np.arange(len(starts)) if len(self.final) else np.empty(0, np.int64)
        state, total, at = np.full(len(on), len(self.final) - 1), np.zeros(len(on), np.int64), np.asarray(starts)[on]
        ends = np.asarray(ends)
        while len(on):
            over = at == ends[on]
            if over.any():
                hit = over & self.final[state]
                out[on[hit]] = total[hit]
                on, state, total, at = on[~over], state[~over], total[~over], at[~over]
            if not len(self.keys):
                break
            want = state * 256 + data[at]
            k = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            go = self.keys[k] == want
            on, at, total, state = on[go], at[go] + 1, total[go] + self.add[k[go]], self.to[k[go]].astype(np.int64)
        return out

    def word(self, ordinal: int) -> bytes:
        """The word of an ordinal."""
        if not 0 <= ordinal < self.size:
            raise IndexError(ordinal)
        out, state = bytearray(), len(self.final) - 1
        while not (self.final[state] and ordinal == 0):
            lo, hi = np.searchsorted(self.keys, (state * 256, (state + 1) * 256))
            k = lo + int(np.searchsorted(self.add[lo:hi], ordinal, side="right")) - 1
            out.append(int(self.keys[k]) & 255)
            ordinal -= int(self.add[k])
            state = int(self.to[k])
        return bytes(out)
