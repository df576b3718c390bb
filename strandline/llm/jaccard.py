"""Exact similarity join of word n-gram sets by a prefix tree, and the groups that its links form.

1. Every document becomes a set of hashed word n-grams. Equal sets are one class, of which one goes on.
2. Blocks. Two t-similar sets differ in few members. If the members are dealt by hash into more classes than can differ,
   some classes are equal in both. Each set sends keys for its largest classes (at the scale of its own size and, near
   a boundary, of the next); sets with a common key go into one block. Nothing that is similar is missed, and most
   sets meet no other. Chance meetings can chain sets to a large block, the more of them the larger the input is. Such
   blocks are dealt again by other hashes, by which similar sets have a common key too and chance seldom meets the same.
3. All sets in blocks are sorted by one global order of their members, the most frequent first: counts of all members
   over a fixed number of cells, then the members themselves. A chunk of sets is stored in a compressed prefix tree.
   Sets walk the tree level by level: the overlap with a path is counted once for all sets below it, and a subtree is
   left as soon as its overlap and the shorter of both remainders cannot reach what is needed. The count at a set's end
   is the exact overlap. A join returns the links of a spanning forest, so that copies never become all their pairs.
4. Large blocks are cut by hash into chunks, each joined with itself. One set of each component found goes on to the
   next round, in fewer chunks, until no round finds a link: near copies, however many, end up as one component. Only
   chunks with sets of different components are then joined with each other, each pair once.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import _MUL, Scratch, flat_ranges, mix, runs, scan_rows, small_side, text_hashes, window_hashes, written, written_alone
from strandline.operators.components import star_components

#: Sizes of chunks of a block: sets, members.
CHUNK_SETS, CHUNK_MEMBERS = 1000, 500_000
#: Cells over which members are counted for their global order (a power of two).
CELLS = 1 << 18
_BAND = 1.5
#: Passes in which sets are dealt by their keys: each shuffles, and holds on disk, its share of the keys.
PASSES = 2
#: Blocks of more than so many chunks of sets are dealt again: each set meets every chunk of its block.
FEW_CHUNKS = 4
#: Rounds in which they are dealt again at most; one that takes less than a tenth of their sets out is the last.
ROUNDS = 8


def shingle_sets(texts: pa.Array | list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The ascending hashed n-gram sets, one after another, and their sizes. Shorter texts are one n-gram as a whole;
    texts without words have none."""
    h, counts = text_hashes(texts, lower=True)
    first = np.cumsum(counts) - counts
    grams = window_hashes(h, n)
    windows = np.maximum(counts - n + 1, 0)
    doc = np.repeat(np.arange(len(texts)), windows)
    g = grams[flat_ranges(first, windows)] if len(grams) else np.empty(0, np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        own = np.array([xxhash.xxh3_64_intdigest(h[a : a + c].tobytes(), seed=n) for a, c in zip(first[short].tolist(), counts[short].tolist(), strict=True)], np.uint64)
        g, doc = np.concatenate([g, own]), np.concatenate([doc, short])
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    return g[new], np.bincount(doc[new], minlength=len(texts)).astype(np.int64)


def bands(size: int) -> int:
    """The band of a size: bounds grow by a factor, from 1."""
    return int(math.log(size) / math.log(_BAND) + 1e-9) if size else 0


def classes_of(band: int, percent: int) -> int:
    """Classes at a band: a seventh more than two similar sets of the band can differ in, and two."""
    top = math.ceil(_BAND ** (band + 1))
    # |x ^ y| <= (1 - t) / (1 + t) * (|x| + |y|)
    return ((100 - percent) * 2 * top // (100 + percent)) * 8 // 7 + 2


def block_keys(g: np.ndarray, sizes: np.ndarray, percent: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all sets and each one's set. Each seed deals the members to classes in another way.

    Of m classes, two similar sets have at least m - d equal ones, d being the most members they can differ in. Each
    set sends its largest classes, leaving out fewer than m - d: then an equal class is among those sent by whichever
    of the two leaves out more, and its size is at least the other's bound too. Empty and tiny classes, which unlike
    sets share by chance, are sent only by sets that have too few others.
    """
    band = np.array([bands(int(s)) for s in sizes.tolist()], np.int64)
    m = np.array([classes_of(b, percent) for b in range(int(band.max()) + 2)] if len(band) else [1], np.int64)
    keys, owner = [], []
    first = np.cumsum(sizes) - sizes
    # a similar set that is larger has at most size * 100 / percent members
    above = (sizes * 100 // percent >= np.floor(_BAND ** (band + 1)).astype(np.int64)) & (sizes > 0)
    differ = (100 - percent) * sizes // percent
    with np.errstate(over="ignore"):
        dealt = mix(g + np.uint64(seed) * _MUL) if seed else g
    for shift, who in ((0, np.flatnonzero(sizes > 0)), (1, np.flatnonzero(above))):
        if not len(who):
            continue
        level = band[who] + shift
        at = flat_ranges(first[who], sizes[who])
        own = np.repeat(np.arange(len(who)), sizes[who])
        cls = (dealt[at] >> np.uint64(20)) % m[level][own].astype(np.uint64)
        slots = m[level]
        base = np.cumsum(slots) - slots
        slot = base[own] + cls.astype(np.int64)
        held = np.bincount(slot, minlength=int(slots.sum()))
        sums = np.zeros(int(slots.sum()), np.uint64)
        with np.errstate(over="ignore"):
            np.add.at(sums, slot, mix(g[at] ^ np.uint64(0x5BF0363546A3D2C1)))
            number = flat_ranges(np.zeros(len(who), np.int64), slots).astype(np.uint64)
            sums = mix(sums + mix(number * _MUL + np.repeat(level, slots).astype(np.uint64)))
        who_of = np.repeat(np.arange(len(who)), slots)
        order = np.lexsort((held, who_of))
        bound = held[order][base + np.maximum(slots - np.minimum(differ[who], slots - 1) - 1, 0)]
        sent = held >= bound[who_of]
        keys.append(sums[sent])
        owner.append(who[who_of[sent]])
    return (np.concatenate(keys), np.concatenate(owner)) if keys else (np.empty(0, np.uint64), np.empty(0, np.int64))


class PrefixTree:
    """A compressed prefix tree of sorted member lists, its nodes laid out level by level."""

    def __init__(self, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        """flat: members of all lists, each list ascending; lists are in lexicographic order."""
        n = len(sizes)
        same = np.zeros(n, np.int64)  # members shared with the list before
        for i in range(1, n):
            a, b, k = starts[i - 1], starts[i], min(sizes[i - 1], sizes[i])
            differ = np.flatnonzero(flat[a : a + k] != flat[b : b + k])
            same[i] = differ[0] if len(differ) else k
        nodes: list[tuple[int, int, int, int, int]] = []  # level, parent, from, to, list's number or -1
        self.end = np.zeros(n, np.int64)
        shortest: list[int] = []
        longest: list[int] = []

        def add(level, parent, a, b):
            nodes.append((level, parent, a, b))
            shortest.append(1 << 40)
            longest.append(0)
            return len(nodes) - 1

        stack = [(0, n, 0, -1, 0)]  # lists, depth so far, parent, level
        while stack:
            lo, hi, depth, parent, level = stack.pop()
            while lo < hi and sizes[lo] == depth and parent >= 0:
                self.end[lo] = parent
                lo += 1
            if lo >= hi:
                continue
            cuts = [lo, *(lo + 1 + np.flatnonzero(same[lo + 1 : hi] <= depth)).tolist(), hi]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                to = int(sizes[a]) if b - a == 1 else int(min(same[a + 1 : b].min(), sizes[a]))
                node = add(level, parent, int(starts[a]) + depth, int(starts[a]) + to)
                shortest[node], longest[node] = int(sizes[a:b].min()), int(sizes[a:b].max())
                stack.append((a, b, to, node, level + 1))
        order = np.argsort([x[0] for x in nodes], kind="stable") if nodes else np.empty(0, np.int64)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        table = np.array(nodes, np.int64).reshape(-1, 4)[order]
        self.parent = np.where(table[:, 1] >= 0, place[table[:, 1]], -1)
        self.length = table[:, 3] - table[:, 2]
        self.members = flat[flat_ranges(table[:, 2], self.length)]
        self.at = np.cumsum(self.length) - self.length
        self.shortest, self.longest = np.array(shortest, np.int64)[order], np.array(longest, np.int64)[order]
        self.depth = np.zeros(len(order), np.int64)
        self.levels = np.searchsorted(table[:, 0], np.arange(int(table[-1, 0]) + 2)) if len(order) else np.zeros(1, np.int64)
        for a, b in zip(self.levels[:-1], self.levels[1:], strict=True):
            p = self.parent[a:b]
            self.depth[a:b] = np.where(p >= 0, self.depth[p], 0) + self.length[a:b]
        self.end = place[self.end] if len(order) else self.end

    def overlaps(self, inside: np.ndarray, size: int, extra: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Overlap of each node's path with a set given as a mask over members, and whether the node was reached.

        size: the set's full size. extra: for each node, members below it that are in no other set and so in no path.
        """
        got = np.zeros(len(self.parent), np.int64)
        alive = np.zeros(len(self.parent), bool)
        for a, b in zip(self.levels[:-1], self.levels[1:], strict=True):
            p = self.parent[a:b]
            own = np.flatnonzero((p < 0) | alive[p])
            if not len(own):
                break
            node = own + a
            n = self.length[node]
            hits = inside[self.members[flat_ranges(self.at[node], n)]]
            sums = np.add.reduceat(hits, np.concatenate(([0], np.cumsum(n)[:-1]))) if len(hits) else np.zeros(len(node), np.int64)
            o = np.where(p[own] >= 0, got[p[own]], 0) + sums
            got[node] = o
            # the smallest set below decides what is needed, the longest what may still come
            small = self.shortest[node] + extra[node]
            need = -(-percent * (size + small) // (100 + percent))
            alive[node] = o + np.minimum(size - o, self.longest[node] - self.depth[node]) >= need
        return got, alive


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        a, b = self.root(x), self.root(y)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def cell_of(members: np.ndarray) -> np.ndarray:
    return (mix(members) >> np.uint64(40)).astype(np.int64) & (CELLS - 1)


def tree_join(ids: np.ndarray, sets: list[np.ndarray], side: np.ndarray, percent: int, frequency: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of the sets whose Jaccard similarity is at least percent / 100.

    side: 0 for sets of the tree, 1 for sets that walk it; where all are of side 0, they do both. frequency: of each
    cell, for the members' global order.
    """
    two = bool(side.any())
    if two and side.all():
        return []
    sizes = np.array([len(s) for s in sets], np.int64)
    members, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    walks = np.bincount(inverse, weights=side[owner], minlength=len(members))
    count = np.bincount(inverse, minlength=len(members))
    met = (walks > 0) & (walks < count) if two else count > 1
    shared = met[inverse]
    common = np.bincount(owner, weights=shared, minlength=len(sets)).astype(np.int64)
    # a set whose shared members are too few for any partner has no link
    fit = 100 * common >= percent * sizes
    rank = np.empty(len(members), np.int64)
    rank[np.lexsort((members, -frequency[cell_of(members)]))] = np.arange(len(members))
    keep = shared & fit[owner]
    own, flat = owner[keep], rank[inverse[keep]]
    order = np.lexsort((flat, own))
    own, flat = own[order], flat[order]
    starts = np.searchsorted(own, np.arange(len(sets)))
    lists = {i: flat[starts[i] : starts[i] + common[i]] for i in np.flatnonzero(fit).tolist()}
    by = np.array(sorted((i for i in lists if not side[i]), key=lambda i: lists[i].astype(">i8").tobytes()), np.int64)
    walkers = [i for i in lists if side[i]] if two else by.tolist()
    if not len(by) or not walkers:
        return []
    tree = PrefixTree(flat, starts[by], common[by])
    extra = np.full(len(tree.parent), 1 << 40, np.int64)
    # the fewest members outside the tree among the sets below a node
    np.minimum.at(extra, tree.end, (sizes - common)[by])
    for node in range(len(extra) - 1, -1, -1):
        if tree.parent[node] >= 0:
            extra[tree.parent[node]] = min(extra[tree.parent[node]], extra[node])
    forest, links = Forest(len(sets)), []
    inside = np.zeros(len(members), np.int64)
    full = sizes[by]
    for q in walkers:
        x = lists[q]
        inside[x] = 1
        got, alive = tree.overlaps(inside, int(sizes[q]), extra, percent)
        inside[x] = 0
        o = got[tree.end]
        near = np.flatnonzero(alive[tree.end] & (100 * o >= percent * (sizes[q] + full - o)))
        for j in by[near].tolist():
            if j != q and forest.join(q, j):
                links.append((int(ids[q]), int(ids[j])))
    return links


def _least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links, ascending, and the least node that the links lead each one to."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    forest = Forest(len(nodes))
    for x, y in np.unique(at.reshape(2, -1), axis=1).T.tolist():
        forest.join(x, y)
    return nodes, nodes[[forest.root(x) for x in range(len(nodes))]]


def _local_stars(batches):
    """Sets that keys in a batch link, one way or another, are linked with the least of them at once; of each key, the least
    set that its sets are linked with is sent on as (key, set)."""
    for batch in batches:
        keys = batch.column("keys")
        flat = keys.flatten().to_numpy()
        if not len(flat):
            continue
        node = np.repeat(batch.column("__id").to_numpy(), np.diff(keys.offsets.to_numpy()))
        order = np.argsort(flat, kind="stable")
        flat, node = flat[order], node[order]
        starts, lengths = runs(flat)
        nodes, least = _least_reached(node, np.repeat(node[starts], lengths))
        on = nodes != least
        sent = least[np.searchsorted(nodes, node[starts])]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat([False, True], [len(starts), int(on.sum())])), pa.array(np.concatenate([flat[starts], nodes[on]])), pa.array(np.concatenate([sent, least[on]]))], ["local", "a", "b"]
        )


def _stars(batches):
    """(a, b): links between the sets of each key, from rows sorted by key, and the links that are there already: of each
    batch a spanning forest, so fewer links than sets however many keys these share. Holds one row between batches."""
    last, first = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        local, a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("local", "a", "b"))
        pairs = [np.stack([a[local], b[local]])]
        key, node = a[~local], b[~local]
        if len(key):
            starts, lengths = runs(key)
            hub = np.repeat(node[starts], lengths)
            if last is not None and key[0] == last:
                hub[: lengths[0]] = first
            last, first = key[-1], hub[-1]
            on = hub != node
            pairs.append(np.stack([node[on], hub[on]]))
        nodes, least = _least_reached(*np.concatenate(pairs, axis=1))
        on = nodes != least
        if on.any():
            yield pa.RecordBatch.from_arrays([pa.array(nodes[on]), pa.array(least[on])], ["a", "b"])


def _join_chunks(percent: int, frequency: np.ndarray):
    """Links within each group of rows (block, ci, cj), sorted by it."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        key = None

        def done(parts):
            t = pa.Table.from_batches(parts)
            sets = [np.frombuffer(b, np.uint64) for b in t.column("members").to_pylist()]
            return tree_join(t.column("node").to_numpy(), sets, t.column("side").to_numpy(), percent, frequency)

        def send(links):
            a = np.array(links, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["a", "b"])

        for batch in batches:
            links = []
            b, i, j = (batch.column(c).to_numpy() for c in ("block", "ci", "cj"))
            if not len(b):
                continue
            cut = np.flatnonzero((b[1:] != b[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(b)], strict=True):
                k = (b[lo], i[lo], j[lo])
                if held and k != key:
                    links += done(held)
                    held = []
                key = k
                held.append(batch.slice(lo, hi - lo))
            if links:
                yield send(links)
        if held and (links := done(held)):
            yield send(links)

    return run


def _list_of(keys: np.ndarray, owner: np.ndarray, n: int) -> pa.ListArray:
    """The keys of each of n sets."""
    ends = np.cumsum(np.bincount(owner, minlength=n))
    order = np.argsort(owner, kind="stable")
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(keys[order].view(np.int64)))


def _measure(src: DataFrame, n: int, percent: int) -> DataFrame:
    """__id, the set's size, digest and block keys."""

    def run(batches):
        for (ids,), texts in scan_rows(batches, "__text", ["__id"]):
            g, sizes = shingle_sets(texts, n)
            lists = _list_of(*block_keys(g, sizes, percent), len(sizes))
            at = np.cumsum(sizes)
            data = g.tobytes()
            dig = [xxhash.xxh3_128_intdigest(data[8 * (e - s) : 8 * e]) for e, s in zip(at.tolist(), sizes.tolist(), strict=True)]
            hi = np.array([d >> 64 for d in dig], np.uint64).view(np.int64)
            lo = np.array([d & 0xFFFFFFFFFFFFFFFF for d in dig], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes), pa.array(hi), pa.array(lo), lists], ["__id", "n", "hi", "lo", "keys"])

    return src.mapInArrow(run, "__id long, n long, hi long, lo long, keys array<long>")


def _blocks(sets: DataFrame) -> DataFrame:
    """node, block: sets (__id, keys) that keys link, one way or another; a block has the least node's id."""
    stars = []
    for i in range(PASSES):
        own = sets.select("__id", F.expr(f"filter(keys, k -> pmod(k, {PASSES}) = {i})").alias("keys"))
        keyed = own.mapInArrow(_local_stars, "local boolean, a long, b long")
        stars.append(written(keyed.repartition("local", "a").sortWithinPartitions("local", "a").mapInArrow(_stars, "a long, b long").distinct(), "stars"))
    return written(star_components(reduce(DataFrame.unionByName, stars)).select("node", F.col("component").alias("block")), "blocks")


def _dealt_again(src: DataFrame, n: int, percent: int, seed: int) -> DataFrame:
    """__id and the keys by another seed, of which those of different blocks differ. src: __id, __text, block."""

    def run(batches):
        for (ids, block), texts in scan_rows(batches, "__text", ["__id", "block"]):
            g, sizes = shingle_sets(texts, n)
            keys, owner = block_keys(g, sizes, percent, seed)
            with np.errstate(over="ignore"):
                keys = mix(keys + mix(block.to_numpy().view(np.uint64) + _MUL)[owner])
            yield pa.RecordBatch.from_arrays([ids, _list_of(keys, owner, len(sizes))], ["__id", "keys"])

    return src.mapInArrow(run, "__id long, keys array<long>")


def _refined(src: DataFrame, blocks: DataFrame, n: int, percent: int) -> DataFrame:
    """blocks with those of more than FEW_CHUNKS chunks of sets parted by further dealings. Similar sets stay in one block, since
    every dealing gives them a common key; sets that meet no other are left out."""
    done = []
    large = lambda b: written(b.groupBy(F.col("block").alias("k")).agg(F.count("*").alias("held")).where(F.col("held") > FEW_CHUNKS * CHUNK_SETS), "large")
    wide, seed = large(blocks), 0
    held = wide.agg(F.sum("held")).first()[0] or 0
    while held and seed < ROUNDS:
        seed += 1
        side = small_side(wide.select("k"), wide.count())
        done.append(blocks.join(side, F.col("block") == F.col("k"), "left_anti"))
        again = written(blocks.join(side, F.col("block") == F.col("k"), "left_semi"), "again")
        dealt = Scratch(src.sparkSession, "keys")
        blocks = _blocks(dealt.write(_dealt_again(src.join(small_side(again, held), F.col("__id") == F.col("node")).select("__id", "__text", "block"), n, percent, seed)))
        dealt.keep(0)
        before, wide = held, large(blocks)
        held = wide.agg(F.sum("held")).first()[0] or 0
        if 10 * held > 9 * before:
            break
    return written(reduce(DataFrame.unionByName, [*done, blocks]), "blocks") if done else blocks


def _members(src: DataFrame, n: int) -> DataFrame:
    def run(batches):
        for (ids, block), texts in scan_rows(batches, "__text", ["__id", "block"]):
            g, sizes = shingle_sets(texts, n)
            data, at = g.tobytes(), np.cumsum(sizes)
            blobs = pa.array([data[8 * (e - s) : 8 * e] for e, s in zip(at.tolist(), sizes.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([ids, block, pa.array(sizes), blobs], ["node", "block", "n", "members"])

    return src.mapInArrow(run, "node long, block long, n long, members binary")


def _frequencies(members: DataFrame) -> np.ndarray:
    """How often members of each cell occur, over all sets: CELLS numbers, whatever the input's size."""

    def run(batches):
        total = np.zeros(CELLS, np.int64)
        for b in batches:
            total += np.bincount(cell_of(np.frombuffer(b"".join(b.column("members").to_pylist()), np.uint64)), minlength=CELLS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    out = np.zeros(CELLS, np.int64)
    counted = members.select("members").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out[counted["cell"].to_numpy()] = counted["n"].to_numpy()
    return out


def _chunks(sets: Column | str, members: Column | str) -> Column:
    return F.greatest(F.ceil(F.col(sets) / CHUNK_SETS), F.ceil(F.col(members) / CHUNK_MEMBERS)).cast("int")


def _inside(members: DataFrame, percent: int, frequency: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """Links within chunks of each block, and the blocks (k) of several chunks."""
    room = written(members.groupBy(F.col("block").alias("k")).agg(F.count("*").alias("sets"), F.sum("n").alias("m")).select("k", _chunks("sets", "m").alias("chunks")), "room")
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    dealt = members.join(small_side(room, room.count()), F.col("block") == F.col("k")).select("node", "block", "members", chunk.alias("ci"), chunk.alias("cj"), F.lit(0).alias("side"))
    links = dealt.repartition("block", "ci", "cj").sortWithinPartitions("block", "ci", "cj").mapInArrow(_join_chunks(percent, frequency), "a long, b long")
    return written(links, "inside"), room.where("chunks > 1").select("k")


def _across(members: DataFrame, labels: DataFrame, percent: int, frequency: np.ndarray) -> DataFrame:
    """Links between sets of one block that are in different components. A large component has chunks of its own, which
    are not joined with each other; small ones share chunks."""
    m = members.join(labels.withColumnRenamed("node", "k"), F.col("node") == F.col("k"), "left").withColumn("label", F.coalesce("component", "node")).drop("k", "component")
    m = written(m, "labelled")
    own = written(m.groupBy("block", "label").agg(F.count("*").alias("sets"), F.sum("n").alias("m")), "labels")
    several = own.groupBy(F.col("block").alias("b")).agg(F.count("*").alias("labels"), F.sum(F.when(F.col("sets") <= CHUNK_SETS, F.col("sets"))).alias("s"), F.sum(F.when(F.col("sets") <= CHUNK_SETS, F.col("m"))).alias("sm")).where("labels > 1")
    several = written(several.select("b", _chunks("s", "sm").alias("shared")), "several")
    plan = own.join(small_side(several, several.count()), F.col("block") == F.col("b"))
    large = F.col("sets") > CHUNK_SETS
    plan = written(plan.select(F.col("block").alias("pb"), F.col("label").alias("pl"), F.when(large, F.col("label")).alias("alone"), F.when(large, _chunks("sets", "m")).otherwise(F.col("shared")).alias("chunks")), "plan")
    spread = F.pmod(F.xxhash64(F.when(F.col("alone").isNull(), F.col("label")).otherwise(F.col("node"))), F.col("chunks")).cast("int")
    dealt = written(m.join(small_side(plan, plan.count()), (F.col("block") == F.col("pb")) & (F.col("label") == F.col("pl"))).select("node", "block", "members", "alone", spread.alias("c")), "dealt")
    parts = dealt.select("block", "alone", "c").distinct()
    parts = written(parts.withColumn("part", F.row_number().over(Window.partitionBy("block").orderBy("alone", "c"))), "parts")
    a = parts.select("block", F.col("alone").alias("a1"), F.col("c").alias("c1"), F.col("part").alias("ci"))
    b = parts.select(F.col("block").alias("b2"), F.col("alone").alias("a2"), F.col("part").alias("cj"))
    # chunks of one component by itself need not meet
    met = written(a.join(b, (F.col("block") == F.col("b2")) & (F.col("ci") <= F.col("cj"))).where("a1 is null or a2 is null or a1 <> a2").select("block", "ci", "cj"), "met")
    sides = met.select(F.col("block").alias("b"), "ci", "cj", F.col("ci").alias("part"), F.lit(0).alias("side")).unionByName(met.where("ci <> cj").select(F.col("block").alias("b"), "ci", "cj", F.col("cj").alias("part"), F.lit(1).alias("side")))
    sides = sides.join(parts.select(F.col("block").alias("pb"), F.col("part").alias("pp"), "alone", "c"), (F.col("b") == F.col("pb")) & (F.col("part") == F.col("pp"))).select("b", "ci", "cj", "side", F.col("alone").alias("pa"), F.col("c").alias("pc"))
    rows = dealt.join(sides, (F.col("block") == F.col("b")) & F.col("alone").eqNullSafe(F.col("pa")) & (F.col("c") == F.col("pc"))).select("node", "block", "members", "ci", "cj", "side")
    return rows.repartition("block", "ci", "cj").sortWithinPartitions("block", "ci", "cj").mapInArrow(_join_chunks(percent, frequency), "a long, b long")


def _links(members: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that connect all similar sets of each block. members: node, block, n, members, written."""
    frequency = _frequencies(members)
    links, wide = _inside(members, percent, frequency)
    if wide.isEmpty():
        return links
    members = left = written(members.join(small_side(wide, wide.count()), F.col("block") == F.col("k"), "left_semi"), "wide")
    while True:
        labels = written(star_components(links), "labels")
        # one set of each component meets the others' in fewer chunks
        gone = labels.where("node <> component").select(F.col("node").alias("k"))
        left = written(left.join(gone, F.col("node") == F.col("k"), "left_anti"), "left")
        found, more = _inside(left, percent, frequency)
        if found.isEmpty():
            break
        links = links.unionByName(found)
        if more.isEmpty():
            labels = written(star_components(links), "labels")
            break
    return links.unionByName(_across(members, labels, percent, frequency))


def similarity_groups(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents whose n-gram sets are linked: 100 * intersection >= percent * union.

    Returns id_col (an integer), n_shingles and component_id (the least id that links reach, itself included), one row
    for each row of docs. Texts without words (null and empty ones too) have no n-grams and no links; texts shorter
    than n words are one n-gram; rows of one id count as one document with several texts, and are linked; a null id
    links with nothing and is its own (null) component; an empty table gives an empty result; other columns are left
    out. n-grams are equal if their 64-bit hashes are.
    """
    src = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"))
    kept = Scratch(docs.sparkSession, "sets")
    measured = kept.write(_measure(src, n, percent))
    sets = measured.where("n > 0 and __id is not null")
    reps = written(sets.groupBy("hi", "lo", "n").agg(F.min("__id").alias("rep"), F.count("*").alias("rows")).where("rows > 1").drop("rows"), "reps")
    copies = sets.select("__id", "hi", "lo", "n").join(small_side(reps, reps.count()), ["hi", "lo", "n"]).where("__id <> rep")
    copies = written(copies.select("__id", "hi", "lo", "rep").distinct(), "copies")
    # of equal sets only one has keys and a place in a block
    others = copies.select(F.col("__id").alias("i"), F.col("hi").alias("h"), F.col("lo").alias("l"))
    once = sets.join(small_side(others, others.count()), (F.col("__id") == F.col("i")) & (F.col("hi") == F.col("h")) & (F.col("lo") == F.col("l")), "left_anti")
    blocks = _blocks(once)
    ids = written(measured.select("__id", "n"), "ids")
    kept.keep(0)  # the keys, most of what is on disk here
    blocks = _refined(src, blocks, n, percent)
    members = written(_members(src.join(small_side(blocks, blocks.count()), F.col("__id") == F.col("node")).select("__id", "__text", "block"), n).where("n > 0"), "members")
    same = copies.select(F.col("__id").alias("a"), F.col("rep").alias("b"))
    found = star_components(_links(members, percent).unionByName(same))
    return ids.join(found, F.col("__id") == F.col("node"), "left").select(F.col("__id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "__id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns: of each group the document of least id; rows of that id all stay."""
    groups = lambda: similarity_groups(docs, n, percent, id_col, text_col)
    gone = written_alone(lambda: groups().where(f"component_id <> `{id_col}`").select(F.col(id_col).alias("__gone")).distinct(), "gone")
    return docs.join(small_side(gone, gone.count()), F.col(id_col) == F.col("__gone"), "left_anti")
