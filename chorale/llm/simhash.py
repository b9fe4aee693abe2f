"""SimHash near-duplicates with a Gray-order hierarchical index.

An upper node of the index is a mask with the bits that its members share under it, and tasks take whole upper nodes. Within one,
fingerprints are sorted by Gray rank, so that neighbours share long bit patterns, and runs of eight are factored into nodes again
and again: a node holds the bits that all below it have in common and are not fixed above it. A search goes down from the root,
adds the differences on those bits and drops a node, and all below it, once the sum exceeds the radius. Nodes whose members
already belong to the searched one's component are dropped too, so a large group of near copies costs about one pass. Only
distinct fingerprints are searched, and a task passes on a spanning forest of what it linked, never all pairs.

Fingerprints of one word (64 bits) are linked exactly: those that differ in at most r bits agree on some b - r of b blocks, and
the masks are all choices of b - r blocks. A similarity of texts, rather than a distance, needs longer fingerprints: texts of
Jaccard similarity 0.8 differ in 15 % of bits, +- 4.5 % in 64 of them, unrelated ones in half. `near_copies` takes four words by
default and links up to a fifth of the bits; its masks are samples of bits, as many as find a pair of similarity 0.8 in 97 of 100
cases and closer ones nearly always. This is an estimate: a pair between 0.6 and 0.8 may be linked as well.

`drop_near_copies` with longer fingerprints takes them for candidates only: a link counts if the Jaccard similarity of the sets of
shingles is SIMILAR or more. Fingerprints are of the sets there, so repeats have no weight, and equal sets are compared once. A
first search passes on a forest of near candidates, which are verified by a join with the sets. A second one names the members of
upper nodes that have a candidate in another component still, and only their sets travel, to the tasks of those nodes; candidates
are verified there, nearest first, and those whose components have met by then are passed over. So no candidate stays unverified
but those that would join what is joined, and no list of pairs is made. Shingles are compared as XXH64.

Upper nodes with more members than a task should hold are cut into blocks by a hash, and each two blocks meet in a task of their
own: what a task holds is bounded, and no pair is lost.

Defined results: null and empty text have no words and fingerprint zero; equal fingerprints are linked; texts without words are
near copies of each other; repeated rows count as rows; a null doc_id never names a component unless all are null. Columns other
than doc_id and text are ignored, whatever their names, and kept by `drop_near_copies`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate, combinations
from math import acos, ceil, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components
from .util import documents, id_type, runs, small, table, with_known

SEED = 42
FANOUT = 8
#: Searches that meet at once in a task: the number of searched ids times the size of their groups.
FRONTIER = 1 << 21
#: Rows that a task collects before it searches; a larger group is taken as a whole.
COLLECTED = 1 << 17
#: Members of an upper node, and shingles of its members' sets, that a task takes as one block.
BLOCK, SET_BLOCK = 1 << 17, 1 << 22
#: One member in so many is counted to tell which upper nodes are larger than a block.
COUNTED = 16
#: Members that an upper node should have on average at most, if blocks are exact and if bits are sampled.
CROWD, SAMPLED_CROWD = 256, 64
#: Share of bits in which texts of Jaccard similarity 0.8 differ: the angle of their shingle vectors over pi.
DIFFER = acos(2 * 0.8 / 1.8) / pi
#: How many masks are expected to hold such a pair together: 1 - exp(-FOUND) of the pairs are found.
FOUND = 3.5
#: Least Jaccard similarity of near copies, as a fraction.
SIMILAR = (4, 5)
#: Shingles of all sets that are broadcast at most, some 32 MB; more are joined by shuffle.
BROADCAST_SHINGLES = 1 << 22


def shingles(text: bytes, size: int) -> Iterator[np.ndarray]:
    """The XXH64 of all shingles of a text, in bounded pieces."""
    said = text.lower().split()  # bytes: A-Z only, and exactly the white space of the word pattern
    digest, n = xxhash.xxh64_intdigest, max(len(said) - size + 1, 1) if said else 0
    for at in range(0, n, 1 << 14):
        part = said[at : at + (1 << 14) + size - 1]
        joined = b" ".join(part)
        starts = [0, *accumulate(len(w) + 1 for w in part)]
        m = max(len(part) - size + 1, 1)
        yield np.fromiter((digest(joined[s : e - 1], SEED) for s, e in zip(starts, starts[min(size, len(part)) :])), np.uint64, m)


def majority(pieces: Iterable[np.ndarray], words: int) -> list[int]:
    """Majority bits of hashes, and of further hashes made of them."""
    bits, n = np.zeros((words, 64), np.int64), 0
    for hashes in pieces:
        n += len(hashes)
        for k in range(words):
            h = _mixed(hashes + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) if k else hashes
            bits[k] += np.unpackbits(h.view(np.uint8).reshape(len(h), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(bits * 2 > n, axis=1, bitorder="little").view(np.uint64).ravel().tolist()


def fingerprint(text: bytes, size: int, words: int = 1) -> list[int]:
    """Majority bits of all shingles of a text, repeats included."""
    return majority(shingles(text, size), words)


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """The hashes of the distinct shingles of a text, in order."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingles(text, size)]))


def set_row(text: bytes, size: int, words: int) -> list[int]:
    """The fingerprint of a text's set of shingles, its size and two hashes of it."""
    every = shingle_set(text, size)
    pieces = (every[at : at + (1 << 14)] for at in range(0, len(every), 1 << 14))
    body = every.tobytes()
    return [*majority(pieces, words), len(every), xxhash.xxh64_intdigest(body, 1), xxhash.xxh64_intdigest(body, 2)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def names(words: int) -> list[str]:
    return [f"f{k}" for k in range(words)]


def hash_table(df: DataFrame, of: Callable[[bytes], list[int]], columns: list[str]) -> DataFrame:
    """doc_id and what of() makes of each row's text, a long for each column."""
    rows = df.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs(batch, "body"):
                made = np.array([of(x.as_py()) for x in part.column(1)], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c) for c in made.T)], names=["doc_id", *columns])

    return rows.mapInArrow(hashed, f"doc_id {id_type(df)}, " + ", ".join(f"{c} long" for c in columns))


def fingerprint_table(df: DataFrame, size: int, words: int = 1) -> DataFrame:
    """doc_id and f0, f1, ... (64 bits each as a long) of each row."""
    return hash_table(df, lambda text: fingerprint(text, size, words), names(words))


def masks(n: int, radius: int, words: int = 1) -> list[list[int]]:
    """Masks of the upper nodes for n fingerprints, one number for each word."""
    if words > 1:
        bits = max(8, (n // SAMPLED_CROWD).bit_length())
        count = ceil(FOUND / (1 - DIFFER) ** bits)
        rng = np.random.default_rng(1)
        chosen = [rng.choice(64 * words, bits, replace=False).tolist() for _ in range(count)]
        return [[sum(1 << (b % 64) for b in c if b // 64 == k) for k in range(words)] for c in chosen]
    for blocks in range(radius + 1, radius + 5):  # as few blocks as keep upper nodes small if bits were even
        cuts = [64 * i // blocks for i in range(blocks + 1)]
        fixed = min(sum(sorted(b - a for a, b in zip(cuts, cuts[1:]))[: blocks - radius]), 62)
        if n >> fixed <= CROWD:
            break
    ranges = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    return [[sum(chosen)] for chosen in combinations(ranges, blocks - radius)]


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Where each code stands in the reflected Gray order."""
    out = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label with the components of a[i] and b[i] joined; each label is the least index of its component."""
    while len(a):
        a, b = label[a], label[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = label[label]
            if np.array_equal(further, label):
                break
            label = further
    return label


def nearest_first(label: np.ndarray, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """label with all pairs joined, and which pairs make the forest of least distances d that joins them (Boruvka's)."""
    left, taken = np.argsort(d, kind="stable"), []
    while True:
        left = left[label[a[left]] != label[b[left]]]
        if not len(left):
            return label, np.concatenate([np.zeros(0, np.int64), *taken])
        best, rank = np.full(len(label), len(left)), np.arange(len(left))
        np.minimum.at(best, label[a[left]], rank)
        np.minimum.at(best, label[b[left]], rank)
        chosen = left[np.unique(best[best < len(left)])]
        taken.append(chosen)
        label = unite(label, a[chosen], b[chosen])


def in_gray_order(codes: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The order of codes [n, words] by group and Gray rank, word for word."""
    return np.lexsort((*(gray_rank(codes[:, k].copy()) for k in reversed(range(codes.shape[1]))), group))


def differences(a: np.ndarray, b: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b) & bits).sum(axis=1, dtype=np.int32)


class GrayIndex:
    """Of codes [n, words] in groups; they are to be sorted by group and then by Gray rank."""

    def __init__(self, codes: np.ndarray, group: np.ndarray):
        self.codes, self.group = codes, group
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # first child, end child, pattern, bits fixed here
        every, some, owner = codes, codes, group
        built = []
        while True:
            change = np.flatnonzero(np.diff(owner)) + 1
            first = np.concatenate([[0], change])
            place = np.arange(len(owner)) - np.repeat(first, np.diff(np.append(first, len(owner))))
            top = len(first) == len(owner)
            start = np.flatnonzero(place % FANOUT == 0)
            every, some = np.bitwise_and.reduceat(every, start, axis=0), np.bitwise_or.reduceat(some, start, axis=0)
            built.append((start, np.append(start[1:], len(owner)), every, ~(every ^ some)))
            owner = owner[start]
            if top:
                break
        above = np.zeros((len(owner), codes.shape[1]), np.uint64)
        for start, end, every, fixed in reversed(built):
            self.levels.append((start, end, every & fixed, fixed & ~above))
            above = np.repeat(fixed, end - start, axis=0)
        self.left = ~above  # bits that a code itself decides, below its last node
        self.roots = owner

    def uniform(self, label: np.ndarray) -> list[np.ndarray]:
        """For each level, the component that all codes below a node belong to, or -1."""
        low = high = label
        out = []
        for start, *_ in reversed(self.levels):
            low, high = np.minimum.reduceat(low, start), np.maximum.reduceat(high, start)
            out.append(np.where(low == high, low, -1))
        return out[::-1]

    def near(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs within groups and their distances, a batch at a time, without those that self.label joined before the batch."""
        codes = self.codes
        bounds = np.searchsorted(self.roots, self.group)
        size = np.bincount(bounds)[bounds]
        work = np.cumsum(size) * codes.shape[1]
        at = 0
        while at < len(codes):
            to = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + FRONTIER, side="right")))
            label = self.label
            same = self.uniform(label)
            q = np.arange(at, to)
            node, acc = bounds[q], np.zeros(to - at, np.int32)
            for k, (start, end, pattern, bits) in enumerate(self.levels):
                acc = acc + differences(codes[q], pattern[node], bits[node])
                go = (acc <= radius) & (same[k][node] != label[q])
                q, node, acc = q[go], node[go], acc[go]
                n = end[node] - start[node]
                child = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[node], n)
                q, acc, node = np.repeat(q, n), np.repeat(acc, n), child
            go = node > q  # a pair once
            q, node, acc = q[go], node[go], acc[go]
            acc = acc + differences(codes[q], codes[node], self.left[node])
            go = acc <= radius
            yield q[go], node[go], acc[go]
            at = to

    def link(self, radius: int) -> np.ndarray:
        """The component of each code, as the least index in it, after all links within groups."""
        self.label = np.arange(len(self.codes))
        for a, b, _ in self.near(radius):
            self.label = unite(self.label, a, b)
        return self.label

    def candidates(self, radius: int, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """A forest of pairs whose sets' sizes allow for SIMILAR, nearest ones first."""
        self.label = np.arange(len(self.codes))
        for a, b, d in self.near(radius):
            go = alike(size[a], size[b]) & (self.label[a] != self.label[b])
            self.label, go_on = nearest_first(self.label, a[go], b[go], d[go])
            yield a[go][go_on], b[go][go_on]

    def between(self, radius: int, size: np.ndarray, owner: np.ndarray, first: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of different owners whose sets' sizes allow for SIMILAR; first() tells which ones have their first node in common here."""
        _, at, of = np.unique(owner, return_index=True, return_inverse=True)
        self.label = at[of]
        for a, b, d in self.near(radius):
            go = alike(size[a], size[b]) & (self.label[a] != self.label[b])
            a, b, d = a[go], b[go], d[go]
            go = first(a, b)
            yield a[go], b[go], d[go]


def alike(m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can have the similarity SIMILAR."""
    return SIMILAR[1] * np.minimum(m, n) >= SIMILAR[0] * np.maximum(m, n)


GROUP = ("t", "key", "part")


def in_blocks(rows: DataFrame, crowded: DataFrame | None) -> DataFrame:
    """rows(id, *GROUP of which part is 0) with members of crowded groups (*GROUP, blocks) sent to the tasks of their block and each other."""
    if crowded is None or not (n := crowded.count()):
        return rows
    own = F.pmod(F.xxhash64("id", F.lit("block")), F.col("blocks"))
    pair = lambda k: F.shiftleft("part", 32) + F.least(k, own) * F.col("blocks") + F.greatest(k, own) + 1
    pairs = F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: k != own), pair)
    every = F.explode(F.when(F.col("blocks") > 1, pairs).otherwise(F.array("part"))).alias("part_")
    told = rows.join(small(crowded, n), list(GROUP), "left").select(*rows.columns, every)
    return told.select(*[F.col("part_").alias("part") if c == "part" else c for c in rows.columns])


def members(found: DataFrame, n: int, radius: int, words: int, more: list[str]) -> DataFrame:
    """found(id, f0, ..., more) as members of upper nodes: *GROUP, id, f0, ..., more."""
    chosen, fs = masks(n, radius, words), names(words)
    signed = lambda m: F.lit(m - (1 << 64) if m >> 63 else m).cast("long")
    parts_of = lambda m: [F.col(f).bitwiseAND(signed(x)) for f, x in zip(fs, m)]
    # a hash of several words' bits may bring strangers together; the search tells them apart
    keys = [parts_of(m)[0] if words == 1 else F.xxhash64(*parts_of(m)) for m in chosen]
    nodes = F.posexplode(F.array(*keys)).alias("t", "key")
    rows = found.select("id", *fs, *more, nodes).select(F.col("t").cast("long").alias("t"), "key", F.lit(0).cast("long").alias("part"), "id", *fs, *more)
    crowded = None
    if n > BLOCK:
        counts = rows.where(F.pmod(F.xxhash64("id", F.lit("count")), F.lit(COUNTED)) == 0).groupBy(*GROUP).agg(F.count(F.lit(1)).alias("k")).where(F.col("k") * COUNTED > BLOCK)
        crowded = table(counts.select(*GROUP, F.ceil(F.col("k") * COUNTED / BLOCK).alias("blocks")))
    return in_blocks(rows, crowded)


def by_group(search: Callable, columns: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that calls search(group numbers, arrays) for runs of whole groups of COLLECTED rows or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < COLLECTED:
                continue
            every = pa.concat_batches(held)
            heads = [np.asarray(every.column(k)) for k in range(3)]
            last = np.flatnonzero(np.logical_or.reduce([h != h[-1] for h in heads]))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last group may go on
            if cut:
                yield called(every.slice(0, cut))
            held, rows = [every.slice(cut)], len(heads[0]) - cut
        if rows:
            yield called(pa.concat_batches(held))

    def called(every: pa.RecordBatch) -> pa.RecordBatch:
        heads = [np.asarray(every.column(k)) for k in range(3)]
        group = np.cumsum(np.concatenate([[0], np.logical_or.reduce([h[1:] != h[:-1] for h in heads])]))
        return search(heads, group, [np.asarray(every.column(k)) for k in range(3, columns)])

    return run


def dealt(rows: DataFrame, n_rows: int) -> DataFrame:
    """rows dealt by their group, some COLLECTED rows to a task, and in order of groups."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_rows // (COLLECTED * 4))
    return rows.repartition(parts, *GROUP).sortWithinPartitions(*GROUP)


def pairs_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b), pa.int64()), pa.array(np.minimum(a, b), pa.int64())], names=["a", "b"])


def links(found: DataFrame, n: int, radius: int, words: int = 1) -> DataFrame:
    """A spanning forest (a, b) of the links of distinct fingerprints found(id, f0, ...).

    If found has m, the size of each id's set, it is a forest of near candidates of SIMILAR instead.
    """
    more = ["m"] if "m" in found.columns else []
    rows = members(found, n, radius, words, more)

    def searched(_, group: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
        ids, *rest = columns
        several = np.bincount(group)[group] > 1
        group, ids, codes = group[several], ids[several], np.stack([f[several].view(np.uint64) for f in rest[:words]], axis=1)
        if not len(codes):
            return pairs_batch(ids, ids)
        order = in_gray_order(codes, group)
        codes, group, ids = codes[order], group[order], ids[order]
        if more:
            a, b = (np.concatenate(x) for x in zip(*GrayIndex(codes, group).candidates(radius, rest[words][several][order])))
            return pairs_batch(ids[a], ids[b])
        label = GrayIndex(codes, group).link(radius)
        linked = np.flatnonzero(label != np.arange(len(label)))
        return pairs_batch(ids[linked], ids[label[linked]])

    return dealt(rows, n * len(masks(n, radius, words))).mapInArrow(by_group(searched, 4 + words + len(more)), "a long, b long").distinct()


def unjoined(found: DataFrame, n: int, radius: int, words: int) -> DataFrame:
    """*GROUP, id, m of members that have a candidate of another component c in their node; found(id, f0, ..., m, c).

    A pair that several nodes hold is looked at in the first of them only.
    """
    chosen = np.array(masks(n, radius, words), np.uint64)

    def searched(heads: list[np.ndarray], group: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
        ids, *rest = columns
        several = np.flatnonzero(np.bincount(group)[group] > 1)
        codes = np.stack([f[several].view(np.uint64) for f in rest[:words]], axis=1)
        order = in_gray_order(codes, group[several]) if len(codes) else several
        several = several[order]
        codes, size, owner = codes[order], rest[words][several], rest[words + 1][several]
        met = np.zeros(len(codes), bool)
        if len(codes):
            for a, b, _ in GrayIndex(codes, group[several]).between(radius, size, owner, first_here(chosen, codes, heads[0][several])):
                met[a] = met[b] = True
        at = several[met]
        return pa.RecordBatch.from_arrays([pa.array(x[at]) for x in (*heads, ids, rest[words])], names=[*GROUP, "id", "m"])

    rows = dealt(members(found, n, radius, words, ["m", "c"]), n * len(chosen))
    return rows.mapInArrow(by_group(searched, 6 + words), "t long, key long, part long, id long, m long")


def first_here(chosen: np.ndarray, codes: np.ndarray, t: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Of pairs of codes with the same t, those that agree under no mask before mask t."""

    def told(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        apart, before = codes[a] ^ codes[b], np.zeros(len(a), bool)
        for k in range(len(chosen)):
            before |= (t[a] > k) & ~(apart & chosen[k]).any(axis=1)
        return ~before

    return told


def verified_here(flagged: DataFrame, found: DataFrame, sets: DataFrame, n: int, radius: int, words: int) -> DataFrame:
    """A forest (a, b) of links between different components c of found(id, f0, ..., m, c), of which flagged has the members.

    sets(id, s) has the sets of shingles; those of a node, or of two blocks of it, are in one task.
    """
    chosen, fs = np.array(masks(n, radius, words), np.uint64), names(words)
    large = table(flagged.groupBy(*GROUP).agg(F.sum("m").alias("k")).where(F.col("k") > SET_BLOCK).select(*GROUP, F.ceil(F.col("k") / SET_BLOCK).alias("blocks")))
    rows = in_blocks(flagged.select(*GROUP, "id"), large).join(found.select("id", *fs, "m", "c"), "id").join(sets, "id")

    def searched(heads: list[np.ndarray], rest: list[np.ndarray], shingles_of: list[np.ndarray]) -> pa.RecordBatch:
        codes, group = np.stack([f.view(np.uint64) for f in rest[1 : 1 + words]], axis=1), np.zeros(len(heads[0]), np.int64)
        order = in_gray_order(codes, group)
        codes, (ids, size, owner) = codes[order], (rest[k][order] for k in (0, 1 + words, 2 + words))
        made: dict[int, set] = {}
        above: dict[int, int] = {}

        def shingles_at(i: int) -> set:
            if i not in made:
                made[i] = set(shingles_of[order[i]].tolist())
            return made[i]

        def top(i: int) -> int:
            while (j := above.get(i, i)) != i:
                above[i] = i = above.get(j, j)
            return i

        index, out = GrayIndex(codes, group), []
        for a, b, d in index.between(radius, size, owner, first_here(chosen, codes, heads[0][order])):
            label = index.label
            for k in np.argsort(d, kind="stable"):
                i, j = int(a[k]), int(b[k])
                if (x := top(int(label[i]))) == (y := top(int(label[j]))):
                    continue
                both = len(shingles_at(i) & shingles_at(j))
                if SIMILAR[1] * both >= SIMILAR[0] * (size[i] + size[j] - both):
                    above[max(x, y)] = min(x, y)
                    out.append((i, j))
            index.label = np.array([top(int(x)) for x in label])
        i, j = np.array(out, np.int64).reshape(-1, 2).T
        return pairs_batch(ids[i], ids[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            heads = [np.asarray(batch.column(k)) for k in range(3)]
            cuts = np.flatnonzero(np.logical_or.reduce([h[1:] != h[:-1] for h in heads])) + 1 if batch.num_rows else []
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
                if hi == lo:
                    continue
                head = tuple(int(h[lo]) for h in heads)
                if head != at and held:
                    yield group(held)
                    held = []
                at = head
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield group(held)

    def group(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        columns = [np.concatenate([np.asarray(x.column(k)) for x in held]) for k in range(6 + words)]
        return searched(columns[:3], columns[3:], [v.values.to_numpy() for x in held for v in x.column(6 + words)])

    rows = rows.select(*GROUP, "id", *fs, "m", "c", "s")
    return rows.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(run, "a long, b long").distinct()


def near_copies(df: DataFrame, size: int = 5, radius: int = 51, words: int = 4) -> DataFrame:
    """A row for each row of df: doc_id, fingerprint, component_id and component_size.

    Five words a shingle and a fifth of 256 bits are the defaults, for a similarity of 0.8; one word links exactly.
    """
    fs = names(words)
    found = table(fingerprint_table(df, size, words))
    distinct = found.groupBy(*fs).agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    # ids of long fingerprints are given once, by writing them
    distinct = table(distinct.withColumn("id", F.col("f0") if words == 1 else F.monotonically_increasing_id()))
    reached = components(links(distinct.select("id", *fs), distinct.count(), radius, words))
    nodes = table(distinct.join(reached, distinct["id"] == reached["node"], "left").select(*fs, "first", "n", F.coalesce("component", "id").alias("component")))
    named = table(nodes.groupBy("component").agg(F.min("first").alias("component_id"), F.sum("n").alias("component_size"), F.count(F.lit(1)).alias("w")))
    nodes = table(with_known(nodes, named, ["component"], "w").select(*fs, "n", "component_id", "component_size"))
    shown = F.concat(*[F.lower(F.lpad(F.hex(f), 16, "0")) for f in fs])
    return with_known(found, nodes, fs, "n").select("doc_id", shown.alias("fingerprint"), "component_id", "component_size")


def sets_of(sought: DataFrame, df: DataFrame, size: int) -> DataFrame:
    """id, s: the set of shingles of each id of sought(id, doc_id, h), which has a text of each."""
    sought = table(sought.select("id", F.col("doc_id").alias("i"), "h"))
    texts = df.select("doc_id", F.xxhash64("text").alias("x"), F.coalesce("text", F.lit("")).cast("binary").alias("body"))
    texts = texts.join(small(sought, sought.count()), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("x") == F.col("h"))).select("id", "body")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs(batch, "body"):
                made = [shingle_set(x.as_py(), size).view(np.int64) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.list_(pa.int64()))], names=["id", "s"])

    return table(texts.mapInArrow(hashed, "id long, s array<long>").dropDuplicates(["id"]))


def verified(pairs: DataFrame, df: DataFrame, first: DataFrame, size: int) -> DataFrame:
    """The pairs (a, b) of ids whose sets of shingles have the similarity SIMILAR; first(id, doc_id, h) has a text of each id."""
    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(first, "id"), df, size)
    few = (sets.agg(F.sum(F.size("s"))).first()[0] or 0) <= BROADCAST_SHINGLES
    side = lambda k: (F.broadcast if few else lambda x: x)(sets.select(F.col("id").alias(k), F.col("s").alias(f"s{k}")))
    both = F.size(F.array_intersect("sa", "sb"))
    enough = SIMILAR[1] * both >= SIMILAR[0] * (F.size("sa") + F.size("sb") - both)
    return pairs.join(side("a"), "a").join(side("b"), "b").where(enough).select("a", "b")


def keyed(df: DataFrame) -> DataFrame:
    """doc_id with the hash of the text, which tells rows of the same doc_id apart, and text; null ids are the greatest."""
    return df.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("h")).alias("doc_id"), "text")


def similar(df: DataFrame, size: int, radius: int, words: int) -> DataFrame:
    """doc_id and component_id of each row of df(doc_id, text), both as keyed() makes them, by links of the similarity SIMILAR."""
    fs = names(words)
    key = [*fs, "m", "s0", "s1"]
    found = table(hash_table(keyed(df), lambda text: set_row(text, size, words), key))
    # ids are given once, by writing them
    nodes = table(found.groupBy(*key).agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).withColumn("id", F.monotonically_increasing_id()))
    first, n = nodes.select("id", "first.doc_id", "first.h"), nodes.count()
    owned = lambda reached: table(nodes.join(reached, nodes["id"] == reached["node"], "left").select(*nodes.columns, F.coalesce("component", "id").alias("c")))
    reached = components(verified(table(links(nodes.select("id", *fs, "m"), n, radius, words)), df, first, size))
    told = owned(reached)
    flagged = table(unjoined(told.select("id", *fs, "m", "c"), n, radius, words))
    sets = sets_of(flagged.select("id").distinct().join(first, "id"), df, size)
    more = table(verified_here(flagged, told, sets, n, radius, words))
    if more.count():
        told = owned(components(reached.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)))
    kept = table(told.groupBy("c").agg(F.min("first").alias("kept"), F.count(F.lit(1)).alias("w")))
    told = table(with_known(told, kept, ["c"], "w").select(*key, "n", "kept"))
    return with_known(found, told, key, "n").select("doc_id", F.col("kept").alias("component_id"))


def drop_near_copies(df: DataFrame, size: int = 5, radius: int = 51, words: int = 4) -> DataFrame:
    """df with the least doc_id of each component; all columns kept. Links of more than one word are verified.

    Rows go by doc_id and text: of those that share a doc_id or have none, only the near copies go; equal ones stay together.
    """
    found = near_copies(keyed(df), size, radius, words) if words == 1 else similar(df, size, radius, words)
    gone = table(found.where("doc_id <> component_id").select(F.col("doc_id.doc_id").alias("i"), F.col("doc_id.h").alias("h")).distinct())
    mark = small(gone, gone.count()).alias("g")
    same = F.col("d.doc_id").eqNullSafe(F.col("g.i")) & (F.xxhash64("d.text") == F.col("g.h"))
    return df.alias("d").join(mark, same, "left_anti").select(*[F.col(f"d.`{c}`") for c in df.columns])


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(documents(spark, sf_dir), size=4, radius=4, words=1)


ORACLE: dict[str, str] = {}
QUERIES = {"op3_simhash": op3_simhash}
