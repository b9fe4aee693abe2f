"""Substring deduplication by prefix-partitioned suffix trees.

A suffix starts at each word of a text. Its prefix runs from there to the end of an anchor: among the GRAM-word sequences inside
the suffix's first `size` words the one whose hash is least, the leftmost on ties. Prefixes thus vary in length, follow from the
words alone, and suffixes that agree in `size` words have the same one. The suffixes of neighbouring words mostly share their
anchor, so they travel together as one stretch of text, and the anchor's hash is the partition that they go to.

1. Anchors are counted over all texts. A prefix through an anchor that occurs once ends in a leaf and isn't pursued further.
2. Stretches whose anchor recurs are dealt by it. A task sends the words of equal stretches twice at most, which is enough to
   know that they repeat, so no large group of copies meets in one task. Equal stretches are told by a digest of 128 bits.
3. Partitions that were sent more than GROUP stretches get longer prefixes: suffixes are dealt again by how far they begin before
   the anchor, in ranges half as wide, and those of a range have size - range + 1 words in common, which are their new partition.
   This is repeated until a partition fits, or a prefix has `size` words, when equal ones are counted by aggregation.
4. For each partition the subtree of its suffixes is built: they are sorted, neighbours give common-prefix lengths, and a stack
   over these gives the internal nodes of `size` words or more with the suffixes below them. These nodes are the maximal repeats:
   longest sequences that the suffixes below share, as far as their stretches go. Suffixes below them are marked.
5. Marks go back to the texts as intervals of words, and those words are removed.

The counting filter is a bitmap of FILTER_BITS bits at most; more recurring anchors are taken in several rounds, each with its
share of anchors. A wrongly set bit costs a comparison, never a result.

Defined results: words are [^\\x20\\x09-\\x0D]+, unchanged; null and empty texts have none; texts of fewer than `size` words keep
all; a repeated row is another text; rows with equal doc_id are told apart by their text. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import documents, id_type, runs, small, table, with_known

SIZE = 35
GRAM = 8
FILTER_BITS = 1 << 27
#: Words of a text that are handled at once.
PIECE = 1 << 17
#: Digests by which a task knows the stretches it has sent; after so many it starts anew.
KNOWN = 1 << 20
#: Stretches that a partition may be sent before its prefixes are lengthened.
GROUP = 1 << 13

_RNG = np.random.default_rng(20)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        m = 1 << (n - 1).bit_length()
        _POWERS[:] = [np.cumprod(np.append(np.uint64(1), np.full(m - 1, b))) for b in (_BASE, _INVERSE)]
    return _POWERS[0], _POWERS[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Stretches:
    """The stretches of some word lists: text, first and n_starts of each, and its anchor's hash."""

    def __init__(self, lists: list[list[bytes]], size: int, gram: int):
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        self.joined = b" ".join([b" ".join(w) for w in lists if w])
        data = np.frombuffer(self.joined, np.uint8)
        space = np.flatnonzero(data == 32)
        self.starts, self.ends = np.append(0, space + 1), np.append(space, len(data))
        n, after = int(counts.sum()), np.cumsum(counts)
        width = size - gram + 1
        if n < size:
            self.key = np.zeros(0, np.int64)
            self.text = self.first = self.n_starts = self.ahead = self.key
            return
        up, down = _powers(len(data) + 1)
        prefix = np.append(np.uint64(0), np.cumsum(_BYTE[data] * up[: len(data)]))
        s, e = self.starts[: n - gram + 1], self.ends[gram - 1 :]
        h = _mixed((prefix[e] - prefix[s]) * down[s] + (e - s).astype(np.uint64))
        # leftmost least hash of each window of width hashes, by doubling
        best, reach = np.arange(len(h)), 1
        while reach < width:
            step = min(reach, width - reach)
            left, right = best[:-step], best[step:]
            best, reach = np.where(h[left] <= h[right], left, right), reach + step
        owner = np.repeat(np.arange(len(lists)), counts)
        begin = np.arange(n - size + 1)
        begin = begin[owner[begin] == owner[begin + size - 1]]
        anchor = best[begin]
        new = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (owner[begin[1:]] != owner[begin[:-1]]))) if len(begin) else np.zeros(0, np.int64)
        self.key = h[anchor[new]].view(np.int64)
        self.at = begin[new]
        self.ahead = anchor[new] - self.at  # words from a stretch's first suffix to its anchor
        self.n_starts = np.diff(np.append(new, len(begin)))
        self.text = owner[self.at]
        self.first = self.at - (after - counts)[self.text]
        self.last = self.at + self.n_starts + size - 2

    def body(self, i: int) -> bytes:
        return self.joined[self.starts[self.at[i]] : self.ends[self.last[i]]]


def pieces(part: pa.RecordBatch, column: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[list[bytes]]]]:
    """Word lists of some texts, each with its row and where in the text it begins; a window is in one of them."""
    rows, offs, lists, held = [], [], [], 0
    for i, value in enumerate(part.column(column)):
        words = value.as_py().split()
        for at in range(0, max(len(words) - size + 1, 0), PIECE):
            rows.append(i)
            offs.append(at)
            lists.append(words[at : at + PIECE + size - 1] if at or len(words) > PIECE + size - 1 else words)
            held += len(lists[-1])
            if held >= PIECE:
                yield np.array(rows), np.array(offs), lists
                rows, offs, lists, held = [], [], [], 0
    if lists:
        yield np.array(rows), np.array(offs), lists


def anchors(rows: DataFrame, size: int, gram: int) -> DataFrame:
    """The anchor's hash of each stretch."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs(batch, "body"):
                for _, _, lists in pieces(part, 0, size):
                    yield pa.RecordBatch.from_arrays([pa.array(Stretches(lists, size, gram).key)], names=["key"])

    return rows.select("body").mapInArrow(found, "key long")


def bit_filter(recurring: DataFrame, bits: int) -> np.ndarray:
    """A bitmap with a bit for each key; its size doesn't depend on how many there are."""
    bit = F.col("key").bitwiseAND(F.lit(bits - 1))
    made = recurring.groupBy(F.shiftright(bit, 15).alias("b")).agg(F.bitmap_construct_agg(bit.bitwiseAND(F.lit(32767))).alias("m"))
    out = np.zeros((max(bits >> 15, 1), 4096), np.uint8)
    for r in made.toLocalIterator():
        out[r.b] = np.frombuffer(r.m, np.uint8)
    return out.ravel()


def stretches(rows: DataFrame, bitmap: np.ndarray, bits: int, share: tuple[int, int], size: int, gram: int, kind: str) -> DataFrame:
    """Stretches whose anchor the bitmap has: doc_id, h, first, key, id (a digest of the words), n_starts, ahead and words.

    words are null where the task has given them twice.
    """
    sent = rows.sparkSession.sparkContext.broadcast(bitmap)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, known = sent.value, {}
        for batch in batches:
            for part in runs(batch, "body"):
                for row, off, lists in pieces(part, 2, size):
                    s = Stretches(lists, size, gram)
                    at = s.key & (bits - 1)
                    pick = np.flatnonzero(((seen[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool) & ((s.key.view(np.uint64) >> np.uint64(32)) % np.uint64(share[1]) == share[0]))
                    if not len(pick):
                        continue
                    text, bodies = s.text[pick], [s.body(i) for i in pick]
                    ids = [xxhash.xxh3_128_digest(b) for b in bodies]
                    if len(known) > KNOWN:
                        known.clear()
                    for k, i in enumerate(ids):
                        if (n := known.get(i, 0)) < 2:
                            known[i] = n + 1
                        else:
                            bodies[k] = None
                    where = pa.array(row[text])
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(where), part.column(1).take(where), pa.array(off[text] + s.first[pick]), pa.array(s.key[pick]), pa.array(ids, pa.binary()), pa.array(s.n_starts[pick]), pa.array(s.ahead[pick]), pa.array(bodies, pa.binary())],
                        names=["doc_id", "h", "first", "key", "id", "n_starts", "ahead", "words"],
                    )

    return rows.mapInArrow(found, f"doc_id {kind}, h long, first long, key long, id binary, n_starts long, ahead long, words binary")


def internal_nodes(suffixes: list[list[bytes]], size: int) -> list[tuple[int, list[int]]]:
    """Depth and suffixes below of each internal node at size words or deeper in the tree of these suffixes.

    The tree is held as the sorted suffixes and the common-prefix lengths of neighbours; lengths below size count as none.
    """
    order = sorted(range(len(suffixes)), key=suffixes.__getitem__)
    out: list[tuple[int, list[int]]] = []
    stack: list[tuple[int, int]] = []  # depth and first place of nodes that are still open
    for place in range(1, len(order) + 1):
        depth = 0
        if place < len(order):
            a, b = suffixes[order[place - 1]], suffixes[order[place]]
            if a[:size] == b[:size]:
                depth = next((k for k in range(size, min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        first = place - 1
        while stack and stack[-1][0] > depth:
            deep, first = stack.pop()
            out.append((deep, order[first:place]))
        if depth >= size and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))
    return out


def by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[tuple[bytes, int], list]]:
    """For each key of rows in order (key, id, lo, n, words): its different stretches (id, lo), each with times, n and words."""
    at, group = None, {}
    for batch in batches:
        for key, i, lo, n, words in zip(*(c.to_pylist() for c in batch.columns)):
            if key != at and group:
                yield group
                group = {}
            at = key
            group.setdefault((i, lo), [0, n, words])[0] += 1
    if group:
        yield group


def subtrees(dealt: DataFrame, size: int) -> DataFrame:
    """id and mark of stretches (key, id, lo, n, words) with suffixes from lo on; bit k of mark says that the window at the stretch's word k occurs elsewhere too."""

    def marks(group: dict) -> Iterator[tuple[bytes, int]]:
        below = {s: (1 << n) - 1 if times > 1 else 0 for s, (times, n, _) in group.items()}  # a repeated stretch repeats each window in it
        if len(group) > 1 and not all(below.values()):
            split = [(s, k, w[k:]) for s, (_, n, words) in group.items() for w in [words.split()] for k in range(n)]
            for _, leaves in internal_nodes([w for _, _, w in split], size):
                for leaf in leaves:
                    s, k, _ = split[leaf]
                    below[s] |= 1 << k
        yield from ((i, mark << lo) for (i, lo), mark in below.items() if mark)

    def out(pairs: list[tuple[bytes, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.int64())], names=["id", "mark"])

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: list[tuple[bytes, int]] = []
        for group in by_key(batches):
            pairs += marks(group)
            if len(pairs) > 1 << 14:
                yield out(pairs)
                pairs = []
        yield out(pairs)

    dealt = dealt.select("key", "id", "lo", "n", "words").repartition("key").sortWithinPartitions("key", "id", "lo")
    return dealt.mapInArrow(built, "id binary, mark long")


def maximal_repeats(df: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """words, n_words and leaves: the internal nodes of all subtrees, as far as stretches go; leaves counts different stretches."""

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_key(batches):
            suffixes = [w[k:] for _, n, words in group.values() for w in [words.split()] for k in range(n)]
            found = internal_nodes(suffixes, size)
            words = [b" ".join(suffixes[leaves[0]][:depth]) for depth, leaves in found]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([d for d, _ in found], pa.int64()), pa.array([len(x) for _, x in found], pa.int64())], names=["words", "n_words", "leaves"])

    dealt = [lengthened(sent, size, min(gram, size))[0] for _, sent in rounds(df, size, min(gram, size), FILTER_BITS)]
    every = reduce(DataFrame.unionByName, [x.select("key", "id", "lo", "n", "words") for x in dealt])
    found = every.repartition("key").sortWithinPartitions("key", "id", "lo").mapInArrow(nodes, "words binary, n_words long, leaves long")
    return found.withColumn("words", F.col("words").cast("string"))


def cut(rows: DataFrame, size: int, width: int) -> DataFrame:
    """Stretches (id, lo, n, ahead, words) with their suffixes dealt by ranges of width words that they begin before the anchor."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs(batch, "words"):
                made = []
                for i, lo, n, ahead, words in zip(*(c.to_pylist() for c in part.columns)):
                    w = words.split()
                    for r in range((ahead - n + 1) // width, ahead // width + 1):
                        first, last = max(0, ahead - (r + 1) * width + 1), min(n - 1, ahead - r * width)
                        common = w[ahead - r * width : ahead - (r + 1) * width + 1 + size]  # of all windows of the range
                        key = xxhash.xxh3_64_intdigest(b" ".join(common), width << 8 | r) - (1 << 63)
                        made.append((key, i, lo + first, last - first + 1, ahead - first, b" ".join(w[first : last + size])))
                kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*made), kinds)], names=["key", "id", "lo", "n", "ahead", "words"])

    return rows.select("id", "lo", "n", "ahead", "words").mapInArrow(parts, "key long, id binary, lo long, n long, ahead long, words binary")


def lengthened(sent: DataFrame, size: int, gram: int, most: int = 0) -> tuple[DataFrame, DataFrame | None]:
    """sent(key, id, lo, n, ahead, words, of) in partitions of at most `most` stretches, by longer prefixes, and marks of windows that are prefixes as a whole.

    of is how often the anchor occurs; it tells which partitions may be too large, and only these are counted.
    """
    most = most or GROUP
    may, width, ready, marks = sent.where(F.col("of") > most), size - gram + 1, [sent.where(F.col("of") <= most).drop("of")], None
    may = may.drop("of")
    while True:
        crowded = table(may.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > most).select("key"))
        n = crowded.count()
        ready.append(may if not n else may.join(small(crowded, n), "key", "left_anti"))
        if not n:
            break
        width = -(-width // 2)
        may = table(cut(may.join(small(crowded, n), "key", "left_semi"), size, width))
        if width == 1:
            again = table(may.groupBy("words").agg(F.count(F.lit(1)).alias("k")).where("k > 1"))
            marks = with_known(may, again, ["words"], "k").where("k is not null").select("id", F.expr("shiftleft(1L, cast(lo as int))").alias("mark"))
            break
    return reduce(DataFrame.unionByName, ready), marks


def rounds(df: DataFrame, size: int, gram: int, filter_bits: int) -> Iterator[tuple[DataFrame, DataFrame]]:
    """For each share of the recurring anchors: all stretches (doc_id, h, first, id, ...), and those sent with their words."""
    rows = df.where("text is not null").select("doc_id", F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("body"))
    recurring = table(anchors(rows, size, gram).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    n = recurring.count()
    bits = min(filter_bits, max(1 << 20, 1 << (16 * n).bit_length()))
    several = max(1, -(-4 * n // bits))
    often = table(recurring.where(F.col("n") > GROUP).select("key", F.col("n").alias("of")))
    n_often = often.count()
    for r in range(several):
        mine = recurring.where(F.pmod(F.shiftrightunsigned("key", 32), F.lit(several)) == r)
        found = table(stretches(rows, bit_filter(mine.select("key"), bits), bits, (r, several), size, gram, id_type(df)))
        sent = found.where("words is not null").select("key", "id", F.lit(0).cast("long").alias("lo"), F.col("n_starts").alias("n"), "ahead", "words")
        sent = sent.join(small(often, n_often), "key", "left").withColumn("of", F.coalesce("of", F.lit(0))) if n_often else sent.withColumn("of", F.lit(0))
        yield found, sent


def repeats(df: DataFrame, size: int = SIZE, gram: int = GRAM, filter_bits: int = FILTER_BITS) -> DataFrame:
    """doc_id, h (XXH64 of the text) and the words of it that repeated windows cover: spans, an array of start, end, start, ..."""
    kind, gram = id_type(df), min(gram, size)
    marked = []
    for found, sent in rounds(df, size, gram, filter_bits):
        dealt, whole = lengthened(sent, size, gram)
        marks = subtrees(dealt, size)
        if whole is not None:
            marks = marks.unionByName(whole).groupBy("id").agg(F.bit_or("mark").alias("mark"))
        marked.append(table(found.select("doc_id", "h", "first", "id").join(table(marks), "id").select("doc_id", "h", "first", "mark")))
    gathered = reduce(DataFrame.unionByName, marked).groupBy("doc_id", "h").agg(F.collect_set(F.struct("first", "mark")).alias("m"))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for m in batch.column(2):
                starts = np.sort(np.concatenate([v["first"] + np.flatnonzero(np.unpackbits(np.array([v["mark"]], np.int64).view(np.uint8), bitorder="little")) for v in m.as_py()]))
                new = np.append(True, starts[1:] > starts[:-1] + size)
                last = np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)
                spans.append(np.stack([starts[new], starts[last] + size], axis=1).ravel().tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.list_(pa.int64()))], names=["doc_id", "h", "spans"])

    return gathered.mapInArrow(merged, f"doc_id {kind}, h long, spans array<long>")


def remove_repeats(df: DataFrame, size: int = SIZE) -> DataFrame:
    """A row for each row of df: doc_id, n_words, n_removed and kept (the other words, joined by one space).

    The spans are broadcast only if few: their number and that of their bounds are counted. Otherwise texts are dealt by doc_id.
    """
    spans = table(repeats(df, size)).select(F.col("doc_id").alias("s_id"), F.col("h").alias("s_h"), "spans")
    rows = df.select("doc_id", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("h"), F.coalesce("text", F.lit("")).cast("binary").alias("body"))
    size_of = spans.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()
    rows = rows.join(small(spans, size_of[0] + size_of[1] // 4), rows["doc_id"].eqNullSafe(F.col("s_id")) & (rows["h"] == F.col("s_h")), "left").select("doc_id", "body", "spans")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs(batch, "body"):
                n_words, n_removed, left = [], [], []
                for body, gone in zip(part.column(1), part.column(2)):
                    words, gone = body.as_py().split(), gone.as_py() or []
                    n_words.append(len(words))
                    n_removed.append(sum(gone[1::2]) - sum(gone[::2]))
                    edges = [0, *gone, len(words)]
                    left.append(b" ".join([w for a, b in zip(edges[::2], edges[1::2]) for w in words[a:b]] if gone else words))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(left, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])

    return rows.mapInArrow(kept, f"doc_id {id_type(df)}, n_words long, n_removed long, kept binary").withColumn("kept", F.col("kept").cast("string"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = {
    "op2_substring_dedup": r"""
        with d as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
        win as (select doc_id, s, array_to_string(w[s + 1 : s + 35], ' ') as g from (select doc_id, w, unnest(range(len(w) - 34)) as s from d where len(w) >= 35)),
        again as (select doc_id, s from (select doc_id, s, count(*) over (partition by g) as n from win) where n > 1),
        gone as (select doc_id, list(distinct p) as ps from (select doc_id, unnest(range(s, s + 35)) as p from again) group by doc_id)
        select d.doc_id, len(w)::bigint as n_words, coalesce(len(ps), 0)::bigint as n_removed,
               sha256(array_to_string(list_filter(w, lambda x, i: ps is null or not list_contains(ps, i - 1)), ' ')) as kept_sha256
        from d left join gone using (doc_id)"""
}
QUERIES = {"op2_substring_dedup": op2_substring_dedup}
