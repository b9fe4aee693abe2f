"""Token counts by byte-pair merging with a heap and a linked list.

A text is cut by the pre-tokenizer's pattern; the symbols of a piece are a doubly linked list, and a heap holds the ranks of
adjacent pairs. The lowest rank is popped again and again, its pair merged and the new pairs pushed; entries whose symbols have
changed since are skipped. A piece's count is its symbols minus its merges, no identifier is made. Merging takes
O(n log n) for a piece of any length. Counts of short pieces are kept in a bounded memo, as most pieces recur.

The vocabulary is a `tokenizers` JSON file of a byte-level BPE; its path is a parameter and the executors read it themselves.
Added special tokens inside a text count as one token each, as is that library's default; none are added at its ends.

Defined results: null and empty texts have no bytes and no tokens. Extra columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import documents, id_type, runs

LIMIT = 1024
#: The pattern of byte-level pre-tokenizers; a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of a memo in a worker, and the longest of them.
MEMO, MEMO_LENGTH = 600_000, 64
#: A space beside other white space or at an end of the text. Any other space begins a piece, so a text may be cut before it.
IRREGULAR = regex.compile(r" \s|[^\S ] |^ | $")


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    more = iter(range(256, 512))
    return [chr(b if b in plain else next(more)) for b in range(256)]


class Memo(dict):
    """Values of a function of short strings, for so many strings at most."""

    def __init__(self, f):
        super().__init__()
        self.f = f

    def __missing__(self, key: str) -> int:
        n = self.f(key)
        if len(key) <= MEMO_LENGTH:
            if len(self) >= MEMO:
                self.clear()
            self[key] = n
        return n


class PairMerger:
    """Counts the tokens of texts with the merges of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbol = {letter: b for b, letter in enumerate(byte_letters())}
        number: dict[str, int] = dict(symbol)
        #: pair of symbols -> rank << 32 | the symbol they make
        self.pairs: dict[int, int] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            made = number.setdefault(left + right, len(number))
            self.pairs.setdefault(number[left] << 32 | number[right], rank << 32 | made)
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.pieces = regex.compile(PATTERN).findall
        self.of_piece = Memo(lambda piece: self.merged(piece.encode())).__getitem__
        self.after_space = Memo(lambda rest: sum(map(self.of_piece, self.pieces(" " + rest)))).__getitem__

    def merged(self, piece: bytes) -> int:
        """The number of tokens of a piece."""
        pairs, sym, n = self.pairs, list(piece), len(piece)
        heap = []
        for i in range(n - 1):
            if (r := pairs.get(sym[i] << 32 | sym[i + 1])) is not None:
                heap.append((r, i))
        if not heap:
            return n
        heapify(heap)
        after, before, count = [*range(1, n), -1], [*range(-1, n - 1)], n
        while heap:
            r, i = heappop(heap)
            j = after[i]
            # the entry holds if its two symbols still make this very pair
            if j < 0 or sym[i] < 0 or pairs.get(sym[i] << 32 | sym[j]) != r:
                continue
            sym[i], sym[j] = r & 0xFFFFFFFF, -1
            count -= 1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (x := pairs.get(sym[i] << 32 | sym[k])) is not None:
                    heappush(heap, (x, i))
            h = before[i]
            if h >= 0 and (x := pairs.get(sym[h] << 32 | sym[i])) is not None:
                heappush(heap, (x, h))
        return count

    def plain(self, text: str) -> int:
        if IRREGULAR.search(text):
            return sum(map(self.of_piece, self.pieces(text)))
        first, *rest = text.split(" ")
        return sum(map(self.of_piece, self.pieces(first))) + sum(map(self.after_space, rest))

    def count(self, text: str) -> int:
        if self.special is None or not (cuts := list(self.special.finditer(text))):
            return self.plain(text)
        ends = [0, *(m.end() for m in cuts)]
        return len(cuts) + sum(self.plain(text[a:b]) for a, b in zip(ends, [*(m.start() for m in cuts), len(text)]))


_MADE: dict[str, PairMerger] = {}


def merger(path: str) -> PairMerger:
    """One for each worker process and vocabulary."""
    if path not in _MADE:
        _MADE[path] = PairMerger(path)
    return _MADE[path]


def token_counts(df: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """A row for each row of df: doc_id, n_bytes, n_tokens, over_limit."""
    rows = df.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("body"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = merger(path)
        for batch in batches:
            for part in runs(batch, "body"):
                body = [v.as_py() for v in part.column(1)]
                n = [tool.count(b.decode("utf-8", "replace")) for b in body]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, body), pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return rows.mapInArrow(counted, f"doc_id {id_type(df)}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


ORACLE: dict[str, str] = {}
QUERIES = {"op7_token_counts": op7_token_counts}
