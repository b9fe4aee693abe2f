"""Measures of texts, within the row: no shuffle, whatever the number of texts. Characters and n-grams are counted in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def entropy_of(text: str) -> float:
    """Bits for each code point of a text."""
    if not text:
        return 0.0
    if text.isascii():
        counts = np.bincount(np.frombuffer(text.encode(), np.uint8))
        counts = counts[counts > 0]
    else:
        counts = np.unique(np.frombuffer(text.encode("utf-32-le"), np.uint32), return_counts=True)[1]
    share = counts / counts.sum()
    return float(-(share * np.log2(share)).sum()) + 0.0


def char_entropy(text: Column) -> Column:
    """Bits for each code point; 0 for an empty or null text."""

    def measured(texts: pa.Array) -> pa.Array:
        return pa.array([entropy_of(t.as_py()) for t in texts], pa.float64())

    return F.arrow_udf(measured, DoubleType())(F.coalesce(text, F.lit("")))


def is_hallucination(text: Column, threshold: float = 2.4, entropy: Column | None = None) -> Column:
    """Low entropy for ten bytes or more: below 8 / threshold bits. A threshold of 0 or less turns the test off; entropy if known already."""
    if threshold <= 0:
        return F.lit(False)
    text = F.coalesce(text, F.lit(""))
    return (F.octet_length(text) >= 10) & ((char_entropy(text) if entropy is None else entropy) < 8 / threshold)


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"\s+"), "")


def let(value: Column, f) -> Column:
    """f(value) with value worked out once: inside a lambda an expression would be worked out again for each element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def ngrams(items: Column, n: int) -> Column:
    """All n-grams of an array of words, each joined by spaces; none if it is shorter. Strings are told apart by hash, structs aren't."""

    def of(w: Column) -> Column:
        k = F.greatest(F.size(w) - (n - 1), F.lit(0))
        grams = F.slice(w, 1, k)
        for j in range(1, n):
            grams = F.zip_with(grams, F.slice(w, 1 + j, k), lambda a, b: F.concat(a, F.lit(" "), b))
        return grams

    return let(items, of)


def repeat_ratio(text: Column, n: int = 3) -> Column:
    """The share of a text's word n-grams that occurred before in it."""

    def measured(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            said = t.as_py().encode().split()  # bytes: the white space of the pattern, no other
            k = len(said) - n + 1
            out.append(1 - len(set(zip(*(said[j:] for j in range(n))))) / k if k > 0 else 0.0)
        return pa.array(out, pa.float64())

    return F.arrow_udf(measured, DoubleType())(F.coalesce(text, F.lit("")))


def blocked(tokens: Column, n: int) -> Column:
    """Tokens that would complete an n-gram that the array already has, distinct and sorted."""

    def of(w: Column) -> Column:
        k = F.size(w) - (n - 1)
        starts = F.filter(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), lambda i: F.slice(w, i, n - 1) == F.slice(w, F.greatest(k + 1, F.lit(1)), n - 1))
        found = F.transform(starts, lambda i: F.try_element_at(w, i + (n - 1)))
        return F.when(k < 1, F.slice(w, 1, 0)).otherwise(F.array_sort(F.array_distinct(found)))

    return let(tokens, of)


def trim(text: Column) -> Column:
    """White space of any script off both ends."""
    return F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
