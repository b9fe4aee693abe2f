"""Clustering of a clip's embeddings: average linkage, spectral, k-means. One clip at a time; labels count from first appearance.

Memory and time grow with the square (linkage, spectral) of the windows of a clip, which a clip's length bounds.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def compact(labels: np.ndarray) -> np.ndarray:
    """Labels numbered from 0 by first appearance."""
    _, first, inverse = np.unique(labels, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[inverse]


def linkage(x: np.ndarray, threshold: float, k: int | None, lo: int, hi: int) -> np.ndarray:
    """Average linkage on cosine distance of unit vectors.

    Closest pairs merge until k clusters are left, or, without k, as long as there are more than hi, or more than lo and the
    pair is within the threshold. The lowest pair of indices wins a tie.
    """
    n = len(x)
    apart = 1.0 - x @ x.T
    apart[np.tril_indices(n)] = np.inf
    size, label, count = np.ones(n), np.arange(n), n
    full = 1.0 - x @ x.T
    until = min(max(k, lo), hi) if k else lo
    while count > until:
        i, j = divmod(int(apart.argmin()), n)
        if not k and count <= hi and apart[i, j] > threshold:
            break
        full[i] = full[:, i] = (size[i] * full[i] + size[j] * full[j]) / (size[i] + size[j])
        size[i] += size[j]
        label[label == j] = i
        apart[j], apart[:, j] = np.inf, np.inf
        alive = np.unique(label)
        up, down = alive[alive > i], alive[alive < i]
        apart[i, up], apart[down, i] = full[i, up], full[down, i]
        count -= 1
    return label


def gap_count(values: np.ndarray, lo: int, hi: int) -> int:
    """The number of clusters in [lo, hi] behind which ascending eigenvalues leap most; the lower one on ties."""
    gaps = [values[k] - values[k - 1] if k < len(values) else -np.inf for k in range(lo, hi + 1)]
    return lo + int(np.argmax(gaps)) if hi > lo else lo


def kmeans(x: np.ndarray, k: int, rounds: int = 300) -> np.ndarray:
    """Lloyd's algorithm from spread-out seeds drawn by a stream that the data itself starts; an empty cluster gets the farthest point."""
    if k <= 1:
        return np.zeros(len(x), int)
    rng = np.random.default_rng(zlib.crc32(np.ascontiguousarray(x).tobytes()))
    square = lambda c: ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    centres = x[[int(rng.integers(len(x)))]]
    while len(centres) < k:
        near = square(centres).min(axis=1)
        total = near.sum()
        pick = int(near.argmax()) if total <= 1e-18 else min(int(np.searchsorted(near.cumsum(), rng.random() * total)), len(x) - 1)
        centres = np.vstack([centres, x[pick]])
    labels = np.full(len(x), -1)
    for _ in range(rounds):
        new = square(centres).argmin(axis=1)
        empty = [c for c in range(k) if not (new == c).any()]
        if np.array_equal(new, labels) and not empty:
            break
        labels = new
        for c in range(k):
            centres[c] = x[int(square(centres).min(axis=1).argmax())] if c in empty else x[labels == c].mean(axis=0)
    return labels


def spectral(x: np.ndarray, k: int | None, lo: int, hi: int) -> np.ndarray:
    """k-means on the leading eigenvectors of the normalised Laplacian of cosines; without k the eigengap tells how many."""
    affinity = np.maximum(x @ x.T, 0.0)
    np.fill_diagonal(affinity, 0.0)
    degree = affinity.sum(axis=1)
    scale = np.divide(1.0, np.sqrt(degree), out=np.zeros_like(degree), where=degree > 0)
    values, vectors = np.linalg.eigh(np.eye(len(x)) - scale[:, None] * affinity * scale)
    k = min(max(k, lo), hi) if k else gap_count(values, lo, hi)
    if k <= 1:
        return np.zeros(len(x), int)
    rows = vectors[:, :k]
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return kmeans(rows / np.where(norms > 0, norms, 1.0), k)


def cluster(x: np.ndarray, method: str = "ahc", threshold: float = 0.5, k: int | None = None, least: int = 1, most: int = 10) -> np.ndarray:
    """Labels of unit vectors. Methods: ahc, spectral, kmeans (needs k)."""
    n = len(x)
    if n <= 1:
        return np.zeros(n, int)
    if x.ndim != 2 or not x.shape[1]:
        raise ValueError("embeddings need one common length above zero")
    lo = min(max(least, 1), n)
    hi = min(max(most, lo), n)
    if method == "kmeans":
        return compact(kmeans(x, min(max(k or 1, lo), hi)))
    return compact(linkage(x, threshold, k, lo, hi) if method == "ahc" else spectral(x, k, lo, hi))


def cluster_windows(vectors: DataFrame, key: str = "clip_id", order: str = "vec_id", carry: tuple[str, ...] = (), **how) -> DataFrame:
    """key, order, the columns to carry and label of vectors(key, order, embedding, ...)."""
    columns = [key, order, *carry]
    kinds = ", ".join(f"{c} {vectors.schema[c].dataType.simpleString()}" for c in columns)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        x = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
        norms = np.linalg.norm(x, axis=1, keepdims=True)
        return pdf[columns].assign(label=cluster(x / np.where(norms > 0, norms, 1.0), **how))

    return vectors.select(*columns, "embedding").groupBy(key).applyInPandas(one, f"{kinds}, label long")
