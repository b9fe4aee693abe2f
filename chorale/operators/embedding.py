"""Speaker vectors of windows, inside a Python worker.

An embedder has `dim`, known without any sound, and `embed(samples, rate)`, which gives a vector of dim values and unit length or
raises ValueError where there is none. A bare function of samples and rate will do as well; its first vector tells dim.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np

from chorale.functions import kernels
from chorale.operators.scorer import TransformerScorer

RATE = 16000
#: Shorter vectors have no direction.
LEAST_NORM = 1e-8
#: How far from 1 a vector's length may be.
SLACK = 1e-3


class Embedder(Protocol):
    @property
    def dim(self) -> int: ...

    def embed(self, samples: np.ndarray, rate: int) -> np.ndarray: ...


def unit(v: np.ndarray) -> np.ndarray:
    v = np.asarray(v, np.float64)
    n = float(np.linalg.norm(v))
    if not n >= LEAST_NORM:  # not a number either
        raise ValueError("the window has no direction")
    return v / n


def mean_mel(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """The baseline: the mean log-mel frame, of unit length."""
    if not len(samples):
        raise ValueError("the window is empty")
    return unit(kernels.log_mel(samples).mean(axis=1))


class EncoderEmbedder:
    """The mean frame of a transformer's encoder, of unit length. Samples are taken to come at the model's rate, whatever `rate` says."""

    def __init__(self, scorer: TransformerScorer):
        self.scorer = scorer

    @property
    def dim(self) -> int:
        return self.scorer.width

    def embed(self, samples: np.ndarray, rate: int = RATE) -> np.ndarray:
        if not len(samples):
            raise ValueError("the window is empty")
        return unit(self.scorer.encode(samples).mean(axis=0))


class Checked:
    """An embedder, or a function as one, whose vectors are held to the contract."""

    def __init__(self, inner: Embedder | Callable[[np.ndarray, int], np.ndarray]):
        self.dim = getattr(inner, "dim", None)
        self.of = inner.embed if hasattr(inner, "embed") else inner

    def embed(self, samples: np.ndarray, rate: int = RATE) -> np.ndarray:
        v = np.asarray(self.of(samples, rate), np.float64)
        self.dim = v.size if self.dim is None else self.dim
        if v.shape != (self.dim,):
            raise ValueError(f"the embedder gave shape {v.shape}, not {self.dim} values")
        if not abs(float(np.linalg.norm(v)) - 1) <= SLACK:
            raise ValueError("the embedder's vector isn't of unit length")
        return v
