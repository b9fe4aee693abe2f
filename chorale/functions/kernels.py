"""Numeric kernels in NumPy for use inside Arrow-batched functions: spectra, block codecs, layers, attention."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

SAMPLE_RATE, N_FFT, FFT_SIZE, HOP, N_MELS, MAX_FRAMES, N_AUDIO_CTX = 16000, 400, 512, 160, 80, 3000, 1500


# spectra


def hann(size: int = N_FFT) -> np.ndarray:
    """The periodic window."""
    return (0.5 * (1 - np.cos(2 * np.pi * np.arange(size) / size))).astype(np.float32)


@lru_cache(maxsize=8)
def mel_filters(n_mels: int = N_MELS, n_fft: int = N_FFT, rate: int = SAMPLE_RATE) -> np.ndarray:
    """[n_mels, n_fft // 2 + 1] triangles, evenly spaced on the mel scale, each scaled by 2 over its width in Hz."""
    mels = np.linspace(0, 2595 * math.log10(1 + rate / 2 / 700), n_mels + 2)
    hz = 700 * (10 ** (mels / 2595) - 1)
    at, k = (n_fft + 1) * hz / rate, np.arange(n_fft // 2 + 1)
    rise = (k - at[:-2, None]) / (at[1:-1] - at[:-2])[:, None]
    fall = (at[2:, None] - k) / (at[2:] - at[1:-1])[:, None]
    return (np.maximum(np.minimum(rise, fall), 0) * (2 / (hz[2:] - hz[:-2]))[:, None]).astype(np.float32)


def frame_count(n_samples: int) -> int:
    return min(-(-n_samples // HOP) + 1, MAX_FRAMES)


def power_spectrum(frames: np.ndarray, size: int = FFT_SIZE) -> np.ndarray:
    """Squared magnitudes of the non-negative frequencies of zero-padded frames."""
    spectrum = np.fft.rfft(frames.astype(np.float64), n=size, axis=-1)
    return spectrum.real**2 + spectrum.imag**2


def log_mel(samples: np.ndarray, filters: np.ndarray | None = None) -> np.ndarray:
    """[n_mels, frames]: log10 of mel energies, at most 8 below the greatest, as (x + 4) / 4."""
    filters = mel_filters() if filters is None else filters
    n = frame_count(len(samples))
    padded = np.zeros((n - 1) * HOP + N_FFT, np.float32)
    padded[: min(len(samples), len(padded))] = samples[: len(padded)]
    frames = np.lib.stride_tricks.sliding_window_view(padded, N_FFT)[::HOP][:n] * hann()
    energies = power_spectrum(frames)[:, : filters.shape[1]] @ filters.T
    logs = np.log10(np.maximum(energies, 1e-10))
    return ((np.maximum(logs, logs.max() - 8.0) + 4.0) / 4.0).T.astype(np.float32)


# block codecs: 32 values with a half-precision scale

BLOCK = 32
#: kind: bytes of a block, divisor of the greatest magnitude, offset, greatest code
CODECS = {"q8_0": (34, 127, 0, 127), "q5_0": (22, 15, 16, 31), "q4_0": (18, 8, 8, 15)}


def half_away(x: np.ndarray) -> np.ndarray:
    return np.trunc(x + np.copysign(np.float32(0.5), x))


def quantize(values: np.ndarray, kind: str) -> bytes:
    """values (a multiple of 32) as blocks of this kind."""
    width, divisor, offset, most = CODECS[kind]
    x = np.asarray(values, np.float32).reshape(-1, BLOCK)
    scale = np.abs(x).max(axis=1, initial=0) / np.float32(divisor)
    inverse = np.divide(np.float32(1), scale, out=np.zeros_like(scale), where=scale != 0)
    q = np.clip(half_away(x * inverse[:, None]) + offset, -128 if kind == "q8_0" else 0, most).astype(np.int32)
    out = np.zeros((len(x), width), np.uint8)
    out[:, :2] = scale.astype("<f2").view(np.uint8).reshape(-1, 2)
    if kind == "q8_0":
        out[:, 2:] = q.astype(np.int8).view(np.uint8)
        return out.tobytes()
    out[:, -16:] = (q[:, :16] & 15) | ((q[:, 16:] & 15) << 4)
    if kind == "q5_0":
        high = ((q >> 4) & 1).astype(np.uint64) << np.arange(BLOCK, dtype=np.uint64)
        out[:, 2:6] = high.sum(axis=1).astype("<u4").view(np.uint8).reshape(-1, 4)
    return out.tobytes()


def dequantize(raw: bytes, kind: str) -> np.ndarray:
    width, _, offset, _ = CODECS[kind]
    blocks = np.frombuffer(raw, np.uint8).reshape(-1, width)
    scale = blocks[:, :2].copy().view("<f2").astype(np.float32)
    if kind == "q8_0":
        return (blocks[:, 2:].view(np.int8) * scale).astype(np.float32).ravel()
    packed = blocks[:, -16:]
    q = np.concatenate([packed & 15, packed >> 4], axis=1).astype(np.int32)
    if kind == "q5_0":
        high = blocks[:, 2:6].copy().view("<u4").astype(np.int64)
        q |= (((high >> np.arange(BLOCK)) & 1) << 4).astype(np.int32)
    return ((q - offset) * scale).astype(np.float32).ravel()


def quantized_dot(raw: bytes, kind: str, x: np.ndarray) -> float:
    return float(np.dot(dequantize(raw, kind), np.asarray(x, np.float32)))


def row_bytes(elements: int, kind: str) -> int:
    """Bytes of a row of a quantized matrix; a started block counts."""
    return -(-elements // BLOCK) * CODECS[kind][0]


# layers, row-major float32


def softmax(x: np.ndarray, axis: int = -1) -> np.ndarray:
    e = np.exp(x - x.max(axis=axis, keepdims=True))
    return e / e.sum(axis=axis, keepdims=True)


def gelu(x: np.ndarray) -> np.ndarray:
    """The tanh form."""
    return 0.5 * x * (1 + np.tanh(math.sqrt(2 / math.pi) * (x + 0.044715 * x**3)))


def layer_norm(x: np.ndarray, gain: np.ndarray, bias: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    centred = x - x.mean(axis=-1, keepdims=True)
    return centred / np.sqrt((centred**2).mean(axis=-1, keepdims=True) + eps) * gain + bias


def linear(x: np.ndarray, weight: np.ndarray | tuple[bytes, str, tuple[int, int]], bias: np.ndarray | None = None) -> np.ndarray:
    """x @ weight.T + bias; weight is [out, in], or (blocks, kind, shape) of a quantized one."""
    if isinstance(weight, tuple):
        raw, kind, shape = weight
        weight = dequantize(raw, kind).reshape(shape)
    out = x @ weight.T
    return out if bias is None else out + bias


def conv1d(x: np.ndarray, weight: np.ndarray, bias: np.ndarray, stride: int = 1, padding: int = 1) -> np.ndarray:
    """x [in, n], weight [out, in, k] -> [out, n']."""
    padded = np.pad(x, ((0, 0), (padding, padding)))
    windows = np.lib.stride_tricks.sliding_window_view(padded, weight.shape[2], axis=1)[:, ::stride]
    return np.einsum("ink,oik->on", windows, weight) + bias[:, None]


def causal_mask(n: int, past: int = 0) -> np.ndarray:
    """0 where position i may look at j, -inf beyond."""
    return np.where(np.arange(n + past)[None, :] <= np.arange(n)[:, None] + past, 0.0, -np.inf).astype(np.float32)


def attention(q: np.ndarray, k: np.ndarray, v: np.ndarray, heads: int, mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Scaled dot-product attention of [n, d] with [m, d]: the output [n, d] and the mean weights over heads [n, m]."""
    n, d = q.shape
    split = lambda x: x.reshape(len(x), heads, d // heads).transpose(1, 0, 2)
    scores = split(q) @ split(k).transpose(0, 2, 1) / math.sqrt(d // heads)
    weights = softmax(scores if mask is None else scores + mask)
    return (weights @ split(v)).transpose(1, 0, 2).reshape(n, d), weights.mean(axis=0)


class KeyValueCache:
    """Keys and values of past positions, in single or half precision."""

    def __init__(self, capacity: int, width: int, half: bool = False):
        kind = np.float16 if half else np.float32
        self.k, self.v, self.length = np.zeros((capacity, width), kind), np.zeros((capacity, width), kind), 0

    def append(self, k: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        end = self.length + len(k)
        if end > len(self.k):
            raise ValueError("the cache is full")
        self.k[self.length : end], self.v[self.length : end], self.length = k, v, end
        return self.k[:end].astype(np.float32), self.v[:end].astype(np.float32)

    def copy(self) -> KeyValueCache:
        out = KeyValueCache.__new__(KeyValueCache)
        out.k, out.v, out.length = self.k.copy(), self.v.copy(), self.length
        return out


def alignment_layers(n_layers: int) -> range:
    """The upper half, whose attention follows time."""
    return range(n_layers // 2, n_layers)
