"""Audio files as rows: format by magic bytes, RIFF/WAVE decoding, downmix and resampling.

Files come from `binaryFile`; decoding is Arrow-batched Python with the file as its unit. Clips are cut into rows of at most
CHUNK samples, so a long clip never is one row. Compressed formats are recognised; they are decoded only by a function given.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RATE, CHUNK = 16000, 480_000


class AudioError(ValueError):
    pass


def sniff(content: Column) -> Column:
    """wav, flac, opus, vorbis, mp3 or mp4 by a file's first bytes; null if it is none of them or too short."""
    head = lambda at, n: F.hex(F.substring(content, at, n))
    return (
        F.when(F.octet_length(content) < 4, F.lit(None).cast("string"))
        .when(head(1, 4) == "52494646", "wav")
        .when(head(1, 4) == "664C6143", "flac")
        .when((head(1, 4) == "4F676753") & (F.locate("4F70757348656164", head(1, 100)) > 0), "opus")
        .when(head(1, 4) == "4F676753", "vorbis")
        .when((head(1, 3) == "494433") | ((head(1, 1) == "FF") & F.substring(head(2, 1), 1, 1).isin("E", "F")), "mp3")
        .when(head(5, 4) == "66747970", "mp4")
    )


def pcm(data: bytes, code: int, bits: int) -> np.ndarray:
    """Samples in [-1, 1] from little-endian PCM: 8 bits unsigned, 16, 24, 32 signed, or 32-bit floats (code 3)."""
    if code == 3 and bits == 32:
        return np.frombuffer(data[: len(data) // 4 * 4], "<f4").astype(np.float32)
    if code != 1 or bits not in (8, 16, 24, 32):
        raise AudioError(f"no decoder for format {code} with {bits} bits")
    if bits == 8:
        return ((np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 128).astype(np.float32)
    if bits == 24:
        raw = np.frombuffer(data[: len(data) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int32)
        return (((raw[:, 0] | raw[:, 1] << 8 | raw[:, 2] << 16) << 8 >> 8) / np.float32(1 << 23)).astype(np.float32)
    width = bits // 8
    return (np.frombuffer(data[: len(data) // width * width], f"<i{width}").astype(np.float64) / (1 << (bits - 1))).astype(np.float32)


def downmix(samples: np.ndarray, channels: int) -> np.ndarray:
    """The mean over channels; a ragged tail is dropped."""
    return samples if channels <= 1 else samples[: len(samples) // channels * channels].reshape(-1, channels).mean(axis=1, dtype=np.float32)


def resample(samples: np.ndarray, rate: int, to: int = RATE) -> np.ndarray:
    """Linear interpolation at positions in double precision; the last sample holds at the end."""
    if rate == to or not len(samples):
        return samples
    ratio = rate / to
    at = np.arange(int(np.ceil(len(samples) / ratio))) * ratio
    k = np.minimum(at.astype(np.int64), len(samples) - 1)
    part = np.where(k >= len(samples) - 1, 0, at - k).astype(np.float32)
    return samples[k] * (1 - part) + samples[np.minimum(k + 1, len(samples) - 1)] * part


def decode_wav(content: bytes, to: int = RATE) -> np.ndarray:
    """Mono samples at rate `to`. Chunks are walked with their padding; fmt has to come before data; data is cut at the file's end."""
    if len(content) < 12 or content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise AudioError("not a RIFF/WAVE file")
    at, form = 12, None
    while at + 8 <= len(content):
        name, size = content[at : at + 4], struct.unpack_from("<I", content, at + 4)[0]
        body = at + 8
        if name == b"fmt ":
            if size < 16 or body + 16 > len(content):
                raise AudioError("the fmt chunk is too short")
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", content, body)
            if code == 0xFFFE and size >= 26 and body + 26 <= len(content):
                code = struct.unpack_from("<H", content, body + 24)[0]
            if not channels or not rate:
                raise AudioError("no channels or no rate")
            form = code, channels, rate, bits
        elif name == b"data":
            if form is None:
                raise AudioError("the data chunk comes before fmt")
            code, channels, rate, bits = form
            return resample(downmix(pcm(content[body : min(body + size, len(content))], code, bits), channels), rate, to)
        at = body + size + size % 2
    raise AudioError("no data chunk")


def raw_pcm(samples: np.ndarray, rate: int, channels: int) -> np.ndarray:
    return resample(downmix(np.asarray(samples, np.float32), channels), rate)


def read_audio(spark: SparkSession, path: str, decoders: dict[str, Callable[[bytes], np.ndarray]] | None = None) -> DataFrame:
    """clip_id (the path), format, chunk_idx, start_sample, samples, error; a bad file is a row with an error, not a failure."""
    known = {"wav": decode_wav} | (decoders or {})
    files = spark.read.format("binaryFile").load(path).select("path", sniff(F.col("content")).alias("format"), "content")

    def decoded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for clip, form, content in zip(pdf.path, pdf["format"], pdf.content):
                try:
                    if form not in known:
                        raise AudioError(f"no decoder for {form or 'this format'}")
                    x, error = known[form](content), None
                except ValueError as e:
                    x, error = np.zeros(0, np.float32), str(e)
                starts = range(0, max(len(x), 1), CHUNK)
                yield pd.DataFrame({"clip_id": clip, "format": form, "chunk_idx": range(len(starts)), "start_sample": list(starts), "samples": [x[s : s + CHUNK] for s in starts], "error": error})

    return files.mapInPandas(decoded, "clip_id string, format string, chunk_idx int, start_sample long, samples array<float>, error string")
