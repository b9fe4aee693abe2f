"""Signals as rows and arrays: windows, mel scale, resampling, quantized blocks. Numeric kernels in NumPy are in kernels.py."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

SAMPLE_RATE, N_FFT, FFT_SIZE, HOP, N_MELS, MAX_FRAMES = 16000, 400, 512, 160, 80, 3000


def n_frames(n_samples: Column) -> Column:
    """ceil(n / hop) + 1, at most MAX_FRAMES."""
    return F.least(F.ceil(n_samples / HOP).cast("long") + 1, F.lit(MAX_FRAMES))


def hann(spark: SparkSession, size: int = N_FFT) -> DataFrame:
    """i, w: the periodic Hann window."""
    return spark.range(size).select(F.col("id").alias("i"), (0.5 * (1 - F.cos(2 * math.pi * F.col("id") / size))).alias("w"))


def hz_to_mel(hz: Column) -> Column:
    return 2595.0 * F.log10(1 + hz / 700.0)


def mel_to_hz(mel: Column) -> Column:
    return 700.0 * (F.pow(F.lit(10.0), mel / 2595.0) - 1)


def mel_filterbank(spark: SparkSession, n_mels: int = N_MELS, n_fft: int = N_FFT, rate: int = SAMPLE_RATE) -> DataFrame:
    """mel, bin, weight: triangles between points spaced evenly on the mel scale, scaled by 2 / width in Hz."""
    top = 2595.0 * math.log10(1 + rate / 2 / 700.0)
    point = lambda k: mel_to_hz(F.lit(top) * k / (n_mels + 1))
    m = spark.range(n_mels).select(F.col("id").alias("mel"), point(F.col("id")).alias("lo"), point(F.col("id") + 1).alias("mid"), point(F.col("id") + 2).alias("hi"))
    bins = m.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_fft // 2))).alias("bin"))
    at = lambda hz: (n_fft + 1.0) * F.col(hz) / rate  # noqa: E731  where a frequency falls among the bins
    rise, fall = (F.col("bin") - at("lo")) / (at("mid") - at("lo")), (at("hi") - F.col("bin")) / (at("hi") - at("mid"))
    weight = F.greatest(F.least(rise, fall), F.lit(0.0)) * 2 / (F.col("hi") - F.col("lo"))
    return bins.select("mel", F.col("bin").cast("long").alias("bin"), weight.alias("weight"))


def downmix(samples: Column, channels: int) -> Column:
    """The mean over channels of an interleaved array; a ragged tail is dropped."""
    n = F.floor(F.size(samples) / channels).cast("int")
    mean = lambda i: F.aggregate(F.slice(samples, i * channels + 1, channels), F.lit(0.0), lambda a, x: a + x.cast("double")) / channels
    return F.when(n < 1, F.array().cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), mean))


def resample(samples: DataFrame, rate: int, to: int = SAMPLE_RATE, key: str = "clip_id") -> DataFrame:
    """samples(key, idx, x) at another rate, by linear interpolation: ceil(n / ratio) samples, the last one held at the end."""
    ratio = rate / to
    n = samples.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    out = n.select(key, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / ratio).cast("long") - 1)).alias("j")).withColumn("at", F.col("j") * ratio).withColumn("idx", F.least(F.floor("at").cast("long"), F.col("n") - 1))
    w = W.partitionBy(key).orderBy("idx")
    pairs = samples.select(key, "idx", "x", F.coalesce(F.lead("x").over(w), F.col("x")).alias("x1"))
    return out.join(pairs, [key, "idx"]).select(key, F.col("j").alias("idx"), (F.col("x") + (F.col("x1") - F.col("x")) * F.least(F.col("at") - F.col("idx"), F.lit(1.0))).alias("x"))


BLOCK = 32
LEVELS = {"q8_0": 127, "q5_0": 15, "q4_0": 8}


def block_scales(values: DataFrame, kind: str, key: str = "vec_id") -> DataFrame:
    """key, block, absmax, scale of values(key, idx, x) in blocks of 32."""
    most = values.groupBy(key, F.floor(F.col("idx") / BLOCK).alias("block")).agg(F.max(F.abs("x")).alias("absmax"))
    return most.withColumn("scale", F.col("absmax") / LEVELS[kind])


def q8_integers(values: DataFrame, key: str = "vec_id") -> DataFrame:
    """key, idx, q: integers of 8-bit blocks, rounded half away from zero with the unrounded scale."""
    scales = block_scales(values, "q8_0", key)
    v = values.withColumn("block", F.floor(F.col("idx") / BLOCK)).join(scales, [key, "block"])
    x = F.col("x") / F.col("scale")
    q = F.signum(x) * F.floor(F.abs(x) + 0.5)
    return v.select(key, "idx", F.when(F.col("scale") == 0, 0).otherwise(F.greatest(F.lit(-128), F.least(F.lit(127), q))).cast("long").alias("q"))


def tensor_statistics(tensors: DataFrame) -> DataFrame:
    """One row over tensors(name, shape, dtype, n_bytes): their number, elements, and elements and bytes by dtype group."""
    elements = F.aggregate("shape", F.lit(1).cast("long"), lambda a, x: a * x)
    quantized = F.col("dtype").startswith("q")
    return tensors.agg(
        F.count(F.lit(1)).alias("n_tensors"), F.sum(elements).alias("n_params"), F.sum("n_bytes").alias("n_bytes"), F.sum(F.when(quantized, elements).otherwise(0)).alias("quantized_params"), F.sum(F.when(quantized, F.col("n_bytes")).otherwise(0)).alias("quantized_bytes")
    )
