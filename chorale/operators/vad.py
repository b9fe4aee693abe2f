"""Activity detection over frames: thresholds, gaps and islands, silence, windows.

Frames are (clip_id, frame, rms); results are ranges of frames, ends exclusive. Everything is partitioned by clip.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


@dataclass(frozen=True)
class VadConfig:
    energy_threshold: float = 0.01
    min_speech_ms: int = 250
    min_silence_ms: int = 300
    frame_size_ms: int = 30
    adaptive_threshold: bool = False
    noise_margin: float = 3.0


def ms_to_frames(ms: int, frame_size_ms: int) -> int:
    """Rounded up; 0 for frames of no length."""
    return -(-ms // frame_size_ms) if frame_size_ms else 0


def rms(samples: Column) -> Column:
    """Of an array of samples; 0 if it is empty."""
    n = F.size(samples)
    return F.when(n > 0, F.sqrt(F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) / n)).otherwise(0.0)


def noise_floor(frames: DataFrame) -> DataFrame:
    """clip_id, noise: the nearest-rank tenth percentile of a clip's frames."""
    w = W.partitionBy("clip_id")
    ranked = frames.select("clip_id", "rms", F.row_number().over(w.orderBy("rms", "frame")).alias("rank"), F.count(F.lit(1)).over(w).alias("n"))
    return ranked.where(F.col("rank") == F.floor(F.col("n") * 0.1) + 1).select("clip_id", F.col("rms").alias("noise"))


def thresholds(frames: DataFrame, config: VadConfig) -> DataFrame:
    """clip_id, noise, threshold."""
    noise = noise_floor(frames)
    limit = F.greatest(F.col("noise") * config.noise_margin, F.lit(1e-6)) if config.adaptive_threshold else F.lit(config.energy_threshold)
    return noise.withColumn("threshold", limit)


def runs(frames: DataFrame, config: VadConfig) -> DataFrame:
    """clip_id, start, end of each run of frames at or above the threshold."""
    if config.adaptive_threshold:
        loud = frames.join(thresholds(frames, config), "clip_id").where("rms >= threshold")
    else:
        loud = frames.where(F.col("rms") >= config.energy_threshold)
    island = F.col("frame") - F.row_number().over(W.partitionBy("clip_id").orderBy("frame"))
    return loud.select("clip_id", "frame", island.alias("island")).groupBy("clip_id", "island").agg(F.min("frame").alias("start"), (F.max("frame") + 1).alias("end")).drop("island")


def detect(frames: DataFrame, config: VadConfig) -> DataFrame:
    """clip_id, seg_idx, start, end: runs that are long enough, merged over gaps that are too short."""
    least, gap = ms_to_frames(config.min_speech_ms, config.frame_size_ms), ms_to_frames(config.min_silence_ms, config.frame_size_ms)
    w = W.partitionBy("clip_id").orderBy("start")
    kept = runs(frames, config).where(F.col("end") - F.col("start") >= least)
    new = F.coalesce(F.col("start") - F.lag("end").over(w) >= gap, F.lit(True))
    kept = kept.withColumn("part", new.cast("long")).withColumn("part", F.sum("part").over(w))
    merged = kept.groupBy("clip_id", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return merged.select("clip_id", (F.col("part") - 1).alias("seg_idx"), "start", "end")


def silence(segments: DataFrame, clips: DataFrame) -> DataFrame:
    """clip_id, start, end of what segments(clip_id, start, end) leave of clips(clip_id, length)."""
    w = W.partitionBy("clip_id").orderBy("start")
    cut = segments.select("clip_id", "start", "end").unionByName(clips.select("clip_id", F.col("length").alias("start"), F.col("length").alias("end")))
    cut = cut.select("clip_id", F.coalesce(F.lag("end").over(w), F.lit(0).cast("long")).alias("begin"), F.col("start").alias("until"))
    return cut.where("until > begin").select("clip_id", F.col("begin").alias("start"), F.col("until").alias("end"))


def slide(regions: DataFrame, window: int, hop: int, least: int) -> DataFrame:
    """clip_id, start, end of windows inside regions(clip_id, start, end); a tail counts if it has `least` samples."""
    full = F.floor((F.col("end") - F.col("start") - window) / hop).cast("long") + 1
    n = F.greatest(full, F.lit(0).cast("long"))
    tail = F.col("start") + n * hop
    count = n + ((tail < F.col("end")) & (F.col("end") - tail >= least)).cast("long")
    every = regions.where("end > start").withColumn("_n", count).where("_n > 0").select("clip_id", "start", "end", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("k"))
    begin = F.col("start") + F.col("k") * hop
    return every.select("clip_id", begin.alias("start"), F.least(begin + window, "end").alias("end"))


def nearest_silence(targets: DataFrame, gaps: DataFrame, reach: int) -> DataFrame:
    """targets(clip_id, target) with the point of a gap that is closest, within reach; the earliest gap on ties."""
    t = targets.alias("t").join(gaps.alias("g"), F.col("t.clip_id") == F.col("g.clip_id"))
    lo, hi = F.greatest(F.col("target") - reach, F.lit(0)), F.col("target") + reach
    t = t.where((F.col("g.end") > lo) & (F.col("g.start") < hi))
    centre = F.floor((F.col("g.start") + F.col("g.end")) / 2).cast("long")
    point = F.least(F.greatest(F.least(F.greatest(centre, lo), hi), F.col("g.start")), F.col("g.end"))
    best = F.min(F.struct(F.abs(point - F.col("target")).alias("distance"), F.col("g.start").alias("begin"), point.alias("point")))
    return t.groupBy(F.col("t.clip_id").alias("clip_id"), "target").agg(best.alias("b")).select("clip_id", "target", "b.point", "b.distance")


def extract_length(segments: DataFrame, clips: DataFrame, padding: int) -> DataFrame:
    """clip_id, frames: the length of all segments with padding on both sides, clamped to the clip; padding may count twice."""
    p = segments.join(clips, "clip_id").select("clip_id", (F.least(F.col("end") + padding, "length") - F.greatest(F.col("start") - padding, F.lit(0))).alias("n"))
    return p.groupBy("clip_id").agg(F.sum(F.greatest("n", F.lit(0))).alias("frames"))


def extract(samples: Column, segments: Column, padding: int) -> Column:
    """The samples of an array inside segments (an array of start, end structs), padded and concatenated."""
    lo = lambda s: F.greatest(s["start"] - padding, F.lit(0))
    return F.flatten(F.transform(segments, lambda s: F.slice(samples, (lo(s) + 1).cast("int"), F.greatest(F.least(s["end"] + padding, F.size(samples)) - lo(s), F.lit(0)).cast("int"))))
