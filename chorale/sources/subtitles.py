"""Writers of timed text: SRT, WebVTT, RTTM, labelled transcripts. Each makes one text for each clip, in a set order.

Times are cut to milliseconds as 32-bit floats cut them: (float) seconds * 1000 without rounding. Decimals of RTTM and labelled
transcripts are put together from whole thousandths and hundredths, rounded half up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from chorale.operators.transcript import join_text


def millis(seconds: Column) -> Column:
    return F.floor(F.greatest((seconds.cast("float") * F.lit(1000).cast("float")).cast("float"), F.lit(0).cast("float"))).cast("long")


def clock(seconds: Column, mark: str) -> Column:
    """HH:MM:SS and three digits behind the mark."""
    ms = millis(seconds)
    two = lambda x: F.when(x < 100, F.lpad(x.cast("string"), 2, "0")).otherwise(x.cast("string"))
    part = lambda by, of: F.floor(ms / by).cast("long") % of
    return F.concat(two(F.floor(ms / 3_600_000).cast("long")), F.lit(":"), two(part(60_000, 60)), F.lit(":"), two(part(1000, 60)), F.lit(mark), F.lpad((ms % 1000).cast("string"), 3, "0"))


def decimals(x: Column, n: int) -> Column:
    """x with n digits behind the point."""
    whole = F.round(F.abs(x) * 10**n).cast("long")
    sign = F.when((x < 0) & (whole > 0), F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, F.floor(whole / 10**n).cast("long").cast("string"), F.lit("."), F.lpad((whole % 10**n).cast("string"), n, "0"))


def _joined(df: DataFrame, key: str, order: list[str], line: Column, between: str, name: str, head: str = "", tail: str = "") -> DataFrame:
    rows = df.select(key, *order, line.alias("_line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "_line"))), lambda x: x["_line"]), between)
    return rows.groupBy(key).agg(F.concat(F.lit(head), text, F.lit(tail)).alias(name))


def to_srt(segments: DataFrame, key: str = "clip_id") -> DataFrame:
    """key, srt from segments(key, seg_idx, start, end, text)."""
    n = F.row_number().over(W.partitionBy(key).orderBy("seg_idx")).cast("string")
    line = F.concat(n, F.lit("\n"), clock(F.col("start"), ","), F.lit(" --> "), clock(F.col("end"), ","), F.lit("\n"), F.col("text"), F.lit("\n"))
    return _joined(segments.withColumn("_l", line), key, ["seg_idx"], F.col("_l"), "\n", "srt")


def to_vtt(segments: DataFrame, key: str = "clip_id") -> DataFrame:
    line = F.concat(clock(F.col("start"), "."), F.lit(" --> "), clock(F.col("end"), "."), F.lit("\n"), F.col("text"), F.lit("\n"))
    return _joined(segments, key, ["seg_idx"], line, "\n", "vtt", head="WEBVTT\n\n")


def rttm_line(uri: Column, speaker: Column, start: Column, end: Column) -> Column:
    return F.concat(F.lit("SPEAKER "), uri.cast("string"), F.lit(" 1 "), decimals(start, 3), F.lit(" "), decimals(F.greatest(end - start, F.lit(0.0)), 3), F.lit(" <NA> <NA> speaker_"), speaker.cast("string"), F.lit(" <NA> <NA>"))


def to_rttm(segments: DataFrame, key: str = "clip_id") -> DataFrame:
    """key, rttm from segments(key, seg_idx, speaker, start, end), a line each, in order of seg_idx."""
    return _joined(segments, key, ["seg_idx"], rttm_line(F.col(key), F.col("speaker"), F.col("start"), F.col("end")), "\n", "rttm", tail="\n")


def labeled(turns: DataFrame, key: str = "clip_id", timed: bool = False) -> DataFrame:
    """key, transcript: a line for each turn(key, turn, speaker, start, end, text), with its times if asked for."""
    times = F.concat(F.lit("["), decimals(F.col("start"), 2), F.lit(" -> "), decimals(F.col("end"), 2), F.lit("] ")) if timed else F.lit("")
    return _joined(turns, key, ["turn"], F.concat(times, F.lit("[SPEAKER_"), F.col("speaker").cast("string"), F.lit("] "), F.col("text")), "\n", "transcript")


def to_json(segments: DataFrame, key: str = "clip_id") -> DataFrame:
    """key, json: text and segments of a clip as one object."""
    listed = F.array_sort(F.collect_list(F.struct("seg_idx", "text", "start", "end")))
    s = segments.groupBy(key).agg(F.transform(listed, lambda x: F.struct(x["text"].alias("text"), x["start"].alias("start"), x["end"].alias("end"))).alias("segments"))
    told = s.join(join_text(segments), key, "left")  # a clip of blank texts has none
    return told.select(key, F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("text"), "segments")).alias("json"))
