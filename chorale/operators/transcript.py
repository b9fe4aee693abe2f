"""Transcripts as rows: assembly of chunks, tokens to segments and words, attribution of words to speakers, turns."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructField, StructType
from pyspark.sql.window import Window as W

from chorale.functions.text import trim

TIMESTAMP_BEGIN, RESOLUTION = 50364, 0.02


def is_mark(token):
    return token >= TIMESTAMP_BEGIN


def mark_seconds(token):
    return F.when(is_mark(token), F.round((token - TIMESTAMP_BEGIN) * RESOLUTION, 6)).otherwise(0.0)


def offset(segments: DataFrame, chunk_start_samples: str, rate: int = 16000) -> DataFrame:
    """start and end moved by the chunk's first sample."""
    by = F.col(chunk_start_samples) / rate
    return segments.withColumn("start", F.col("start") + by).withColumn("end", F.col("end") + by)


def join_text(segments: DataFrame) -> DataFrame:
    """clip_id, text: a clip's texts in order, trimmed, empty ones skipped, with a space between."""
    rows = segments.select("clip_id", "seg_idx", trim(F.col("text")).alias("text")).where("text <> ''")
    ordered = F.array_sort(F.collect_list(F.struct("seg_idx", "text")))
    return rows.groupBy("clip_id").agg(ordered.alias("s")).select("clip_id", F.array_join(F.transform("s", lambda x: x["text"]), " ").alias("text"))


def first_language(rows: DataFrame) -> DataFrame:
    """clip_id, language: of the earliest chunk (chunk_idx) that has one."""
    return rows.groupBy("clip_id").agg(F.min_by("language", F.when(F.col("language").isNotNull(), F.col("chunk_idx"))).alias("language"))


#: Entries of a vocabulary that is sent to the tasks at most.
VOCABULARY = 1_000_000
#: White space of any script, as trim() takes it off.
BLANK = " \t\n\x0b\x0c\r" + "".join(c for c in map(chr, range(0x3001)) if unicodedata.category(c)[0] == "Z")


def packed(tokens: DataFrame, key: str) -> DataFrame:
    """key, token and prob as arrays in order of pos; a scorer's tokens come as such arrays, others are gathered."""
    if isinstance(tokens.schema["token"].dataType, ArrayType):
        return tokens
    more = [c for c in ("prob",) if c in tokens.columns]
    every = tokens.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "token", *more))).alias("t"))
    field = lambda c: F.transform("t", lambda x: x[c]).alias(c)
    return every.select(key, *map(field, ("token", *more)))


def by_key(tokens: DataFrame, key: str, fields: str, rows: Callable, vocab: DataFrame | None = None) -> DataFrame:
    """key and fields of rows(tokens, log-probabilities, texts of the vocabulary) for each key; one pass, no shuffle of tokens."""
    sent = None
    if vocab is not None:
        if vocab.count() > VOCABULARY:
            raise ValueError("the vocabulary has too many entries to be sent to the tasks")
        known = vocab.where(~F.col("token_text").startswith("<|")).select("token", "token_text")  # special ones are never said
        sent = vocab.sparkSession.sparkContext.broadcast({r.token: r.token_text for r in known.collect()})
    columns = [c for c in ("token", "prob") if c in tokens.columns]
    schema = StructType([StructField(key, tokens.schema[key].dataType), *StructType.fromDDL(fields).fields])
    names = [f.name for f in schema.fields]

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = sent.value if sent else {}
        kinds = None
        for batch in batches:
            at, out = [], []
            for i in range(batch.num_rows):
                arrays = [c[i].values.to_numpy(zero_copy_only=False) if c[i].is_valid else np.zeros(0) for c in batch.columns[1:]]
                found = list(rows(arrays[0], arrays[1] if len(arrays) > 1 else None, texts))
                at += [i] * len(found)
                out += found
            kinds = kinds or to_arrow_schema(schema)
            values = [pa.array(list(c), f.type) for c, f in zip(zip(*out), list(kinds)[1:])] if out else [pa.array([], f.type) for f in list(kinds)[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *values], names=names)

    return tokens.select(key, *columns).mapInArrow(told, schema)


def said(tokens: np.ndarray, texts: dict[int, str]) -> str:
    return "".join([texts[t] for t in tokens.tolist() if t in texts])


def segments_of(tokens: np.ndarray, probs: np.ndarray | None, texts: dict[int, str]) -> Iterator[tuple[int, float, float, str]]:
    """Number, start, end and text of each segment with text."""
    marks = np.flatnonzero(tokens >= TIMESTAMP_BEGIN)
    at = [round((int(t) - TIMESTAMP_BEGIN) * RESOLUTION, 6) for t in tokens[marks]]
    if not len(marks):
        if text := said(tokens, texts).strip(BLANK):
            yield 0, 0.0, 0.0, text
    for k, (start, lo, hi) in enumerate(zip(at, marks + 1, [*marks[1:], len(tokens)])):
        if text := said(tokens[lo:hi], texts).strip(BLANK):
            yield k + 1, start, at[k + 1] if k + 1 < len(at) else 0.0, text


def confidences_of(tokens: np.ndarray, probs: np.ndarray) -> list[float]:
    """The mean log-probability between each mark and the next, 0 where nothing stands."""
    marks = np.flatnonzero(tokens >= TIMESTAMP_BEGIN)
    return [float(probs[lo + 1 : hi].mean()) if hi > lo + 1 else 0.0 for lo, hi in zip(marks, marks[1:])]


def decode(tokens: DataFrame, vocab: DataFrame, key: str = "doc_id") -> DataFrame:
    """The text of each key's tokens; special ones and those without a vocabulary entry are left out, and keys without others."""

    def rows(t, _, texts):
        known = [texts[x] for x in t.tolist() if x in texts]
        return [("".join(known),)] if known else []

    return by_key(packed(tokens, key), key, "text string", rows, vocab)


def parse_segments(tokens: DataFrame, vocab: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, seg (number of its opening mark, from 1), start, end, text.

    A mark closes a segment and opens the next; empty segments are skipped; text after the last mark ends at 0; text before
    the first mark is dropped unless there is no mark at all, in which case everything is one segment from 0 to 0.
    """
    return by_key(packed(tokens, key), key, "seg long, start double, end double, text string", segments_of, vocab)


def segment_confidences(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, k (from 0), confidence: the mean log-probability between each mark and the next, 0 where nothing stands.

    These go by marks, not by segments that have text: zipped with parse_segments by position they can be out of step, which is
    how `zip_confidences` has it; join on seg - 1 = k to have each segment's own.
    """
    return by_key(packed(tokens, key), key, "k long, confidence double", lambda t, p, _: enumerate(confidences_of(t, p)))


def scored_segments(tokens: DataFrame, vocab: DataFrame, key: str = "doc_id") -> DataFrame:
    """parse_segments with k and confidence as `zip_confidences` gives them, in one pass."""

    def rows(t, p, texts):
        told = confidences_of(t, p)
        return [(*s, k, told[k] if k < len(told) else 0.0) for k, s in enumerate(segments_of(t, p, texts))]

    return by_key(packed(tokens, key), key, "seg long, start double, end double, text string, k long, confidence double", rows, vocab)


def zip_confidences(segments: DataFrame, confidences: DataFrame, key: str = "doc_id") -> DataFrame:
    """segments with the confidence of the same position, 0 beyond their end."""
    k = F.row_number().over(W.partitionBy(key).orderBy("seg")) - 1
    return segments.withColumn("k", k.cast("long")).join(confidences, [key, "k"], "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))


def group_words(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, word_idx, word, start, end, confidence from tokens (pos, token_text, start, end, prob).

    A token that begins with a space starts a word, and so does the first one with text; pure white space is skipped and marks
    no boundary. A word ends where the next one starts, the last one where the last token ends.
    """
    w = W.partitionBy(key).orderBy("pos")
    last = F.max_by("end", "pos").over(W.partitionBy(key))
    t = tokens.withColumn("last_end", last).withColumn("trimmed", trim(F.col("token_text"))).where("trimmed <> ''")
    starts = F.col("token_text").startswith(" ") | (F.row_number().over(w) == 1)
    t = t.withColumn("word_idx", F.sum(starts.cast("long")).over(w.rowsBetween(W.unboundedPreceding, 0)) - 1)
    ordered = F.array_sort(F.collect_list(F.struct("pos", "trimmed")))
    words = t.groupBy(key, "word_idx").agg(ordered.alias("s"), F.min_by("start", "pos").alias("start"), F.avg("prob").alias("confidence"), F.max("last_end").alias("last_end"))
    end = F.coalesce(F.lead("start").over(W.partitionBy(key).orderBy("word_idx")), F.col("last_end"))
    return words.select(key, "word_idx", F.array_join(F.transform("s", lambda x: x["trimmed"]), "").alias("word"), "start", end.alias("end"), "confidence")


def attribute(words: DataFrame, timeline: DataFrame, key: str = "clip_id", bucket: float = 60.0) -> DataFrame:
    """words(key, seg_idx, word_idx, word, start, end) with the speaker of timeline(key, speaker, start, end).

    A word belongs to the segment that its middle is in (start inclusive, end exclusive; the earliest start wins); otherwise to
    the nearest one. Words meet the segments of their time bucket only; for those in none, a running maximum of ends before and
    a running minimum of starts behind give the nearest, so a clip of any length takes work in proportion to it.
    """
    t = timeline.select(F.col(key).alias("_k"), "speaker", F.col("start").alias("s"), F.col("end").alias("e"))
    spread = t.where("e > s").select("*", F.explode(F.sequence(F.floor(F.col("s") / bucket), F.floor(F.col("e") / bucket))).alias("_b"))
    w = words.select(key, "seg_idx", "word_idx", "word", "start", "end", ((F.col("start") + F.col("end")) / 2).alias("mid"))
    hit = w.join(spread, (w[key] == spread["_k"]) & (F.floor(F.col("mid") / bucket) == spread["_b"]) & (F.col("mid") >= F.col("s")) & (F.col("mid") < F.col("e")), "left")
    own = [key, "seg_idx", "word_idx", "word", "start", "end"]
    inside = hit.groupBy(*own, "mid").agg(F.min(F.struct("s", "e", "speaker")).alias("x"), F.max(F.col("s").isNotNull()).alias("found"))
    # segments' ends and starts among the words that are in no segment, in order of time
    lone = inside.where("not found").select(F.col(key).alias("_k"), F.col("mid").alias("t"), F.lit(1).alias("kind"), F.struct(*own).alias("word"))
    none = F.lit(None).cast(lone.schema["word"].dataType).alias("word")
    marks = t.select("_k", F.explode(F.array(F.struct(F.col("e").alias("t"), F.lit(True).alias("is_end")), F.struct(F.col("s").alias("t"), F.lit(False).alias("is_end")))).alias("m"), "s", "e", "speaker")
    marks = marks.select("_k", "m.t", F.lit(0).alias("kind"), none, "m.is_end", "s", "e", "speaker")
    events = marks.unionByName(lone, allowMissingColumns=True)
    before = F.max(F.when(F.col("is_end"), F.struct("e", (-F.col("s")).alias("ns"), "speaker"))).over(W.partitionBy("_k").orderBy("t", "kind").rowsBetween(W.unboundedPreceding, 0))
    behind = F.min(F.when(~F.col("is_end"), F.struct("s", "e", "speaker"))).over(W.partitionBy("_k").orderBy(F.col("t").desc(), "kind").rowsBetween(W.unboundedPreceding, 0))
    near = events.withColumn("l", before).withColumn("r", behind).where("kind = 1 and (l is not null or r is not null)")
    left = F.col("r").isNull() | (F.col("l").isNotNull() & (F.col("t") - F.col("l.e") <= F.col("r.s") - F.col("t")))
    near = near.select("word.*", F.when(left, F.col("l.speaker")).otherwise(F.col("r.speaker")).alias("speaker"))
    return inside.where("found").select(*own, F.col("x.speaker").alias("speaker")).unionByName(near)


def turns(attributed: DataFrame, key: str = "clip_id", separator: str = "") -> DataFrame:
    """key, turn, speaker, start, end, n_words, text: runs of words of one speaker.

    Words are trimmed already, so the usual joining without a separator runs them together; pass " " for text to read.
    """
    w = W.partitionBy(key).orderBy("seg_idx", "word_idx")
    change = F.coalesce((F.lag("speaker").over(w) != F.col("speaker")).cast("long"), F.lit(0).cast("long"))
    t = attributed.withColumn("change", change).withColumn("turn", F.sum("change").over(w))
    ordered = F.array_sort(F.collect_list(F.struct("seg_idx", "word_idx", "word")))
    return t.groupBy(key, "turn").agg(
        F.first("speaker").alias("speaker"), F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_words"), F.array_join(F.transform(ordered, lambda x: x["word"]), separator).alias("text")
    )
