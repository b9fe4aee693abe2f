"""Transcripts of streams: chunks are scored as they fill up, their segments timed from the stream's start.

The buffer is the only state. Scoring a chunk needs no other, so the result is a row for each chunk, and `finish` makes the text,
the language and the segments of whole streams of such rows, wherever a query has written them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorale.operators import scorer
from chorale.operators.transcript import BLANK, TIMESTAMP_BEGIN, segments_of
from chorale.streaming import chunks

RATE = 16000
SEGMENT = "struct<start: double, end: double, text: string, confidence: double, is_hallucination: boolean>"
OUT = f"stream_id long, chunk_idx long, start_sample long, language string, text string, segments array<{SEGMENT}>, last boolean, buffered long, error string"
COLUMNS = ["stream_id", "chunk_idx", "start_sample", "language", "text", "segments", "last", "buffered", "error"]


def timed(out: scorer.Decoded, vocab: list[str], offset: float, threshold: float) -> list[tuple]:
    """Segments of a chunk's tokens; confidence is the mean log-probability between a mark and the next, 0 where nothing stands."""
    tokens, probs = np.array(out.tokens, np.int64), np.array(out.logprobs)
    texts = {t: vocab[t] for t in set(out.tokens) if t < len(vocab) and not vocab[t].startswith("<|")}
    marks = np.cumsum(tokens >= TIMESTAMP_BEGIN)
    plain = tokens < TIMESTAMP_BEGIN
    rows = []
    for k, start, end, text in segments_of(tokens, probs, texts):
        of = probs[(marks == k) & plain]
        rows.append((start + offset, end + offset, text, float(of.mean()) if len(of) else 0.0, scorer.repeated(text, threshold)))
    return rows


def score(cut: DataFrame, make: Callable[[], scorer.Scorer], options: scorer.Options = scorer.Options()) -> DataFrame:
    """A row for each chunk with samples; a chunk that fails has an error and neither text nor segments."""
    call = uuid.uuid4().hex

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for stream, k, at, samples, last, buffered in zip(*(pdf[c] for c in chunks.columns(chunks.SAMPLES))):
                try:
                    tool = scorer.made(call, make)
                    out, language = scorer.transcribe(tool, np.asarray(samples, np.float32), options)
                    text = scorer.text_of(out.tokens, tool.vocab).strip(BLANK)
                    rows.append((stream, k, at, language, text, timed(out, tool.vocab, at / RATE, options.compression_ratio_threshold), last, buffered, None))
                except (ValueError, KeyError, IndexError) as e:
                    rows.append((stream, k, at, None, None, None, last, buffered, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=COLUMNS)

    return cut.mapInPandas(work, OUT)


def transcribe(pushes: DataFrame, make: Callable[[], scorer.Scorer], options: scorer.Options = scorer.Options(), chunk: int = chunks.CHUNK, hop: int = chunks.HOP) -> DataFrame:
    """Rows of score for pushes(stream_id, seq, samples, eos), in batch or streaming."""
    cut = chunks.stream_chunks if pushes.isStreaming else chunks.batch_chunks
    return score(cut(pushes, chunk, hop, samples=True), make, options)


def segments(results: DataFrame) -> DataFrame:
    """stream_id, chunk_idx and the segments of rows of score, a row each; works on streaming DataFrames as well."""
    return results.select("stream_id", "chunk_idx", F.inline("segments"))


def finish(results: DataFrame) -> DataFrame:
    """stream_id, text, language, segments, processed and errors of whole streams. Texts join by a blank, without empty ones; the
    language is that of the first chunk that has one. A stream without chunks has no row."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk_idx", "text", "language", F.coalesce("segments", F.array().cast(f"array<{SEGMENT}>")).alias("segments"))))
    each = results.groupBy("stream_id").agg(ordered.alias("c"), F.max("start_sample").alias("processed"), F.count("error").alias("errors"))
    texts = F.filter(F.col("c.text"), lambda t: t != "")
    return each.select("stream_id", F.array_join(texts, " ").alias("text"), F.get(F.filter(F.col("c.language"), lambda x: x.isNotNull()), F.lit(0)).alias("language"), F.flatten("c.segments").alias("segments"), "processed", "errors")
