"""The library's front: tables of samples to transcripts, words and speakers, with scorer and embedder given by the caller.

Signals are rows (clip_id, chunk_idx, start_sample, samples) as read_audio makes them. A scorer or embedder is made in each worker
by a function without arguments, so weights are read there and never travel in a plan.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from chorale.functions import kernels, text
from chorale.operators import clustering, embedding, scorer, sequential, transcript, vad
from chorale.operators.embedding import mean_mel as mean_mel_embedder
from chorale.plans.progress import Progress
from chorale.sources import exported, models, subtitles
from chorale.streaming import transcripts

RATE = 16000
TOKENS = "clip_id string, chunk_idx long, start_sample long, language string, no_speech double, pos long, token long, token_text string, prob double, start double, end double, error string"


@dataclass(frozen=True)
class DiarizeOptions:
    num_speakers: int | None = None
    min_speakers: int = 1
    max_speakers: int = 10
    window_s: float = 1.5
    hop_s: float = 0.75
    min_duration_s: float = 0.5
    method: str = "ahc"
    threshold: float = 0.5
    vad: vad.VadConfig = field(default_factory=vad.VadConfig)

    def __post_init__(self):
        n = self.num_speakers
        for ok, what in (
            (self.window_s > 0, "window_s has to be above 0"),
            (0 < self.hop_s <= self.window_s, "hop_s has to be above 0 and at most window_s"),
            (self.min_duration_s >= 0, "min_duration_s can't be negative"),
            (1 <= self.min_speakers <= self.max_speakers, "speaker bounds have to be 1 or more and in order"),
            (n is None or self.min_speakers <= n <= self.max_speakers, "num_speakers has to be within the bounds"),
            (self.method != "ahc" or 0 < self.threshold < float("inf"), "the threshold has to be finite and above 0"),
            (self.method in ("ahc", "spectral", "kmeans"), "unknown method"),
        ):
            if not ok:
                raise ValueError(what)


def read_model(spark: SparkSession, path: str) -> DataFrame:
    return models.read_model(spark, path)


def read_exported(spark: SparkSession, paths: list[str], vocab_path: str | None = None) -> DataFrame:
    return exported.read_exported(spark, paths, vocab_path)


def stream(pushes: DataFrame, make: Callable[[], scorer.Scorer], options: scorer.Options = scorer.Options()) -> DataFrame:
    """A row for each chunk of pushes(stream_id, seq, samples, eos), in batch or streaming; transcripts.finish puts them together."""
    return transcripts.transcribe(pushes, make, options)


def model_info(items: DataFrame) -> DataFrame:
    """One row for each file: its hyper-parameters as columns."""
    return items.where("part = 'hparam'").groupBy("path").pivot("name", list(models.HPARAMS)).agg(F.first(F.col("text").cast("int")))


def model_stats(items: DataFrame) -> DataFrame:
    from chorale.functions.signal import tensor_statistics

    return tensor_statistics(items.where("part = 'tensor'"))


def frames(signal: DataFrame, frame_ms: int = 30, rate: int = RATE) -> DataFrame:
    """clip_id, frame, rms of a signal; a frame that two chunks share is put together from its sums."""
    size = rate * frame_ms // 1000
    sums = signal.select("clip_id", F.posexplode("samples").alias("i", "x"), "start_sample").select("clip_id", F.floor((F.col("start_sample") + F.col("i")) / size).alias("frame"), (F.col("x").cast("double") * F.col("x")).alias("e"))
    return sums.groupBy("clip_id", "frame").agg(F.sqrt(F.avg("e")).alias("rms"))


def lengths(signal: DataFrame) -> DataFrame:
    return signal.groupBy("clip_id").agg(F.max(F.col("start_sample") + F.size("samples")).alias("length"))


def speech(signal: DataFrame, config: vad.VadConfig = vad.VadConfig()) -> DataFrame:
    """clip_id, seg_idx, start, end in samples."""
    size = RATE * config.frame_size_ms // 1000
    found = vad.detect(frames(signal, config.frame_size_ms), config).join(lengths(signal), "clip_id")
    return found.select("clip_id", "seg_idx", (F.col("start") * size).alias("start"), F.least(F.col("end") * size, "length").alias("end"))


def plan_chunks(signal: DataFrame, config: vad.VadConfig = vad.VadConfig(0.01, 100, 100)) -> DataFrame:
    clips = lengths(signal)
    return sequential.chunk_plan(vad.silence(speech(signal, config), clips), clips)


def cut(signal: DataFrame, ranges: DataFrame, index: str) -> DataFrame:
    """Samples of ranges(clip_id, index, start, end), put together from the rows of the signal that they touch."""
    s = signal.select(F.col("clip_id").alias("_c"), F.col("start_sample").alias("_s"), "samples")
    hit = ranges.join(s, (F.col("clip_id") == F.col("_c")) & (F.col("_s") < F.col("end")) & (F.col("_s") + F.size("samples") > F.col("start")))
    lo = F.greatest(F.col("start") - F.col("_s"), F.lit(0))
    part = F.slice("samples", (lo + 1).cast("int"), (F.least(F.col("end") - F.col("_s"), F.size("samples")) - lo).cast("int"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("_s"), part.alias("p"))))
    return hit.groupBy("clip_id", index, "start", "end").agg(F.flatten(F.transform(ordered, lambda x: x["p"])).alias("samples"))


def score(chunks: DataFrame, make: Callable[[], scorer.Scorer], options: scorer.Options = scorer.Options(), carry: bool = False, progress: Progress | None = None) -> DataFrame:
    """Tokens of chunks(clip_id, chunk_idx, start_sample, samples), a row each; a chunk that fails is a row with an error.

    Chunks are independent of each other unless `carry`, which gives each the text of the one before it in its clip; then a
    clip is one task's work. progress counts the chunks that were scored.
    """

    call, count = uuid.uuid4().hex, progress.done if progress else None

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = scorer.made(call, make)
        clip, before = None, ()
        for pdf in batches:
            rows = []
            for c, k, at, samples in zip(pdf.clip_id, pdf.chunk_idx, pdf.start_sample, pdf.samples):
                try:
                    out, language = scorer.transcribe(tool, np.asarray(samples, np.float32), options, list(before) if carry and c == clip else None)
                    clip, before = c, tuple(t for t in out.tokens if t < scorer.END)
                    times = sequential.align(np.array(out.attention), kernels.HOP / RATE) if out.attention else [(None, None)] * len(out.tokens)
                    rows += [(c, k, at, language, out.no_speech, i, t, text_, p, s, e, None) for i, (t, p, (s, e), text_) in enumerate(zip(out.tokens, out.logprobs, times, (tool.vocab[t] if t < len(tool.vocab) else "" for t in out.tokens)))]
                except (ValueError, KeyError, IndexError) as e:
                    rows.append((c, k, at, None, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
                if count is not None:
                    count.add(1)
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in TOKENS.split(", ")])

    dealt = chunks.select(F.col("clip_id").cast("string").alias("clip_id"), F.col("chunk_idx").cast("long").alias("chunk_idx"), F.col("start_sample").cast("long").alias("start_sample"), "samples")
    dealt = dealt.repartition("clip_id").sortWithinPartitions("clip_id", "chunk_idx") if carry else dealt
    return dealt.mapInPandas(work, TOKENS)


def transcribe_segments(tokens: DataFrame, threshold: float = 2.4) -> DataFrame:
    """clip_id, seg_idx, start, end, text, confidence, is_hallucination from scored tokens; times are of the whole clip."""
    keyed = tokens.where("error is null").withColumn("key", F.struct("clip_id", "chunk_idx", "start_sample"))
    known = keyed.select("key", "pos", "token", "prob", "token_text")
    w = W.partitionBy("key").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    mark = transcript.is_mark(F.col("token"))
    marked = known.withColumn("seg", F.sum(mark.cast("long")).over(w)).withColumn("said", ~mark & ~F.col("token_text").startswith("<|"))
    ordered = F.array_sort(F.collect_list(F.when(F.col("said"), F.struct("pos", "token_text"))))
    segs = marked.groupBy("key", "seg").agg(text.trim(F.array_join(F.transform(ordered, lambda x: x["token_text"]), "")).alias("text"), F.max(F.when(mark, F.col("token"))).alias("m"), F.avg(F.when(~mark, F.col("prob"))).alias("confidence"))
    nxt = F.lead("m").over(W.partitionBy("key").orderBy("seg"))
    segs = segs.withColumn("start", F.coalesce(transcript.mark_seconds(F.col("m")), F.lit(0.0))).withColumn("end", F.coalesce(transcript.mark_seconds(nxt), F.lit(0.0)))
    n_marks = F.max("seg").over(W.partitionBy("key"))
    segs = segs.withColumn("_n", n_marks).where("text <> '' and (seg > 0 or _n = 0)")
    by = F.col("key.start_sample") / RATE
    segs = segs.select("key.clip_id", "key.chunk_idx", "seg", (F.col("start") + by).alias("start"), (F.col("end") + by).alias("end"), "text", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    idx = F.row_number().over(W.partitionBy("clip_id").orderBy("chunk_idx", "seg")) - 1
    return segs.select("clip_id", idx.cast("long").alias("seg_idx"), "start", "end", "text", "confidence", text.is_hallucination(F.col("text"), threshold).alias("is_hallucination"))


def transcribe(signal: DataFrame, make: Callable[[], scorer.Scorer], options: scorer.Options = scorer.Options(), config: vad.VadConfig | None = None, carry: bool = False, progress: Progress | None = None) -> DataFrame:
    """Segments of clips of any length: chunks are planned at silences, scored and put together.

    With progress the chunks are counted first; progress.run(action) over the result then tells its listener of them.
    """
    plan = plan_chunks(signal, config) if config else plan_chunks(signal)
    if progress:
        progress.expect(plan)
    chunks = cut(signal, plan, "chunk_idx").withColumn("start_sample", F.col("start"))
    return transcribe_segments(score(chunks, make, options, carry, progress), options.compression_ratio_threshold)


def align_words(tokens: DataFrame) -> DataFrame:
    """clip_id, seg_idx, word_idx, word, start, end, confidence from scored tokens with times."""
    keyed = tokens.where("error is null and start is not null").withColumn("key", F.struct("clip_id", "chunk_idx", "start_sample"))
    said = keyed.where(~transcript.is_mark(F.col("token")) & ~F.col("token_text").startswith("<|"))
    w = transcript.group_words(said.select("key", "pos", "token_text", "start", "end", "prob"), "key")
    by = F.col("key.start_sample") / RATE
    return w.select("key.clip_id", F.col("key.chunk_idx").alias("seg_idx"), "word_idx", "word", (F.col("start") + by).alias("start"), (F.col("end") + by).alias("end"), "confidence")


def to_srt(segments: DataFrame) -> DataFrame:
    return subtitles.to_srt(segments)


def to_vtt(segments: DataFrame) -> DataFrame:
    return subtitles.to_vtt(segments)


def log_mel(chunks: DataFrame) -> DataFrame:
    """clip_id, chunk_idx, n_frames, mel (80 rows of frames, flat)."""

    def work(batches):
        for pdf in batches:
            m = [kernels.log_mel(np.asarray(s, np.float32)) for s in pdf.samples]
            yield pd.DataFrame({"clip_id": pdf.clip_id, "chunk_idx": pdf.chunk_idx, "n_frames": [x.shape[1] for x in m], "mel": [x.ravel() for x in m]})

    return chunks.select("clip_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), "samples").mapInPandas(work, "clip_id string, chunk_idx long, n_frames long, mel array<float>")


def encoder_output(chunks: DataFrame, make: Callable[[], scorer.TransformerScorer]) -> DataFrame:
    """clip_id, chunk_idx, n_frames, width, output (n_frames rows of width values, flat); a chunk without samples is a row with an error."""
    call = uuid.uuid4().hex

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for c, k, samples in zip(pdf.clip_id, pdf.chunk_idx, pdf.samples):
                if samples is None or not len(samples):
                    rows.append((c, k, None, None, None, "the chunk is empty"))
                    continue
                x = scorer.made(call, make).encode(np.asarray(samples, np.float32))
                rows.append((c, k, *x.shape, x.ravel(), None))
            yield pd.DataFrame(rows, columns=["clip_id", "chunk_idx", "n_frames", "width", "output", "error"])

    kind = chunks.schema["clip_id"].dataType.simpleString()
    dealt = chunks.select("clip_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), "samples")
    return dealt.mapInPandas(work, f"clip_id {kind}, chunk_idx long, n_frames long, width long, output array<float>, error string")


def diarize(signal: DataFrame, options: DiarizeOptions = DiarizeOptions(), embedder: embedding.Embedder | Callable[[np.ndarray, int], np.ndarray] = mean_mel_embedder, make_embedder: Callable[[], embedding.Embedder] | None = None) -> DataFrame:
    """clip_id, seg_idx, speaker, start, end (seconds): speech, windows, embeddings, clusters, runs.

    The embedder is given, or made in each worker by make_embedder, as one that reads a model's weights has to be.
    """
    samples = lambda s: int(np.floor(s * RATE + 0.5))
    windows = vad.slide(speech(signal, options.vad), samples(options.window_s), samples(options.hop_s), samples(options.min_duration_s))
    windows = windows.withColumn("vec_id", F.row_number().over(W.partitionBy("clip_id").orderBy("start", "end")).cast("long"))

    call = uuid.uuid4().hex

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = embedding.Checked(scorer.made(call, make_embedder) if make_embedder else embedder)
        for pdf in batches:
            yield pd.DataFrame({"clip_id": pdf.clip_id, "vec_id": pdf.vec_id, "start": pdf.start, "end": pdf.end, "embedding": [tool.embed(np.asarray(s, np.float32), RATE) for s in pdf.samples]})

    kind = signal.schema["clip_id"].dataType.simpleString()
    made = cut(signal, windows, "vec_id").mapInPandas(work, f"clip_id {kind}, vec_id long, start long, end long, embedding array<double>")
    how = {"method": options.method, "threshold": options.threshold, "k": options.num_speakers, "least": options.min_speakers, "most": options.max_speakers}
    labels = clustering.cluster_windows(made, "clip_id", "vec_id", ("start", "end"), **how)
    return sequential.resegment(labels.drop("vec_id"), RATE, options.min_duration_s)


def transcribe_with_speakers(words: DataFrame, timeline: DataFrame) -> DataFrame:
    """Turns of words(clip_id, seg_idx, word_idx, ...) by the speakers of a timeline(clip_id, speaker, start, end)."""
    return transcript.turns(transcript.attribute(words, timeline))
