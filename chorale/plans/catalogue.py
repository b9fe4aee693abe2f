"""Queries over the driver's tables, one for each operator, with the same result in DuckDB's SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from chorale.functions import decoding, kernels, signal, text, vectors
from chorale.operators import clustering, metrics, sequential, transcript, vad
from chorale.plans import adapters as A
from chorale.sources import audio, subtitles
from chorale.streaming import chunks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, *ctes: str):
    """Registers the function under its name, with SQL over the common table expressions."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = (f"with {', '.join(ctes)} " if ctes else "") + sql.strip()
        return f

    return add


R = lambda c, n=6: F.round(F.col(c) if isinstance(c, str) else c, n)


# texts

ENTROPY = """ent as (
    select doc_id, round(-sum(p * log2(p)), 6) as entropy from (
      select doc_id, count(*) / sum(count(*)) over (partition by doc_id) as p from (select doc_id, unnest(string_split(text, '')) as c from documents where text <> '') group by doc_id, c) group by doc_id)"""


@query("select d.doc_id, lang, coalesce(entropy, 0.0) as entropy from documents d left join ent using (doc_id)", ENTROPY)
def char_entropy(spark, sf):
    return A.documents(spark, sf).select("doc_id", "lang", R(text.char_entropy(F.col("text"))).alias("entropy"))


@query("select d.doc_id, lang, strlen(text)::bigint as n_bytes, coalesce(entropy, 0.0) as entropy, strlen(text) >= 10 and coalesce(entropy, 0.0) < 8 / 2.4 as flagged from documents d left join ent using (doc_id)", ENTROPY)
def hallucination_flag(spark, sf):
    measured = A.documents(spark, sf).select("doc_id", "lang", "text", text.char_entropy(F.col("text")).alias("e"))
    return measured.select("doc_id", "lang", F.octet_length("text").cast("long").alias("n_bytes"), R("e").alias("entropy"), text.is_hallucination(F.col("text"), entropy=F.col("e")).alias("flagged"))


@query("select lang, count(*) as n, sum((strlen(text) >= 10 and coalesce(entropy, 0.0) < 8 / 2.4)::bigint)::bigint as n_flagged, round(avg(coalesce(entropy, 0.0)), 4) as mean_entropy from documents d left join ent using (doc_id) group by lang", ENTROPY)
def hallucination_by_lang(spark, sf):
    return hallucination_flag(spark, sf).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("flagged").cast("long")).alias("n_flagged"), F.round(F.avg("entropy"), 4).alias("mean_entropy"))


@query("select quality::bigint as quality, strlen(text) >= 10 and coalesce(entropy, 0.0) < 8 / 2.4 as flagged, count(*) as n from documents d join labels using (doc_id) left join ent using (doc_id) group by 1, 2", ENTROPY)
def flag_vs_quality_label(spark, sf):
    return hallucination_flag(spark, sf).join(A.read(spark, sf, "labels"), "doc_id").groupBy(F.col("quality").cast("long").alias("quality"), "flagged").agg(F.count(F.lit(1)).alias("n"))


DWORDS = r"dw as (select doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') as w from documents)"


@query(
    """select doc_id, n::bigint as n_ngrams, round(case when n = 0 then 0.0 else 1 - u / n end, 6) as repeat_ratio
       from (select doc_id, len(g) as n, len(list_distinct(g)) as u from (select doc_id, list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: array_to_string(w[i:i + 2], ' ')) as g from dw))""",
    DWORDS,
)
def ngram_repeat_ratio(spark, sf):
    n = F.greatest(F.size(text.words(F.col("text"))) - 2, F.lit(0))
    return A.documents(spark, sf).select("doc_id", n.cast("long").alias("n_ngrams"), R(text.repeat_ratio(F.col("text"))).alias("repeat_ratio"))


@query(
    """select doc_id, array_to_string(list_sort(list_distinct(list_transform(list_filter(range(1, len(w) - 1), lambda i: w[i] = w[len(w) - 1] and w[i + 1] = w[len(w)]), lambda i: w[i + 2]))), ',') as blocked from dw where len(w) >= 3""",
    DWORDS,
)
def no_repeat_candidates(spark, sf):
    w = text.words(F.col("text"))
    return A.read(spark, sf, "documents").where(F.size(w) >= 3).select("doc_id", F.array_join(text.blocked(w, 3), ",").alias("blocked"))


# activity

VAD = vad.VadConfig(energy_threshold=60.0, min_speech_ms=60, min_silence_ms=90, frame_size_ms=30)
ADAPTIVE = vad.VadConfig(min_speech_ms=60, min_silence_ms=90, frame_size_ms=30, adaptive_threshold=True, noise_margin=1.5)
RUNS = """runs as (select clip_id, min(frame) as "start", max(frame) + 1 as "end" from (select clip_id, frame, frame - row_number() over (partition by clip_id order by frame) as g from frames where rms >= 60.0) group by clip_id, g)"""
SEGS = """segs as (
    select clip_id, part - 1 as seg_idx, min("start") as "start", max("end") as "end" from (
      select *, sum(new) over (partition by clip_id order by "start")::bigint as part from (
        select *, case when "start" - lag("end") over (partition by clip_id order by "start") < 3 then 0 else 1 end as new from runs where "end" - "start" >= 2)) group by clip_id, part)"""
CLIPS = "clips as (select clip_id, max(frame) + 1 as length from frames group by clip_id)"
GAPS = """gaps as (
    select clip_id, b as "start", u as "end" from (
      select clip_id, coalesce(lag("end") over (partition by clip_id order by "start"), 0) as b, "start" as u from (select clip_id, "start", "end" from segs union all select clip_id, length, length from clips)) where u > b)"""


def clip_lengths(frames: DataFrame) -> DataFrame:
    return frames.groupBy("clip_id").agg((F.max("frame") + 1).alias("length"))


def vad_gaps(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    frames = A.frames(spark, sf)
    segs, clips = vad.detect(frames, VAD), clip_lengths(frames)
    return segs, clips, vad.silence(segs, clips)


@query("select clip_id, frame, round(rms, 6) as rms from frames", A.FRAMES)
def frame_rms(spark, sf):
    return A.frames(spark, sf).select("clip_id", "frame", R("rms").alias("rms"))


@query("select clip_id, round(sqrt(avg(rms * rms)), 6) as rms, sqrt(avg(rms * rms)) >= 30.0 as speech from frames group by clip_id", A.FRAMES)
def has_speech(spark, sf):
    level = F.sqrt(F.avg(F.col("rms") * F.col("rms")))
    return A.frames(spark, sf).groupBy("clip_id").agg(R(level).alias("rms"), (level >= 30.0).alias("speech"))


NOISE = "noise as (select clip_id, rms as noise from (select *, row_number() over (partition by clip_id order by rms, frame) as r, count(*) over (partition by clip_id) as n from frames) where r = floor(n * 0.1)::bigint + 1)"


@query("select clip_id, round(noise, 6) as noise from noise", A.FRAMES, NOISE)
def noise_floor_p10(spark, sf):
    return vad.noise_floor(A.frames(spark, sf)).select("clip_id", R("noise").alias("noise"))


@query("select clip_id, round(noise, 6) as noise, round(greatest(noise * 1.5, 1e-6), 6) as threshold from noise", A.FRAMES, NOISE)
def adaptive_threshold(spark, sf):
    return vad.thresholds(A.frames(spark, sf), ADAPTIVE).select("clip_id", R("noise").alias("noise"), R("threshold").alias("threshold"))


@query('select clip_id, "start", "end" from runs', A.FRAMES, RUNS)
def vad_runs(spark, sf):
    return vad.runs(A.frames(spark, sf), VAD)


@query('select clip_id, seg_idx, "start", "end" from segs', A.FRAMES, RUNS, SEGS)
def vad_segments(spark, sf):
    return vad.detect(A.frames(spark, sf), VAD)


@query('select clip_id, "start", "end" from gaps', A.FRAMES, RUNS, SEGS, CLIPS, GAPS)
def silence_gaps(spark, sf):
    return vad_gaps(spark, sf)[2]


@query('select clip_id, sum(least("end" + 2, length) - greatest("start" - 2, 0))::bigint as frames from segs join clips using (clip_id) group by clip_id', A.FRAMES, RUNS, SEGS, CLIPS)
def extract_speech_len(spark, sf):
    segs, clips, _ = vad_gaps(spark, sf)
    return vad.extract_length(segs, clips, 2)


@query(
    """select clip_id, "start" + k * 2 as "start", least("start" + k * 2 + 3, "end") as "end" from (
         select *, unnest(range(n + case when "start" + n * 2 < "end" and "end" - "start" - n * 2 >= 2 then 1 else 0 end)) as k
         from (select *, greatest(("end" - "start" - 3) // 2 + case when "end" - "start" >= 3 then 1 else 0 end, 0) as n from segs))""",
    A.FRAMES, RUNS, SEGS,
)
def window_speech(spark, sf):
    return vad.slide(vad.detect(A.frames(spark, sf), VAD), 3, 2, 2)


@query(
    """select clip_id, target, point, distance from (
         select clip_id, target, p as point, abs(p - target) as distance, row_number() over (partition by clip_id, target order by abs(p - target), s) as r from (
           select c.clip_id, length // 2 as target, g."start" as s, least(greatest(least(greatest((g."start" + g."end") // 2, greatest(length // 2 - 10, 0)), length // 2 + 10), g."start"), g."end") as p
           from clips c join gaps g on c.clip_id = g.clip_id and g."end" > greatest(length // 2 - 10, 0) and g."start" < length // 2 + 10)) where r = 1""",
    A.FRAMES, RUNS, SEGS, CLIPS, GAPS,
)
def nearest_silence(spark, sf):
    _, clips, gaps = vad_gaps(spark, sf)
    return vad.nearest_silence(clips.select("clip_id", F.floor(F.col("length") / 2).cast("long").alias("target")), gaps, 10)


@query(
    """select clip_id, k as chunk_idx, s as "start", e as "end" from plan""",
    "recursive " + A.FRAMES, RUNS, SEGS, CLIPS, GAPS,
    """listed as (select c.clip_id, length, coalesce(g, []) as g from clips c left join (select clip_id, list({'s': "start", 'e': "end"} order by "start") as g from gaps group by clip_id) using (clip_id)),
       plan(clip_id, length, g, k, s, e) as (
         select clip_id, length, g, k, s0, case when length - s0 > 30 then least(greatest(coalesce(near, s0 + 29), s0 + 1), s0 + 30) else length end
         from (select clip_id, length, g, 0::bigint as k, 0::bigint as s0, list_sort(list_transform(list_filter(g, lambda x: x.e > 25 and x.s < 33), lambda x, i: {'d': abs(least(greatest(least(greatest((x.s + x.e) // 2, 25), 33), x.s), x.e) - 29), 'i': i, 'p': least(greatest(least(greatest((x.s + x.e) // 2, 25), 33), x.s), x.e)}))[1].p as near from listed where length > 0)
         union all
         select clip_id, length, g, k, s0, case when length - s0 > 30 then least(greatest(coalesce(near, s0 + 29), s0 + 1), s0 + 30) else length end
         from (select clip_id, length, g, k + 1 as k, e as s0, list_sort(list_transform(list_filter(g, lambda x: x.e > e + 25 and x.s < e + 33), lambda x, i: {'d': abs(least(greatest(least(greatest((x.s + x.e) // 2, e + 25), e + 33), x.s), x.e) - e - 29), 'i': i, 'p': least(greatest(least(greatest((x.s + x.e) // 2, e + 25), e + 33), x.s), x.e)}))[1].p as near from plan where e < length))""",
)
def chunk_plan(spark, sf):
    _, clips, gaps = vad_gaps(spark, sf)
    return sequential.chunk_plan(gaps, clips, chunk=30, step=29, reach=4)


# long audio and transcripts


@query('select clip_id, seg_idx, round("start", 6) as "start", round("end", 6) as "end", length(text) as n_chars from segments', A.SEGMENTS)
def segment_timeline(spark, sf):
    return A.segments(spark, sf).select("clip_id", "seg_idx", R("start").alias("start"), R("end").alias("end"), F.length("text").cast("long").alias("n_chars"))


@query('select clip_id, seg_idx, round("start" + seg_idx * 464000 / 16000, 6) as "start", round("end" + seg_idx * 464000 / 16000, 6) as "end" from segments', A.SEGMENTS)
def offset_segments(spark, sf):
    s = A.segments(spark, sf).withColumn("at", F.col("seg_idx") * 464000)
    return transcript.offset(s, "at").select("clip_id", "seg_idx", R("start").alias("start"), R("end").alias("end"))


TRIM = r"regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')"


@query(f"select clip_id, string_agg(t, ' ' order by seg_idx) as text from (select clip_id, seg_idx, {TRIM} as t from segments) where t <> '' group by clip_id", A.SEGMENTS)
def join_chunk_text(spark, sf):
    return transcript.join_text(A.segments(spark, sf))


@query("select clip_id, arg_min(case when role <> 'system' then role end, seg_idx) filter (where role <> 'system') as language from segments group by clip_id", A.SEGMENTS)
def first_language(spark, sf):
    s = A.segments(spark, sf).select("clip_id", F.col("seg_idx").alias("chunk_idx"), F.when(F.col("role") != "system", F.col("role")).alias("language"))
    return transcript.first_language(s)


ATTR = """attr as (
    select clip_id, seg_idx, word_idx, word, ws, we, speaker from (
      select w.clip_id, w.seg_idx, w.word_idx, w.word, w."start" as ws, w."end" as we, h.speaker,
        row_number() over (partition by w.clip_id, w.seg_idx, w.word_idx order by case when m >= h."start" and m < h."end" then -1.0 else greatest(h."start" - m, m - h."end", 0.0) end, h."start", h."end") as r
      from (select *, ("start" + "end") / 2 as m from words) w join hyp h on w.clip_id = h.uri) where r = 1)"""
TURNS = """turns as (
    select clip_id, turn, any_value(speaker) as speaker, min(ws) as "start", max(we) as "end", count(*) as n_words, string_agg(word, '' order by seg_idx, word_idx) as text from (
      select *, sum(c) over (partition by clip_id order by seg_idx, word_idx)::bigint as turn from (
        select *, case when lag(speaker) over (partition by clip_id order by seg_idx, word_idx) <> speaker then 1 else 0 end as c from attr)) group by clip_id, turn)"""


def _attributed(spark, sf):
    return transcript.attribute(A.words(spark, sf), A.hyp_timeline(spark, sf).withColumnRenamed("uri", "clip_id"))


@query("select clip_id, seg_idx, word_idx, word, speaker::bigint as speaker from attr", A.SEGMENTS, A.WORDS, A.TIMELINES, ATTR)
def word_midpoint_attribution(spark, sf):
    return _attributed(spark, sf).select("clip_id", "seg_idx", "word_idx", "word", F.col("speaker").cast("long").alias("speaker"))


@query('select clip_id, turn, speaker::bigint as speaker, round("start", 6) as "start", round("end", 6) as "end", n_words, text from turns', A.SEGMENTS, A.WORDS, A.TIMELINES, ATTR, TURNS)
def speaker_turns(spark, sf):
    return transcript.turns(_attributed(spark, sf)).select("clip_id", "turn", F.col("speaker").cast("long").alias("speaker"), R("start").alias("start"), R("end").alias("end"), "n_words", "text")


@query("select clip_id, count(distinct speaker) as n_speakers from attr group by clip_id", A.SEGMENTS, A.WORDS, A.TIMELINES, ATTR)
def distinct_speakers(spark, sf):
    return _attributed(spark, sf).groupBy("clip_id").agg(F.count_distinct("speaker").alias("n_speakers"))


@query(
    """select clip_id, label, min("start") as "start", max("end") as "end" from (
         select *, sum(c) over (partition by clip_id order by "start") as g from (select *, case when lag(label) over (partition by clip_id order by "start") = label then 0 else 1 end as c from wl)) group by clip_id, label, g""",
    A.SEGMENTS, A.WINDOWS_LABELS,
)
def build_runs_simple(spark, sf):
    w = W.partitionBy("clip_id").orderBy("start")
    x = A.windows_labels(spark, sf).withColumn("c", F.coalesce((F.lag("label").over(w) != F.col("label")).cast("long"), F.lit(1).cast("long"))).withColumn("g", F.sum("c").over(w))
    return x.groupBy("clip_id", "label", "g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("g")


@query()
def reseg(spark, sf):
    return sequential.resegment(A.windows_labels(spark, sf), rate=100, min_seconds=0.5)


# formats

MS = "(floor(({0}::float * 1000::float)::float)::bigint)"
CLOCK = "lpad(({0} // 3600000)::varchar, greatest(2, length(({0} // 3600000)::varchar))::int, '0') || ':' || lpad(({0} // 60000 % 60)::varchar, 2, '0') || ':' || lpad(({0} // 1000 % 60)::varchar, 2, '0') || '{1}' || lpad(({0} % 1000)::varchar, 3, '0')"
T1, T2 = MS.format('"start"'), MS.format('"end"')
DEC = "(floor(round({0} * {1})::bigint / {1}.0)::bigint::varchar || '.' || lpad((round({0} * {1})::bigint % {1})::varchar, {2}, '0'))"


@query(
    f"""select clip_id, string_agg(n || chr(10) || {CLOCK.format(T1, ',')} || ' --> ' || {CLOCK.format(T2, ',')} || chr(10) || text || chr(10), chr(10) order by seg_idx) as srt
        from (select *, row_number() over (partition by clip_id order by seg_idx) as n from segments) group by clip_id""",
    A.SEGMENTS,
)
def srt(spark, sf):
    return subtitles.to_srt(A.segments(spark, sf))


@query(f"""select clip_id, 'WEBVTT' || chr(10) || chr(10) || string_agg({CLOCK.format(T1, '.')} || ' --> ' || {CLOCK.format(T2, '.')} || chr(10) || text || chr(10), chr(10) order by seg_idx) as vtt from segments group by clip_id""", A.SEGMENTS)
def vtt(spark, sf):
    return subtitles.to_vtt(A.segments(spark, sf))


RTTM_LINE = f"""'SPEAKER ' || uri || ' 1 ' || {DEC.format('"start"', 1000, 3)} || ' ' || {DEC.format('greatest("end" - "start", 0)', 1000, 3)} || ' <NA> <NA> speaker_' || speaker || ' <NA> <NA>'"""


def _hyp_segments(spark, sf):
    s = A.segments(spark, sf)
    role = F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).otherwise(2)
    return s.select("clip_id", "seg_idx", role.alias("speaker"), "start", "end")


@query(f"""select uri as clip_id, string_agg({RTTM_LINE}, chr(10) order by "start") || chr(10) as rttm from (select clip_id as uri, case role when 'user' then 0 when 'assistant' then 1 else 2 end as speaker, "start", "end" from segments) group by uri""", A.SEGMENTS)
def rttm(spark, sf):
    return subtitles.to_rttm(_hyp_segments(spark, sf))


@query(f"""select uri::varchar as uri, 'speaker_' || speaker as speaker, round({DEC.format('"start"', 1000, 3)}::double, 6) as "start", round({DEC.format('"start"', 1000, 3)}::double + {DEC.format('greatest("end" - "start", 0)', 1000, 3)}::double, 6) as "end" from (select clip_id as uri, case role when 'user' then 0 when 'assistant' then 1 else 2 end as speaker, "start", "end" from segments)""", A.SEGMENTS)
def parse_rttm(spark, sf):
    lines = subtitles.to_rttm(_hyp_segments(spark, sf)).select(F.explode(F.split("rttm", "\n")).alias("value"))
    return metrics.parse_rttm(lines).select("uri", "speaker", R("start").alias("start"), R("end").alias("end"))


@query("select clip_id, string_agg('[SPEAKER_' || speaker || '] ' || text, chr(10) order by turn) as transcript from turns group by clip_id", A.SEGMENTS, A.WORDS, A.TIMELINES, ATTR, TURNS)
def labeled_transcript(spark, sf):
    return subtitles.labeled(transcript.turns(_attributed(spark, sf)))


@query(f"""select clip_id, string_agg('[' || {DEC.format('"start"', 100, 2)} || ' -> ' || {DEC.format('"end"', 100, 2)} || '] [SPEAKER_' || speaker || '] ' || text, chr(10) order by turn) as transcript from turns group by clip_id""", A.SEGMENTS, A.WORDS, A.TIMELINES, ATTR, TURNS)
def labeled_transcript_timed(spark, sf):
    return subtitles.labeled(transcript.turns(_attributed(spark, sf)), timed=True)


@query(f"""select clip_id, to_json({{'text': coalesce(string_agg(case when t <> '' then t end, ' ' order by seg_idx), ''), 'segments': list({{'text': text, 'start': "start", 'end': "end"}} order by seg_idx)}})::varchar as json from (select *, {TRIM} as t from segments) group by clip_id""", A.SEGMENTS)
def result_json(spark, sf):
    return subtitles.to_json(A.segments(spark, sf))


# scores

GRID = """cuts as (select uri, "start" as t from ref union select uri, "end" from ref union select uri, "start" from hyp union select uri, "end" from hyp),
  grid0 as (select uri, t as lo, lead(t) over (partition by uri order by t) as hi from cuts),
  grid as (select uri, row_number() over (partition by uri order by lo) - 1 as k, lo, hi, (lo + hi) / 2 as mid from grid0 where hi is not null)"""
COLLAR_GRID = """rcuts as (select uri, "start" as t from ref union select uri, "end" from ref),
  cuts as (select uri, t from rcuts union select uri, t - 0.25::double from rcuts union select uri, t + 0.25::double from rcuts union select uri, "start" from hyp union select uri, "end" from hyp),
  grid0 as (select uri, t as lo, lead(t) over (partition by uri order by t) as hi from cuts),
  grid as (select * from (select uri, row_number() over (partition by uri order by lo) - 1 as k, lo, hi, (lo + hi) / 2 as mid from grid0 where hi is not null) g
           where not exists (select 1 from rcuts c where c.uri = g.uri and g.mid > c.t - 0.25::double and g.mid < c.t + 0.25::double))"""
ACTIVE = """ra as (select g.uri, k, list_sort(list_distinct(list(speaker))) as ref from grid g join ref r on g.uri = r.uri and mid >= r."start" and mid < r."end" group by g.uri, k),
  ha as (select g.uri, k, list_sort(list_distinct(list(speaker))) as hyp from grid g join hyp h on g.uri = h.uri and mid >= h."start" and mid < h."end" group by g.uri, k),
  el as (select g.uri, g.k, lo, hi, hi - lo as d, coalesce(ref, []) as ref, coalesce(hyp, []) as hyp from grid g left join ra using (uri, k) left join ha using (uri, k)),
  m as (select * from (values ('user', 0), ('assistant', 1), ('system', 2)) t(r, h))"""
DER = """select uri, round(case when total > 0 then miss else 0 end, 6) as miss, round(case when total > 0 then fa else 0 end, 6) as false_alarm, round(case when total > 0 then conf else 0 end, 6) as confusion, round(total, 6) as total,
    round(case when total > 0 then (miss + fa + conf) / total else 0 end, 6) as der from (
  select uri, sum(d * greatest(nr - nh, 0)) as miss, sum(d * greatest(nh - nr, 0)) as fa, sum(d * (least(nr, nh) - ok)) as conf, sum(d * nr) as total from (
    select uri, d, len(ref) as nr, len(hyp) as nh, (select count(*) from m where list_contains(ref, r) and list_contains(hyp, h)) as ok from el{where}) group by uri)"""


def _grid(spark, sf, collar=0.0):
    return metrics.intervals(A.ref_timeline(spark, sf), A.hyp_timeline(spark, sf), collar)


def _mapping(grid: DataFrame) -> DataFrame:
    """The roles' own numbers, for each uri."""
    m = F.explode(F.array(*[F.struct(F.lit(r).alias("ref"), F.lit(h).alias("hyp")) for r, h in A.ROLES.items()]))
    return grid.select("uri").distinct().select("uri", m.alias("m")).select("uri", "m.ref", "m.hyp")


def _der(spark, sf, collar=0.0, skip=False):
    g = _grid(spark, sf, collar)
    out = metrics.der(g, _mapping(g), skip)
    return out.select("uri", *[R(c).alias(c) for c in out.columns[1:]])


BOTH = "both_ as (select uri, r as ref, h as hyp, sum(d) as seconds from (select uri, d, r, unnest(hyp) as h from (select uri, d, unnest(ref) as r, hyp from el)) group by uri, r, h)"


@query("select uri, k, round(lo, 6) as lo, round(hi, 6) as hi, len(ref)::bigint as n_ref, len(hyp)::bigint as n_hyp from el", A.SEGMENTS, A.TIMELINES, GRID, ACTIVE)
def elementary_intervals(spark, sf):
    return _grid(spark, sf).select("uri", "k", R("lo").alias("lo"), R("hi").alias("hi"), F.size("ref").cast("long").alias("n_ref"), F.size("hyp").cast("long").alias("n_hyp"))


@query("select uri, ref, hyp::bigint as hyp, round(seconds, 6) as seconds from both_", A.SEGMENTS, A.TIMELINES, GRID, ACTIVE, BOTH)
def cooccurrence(spark, sf):
    return metrics.cooccurrence(_grid(spark, sf)).select("uri", "ref", F.col("hyp").cast("long").alias("hyp"), R("seconds").alias("seconds"))


@query(DER.format(where=""), A.SEGMENTS, A.TIMELINES, GRID, ACTIVE)
def der_components(spark, sf):
    return _der(spark, sf)


@query(DER.format(where=""), A.SEGMENTS, A.TIMELINES, COLLAR_GRID, ACTIVE)
def der_collar(spark, sf):
    return _der(spark, sf, collar=0.25)


@query(DER.format(where=" where len(ref) <= 1"), A.SEGMENTS, A.TIMELINES, GRID, ACTIVE)
def der_skip_overlap(spark, sf):
    return _der(spark, sf, skip=True)


@query(
    """select uri, round(avg(case when h is null or a + b - o <= 0 then 1.0 else 1 - o / (a + b - o) end), 6) as jer from (
         select x.uri, x.r, y.h, x.a, coalesce(y.b, 0) as b, coalesce(seconds, 0) as o
         from (select uri, r, sum(d) as a from (select uri, d, unnest(ref) as r from el) group by uri, r) x join m on x.r = m.r
         left join (select uri, h, sum(d) as b from (select uri, d, unnest(hyp) as h from el) group by uri, h) y on x.uri = y.uri and m.h = y.h
         left join both_ z on z.uri = x.uri and z.ref = x.r and z.hyp = m.h) group by uri""",
    A.SEGMENTS, A.TIMELINES, GRID, ACTIVE, BOTH,
)
def jer(spark, sf):
    g = _grid(spark, sf)
    return metrics.jer(g, _mapping(g)).select("uri", R("jer").alias("jer"))


#: The best of all ways to map three roles to three speakers.
BEST = """ways as (select * from (values (0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)) t(u, a, s)),
  tried as (select uri, w.u, w.a, w.s, sum(case when (ref = 'user' and hyp = w.u) or (ref = 'assistant' and hyp = w.a) or (ref = 'system' and hyp = w.s) then seconds else 0 end) as total from both_, ways w group by uri, w.u, w.a, w.s),
  chosen as (select * from (select *, row_number() over (partition by uri order by total desc, u, a, s) as r from tried) where r = 1),
  best as (select b.uri, ref, hyp from both_ b join chosen c on b.uri = c.uri and seconds > 0 and ((ref = 'user' and hyp = c.u) or (ref = 'assistant' and hyp = c.a) or (ref = 'system' and hyp = c.s)))"""


@query("select uri, ref, hyp::bigint as hyp from best", A.SEGMENTS, A.TIMELINES, GRID, ACTIVE, BOTH, BEST)
def hungarian_map(spark, sf):
    return metrics.optimal_mapping(metrics.cooccurrence(_grid(spark, sf))).select("uri", "ref", F.col("hyp").cast("long").alias("hyp"))


@query(DER.format(where="").replace("from m where", "from best m where m.uri = el.uri and").replace("list_contains(ref, r)", "list_contains(el.ref, m.ref)").replace("list_contains(hyp, h)", "list_contains(el.hyp, m.hyp)"), A.SEGMENTS, A.TIMELINES, GRID, ACTIVE, BOTH, BEST)
def der_optimal(spark, sf):
    """The error under the mapping that shares the most time, end to end."""
    g = _grid(spark, sf)
    out = metrics.der(g, metrics.optimal_mapping(metrics.cooccurrence(g)))
    return out.select("uri", *[R(c).alias(c) for c in out.columns[1:]])


# tokens

KNOWN = "known as (select t.*, token_text from tokens t join vocab using (token) where not starts_with(token_text, '<|'))"
MARKED = f"marked as (select *, sum((token >= {A.MARK})::int) over (partition by doc_id order by pos)::bigint as seg from tokens)"


@query("select doc_id, string_agg(token_text, '' order by pos) as text from known group by doc_id", A.TOKENS, A.VOCABULARY, KNOWN)
def token_decode(spark, sf):
    return transcript.decode(A.streams(spark, sf), A.vocab(spark))


PARSED = rf"""said as (select doc_id, seg, regexp_replace(string_agg(token_text, '' order by pos), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') as text from marked join vocab using (token) where token < {A.MARK} and not starts_with(token_text, '<|') group by doc_id, seg),
  marks as (select doc_id, seg, round((token - {A.MARK}) * 0.02, 6) as "start", coalesce(lead(round((token - {A.MARK}) * 0.02, 6)) over (partition by doc_id order by seg), 0.0) as "end" from marked where token >= {A.MARK}),
  parsed as (select doc_id, seg, "start"::double as "start", "end"::double as "end", text from said join marks using (doc_id, seg) where text <> '')"""
CONF = f"""conf as (select doc_id, seg - 1 as k, coalesce(m, 0.0) as confidence from (select *, max(seg) over (partition by doc_id) as l from (select doc_id, seg, avg(case when token < {A.MARK} then prob end) as m from marked where seg > 0 group by doc_id, seg)) where seg < l)"""


@query('select doc_id, seg, "start", "end", text from parsed', A.TOKENS, A.VOCABULARY, MARKED, PARSED)
def parse_segments(spark, sf):
    return transcript.parse_segments(A.streams(spark, sf), A.vocab(spark))


@query("select doc_id, seg, p.k, round(coalesce(confidence, 0.0), 6) as confidence from (select *, row_number() over (partition by doc_id order by seg) - 1 as k from parsed) p left join conf using (doc_id, k)", A.TOKENS, A.VOCABULARY, MARKED, PARSED, CONF)
def segment_confidence(spark, sf):
    return transcript.scored_segments(A.streams(spark, sf), A.vocab(spark)).select("doc_id", "seg", "k", R("confidence").alias("confidence"))


@query(
    """select doc_id, word_idx, string_agg(token_text_, '' order by pos) as word, round(min(pos) * 0.02, 6) as "start", round(coalesce(lead(min(pos) * 0.02) over (partition by doc_id order by word_idx), max(last_end)), 6) as "end", round(avg(prob), 6) as confidence from (
         select *, trim(token_text) as token_text_, sum(case when starts_with(token_text, ' ') or rn = 1 then 1 else 0 end) over (partition by doc_id order by pos)::bigint - 1 as word_idx from (
           select *, row_number() over (partition by doc_id order by pos) as rn, (max(pos) over (partition by doc_id) + 1) * 0.02 as last_end from known)) group by doc_id, word_idx""",
    A.TOKENS, A.VOCABULARY, KNOWN,
)
def word_grouping(spark, sf):
    t = A.tokens(spark, sf).join(F.broadcast(A.vocab(spark)), "token").where(~F.col("token_text").startswith("<|"))
    t = t.withColumn("start", F.col("pos") * 0.02).withColumn("end", (F.col("pos") + 1) * 0.02)
    return transcript.group_words(t).select("doc_id", "word_idx", "word", R("start").alias("start"), R("end").alias("end"), R("confidence").alias("confidence"))


# decoding

LP = "lp as (select vec_id, token, logit, logit - (max(logit) over (partition by vec_id) + ln(sum(exp(logit - mx)) over (partition by vec_id))) as logprob from (select *, max(logit) over (partition by vec_id) as mx from logits))"


@query("select vec_id, token, round(logprob, 6) as logprob from lp", A.LOGITS, LP)
def log_softmax(spark, sf):
    return decoding.log_softmax(A.logits(spark, sf)).select("vec_id", "token", R("logprob").alias("logprob"))


@query("select vec_id, rank, token, round(logprob, 6) as logprob from (select *, row_number() over (partition by vec_id order by logprob desc, token) as rank from lp) where rank <= 5", A.LOGITS, LP)
def topk_logprob(spark, sf):
    return decoding.top_k(decoding.log_softmax(A.logits(spark, sf)), 5).select("vec_id", "rank", "token", R("logprob").alias("logprob"))


@query("select vec_id, arg_max(token, {'l': logit, 't': token}) as token, round(max(logit), 6) as logit from logits group by vec_id", A.LOGITS)
def argmax_last(spark, sf):
    return decoding.argmax_last(A.logits(spark, sf)).select("vec_id", "token", R("logit").alias("logit"))


@query(
    """select vec_id, token, rank, round(w / sum(w) over (partition by vec_id), 6) as prob from (
         select *, coalesce(sum(share) over (partition by vec_id order by rank rows between unbounded preceding and 1 preceding), 0) as before from (
           select *, w / sum(w) over (partition by vec_id) as share from (
             select vec_id, token, rank, exp(logit / 0.7 - max(logit / 0.7) over (partition by vec_id)) as w from (select *, row_number() over (partition by vec_id order by logit desc, token) as rank from logits) where rank <= 20))) where before < 0.9""",
    A.LOGITS,
)
def nucleus_filter(spark, sf):
    return decoding.nucleus(A.logits(spark, sf), 0.7, 20, 0.9).select("vec_id", "token", "rank", R("prob").alias("prob"))


@query()
def nucleus_draw(spark, sf):
    return decoding.draw(decoding.nucleus(A.logits(spark, sf), 0.7, 20, 0.9), seed=7)


@query(
    """select grp, beam, token, round(norm, 6) as norm, rank from (select *, row_number() over (partition by grp order by norm desc, beam, token) as rank from (
         select vec_id // 4 as grp, vec_id % 4 as beam, token, logprob / pow(greatest(vec_id % 4 + 1, 1)::double, 0.6) as norm from lp)) where rank <= 5""",
    A.LOGITS, LP,
)
def beam_prune(spark, sf):
    c = decoding.log_softmax(A.logits(spark, sf)).select(F.floor(F.col("vec_id") / 4).alias("grp"), (F.col("vec_id") % 4).alias("beam"), "token", F.col("logprob").alias("score"), (F.col("vec_id") % 4 + 1).alias("length"))
    return decoding.beam_prune(c, 5, "grp").select("grp", "beam", "token", R("norm").alias("norm"), "rank")


@query("select vec_id, round(p, 6) as no_speech, round(a, 6) as mean_logprob, p > 0.01 and a < -4.5 as silent from (select vec_id, max(case when token = 0 then exp(logprob) end) as p, avg(logprob) as a from lp group by vec_id)", A.LOGITS, LP)
def silence_gate(spark, sf):
    x = decoding.log_softmax(A.logits(spark, sf)).groupBy("vec_id").agg(F.max(F.when(F.col("token") == 0, F.exp("logprob"))).alias("p"), F.avg("logprob").alias("a"))
    return x.select("vec_id", R("p").alias("no_speech"), R("a").alias("mean_logprob"), decoding.silence_gate(F.col("p"), F.col("a"), 0.01, -4.5).alias("silent"))


@query(
    """select grp, attempt, round(s, 6) as score from (select *, row_number() over (partition by grp order by case when ok then 0 else 1 end, case when ok then attempt else -attempt end) as r from (
         select vec_id // 5 as grp, vec_id % 5 as attempt, max(logprob) as s, max(logprob) > -1.5 as ok from lp group by vec_id)) where r = 1""",
    A.LOGITS, LP,
)
def temperature_fallback(spark, sf):
    x = decoding.log_softmax(A.logits(spark, sf)).groupBy("vec_id").agg(F.max("logprob").alias("score"))
    x = x.select(F.floor(F.col("vec_id") / 5).alias("grp"), (F.col("vec_id") % 5).alias("attempt"), "score", (F.col("score") > -1.5).alias("ok"))
    return decoding.fallback(x, "grp").select("grp", "attempt", R("score").alias("score"))


RULES = """st as (select vec_id, case vec_id % 4 when 1 then 45 when 2 then 50 when 3 then 3 end as last, case vec_id % 4 when 2 then 50 when 3 then 45 end as before_last, case vec_id % 4 when 1 then 45 when 2 then 50 when 3 then 45 end as lm from embeddings),
  r1 as (select l.vec_id, token, case when token = 39 or (coalesce(last >= 40, false) and coalesce(before_last >= 40, false) and token >= 40) or (coalesce(last >= 40, false) and not coalesce(before_last >= 40, false) and token < 40) or (token >= 40 and coalesce(token < lm, false)) then null else logit end as logit from logits l join st using (vec_id)),
  f as (select vec_id, max(logit) filter (token < 40) as bt, max(logit) filter (token >= 40) as mm, max(logit) filter (token >= 40) + ln(sum(exp(logit - mx)) filter (token >= 40)) as mass from (select *, max(case when token >= 40 then logit end) over (partition by vec_id) as mx from r1) group by vec_id)"""


@query("select vec_id, token, round(logit, 6) as logit from r1 join f using (vec_id) where logit is not null and not (token < 40 and mm is not null and (bt is null or mass > bt))", A.LOGITS, RULES)
def timestamp_rules(spark, sf):
    which = F.col("vec_id") % 4
    state = A.read(spark, sf, "embeddings").select(
        "vec_id", F.when(which == 1, 45).when(which == 2, 50).when(which == 3, 3).alias("last"), F.when(which == 2, 50).when(which == 3, 45).alias("before_last"), F.when(which == 1, 45).when(which == 2, 50).when(which == 3, 45).alias("last_mark")
    )
    out = decoding.timestamp_rules(A.logits(spark, sf), state, begin=40, no_timestamps=39)
    return out.where(F.col("logit") > decoding.NEVER).select("vec_id", "token", R("logit").alias("logit"))


@query("select vec_id, token, round(logit, 6) as logit from logits where token not in (3, 5) and not (vec_id % 10 = 0 and token in (0, 63))", A.LOGITS)
def suppress_tokens(spark, sf):
    out = decoding.suppress_blank(decoding.suppress(A.logits(spark, sf), [3, 5]), F.col("vec_id") % 10, 63, 0)
    return out.where(F.col("logit") > decoding.NEVER).select("vec_id", "token", R("logit").alias("logit"))


# vectors

UNIT = "unit as (select vec_id, label, vec_id // 50 as block, list_transform(embedding, lambda x: x::double) as e, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) as n from embeddings)"
PAIRS = "pairs as (select a.block, a.vec_id as a, b.vec_id as b, list_dot_product(a.e, b.e) / (a.n * b.n) as cosine from unit a join unit b on a.block = b.block and a.vec_id < b.vec_id)"


def _vectors(spark, sf):
    return A.read(spark, sf, "embeddings").withColumn("block", F.floor(F.col("vec_id") / 50))


@query("select block, a, b, round(cosine, 6) as cosine from pairs", UNIT, PAIRS)
def pairwise_cosine(spark, sf):
    return vectors.pair_cosines(_vectors(spark, sf), "block").select("block", "a", "b", R("cosine").alias("cosine"))


@query("select vec_id, other, round(cosine, 6) as cosine from (select *, row_number() over (partition by vec_id order by cosine desc, other) as r from (select a as vec_id, b as other, cosine from pairs union all select b, a, cosine from pairs)) where r = 1", UNIT, PAIRS)
def nearest_neighbour(spark, sf):
    return vectors.nearest(_vectors(spark, sf), "block").select("vec_id", "other", R("cosine").alias("cosine"))


@query("select vec_id, round(sum(greatest(cosine, 0.0)), 6) as degree from (select a as vec_id, cosine from pairs union all select b, cosine from pairs) group by vec_id", UNIT, PAIRS)
def affinity_degree(spark, sf):
    return vectors.affinity_degree(_vectors(spark, sf), "block").select("vec_id", R("degree").alias("degree"))


@query("select label::bigint as label, i::bigint as i, round(avg(e[i + 1]), 6) as x from (select label, e, unnest(range(64)) as i from unit) group by label, i", UNIT)
def mean_pool(spark, sf):
    p = vectors.mean_pool(A.read(spark, sf, "embeddings"), "label")
    return p.select(F.col("label").cast("long").alias("label"), F.posexplode("pooled").alias("i", "x")).select("label", F.col("i").cast("long").alias("i"), R("x").alias("x"))


@query("select vec_id, i::bigint as i, round(e[i + 1] / n, 6) as x from (select *, unnest(range(64)) as i from unit)", UNIT)
def l2_normalize(spark, sf):
    v = A.read(spark, sf, "embeddings").select("vec_id", F.posexplode(vectors.l2_normalize(F.col("embedding"))).alias("i", "x"))
    return v.select("vec_id", F.col("i").cast("long").alias("i"), R("x").alias("x"))


CENTRES = [(0, [0.125] * 64), (1, [-0.125] * 64), (2, [0.125, -0.125] * 32)]
DIST = "list_sum(list_transform(range(1, 65), lambda i: (e[i] - ({0})) * (e[i] - ({0}))))"


@query(
    f"""select vec_id, (m).c as centre, round((m).d, 6) as distance from (select vec_id, list_sort([{{'d': {DIST.format("0.125")}, 'c': 0::bigint}}, {{'d': {DIST.format("-0.125")}, 'c': 1::bigint}}, {{'d': {DIST.format("case when i % 2 = 1 then 0.125 else -0.125 end")}, 'c': 2::bigint}}])[1] as m from unit)""",
    UNIT,
)
def kmeans_assign_step(spark, sf):
    return vectors.kmeans_step(A.read(spark, sf, "embeddings"), CENTRES).select("vec_id", F.col("centre").cast("long").alias("centre"), R("distance").alias("distance"))


@query("select vec_id, label::bigint as label, dense_rank() over (order by f) - 1 as compact from (select *, min(vec_id) over (partition by label) as f from embeddings)")
def compact_labels(spark, sf):
    v = A.read(spark, sf, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"))
    return vectors.compact_labels(v, "vec_id").select("vec_id", "label", "compact")


def _clusters(how):
    return lambda spark, sf: clustering.cluster_windows(_vectors(spark, sf), "block", "vec_id", **how)


for _name, _how in {"ahc_clusters": {"method": "ahc", "threshold": 0.5}, "spectral_clusters": {"method": "spectral"}, "kmeans": {"method": "kmeans", "k": 5}}.items():
    QUERIES[_name] = _clusters(_how)


# alignment

PEAK = """pk as (select grp, token, arg_max(frame, {'w': w, 'f': frame}) as p from attention group by grp, token),
  mono as (select grp, token, max(p) over (partition by grp order by token) as p from pk)"""


@query('select grp, token, round(p * 0.01, 6) as "start", round(greatest(coalesce(lead(p) over (partition by grp order by token), least(64, p + 1)), p) * 0.01, 6) as "end" from mono', A.ATTENTION, PEAK)
def monotonic_peak(spark, sf):
    w = W.partitionBy("grp").orderBy("token")
    p = A.attention(spark, sf).groupBy("grp", "token").agg(F.max_by("frame", F.struct("w", "frame")).alias("p")).withColumn("p", F.max("p").over(w))
    end = F.greatest(F.coalesce(F.lead("p").over(w), F.least(F.lit(64), F.col("p") + 1)), "p")
    return p.select("grp", "token", R(F.col("p") * 0.01).alias("start"), R(end * 0.01).alias("end"))


@query()
def dtw_align(spark, sf):
    return sequential.align_tokens(A.attention(spark, sf))


# signals


@query(
    """select clip_id, j as idx, round(a + (coalesce(b, a) - a) * least(j * 0.75::double - k, 1.0), 6) as x from (
         select o.clip_id, j, k, s.x as a, t.x as b from (select clip_id, j, least(floor(j * 0.75::double)::bigint, n - 1) as k from (select clip_id, n, unnest(range(ceil(n / 0.75::double)::bigint)) as j from (select clip_id, count(*) as n from samples group by clip_id))) o
         join samples s on s.clip_id = o.clip_id and s.idx = k left join samples t on t.clip_id = o.clip_id and t.idx = k + 1)""",
    A.SAMPLES,
)
def resample_linear(spark, sf):
    return signal.resample(A.samples(spark, sf), 12000, 16000).select("clip_id", "idx", R("x").alias("x"))


@query("select vec_id, i::bigint as i, round((e[2 * i + 1] + e[2 * i + 2]) / 2, 6) + 0.0::double as x from (select *, unnest(range(32)) as i from unit)", UNIT)
def downmix(spark, sf):
    v = A.read(spark, sf, "embeddings").select("vec_id", F.posexplode(signal.downmix(F.col("embedding"), 2)).alias("i", "x"))
    return v.select("vec_id", F.col("i").cast("long").alias("i"), (R("x") + 0.0).alias("x"))  # no negative zero


@query("select i, round(0.5 * (1 - cos(2 * pi() * i / 400)), 6) as w from range(400) t(i)")
def hann_window(spark, sf):
    return signal.hann(spark).select("i", R("w").alias("w"))


@query(
    """with p as (select i, 700 * (pow(10, 2595 * log10(1 + 8000 / 700.0::double) * i / 81 / 2595) - 1) as hz from range(82) t(i)),
       f as (select a.i as mel, a.hz as lo, b.hz as mid, c.hz as hi from p a join p b on b.i = a.i + 1 join p c on c.i = a.i + 2)
       select mel, bin, round(greatest(least((bin - 401 * lo / 16000) / (401 * mid / 16000 - 401 * lo / 16000), (401 * hi / 16000 - bin) / (401 * hi / 16000 - 401 * mid / 16000)), 0.0) * 2 / (hi - lo), 6) as weight from f, range(201) t(bin)"""
)
def mel_filterbank(spark, sf):
    return signal.mel_filterbank(spark).select("mel", "bin", R("weight").alias("weight"))


@query("select clip_id, least(ceil(count(*) / 160)::bigint + 1, 3000) as n_frames, count(*) * 1000 // 16000 as duration_ms from samples group by clip_id", A.SAMPLES)
def frame_counts(spark, sf):
    n = F.count(F.lit(1))
    return A.samples(spark, sf).groupBy("clip_id").agg(n.alias("n")).select("clip_id", signal.n_frames(F.col("n")).alias("n_frames"), F.expr("n * 1000 div 16000").alias("duration_ms"))


@query(
    """select clip_id, mel, frame, round(((greatest(l, max(l) over (partition by clip_id) - 8.0::double) + 4) / 4)::float::double, 4) as x from logs""",
    A.SAMPLES,
    """counted as (select clip_id, unnest(range(least(ceil(count(*) / 160)::bigint + 1, 3000))) as frame from samples group by clip_id),
       cut as (select s.clip_id, frame, idx - 160 * frame as i, (x::float * (0.5 * (1 - cos(2 * pi() * (idx - 160 * frame) / 400)))::float)::float::double as v from samples s join counted c on s.clip_id = c.clip_id and idx >= 160 * frame and idx < 160 * frame + 400),
       spectrum as (select clip_id, frame, bin, pow(sum(v * cos(2 * pi() * (bin * i % 512) / 512)), 2) + pow(sum(v * sin(2 * pi() * (bin * i % 512) / 512)), 2) as p from cut, range(201) t(bin) group by all),
       points as (select i, 700 * (pow(10, 2595 * log10(1 + 8000 / 700.0::double) * i / 81 / 2595) - 1) as hz from range(82) t(i)),
       filters as (select a.i as mel, bin, (greatest(least((bin - 401 * a.hz / 16000) / (401 * b.hz / 16000 - 401 * a.hz / 16000), (401 * c.hz / 16000 - bin) / (401 * c.hz / 16000 - 401 * b.hz / 16000)), 0.0) * 2 / (c.hz - a.hz))::float::double as weight
                   from points a join points b on b.i = a.i + 1 join points c on c.i = a.i + 2, range(201) t(bin)),
       energies as (select clip_id, frame, mel, sum(p * weight) as e from spectrum join filters using (bin) where weight > 0 group by all),
       logs as (select c.clip_id, c.frame, m.mel, log10(greatest(coalesce(e, 0), 1e-10)) as l from counted c cross join range(80) m(mel) left join energies n on n.clip_id = c.clip_id and n.frame = c.frame and n.mel = m.mel)""",
)
def log_mel(spark, sf):
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        m = kernels.log_mel(pdf.sort_values("idx").x.to_numpy(np.float32))
        mel, frame = np.indices(m.shape)
        return pd.DataFrame({"clip_id": pdf.clip_id.iloc[0], "mel": mel.ravel(), "frame": frame.ravel(), "x": m.ravel().astype(float)})

    return A.samples(spark, sf).groupBy("clip_id").applyInPandas(one, "clip_id long, mel long, frame long, x double").withColumn("x", R("x", 4))


# codecs and model tables


def _values(spark, sf):
    return A.read(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("idx", "v")).select("vec_id", F.col("idx").cast("long").alias("idx"), F.col("v").cast("double").alias("x"))


@query("select vec_id, i // 32 as block, round(max(abs(e[i + 1])), 6) as absmax, round(max(abs(e[i + 1])) / 127, 8) as scale from (select *, unnest(range(64)) as i from unit) group by vec_id, i // 32", UNIT)
def q8_absmax_block(spark, sf):
    return signal.block_scales(_values(spark, sf), "q8_0").select("vec_id", "block", R("absmax").alias("absmax"), R("scale", 8).alias("scale"))


@query("select vec_id, i as idx, (sign(x / s) * floor(abs(x / s) + 0.5))::bigint as q from (select vec_id, i, e[i + 1] as x, max(abs(e[i + 1])) over (partition by vec_id, i // 32) / 127 as s from (select *, unnest(range(64)) as i from unit))", UNIT)
def q8_quantized_ints(spark, sf):
    return signal.q8_integers(_values(spark, sf))


def _round_trip(kind: str) -> Query:
    def run(spark, sf):
        def trip(frames):
            for pdf in frames:
                back = [kernels.dequantize(kernels.quantize(e, kind), kind) for e in pdf.embedding]
                yield pd.DataFrame({"vec_id": pdf.vec_id, "n_bytes": [len(kernels.quantize(e, kind)) for e in pdf.embedding], "worst": [float(np.abs(b - np.asarray(e)).max()) for b, e in zip(back, pdf.embedding)]})

        return A.read(spark, sf, "embeddings").select("vec_id", "embedding").mapInPandas(trip, "vec_id long, n_bytes long, worst double").withColumn("worst", R("worst"))

    return run


def _round_trip_sql(divisor: int, offset: int, least: int, most: int, width: int) -> str:
    """Single precision throughout; the scale of a block is rounded to half precision, which has eleven bits."""
    return f"""
        with x as (select vec_id, i // 32 as block, embedding[i + 1]::float as x from (select vec_id, embedding, unnest(range(64)) as i from embeddings)),
        s as (select *, (max(abs(x)) over (partition by vec_id, block) / {divisor}::float)::float as s from x),
        q as (select *, greatest(least(trunc(((x * (1::float / s)::float)::float + case when x < 0 then -0.5 else 0.5 end::float)::float)::bigint + {offset}, {most}), {least}) - {offset} as q,
                     round_even(s::double / pow(2, floor(log2(s::double)) - 10), 0) * pow(2, floor(log2(s::double)) - 10) as half from s)
        select vec_id, {2 * width}::bigint as n_bytes, round(max(abs((q * half)::float - x))::double, 6) as worst from q group by vec_id"""


for _kind in ("q4", "q5", "q8"):
    QUERIES[f"{_kind}_roundtrip"] = _round_trip(f"{_kind}_0")
ORACLE |= {"q4_roundtrip": _round_trip_sql(8, 8, 0, 15, 18), "q5_roundtrip": _round_trip_sql(15, 16, 0, 31, 22), "q8_roundtrip": _round_trip_sql(127, 0, -128, 127, 34)}


@query("select count(*) as n_tensors, count(*) * 64 as n_params, sum(case when label < 5 then 256 else 68 end)::bigint as n_bytes, sum(case when label < 5 then 0 else 64 end)::bigint as quantized_params, sum(case when label < 5 then 0 else 68 end)::bigint as quantized_bytes from embeddings")
def model_stats(spark, sf):
    single = F.col("label") < 5
    t = A.read(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("name"), F.array(F.lit(64).cast("long")).alias("shape"), F.when(single, "f32").otherwise("q8_0").alias("dtype"), F.when(single, 256).otherwise(68).cast("long").alias("n_bytes"))
    return signal.tensor_statistics(t)


@query("select clip_id, count(*) as n, round(max(abs(round_even(x * 32767, 0) / 32768 - x)), 6) as worst from samples group by clip_id", A.SAMPLES)
def audio_round_trip(spark, sf):
    """Signals written as 16-bit WAV in memory and decoded again."""

    def one(frames):
        import struct

        for pdf in frames:
            rows = []
            for clip, xs in zip(pdf["clip_id"], pdf["xs"]):
                data = np.round(np.asarray(xs) * 32767).astype("<i2").tobytes()
                wav = b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 16000, 32000, 2, 16) + b"data" + struct.pack("<I", len(data)) + data
                back = audio.decode_wav(wav)
                rows.append((clip, len(back), float(np.abs(back - np.asarray(xs)).max())))
            yield pd.DataFrame(rows, columns=["clip_id", "n", "worst"])

    s = A.samples(spark, sf).groupBy("clip_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "x"))), lambda v: v["x"]).alias("xs"))
    return s.mapInPandas(one, "clip_id long, n long, worst double").withColumn("worst", R("worst"))


# streams


@query(
    """select c.clip_id as stream_id, k as chunk_idx, 29 * k as start_sample, least(30, n - 29 * k) as n_samples, round(sum(x::float::double * x::float::double), 6) as energy, k = full_chunks as "last"
       from (select *, unnest(range(full_chunks + 1)) as k from (select clip_id, count(*) as n, case when count(*) >= 30 then (count(*) - 30) // 29 + 1 else 0 end as full_chunks from samples group by clip_id)) c
       join samples s on s.clip_id = c.clip_id and idx >= 29 * k and idx < 29 * k + 30 group by c.clip_id, k, n, full_chunks""",
    A.SAMPLES,
)
def stream_chunks(spark, sf):
    s = A.samples(spark, sf)
    last = F.max("idx").over(W.partitionBy("clip_id"))
    pushes = s.select(F.col("clip_id").alias("stream_id"), F.col("idx").alias("seq"), F.array(F.col("x").cast("float")).alias("samples"), (F.col("idx") == last).alias("eos"))
    return chunks.batch_chunks(pushes, chunk=30, hop=29).withColumn("energy", R("energy"))
