"""Logical inputs of the library, derived from the driver's tables, and the same as SQL for the oracle.

There is no audio in those tables: frames, timelines, logits and attention are made from events, conversations and embeddings.
Each input has a total order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

FRAME_S = 6 * 3600
RATE = 15.0
SHIFT = 0.4
ROLES = {"user": 0, "assistant": 1, "system": 2}
MARK, MARK_EVERY, VOCAB = 50364, 7, 5000


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """documents, dealt anew if they come in fewer partitions than there are cores, as a file of one large row group does."""
    df, cores = read(spark, sf, "documents"), spark.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """clip_id (user), frame (six hours), rms of the frame's events; a frame without events is silence."""
    frame = F.expr(f"cast(timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts) div {FRAME_S} as bigint)")
    heard = read(spark, sf, "events").groupBy(F.col("user_id").alias("clip_id"), frame.alias("frame")).agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"))
    every = heard.groupBy("clip_id").agg(F.max("frame").alias("last")).select("clip_id", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("frame"))
    return every.join(heard, ["clip_id", "frame"], "left").select("clip_id", "frame", F.coalesce("rms", F.lit(0.0)).alias("rms"))


FRAMES = f"""heard as (
    select user_id as clip_id, date_diff('second', timestamp '2024-01-01', ts) // {FRAME_S} as frame, sqrt(avg(value * value)) as rms from events group by 1, 2),
  frames as (
    select e.clip_id, e.frame, coalesce(h.rms, 0.0) as rms
    from (select clip_id, unnest(range(0, max(frame) + 1)) as frame from heard group by clip_id) e left join heard h on e.clip_id = h.clip_id and e.frame = h.frame)"""


def segments(spark: SparkSession, sf: str) -> DataFrame:
    """clip_id (conversation), seg_idx (turn), start, end (seconds at a fixed reading rate), text, role."""
    until = F.sum(F.length("text")).over(W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0))
    return read(spark, sf, "conversations").select(
        F.col("conv_id").alias("clip_id"), F.col("turn").alias("seg_idx"), ((until - F.length("text")) / RATE).alias("start"), (until / RATE).alias("end"), "text", "role"
    )


SEGMENTS = f"""segments as (
    select conv_id as clip_id, turn as seg_idx, (u - length(text)) / {RATE} as "start", u / {RATE} as "end", text, role
    from (select *, (sum(length(text)) over (partition by conv_id order by turn))::double as u from conversations))"""


def words(spark: SparkSession, sf: str) -> DataFrame:
    """clip_id, seg_idx, word_idx (in the clip's segment), word, start, end: equal shares of the segment."""
    s = segments(spark, sf).withColumn("w", F.array_remove(F.split("text", r"\s+"), ""))
    s = s.select("clip_id", "seg_idx", "start", "end", F.size("w").alias("n"), F.posexplode("w").alias("word_idx", "word"))
    at = lambda k: F.col("start") + (F.col("end") - F.col("start")) * (F.col("word_idx") + k) / F.col("n")
    return s.select("clip_id", "seg_idx", F.col("word_idx").cast("long").alias("word_idx"), "word", at(0).alias("start"), at(1).alias("end"))


WORDS = r"""words as (
    select clip_id, seg_idx, i::bigint as word_idx, w[i + 1] as word, "start" + ("end" - "start") * i / len(w) as "start", "start" + ("end" - "start") * (i + 1) / len(w) as "end"
    from (select *, unnest(range(len(w))) as i from (select *, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') as w from segments)))"""


def ref_timeline(spark: SparkSession, sf: str) -> DataFrame:
    return segments(spark, sf).select(F.col("clip_id").alias("uri"), F.col("role").alias("speaker"), "start", "end")


def hyp_timeline(spark: SparkSession, sf: str) -> DataFrame:
    """The reference shifted in time, with every fifth label changed."""
    role = F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).otherwise(2)
    return segments(spark, sf).select(
        F.col("clip_id").alias("uri"), F.when(F.col("seg_idx") % 5 == 4, (role + 1) % 3).otherwise(role).alias("speaker"), (F.col("start") + SHIFT).alias("start"), (F.col("end") + SHIFT).alias("end")
    )


TIMELINES = f"""ref as (select clip_id as uri, role as speaker, "start", "end" from segments),
  hyp as (
    select clip_id as uri, case when seg_idx % 5 = 4 then (r + 1) % 3 else r end as speaker, "start" + {SHIFT}::double as "start", "end" + {SHIFT}::double as "end"
    from (select *, case role when 'user' then 0 when 'assistant' then 1 else 2 end as r from segments))"""


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, pos, token, prob: each document's words as numbers, every seventh a time mark."""
    w = read(spark, sf, "documents").select("doc_id", F.posexplode(F.array_remove(F.split("text", r"\s+"), "")).alias("pos", "word"))
    mark = F.lit(MARK) + F.floor(F.col("pos") / MARK_EVERY) % 1500
    token = F.when(F.col("pos") % MARK_EVERY == 0, mark).otherwise((F.length("word") * 97 + F.ascii("word")) % (VOCAB + 10))
    return w.select("doc_id", F.col("pos").cast("long").alias("pos"), token.cast("long").alias("token"), (-(F.length("word") % 9) / 10.0).alias("prob"))


def streams(spark: SparkSession, sf: str) -> DataFrame:
    """The same with a document's tokens as arrays: doc_id, token, prob."""
    mark = lambda i: F.lit(MARK) + F.floor(i / MARK_EVERY) % 1500
    token = lambda w, i: F.when(i % MARK_EVERY == 0, mark(i)).otherwise((F.length(w) * 97 + F.ascii(w)) % (VOCAB + 10)).cast("long")
    w = documents(spark, sf).select("doc_id", F.array_remove(F.split("text", r"\s+"), "").alias("w"))
    return w.select("doc_id", F.transform("w", token).alias("token"), F.transform("w", lambda x: -(F.length(x) % 9) / 10.0).alias("prob"))


TOKENS = rf"""tokens as (
    select doc_id, pos::bigint as pos, (case when pos % {MARK_EVERY} = 0 then {MARK} + (pos // {MARK_EVERY}) % 1500 else (length(word) * 97 + ascii(word)) % {VOCAB + 10} end)::bigint as token, -(length(word) % 9) / 10.0::double as prob
    from (select doc_id, i as pos, w[i + 1] as word from (select doc_id, w, unnest(range(len(w))) as i from (select doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') as w from documents))))"""


def vocab(spark: SparkSession) -> DataFrame:
    """token, text: half of them begin a word, the last ten are special."""
    i = F.col("id")
    text = F.when(i >= VOCAB - 10, F.concat(F.lit("<|"), i, F.lit("|>"))).when(i % 2 == 0, F.concat(F.lit(" w"), i)).otherwise(F.concat(F.lit("x"), i))
    return spark.range(VOCAB).select(i.alias("token"), text.alias("token_text"))


VOCABULARY = f"""vocab as (
    select i as token, case when i >= {VOCAB - 10} then '<|' || i || '|>' when i % 2 = 0 then ' w' || i else 'x' || i end as token_text from range({VOCAB}) t(i))"""


def logits(spark: SparkSession, sf: str) -> DataFrame:
    """vec_id, token, logit: each embedding as a step's logits."""
    return read(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("token", "x")).select("vec_id", F.col("token").cast("long").alias("token"), (F.col("x").cast("double") * 10).alias("logit"))


LOGITS = "logits as (select vec_id, i::bigint as token, embedding[i + 1]::double * 10 as logit from (select vec_id, embedding, unnest(range(len(embedding))) as i from embeddings))"


def attention(spark: SparkSession, sf: str) -> DataFrame:
    """grp, token, frame, w: sixteen embeddings as the rows of an attention matrix."""
    v = read(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 16).alias("grp"), (F.col("vec_id") % 16).alias("token"), F.posexplode("embedding").alias("frame", "w"))
    return v.select("grp", "token", F.col("frame").cast("long").alias("frame"), F.col("w").cast("double").alias("w"))


ATTENTION = "attention as (select vec_id // 16 as grp, vec_id % 16 as token, i::bigint as frame, embedding[i + 1]::double as w from (select vec_id, embedding, unnest(range(len(embedding))) as i from embeddings))"


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """clip_id (user), idx, x in [0, 1): a signal of one sample for each event."""
    idx = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return read(spark, sf, "events").select(F.col("user_id").alias("clip_id"), idx.cast("long").alias("idx"), (F.col("value") / 500).alias("x"))


SAMPLES = "samples as (select user_id as clip_id, row_number() over (partition by user_id order by ts, event_id) - 1 as idx, value / 500 as x from events)"


def windows_labels(spark: SparkSession, sf: str) -> DataFrame:
    """clip_id, start, end, label: overlapping windows of 100 samples, one for each turn, labelled by role."""
    s = segments(spark, sf)
    role = F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).otherwise(2)
    return s.select("clip_id", (F.col("seg_idx") * 60).alias("start"), (F.col("seg_idx") * 60 + 100).alias("end"), F.when(F.col("seg_idx") % 3 == 2, (role + 1) % 3).otherwise(role).cast("long").alias("label"))


WINDOWS_LABELS = """wl as (
    select clip_id, seg_idx * 60 as "start", seg_idx * 60 + 100 as "end", (case when seg_idx % 3 = 2 then (r + 1) % 3 else r end)::bigint as label
    from (select *, case role when 'user' then 0 when 'assistant' then 1 else 2 end as r from segments))"""
