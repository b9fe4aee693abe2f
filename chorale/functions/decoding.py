"""Decoding steps over logits as rows (key, token, logit): filters, normalisation, ranking, sampling sets, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

NEVER = float("-inf")


def log_softmax(logits: DataFrame, key: str = "vec_id") -> DataFrame:
    """Adds logprob: logit - (max + ln(sum(exp(logit - max)))). One aggregate and a join back beat two windows."""
    most = logits.groupBy(key).agg(F.max("logit").alias("most"), F.collect_list("logit").alias("all"))
    norm = most.select(key, (F.col("most") + F.log(F.aggregate(F.transform("all", lambda x: F.exp(x - F.col("most"))), F.lit(0.0), lambda a, x: a + x))).alias("norm"))
    return logits.join(norm, key).withColumn("logprob", F.col("logit") - F.col("norm")).drop("norm")


def argmax_last(logits: DataFrame, key: str = "vec_id") -> DataFrame:
    """key, token, logit of the greatest logit; the last token wins a tie."""
    top = F.max(F.struct("logit", "token"))
    return logits.groupBy(key).agg(top.alias("t")).select(key, "t.token", "t.logit")


def top_k(logprobs: DataFrame, k: int, key: str = "vec_id") -> DataFrame:
    """The k greatest logprobs of each key with their rank from 1; the lower token wins a tie."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc("logprob"), "token"))
    return logprobs.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def nucleus(logits: DataFrame, temperature: float, k: int, p: float, key: str = "vec_id") -> DataFrame:
    """The tokens that sampling draws from, and prob among them: k best, then the fewest whose share of those reaches p."""
    scaled = logits.withColumn("logprob", F.col("logit") / max(temperature, 1e-6))
    kept = top_k(scaled, k, key) if k > 0 else scaled.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc("logprob"), "token")).cast("long"))
    every, so_far = W.partitionBy(key), W.partitionBy(key).orderBy("rank")
    kept = kept.withColumn("weight", F.exp(F.col("logprob") - F.max("logprob").over(every))).withColumn("share", F.col("weight") / F.sum("weight").over(every))
    before = F.coalesce(F.sum("share").over(so_far.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    kept = kept.withColumn("before", before).where(F.col("before") < p) if p < 1 else kept
    return kept.withColumn("prob", F.col("weight") / F.sum("weight").over(every)).select(key, "token", "rank", "prob")


def draw(chosen: DataFrame, seed: int, key: str = "vec_id") -> DataFrame:
    """key, token: one token for each key by its prob; the same seed and key always draw the same."""
    so_far = W.partitionBy(key).orderBy("rank")
    r = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    upto = chosen.withColumn("upto", F.sum("prob").over(so_far.rowsBetween(W.unboundedPreceding, 0)))
    return upto.groupBy(key).agg(F.coalesce(F.min_by("token", F.when(r < F.col("upto"), F.col("rank"))), F.max_by("token", "rank")).alias("token"))


def suppress(logits: DataFrame, tokens: list[int]) -> DataFrame:
    return logits.withColumn("logit", F.when(F.col("token").isin(tokens), F.lit(NEVER)).otherwise(F.col("logit"))) if tokens else logits


def suppress_blank(logits: DataFrame, step: Column, end: int, blank: int | None) -> DataFrame:
    """Before the first token neither the end nor the blank can come."""
    return logits.withColumn("logit", F.when((step == 0) & F.col("token").isin([t for t in (end, blank) if t is not None]), F.lit(NEVER)).otherwise(F.col("logit")))


def timestamp_rules(logits: DataFrame, state: DataFrame, begin: int, no_timestamps: int, key: str = "vec_id") -> DataFrame:
    """logits under the rules of paired time marks; state(key, last, before_last, last_mark) is what was emitted so far.

    The no-timestamps token never comes; after a pair comes text, after a single mark another mark; marks don't go back; and if
    all marks together are likelier than any one text token, a mark has to come.
    """
    x = logits.join(state, key, "left")
    mark = F.col("token") >= begin
    was, pair = F.coalesce(F.col("last") >= begin, F.lit(False)), F.coalesce(F.col("before_last") >= begin, F.lit(False))
    out = (F.col("token") == no_timestamps) | (was & pair & mark) | (was & ~pair & ~mark) | (mark & F.coalesce(F.col("token") < F.col("last_mark"), F.lit(False)))
    x = x.withColumn("logit", F.when(out, F.lit(NEVER)).otherwise(F.col("logit")))
    best = x.groupBy(key).agg(F.max(F.when(~mark, F.col("logit"))).alias("text"), F.max(F.when(mark, F.col("logit"))).alias("m"), F.collect_list(F.when(mark, F.col("logit"))).alias("marks"))
    mass = F.col("m") + F.log(F.aggregate(F.transform("marks", lambda v: F.exp(v - F.col("m"))), F.lit(0.0), lambda a, v: a + v))
    forced = best.select(key, F.coalesce((F.col("m") > NEVER) & (mass > F.coalesce("text", F.lit(NEVER))), F.lit(False)).alias("forced"))
    return x.join(forced, key).withColumn("logit", F.when(F.col("forced") & ~mark, F.lit(NEVER)).otherwise(F.col("logit"))).select(*logits.columns)


def is_stop(token: Column, end: int, begin: int) -> Column:
    return (token == end) | ((token >= end) & (token < begin))


def normalized_score(score: Column, length: Column) -> Column:
    return score / F.pow(F.greatest(length, F.lit(1)).cast("double"), F.lit(0.6))


def beam_prune(candidates: DataFrame, width: int, key: str = "vec_id") -> DataFrame:
    """candidates(key, beam, token, score, length): the best `width` by score for their length, ties by beam and token."""
    c = candidates.withColumn("norm", normalized_score(F.col("score"), F.col("length")))
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc("norm"), "beam", "token"))
    return c.withColumn("rank", rank.cast("long")).where(F.col("rank") <= width)


def silence_gate(no_speech: Column, mean_logprob: Column, no_speech_threshold: float, logprob_threshold: float) -> Column:
    """Whether an output counts as silence: surely no speech and unsure text."""
    return (no_speech > no_speech_threshold) & (mean_logprob < logprob_threshold)


def fallback(attempts: DataFrame, key: str = "vec_id") -> DataFrame:
    """attempts(key, attempt, ok, ...): the first that is acceptable, otherwise the last."""
    choice = F.coalesce(F.min(F.when(F.col("ok"), F.col("attempt"))), F.max("attempt"))
    return attempts.groupBy(key).agg(choice.alias("attempt")).join(attempts, [key, "attempt"])
