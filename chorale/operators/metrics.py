"""Scores of speaker timelines: elementary intervals, co-occurrence, DER and JER, optimal assignment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def intervals(ref: DataFrame, hyp: DataFrame, collar: float = 0.0, bucket: float = 60.0) -> DataFrame:
    """uri, k, lo, hi, ref (sorted distinct speakers), hyp of each elementary interval between boundaries.

    With a collar, intervals whose middle is nearer than it to a reference boundary are left out. Boundaries are put in order
    by a window and the speakers of an interval by an equi join on uri and a bucket of time, with a range condition.
    """
    cuts = ref.select("uri", F.explode(F.array("start", "end")).alias("t"))
    every = cuts.unionByName(hyp.select("uri", F.explode(F.array("start", "end")).alias("t")))
    if collar:
        every = every.unionByName(cuts.select("uri", F.explode(F.array(F.col("t") - collar, F.col("t") + collar)).alias("t")))
    w = W.partitionBy("uri").orderBy("lo")
    grid = every.select("uri", F.col("t").alias("lo")).distinct().withColumn("hi", F.lead("lo").over(w)).where("hi is not null").withColumn("k", F.row_number().over(w).cast("long") - 1)
    grid = grid.withColumn("mid", (F.col("lo") + F.col("hi")) / 2)
    if collar:
        near = cuts.select(F.col("uri").alias("c_uri"), "t").distinct()
        grid = grid.join(near, (F.col("uri") == F.col("c_uri")) & (F.col("mid") > F.col("t") - collar) & (F.col("mid") < F.col("t") + collar), "left_anti")

    def active(side: DataFrame, name: str) -> DataFrame:
        s = side.select(F.col("uri").alias("s_uri"), "speaker", F.col("start").alias("s"), F.col("end").alias("e")).where("e > s")
        s = s.select("*", F.explode(F.sequence(F.floor(F.col("s") / bucket), F.floor(F.col("e") / bucket))).alias("b"))
        hit = grid.join(s, (F.col("uri") == F.col("s_uri")) & (F.floor(F.col("mid") / bucket) == F.col("b")) & (F.col("mid") >= F.col("s")) & (F.col("mid") < F.col("e")))
        return hit.groupBy("uri", "k").agg(F.sort_array(F.collect_set("speaker")).alias(name))

    out = grid.join(active(ref, "ref"), ["uri", "k"], "left").join(active(hyp, "hyp"), ["uri", "k"], "left")
    ref_type, hyp_type = ref.schema["speaker"].dataType.simpleString(), hyp.schema["speaker"].dataType.simpleString()
    return out.select("uri", "k", "lo", "hi", F.coalesce("ref", F.array().cast(f"array<{ref_type}>")).alias("ref"), F.coalesce("hyp", F.array().cast(f"array<{hyp_type}>")).alias("hyp"))


def cooccurrence(grid: DataFrame) -> DataFrame:
    """uri, ref, hyp, seconds: how long both speak."""
    pairs = grid.select("uri", (F.col("hi") - F.col("lo")).alias("d"), F.explode("ref").alias("ref"), "hyp").select("uri", "d", "ref", F.explode("hyp").alias("hyp"))
    return pairs.groupBy("uri", "ref", "hyp").agg(F.sum("d").alias("seconds"))


def der(grid: DataFrame, mapping: DataFrame, skip_overlap: bool = False) -> DataFrame:
    """uri, miss, false_alarm, confusion, total, der; mapping(uri, ref, hyp) is one to one. A zero total gives all zeros."""
    if skip_overlap:
        grid = grid.where(F.size("ref") <= 1)
    d = F.col("hi") - F.col("lo")
    pairs = mapping.groupBy("uri").agg(F.collect_set(F.struct("ref", "hyp")).alias("m"))
    g = grid.join(pairs, "uri", "left")
    right = F.size(F.filter("m", lambda p: F.array_contains("ref", p["ref"]) & F.array_contains("hyp", p["hyp"])))
    n_ref, n_hyp, correct = F.size("ref"), F.size("hyp"), F.when(F.col("m").isNull(), 0).otherwise(right)
    sums = g.groupBy("uri").agg(
        F.sum(d * F.greatest(n_ref - n_hyp, F.lit(0))).alias("miss"),
        F.sum(d * F.greatest(n_hyp - n_ref, F.lit(0))).alias("false_alarm"),
        F.sum(d * (F.least(n_ref, n_hyp) - correct)).alias("confusion"),
        F.sum(d * n_ref).alias("total"),
    )
    none = F.col("total") <= 0
    shown = [F.when(none, 0.0).otherwise(F.col(c)).alias(c) for c in ("miss", "false_alarm", "confusion", "total")]
    return sums.select("uri", *shown, F.when(none, 0.0).otherwise((F.col("miss") + F.col("false_alarm") + F.col("confusion")) / F.col("total")).alias("der"))


def jer(grid: DataFrame, mapping: DataFrame) -> DataFrame:
    """uri, jer: the mean over reference speakers of 1 - overlap / union with the mapped speaker; 1 where none is mapped."""
    d = F.col("hi") - F.col("lo")
    ref = grid.select("uri", d.alias("d"), F.explode("ref").alias("ref")).groupBy("uri", "ref").agg(F.sum("d").alias("r"))
    hyp = grid.select("uri", d.alias("d"), F.explode("hyp").alias("hyp")).groupBy("uri", "hyp").agg(F.sum("d").alias("h"))
    both = cooccurrence(grid)
    m = ref.join(mapping, ["uri", "ref"], "left").join(hyp, ["uri", "hyp"], "left").join(both, ["uri", "ref", "hyp"], "left")
    overlap = F.coalesce("seconds", F.lit(0.0))
    union = F.col("r") + F.coalesce("h", F.lit(0.0)) - overlap
    return m.groupBy("uri").agg(F.avg(F.when(F.col("hyp").isNull() | (union <= 0), 1.0).otherwise(1 - overlap / union)).alias("jer"))


def assign(cost: np.ndarray) -> list[int]:
    """The cheapest one-to-one assignment of rows to columns (shortest augmenting paths); -1 for a row without a column."""
    n, m = cost.shape
    size = max(n, m)
    c = np.zeros((size, size))
    c[:n, :m] = cost
    u, v, match = np.zeros(size), np.zeros(size), np.full(size, -1)
    for row in range(size):
        dist, before, done = c[row] - u[row] - v, np.full(size, -1), np.zeros(size, bool)
        free = -1
        while free < 0:
            j = int(np.where(done, np.inf, dist).argmin())
            done[j] = True
            if match[j] < 0:
                free = j
                continue
            i = match[j]
            through = dist[j] + c[i] - u[i] - v
            better = ~done & (through < dist)
            dist[better], before[better] = through[better], j
        best = dist[free]
        for j in np.flatnonzero(done):
            if j != free:
                u[match[j]] += best - dist[j]
                v[j] -= best - dist[j]
        u[row] += best
        j = free
        while before[j] >= 0:
            match[j] = match[before[j]]
            j = before[j]
        match[j] = row
    out = [-1] * n
    for j, i in enumerate(match):
        if i < n and j < m:
            out[i] = j
    return out


def optimal_mapping(both: DataFrame) -> DataFrame:
    """uri, ref, hyp that share the most time in all, one to one; a task has the few speakers of a uri."""
    ref_type, hyp_type = both.schema["ref"].dataType.simpleString(), both.schema["hyp"].dataType.simpleString()

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        table = pdf.pivot_table(index="ref", columns="hyp", values="seconds", fill_value=0.0).sort_index(axis=0).sort_index(axis=1)
        chosen = assign(-table.to_numpy())
        rows = [(pdf.uri.iloc[0], table.index[i], table.columns[j]) for i, j in enumerate(chosen) if j >= 0 and table.iat[i, j] > 0]
        return pd.DataFrame(rows, columns=["uri", "ref", "hyp"])

    return both.groupBy("uri").applyInPandas(best, f"uri {both.schema['uri'].dataType.simpleString()}, ref {ref_type}, hyp {hyp_type}")


def parse_rttm(lines: DataFrame, column: str = "value") -> DataFrame:
    """uri, speaker, start, end of RTTM lines; blank lines, comments and other records are skipped, bad numbers are errors."""
    text = F.trim(F.regexp_replace(column, r"[\s]+", " "))
    kept = lines.select(text.alias("l")).where("l <> '' and not l like ';%' and not l like '#%'").withColumn("f", F.split("l", " ")).where("f[0] = 'SPEAKER'")
    short = F.raise_error(F.concat(F.lit("RTTM line has too few fields: "), F.col("l")))
    number = lambda k: F.when(F.size("f") < 8, short.cast("double")).when(F.try_element_at("f", F.lit(k)).try_cast("double").isNull(), F.raise_error(F.concat(F.lit("RTTM number is bad: "), F.col("l"))).cast("double")).otherwise(F.try_element_at("f", F.lit(k)).try_cast("double"))
    parsed = kept.select(F.try_element_at("f", F.lit(2)).alias("uri"), F.try_element_at("f", F.lit(8)).alias("speaker"), number(4).alias("start"), number(5).alias("length"))
    return parsed.select("uri", "speaker", "start", (F.col("start") + F.col("length")).alias("end"))

