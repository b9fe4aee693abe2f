"""Operators whose next step depends on the last one: chunk planning, resegmentation, alignment. One clip at a time in Python.

A clip's gaps, windows or attention are its group; groups are bounded by a clip's length, and rows of numbers, not samples.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from chorale.functions.kernels import softmax

CHUNK, STEP, REACH = 480_000, 464_000, 32_000


def nearest_point(target: int, gaps: list[tuple[int, int]], reach: int) -> int | None:
    """The point of a silence gap nearest to target and within reach of it; its centre if that is in reach. The first wins a tie."""
    lo, hi = max(target - reach, 0), target + reach
    points = [min(max(min(max((s + e) // 2, lo), hi), s), e) for s, e in gaps if e > lo and s < hi]
    return min(points, key=lambda p: abs(p - target), default=None)


def plan_chunks(length: int, gaps: list[tuple[int, int]], chunk: int = CHUNK, step: int = STEP, reach: int = REACH) -> list[tuple[int, int]]:
    """Ranges that cover a clip: each at most a chunk long, ending at a silence near the step if there is one. They don't overlap."""
    if length <= 0 or chunk <= 0 or step <= 0:
        return []
    out, at = [], 0
    while length - at > chunk:
        near = nearest_point(at + step, gaps, reach)
        to = min(max(at + step if near is None else near, at + 1), at + chunk)
        out.append((at, to))
        at = to
    return [*out, (at, length)]


def chunk_plan(gaps: DataFrame, clips: DataFrame, chunk: int = CHUNK, step: int = STEP, reach: int = REACH) -> DataFrame:
    """clip_id, chunk_idx, start, end from gaps(clip_id, start, end) and clips(clip_id, length)."""
    from pyspark.sql import functions as F

    listed = gaps.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("gaps"))
    kind = clips.schema["clip_id"].dataType.simpleString()

    def planned(frames):
        for pdf in frames:
            rows = []
            for clip, length, found in zip(pdf.clip_id, pdf.length, pdf.gaps):
                pairs = [(g["start"], g["end"]) for g in found] if found is not None else []
                rows += [(clip, k, s, e) for k, (s, e) in enumerate(plan_chunks(int(length), pairs, chunk, step, reach))]
            yield pd.DataFrame(rows, columns=["clip_id", "chunk_idx", "start", "end"])

    return clips.select("clip_id", "length").join(listed, "clip_id", "left").mapInPandas(planned, f"clip_id {kind}, chunk_idx long, start long, end long")


def label_runs(windows: list[tuple[int, int, int]]) -> list[list[int]]:
    """[label, start, end] of runs of equal labels over windows (start, end, label); a change is cut in the middle of the overlap."""
    out: list[list[int]] = []
    for start, end, label in windows:
        if not out:
            out.append([label, start, max(start, end)])
        elif out[-1][0] == label:
            out[-1][2] = max(out[-1][2], end)
        else:
            last = out[-1]
            low, high = sorted((start, last[2]))
            cut = min(max(low + (high - low) // 2, last[1]), max(end, last[1]))
            last[2] = cut
            out.append([label, cut, max(end, cut)])
    return out


def without_flickers(runs: list[list[int]], least: int) -> list[list[int]]:
    """Runs with the shortest one below `least` absorbed again and again, by the one before it or else the one behind."""
    runs = [list(r) for r in runs]
    while len(runs) > 1 and least > 0:
        length, k = min((max(e - s, 0), i) for i, (_, s, e) in enumerate(runs))
        if length >= least:
            break
        _, s, e = runs.pop(k)
        if k:
            runs[k - 1][2] = max(runs[k - 1][2], e)
        else:
            runs[0][1] = min(runs[0][1], s)
        merged = [runs[0]]
        for r in runs[1:]:
            if r[0] == merged[-1][0]:
                merged[-1][1:] = [min(merged[-1][1], r[1]), max(merged[-1][2], r[2])]
            else:
                merged.append(r)
        runs = merged
    return runs


def resegment(windows: DataFrame, rate: int, min_seconds: float) -> DataFrame:
    """clip_id, seg_idx, speaker, start, end (seconds) from windows(clip_id, start, end, label) in samples."""
    least = int(np.floor(min_seconds * rate + 0.5))
    kind = windows.schema["clip_id"].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start", "end", "label"])
        runs = without_flickers(label_runs(list(zip(pdf.start, pdf.end, pdf.label))), least) if rate else []
        return pd.DataFrame([(pdf.clip_id.iloc[0], k, r[0], r[1] / rate, r[2] / rate) for k, r in enumerate(runs)], columns=["clip_id", "seg_idx", "speaker", "start", "end"])

    return windows.groupBy("clip_id").applyInPandas(one, f"clip_id {kind}, seg_idx long, speaker long, start double, end double")


def peak_frames(weights: np.ndarray) -> np.ndarray:
    """Each token's frame of greatest weight (the last on ties), never before the token's before."""
    last = weights.shape[1] - 1 - weights[:, ::-1].argmax(axis=1)
    return np.maximum.accumulate(last)


def peak_times(weights: np.ndarray, seconds: float) -> list[tuple[float, float]]:
    if not weights.size:
        return []
    peaks = peak_frames(weights)
    ends = np.append(peaks[1:], min(weights.shape[1], peaks[-1] + 1))
    return [(p * seconds, max(e, p) * seconds) for p, e in zip(peaks, ends)]


def warp(cost: np.ndarray, band: int) -> np.ndarray | None:
    """The cheapest path's first and last frame of each token [tokens, 2] inside a band around the diagonal, or None.

    Steps go diagonally, up a token or left a frame, preferred in that order.
    """
    n, m = cost.shape
    i, j = np.arange(n)[:, None], np.arange(m)[None, :]
    cost = np.where(np.abs(j * n - i * m) <= band * n, cost, np.inf)
    way = np.zeros((n, m), np.int8)
    row = np.full(m, np.inf)
    row[0] = cost[0, 0]
    for f in range(1, m):
        # a cell of the first row may begin a path or go on from its left; costs are not negative, so the former is never dearer
        row[f] = cost[0, f]
    for t in range(1, n):
        new = np.full(m, np.inf)
        for f in np.flatnonzero(np.isfinite(cost[t])):
            diagonal, left = (row[f - 1], new[f - 1]) if f else (np.inf, np.inf)
            up = row[f]
            if diagonal <= up and diagonal <= left:
                best, way[t, f] = diagonal, 0
            elif up <= left:
                best, way[t, f] = up, 1
            else:
                best, way[t, f] = left, 2
            new[f] = cost[t, f] + best
        row = new
    if not np.isfinite(row[-1]):
        return None
    spans = np.stack([np.full(n, m), np.full(n, -1)], axis=1)
    t, f = n - 1, m - 1
    while True:
        spans[t] = min(spans[t, 0], f), max(spans[t, 1], f)
        if t == 0:
            spans[0, 0] = 0  # the first token takes the frames before it
            return spans
        step = way[t, f]
        t, f = (t - 1, max(f - 1, 0)) if step == 0 else (t - 1, f) if step == 1 else (t, f - 1)


def align(weights: np.ndarray, seconds: float, band: int | None = None) -> list[tuple[float, float]]:
    """Start and end of each token (row) over frames (columns) of an attention matrix, by banded warping of -ln(softmax)."""
    n, m = weights.shape
    if not n or not m:
        return []
    if n > m:
        return peak_times(weights, seconds)
    cost = np.minimum(-np.log(np.maximum(softmax(weights.astype(np.float64)), 1e-22)), 50.0)
    band = band or max(m // 4, 10)
    spans = warp(cost, band)
    if spans is None and band < m:
        spans = warp(cost, m)
    return peak_times(weights, seconds) if spans is None else [(s * seconds, (e + 1) * seconds) for s, e in spans]


def align_tokens(attention: DataFrame, seconds: float = 0.01, band: int | None = None, key: str = "grp") -> DataFrame:
    """key, token, start, end from attention(key, token, frame, w)."""
    kind = attention.schema[key].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        table = pdf.pivot(index="token", columns="frame", values="w").sort_index(axis=0).sort_index(axis=1)
        times = align(table.fillna(0.0).to_numpy(), seconds, band)
        return pd.DataFrame([(pdf[key].iloc[0], t, s, e) for t, (s, e) in zip(table.index, times)], columns=[key, "token", "start", "end"])

    return attention.groupBy(key).applyInPandas(one, f"{key} {kind}, token long, start double, end double")
