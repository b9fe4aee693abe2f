"""Hand-computed cases of attribution, scores, runs and chunk plans."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from chorale.operators import metrics, sequential, transcript, vad

REF = [("u", "A", 0.0, 2.0), ("u", "B", 2.0, 4.0)]
HYP = [("u", 0, 0.5, 2.5), ("u", 1, 3.0, 4.5)]


def scored(spark, ref, hyp, collar=0.0, skip=False, pairs=(("u", "A", 0), ("u", "B", 1))):
    r = spark.createDataFrame(ref, "uri string, speaker string, start double, end double")
    h = spark.createDataFrame(hyp, "uri string, speaker int, start double, end double")
    m = spark.createDataFrame(list(pairs), "uri string, ref string, hyp int")
    grid = metrics.intervals(r, h, collar)
    return metrics.der(grid, m, skip).first(), metrics.jer(grid, m).first(), metrics.optimal_mapping(metrics.cooccurrence(grid)).collect()


def test_der_plain(spark):
    d, j, m = scored(spark, REF, HYP)
    assert (d.miss, d.false_alarm, d.confusion, d.total, d.der) == (1.0, 0.5, 0.5, 4.0, 0.5)
    assert sorted((x.ref, x.hyp) for x in m) == [("A", 0), ("B", 1)]
    assert j.jer == pytest.approx(((1 - 1.5 / 2.5) + (1 - 1.0 / 2.5)) / 2)


def test_der_collar(spark):
    d, _, _ = scored(spark, REF, HYP, collar=0.25)
    assert (d.miss, d.false_alarm, d.confusion, d.total) == (0.75, 0.25, 0.25, 3.0)
    assert d.der == pytest.approx(1.25 / 3)


def test_der_overlap(spark):
    ref, hyp = [("u", "A", 0.0, 2.0), ("u", "B", 1.0, 3.0)], [("u", 0, 0.0, 2.5)]
    d, _, _ = scored(spark, ref, hyp, pairs=[("u", "A", 0)])
    assert (d.miss, d.confusion, d.total) == (1.5, 0.5, 4.0)
    d, _, _ = scored(spark, ref, hyp, skip=True, pairs=[("u", "A", 0)])
    assert (d.miss, d.confusion, d.total) == (0.5, 0.5, 2.0)


@pytest.mark.parametrize("n,m", [(1, 1), (3, 3), (2, 5), (5, 2), (4, 6)])
def test_assign_is_cheapest(n, m):
    rng = np.random.default_rng(n * 10 + m)
    for _ in range(40):
        cost = rng.integers(-9, 9, (n, m)).astype(float)
        size = max(n, m)
        padded = np.zeros((size, size))
        padded[:n, :m] = cost
        best = min(sum(padded[i, p[i]] for i in range(size)) for p in itertools.permutations(range(size)))
        got = metrics.assign(cost)
        used = [j for j in got if j >= 0]
        assert len(used) == len(set(used))
        assert sum(cost[i, j] for i, j in enumerate(got) if j >= 0) == pytest.approx(best)


def test_rttm_parsing(spark):
    good = ["SPEAKER f 1 0.5 1.25 <NA> <NA> s1 <NA> <NA>", "; note", "# note", "", "LEXEME f 1 0 1 a b c"]
    out = metrics.parse_rttm(spark.createDataFrame([(x,) for x in good], "value string")).collect()
    assert [tuple(r) for r in out] == [("f", "s1", 0.5, 1.75)]
    for bad in ("SPEAKER f 1 0.5", "SPEAKER f 1 x 1 <NA> <NA> s <NA> <NA>"):
        with pytest.raises(Exception, match="RTTM"):
            metrics.parse_rttm(spark.createDataFrame([(bad,)], "value string")).collect()


def test_attribution_ties_and_edges(spark):
    words = spark.createDataFrame([("c", 0, i, f"w{i}", s, e) for i, (s, e) in enumerate([(0.0, 2.0), (1.0, 3.0), (4.4, 4.6), (9.0, 9.5)])], "clip_id string, seg_idx long, word_idx long, word string, start double, end double")
    line = spark.createDataFrame([("c", 1, 0.0, 2.0), ("c", 2, 2.0, 4.0), ("c", 3, 5.0, 6.0)], "clip_id string, speaker int, start double, end double")
    got = {r.word_idx: r.speaker for r in transcript.attribute(words, line).collect()}
    assert got == {0: 1, 1: 2, 2: 2, 3: 3}  # half-open; 4.5 is 0.5 from both and the earlier start wins


def frames(spark, levels):
    return spark.createDataFrame([("c", i, float(x)) for i, x in enumerate(levels)], "clip_id string, frame long, rms double")


def by_steps(loud, least, gap):
    runs = [(g[0], g[-1] + 1) for g in ([i for i, _ in grp] for k, grp in itertools.groupby(enumerate(loud), lambda x: x[1]) if k)]
    out = []
    for s, e in (r for r in runs if r[1] - r[0] >= least):
        if out and s - out[-1][1] < gap:
            out[-1][1] = e
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def test_vad_against_steps(spark):
    rng = np.random.default_rng(1)
    for _ in range(5):
        loud = rng.random(120) < 0.6
        config = vad.VadConfig(0.5, 60, 90, 30)
        found = vad.detect(frames(spark, loud), config)
        got = [(r.start, r.end) for r in found.orderBy("start").collect()]
        assert got and got == by_steps(loud, 2, 3)
        clips = spark.createDataFrame([("c", 120)], "clip_id string, length long")
        quiet = [(r.start, r.end) for r in vad.silence(found, clips).orderBy("start").collect()]
        covered = sorted(i for s, e in [*got, *quiet] for i in range(s, e))
        assert covered == list(range(120))


def test_windows_keep_tails_and_stay_inside(spark):
    r = spark.createDataFrame([("c", 0, 10), ("c", 20, 22), ("c", 30, 31)], "clip_id string, start long, end long")
    got = sorted((x.start, x.end) for x in vad.slide(r, 4, 2, 2).collect())
    assert got == [(0, 4), (2, 6), (4, 8), (6, 10), (8, 10), (20, 22)]


def test_chunk_plan_covers_and_snaps():
    assert sequential.plan_chunks(0, []) == []
    assert sequential.plan_chunks(100, [], 100, 90, 5) == [(0, 100)]
    plan = sequential.plan_chunks(1000, [(88, 90), (500, 700)], 100, 90, 5)
    assert plan[0] == (0, 89) and plan[-1][1] == 1000
    assert all(a[1] == b[0] for a, b in zip(plan, plan[1:])) and all(0 < e - s <= 100 for s, e in plan)


def test_flickers_are_absorbed():
    runs = sequential.label_runs([(0, 100, 0), (60, 160, 1), (120, 220, 0)])
    assert runs == [[0, 0, 80], [1, 80, 140], [0, 140, 220]]
    assert sequential.without_flickers(runs, 70) == [[0, 0, 220]]
    assert sequential.without_flickers([[0, 0, 5], [1, 5, 50]], 10) == [[1, 0, 50]]
    assert sequential.without_flickers([[0, 0, 5]], 10) == [[0, 0, 5]]


def brute_warp(cost):
    n, m = cost.shape
    best = {}

    def go(i, j):
        if (i, j) not in best:
            if i == 0:
                best[i, j] = cost[0, j]
            else:
                best[i, j] = cost[i, j] + min([go(i - 1, j)] + ([go(i - 1, j - 1), go(i, j - 1)] if j else []))
        return best[i, j]

    return go(n - 1, m - 1)


def test_warp_finds_a_path():
    rng = np.random.default_rng(3)
    for n, m in ((1, 5), (3, 8), (6, 6), (5, 20)):
        cost = rng.random((n, m))
        spans = sequential.warp(cost, m)
        assert spans[0, 0] == 0 and spans[-1, 1] == m - 1
        assert all(0 <= b[0] - a[1] <= 1 for a, b in zip(spans, spans[1:]))
        # a path's cost with these spans can't be below the optimum
        assert sum(cost[i, s : e + 1].min() for i, (s, e) in enumerate(spans)) <= brute_warp(cost) + 1e-9
    weights = np.eye(5, 10) * 20
    assert [s for s, _ in sequential.align(weights, 1.0)][0] == 0.0
    assert sequential.align(np.zeros((0, 4)), 1.0) == []


def test_paired_marks(spark):
    vocab = spark.createDataFrame([(0, " hello"), (1, " world"), (2, "<|x|>")], "token long, token_text string")
    stream = [50364, 50364, 0, 50414, 50414, 1, 2, 50464, 50464]
    tokens = spark.createDataFrame([(7, i, t, -0.5 if t == 0 else -0.25) for i, t in enumerate(stream)], "doc_id long, pos long, token long, prob double")
    segs = transcript.parse_segments(tokens, vocab)
    assert [(r.start, r.end, r.text) for r in segs.orderBy("seg").collect()] == [(0.0, 1.0, "hello"), (1.0, 2.0, "world")]
    zipped = transcript.zip_confidences(segs, transcript.segment_confidences(tokens))
    assert [r.confidence for r in zipped.orderBy("seg").collect()] == [0.0, -0.5]  # out of step by position
    plain = tokens.where(F.col("token") < 10)
    assert [(r.start, r.end, r.text) for r in transcript.parse_segments(plain, vocab).collect()] == [(0.0, 0.0, "hello world")]


def test_attribution_over_a_day_against_all_pairs(spark):
    """Words of a clip of 24 hours, overlapping segments, gaps, ties and segments without length."""
    import random

    r = random.Random(5)
    line = [("c", k, s, s + r.choice([0, 0.5, 3, 200, 4000])) for k in range(60) for s in [float(r.randrange(0, 86400))]] + [("c", 99, 100.0, 160.0), ("c", 98, 100.0, 160.0)]
    words = [("c", 0, i, f"w{i}", t, t + r.choice([0, 1, 2])) for i in range(400) for t in [float(r.randrange(0, 86400))]] + [("none", 0, 0, "x", 1.0, 2.0)]
    got = {x.word_idx: x.speaker for x in transcript.attribute(spark.createDataFrame(words, "clip_id string, seg_idx long, word_idx long, word string, start double, end double"), spark.createDataFrame(line, "clip_id string, speaker long, start double, end double")).collect() if x.clip_id == "c"}
    assert len(got) == 400
    for _, _, i, _, a, b in words[:-1]:
        m = (a + b) / 2
        rank = lambda x: (-1 if x[2] <= m < x[3] else max(x[2] - m, m - x[3], 0), x[2], x[3])
        best = min(map(rank, line))
        assert got[i] in {x[1] for x in line if rank(x) == best}


def test_json_keeps_clips_of_blank_texts(spark):
    from chorale.sources import subtitles

    rows = [("a", 0, 0.0, 1.0, "  "), ("b", 0, 0.0, 1.5, " hi ")]
    got = {x.clip_id: x.json for x in subtitles.to_json(spark.createDataFrame(rows, "clip_id string, seg_idx long, start double, end double, text string")).collect()}
    assert got == {"a": '{"text":"","segments":[{"text":"  ","start":0.0,"end":1.0}]}', "b": '{"text":"hi","segments":[{"text":" hi ","start":0.0,"end":1.5}]}'}
