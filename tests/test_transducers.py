"""Held choices along a series against loops: blocks of any size, a million frames under one key, odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.operators import series as sr


def loop_hysteresis(frames, hold, margin=sr.SWITCH_MARGIN):
    """frames: (frame, {seat: score}) in order."""
    cur, ch, n, out = None, None, 0, []
    for f, s in frames:
        best = min(s, key=lambda x: (-s[x], x))
        cur = best if cur is None else cur
        lead = best != cur and cur in s and s[best] - s[cur] > margin
        n = 0 if not lead else n + 1 if ch == best else 1
        sw = lead and n >= hold
        cur, ch, n = (best, None, 0) if sw else (cur, best if lead else None, n)
        out.append((f, cur, sw))
    return out


@pytest.mark.parametrize("hold", [1, 2, 5])
@pytest.mark.parametrize("size", [1, 3, 64, 4096])
def test_held_choice_equals_a_loop(spark, hold, size):
    r = random.Random(hold * 100 + size)
    series = {}
    for k, n in (("hot", 900), ("b", 7), (None, 60), ("c", 1)):
        run, frames = [], []
        for f in range(n):
            if f % r.choice([1, 2, 7]) == 0:
                run = [r.choice([0.0, 0.1, 0.3, 0.5]) for _ in range(4)]
            s = {i: v for i, v in enumerate(run) if r.random() < 0.9}
            if s and r.random() < 0.95:
                frames.append((f, s))
        series[k] = frames
    rows = [(k, f, i, v) for k, fs in series.items() for f, s in fs for i, v in s.items()] + [("b", None, 1, 9.0), ("b", 3, 77, None), ("d", 1, 1, None)]
    got = {}
    for g in sr.hysteresis(spark.createDataFrame(rows, "k string, frame long, seat long, score double").repartition(3), ["k"], "frame", hold, size=size).collect():
        got.setdefault(g.k, []).append((g.frame, g.seat, g.switched))
    assert {k: sorted(v) for k, v in got.items()} == {k: loop_hysteresis(v, hold) for k, v in series.items() if v}


def test_one_series_of_a_million_frames(spark):
    n = 1_000_000
    df = spark.range(n * 3, numPartitions=8).selectExpr("1 AS k", "id DIV 3 AS frame", "id % 3 AS seat", "((id DIV 27 * 7919 + id % 3 * 331) % 1009) / 1009D AS score")
    out = sr.hysteresis(df, ["k"], "frame", 4)
    got = out.toArrow().sort_by("frame")
    i = np.arange(n * 3)
    score = ((i // 27 * 7919 + i % 3 * 331) % 1009 / 1009.0).reshape(n, 3).tolist()
    want = loop_hysteresis([(f, dict(enumerate(s))) for f, s in enumerate(score)], 4)
    assert got["frame"].to_numpy().tolist() == list(range(n))
    assert got["seat"].to_numpy().tolist() == [w[1] for w in want] and got["switched"].to_pylist() == [w[2] for w in want]
    assert sum(w[2] for w in want) > 1000


@pytest.mark.parametrize("size", [1, 4, 4096])
def test_opening_choice_equals_a_loop(spark, size):
    r = random.Random(size)
    rows = [(k, shot, seat, r.choice([10.0, 20.0, r.random() * 100]), r.choice([0.0, 1.0, r.random() * 3])) for k, n in (("hot", 300), (None, 9)) for shot in range(n) if r.random() < 0.9 for seat in range(r.randrange(1, 4))]
    df = spark.createDataFrame([*rows, ("hot", 5, 9, None, 99.0), ("hot", None, 1, 1.0, 1.0)], "k string, shot long, seat long, centre double, spoken double")
    want, carry = [], {}
    for k, shot in sorted({(x[0], x[1]) for x in rows}, key=lambda x: (x[0] is None, x)):
        at = [x[2:] for x in rows if x[:2] == (k, shot)]
        talk = min(at, key=lambda x: (-x[2], x[0]))
        near = min(at, key=lambda x: (abs(x[1] - carry[k]), x[0])) if k in carry else talk
        use = talk if talk[2] > near[2] + sr.SWITCH_MARGIN * 2 else near
        carry[k] = use[1]
        want.append((k, shot, use[0]))
    got = sorted((tuple(g) for g in sr.opening_choice(df.repartition(3), ["k"], "shot", 2, size=size).select("k", "shot", "seat").collect()), key=lambda x: (x[0] is None, x))
    assert got == want


def test_empty_series(spark):
    assert sr.hysteresis(spark.createDataFrame([], "k string, frame long, seat long, score double"), ["k"], "frame", 2).count() == 0
    assert sr.opening_choice(spark.createDataFrame([], "k string, shot long, seat long, centre double, spoken double"), ["k"], "shot", 2).count() == 0
