"""Spans of a moment are fitted by search, not by a pass over all sentences and cues of the transcript."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from chronoweave.operators import mining as mn


def _fit(s, a, b, peak, lo_ms, hi_ms):
    lo, hi = min(a, b), max(a, b)
    length = lambda x, y: s[y][1] - s[x][0]
    while length(lo, hi) < lo_ms:
        if hi + 1 < len(s) and length(lo, hi + 1) <= hi_ms:
            hi += 1
        elif lo > 0 and length(lo - 1, hi) <= hi_ms:
            lo -= 1
        else:
            break
    while length(lo, hi) > hi_ms and lo < hi:
        if lo < min(max(peak, lo), hi):
            lo += 1
        else:
            hi -= 1
    return lo, hi


def test_fit_and_snap_equal_loops(spark):
    r, data = random.Random(5), []
    for k in range(60):
        t, sents = 0, []
        for _ in range(r.choice([1, 2, 7, 8, 31, 64])):
            start = t + r.choice([0, 0, 900, 4000])
            t = start + r.choice([400, 2000, 9000, 50000])
            sents.append((start, t))
        a, b = r.randrange(len(sents)), r.randrange(len(sents))
        data.append((k, sents, a, b, r.randint(min(a, b), max(a, b)), r.choice([0, sents[a][0], t + 5, t // 2])))
    df = spark.createDataFrame(data, "k int, s array<struct<start_ms:bigint,end_ms:bigint>>, a int, b int, p int, t bigint")
    got = df.select("k", mn.fit_span(F.col("s"), F.col("a"), F.col("b"), F.col("p"), 20000, 45000).alias("f"), mn.snap_start(F.col("t"), F.col("s.start_ms")).alias("x"),
                    mn.snap_end(F.col("t"), F.col("s.end_ms")).alias("y")).collect()
    for g in got:
        _, s, a, b, p, t = data[g["k"]]
        assert tuple(g["f"]) == _fit(s, a, b, p, 20000, 45000)
        assert g["x"] == max(0, max([x for x, _ in s if x <= t + 1], default=s[0][0]) - 250)
        assert g["y"] == min([y for _, y in s if y >= t - 1], default=s[-1][1])


def test_no_pass_over_all_sentences(spark):
    s, t = F.col("s"), F.col("t")
    for c in (mn.fit_span(s, F.col("a"), F.col("b"), F.col("p"), 20000, 45000), mn.lead_up(s, F.col("f"), t, 45000), mn.snap_start(t, s), mn.snap_end(t, s)):
        assert "filter(" not in str(c)


def test_empty_boundaries(spark):
    df = spark.createDataFrame([(7, [])], "t bigint, b array<bigint>")
    assert tuple(df.select(mn.snap_start(F.col("t"), F.col("b")), mn.snap_end(F.col("t"), F.col("b"))).first()) == (0, 7)
