"""Composed scans against loops: meeting holds on a hot key, null keys, one exchange of data rows."""

import random

import pytest
from pyspark.sql import functions as F

from chronoweave.operators import scans
from chronoweave.operators import series as sr

HOUR = 3_600_000


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning")


def test_scan_exchanges_data_rows_once(spark):
    df = spark.range(1000).selectExpr("IF(id % 3 = 0, null, id % 3) AS k", "id AS t", "id * 2 AS x")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = scans.scan(df, ["k"], ["t"], F.floor(F.col("t") / 10), s=scans.running_sum(F.col("x")), p=scans.previous(F.col("x")))
        assert exchanges(out) == 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    seen = {}
    for r in sorted(out.collect(), key=lambda r: r.t):
        total, last = seen.get(r.k, (0, None))
        assert (r.s, r.p) == (total + r.x, last)
        seen[r.k] = (total + r.x, r.x)
    assert set(seen) == {None, 1, 2}


@pytest.mark.parametrize("kind", ["string", "date", "timestamp", "double", "decimal(9,2)", "struct<a:int>"])
def test_scan_keys_of_any_type(spark, kind):
    key = {"date": "date_add(date'2024-01-01', CAST(id % 3 AS INT))", "timestamp": "timestamp_micros(id % 3)", "struct<a:int>": "named_struct('a', CAST(id % 3 AS INT))"}.get(kind, f"CAST(id % 3 AS {kind})")
    df = spark.range(60).selectExpr(f"IF(id % 3 = 0, null, {key}) AS k", "id % 3 AS g", "id AS t")
    out = scans.scan(df, ["k"], ["t"], F.floor(F.col("t") / 7), n=scans.running_sum(F.lit(1)))
    assert out.columns == ["k", "g", "t", "n"] and all(r.n == r.t // 3 + 1 for r in out.collect())


def held_path(keys, cuts, holds, release):
    """The loop: each hold edits the path that those before it left."""
    keys = [(t, x, False) for t, x in keys]
    for a, b in holds:
        cut = min((c for c in cuts if c > a), default=None)
        ends = cut is not None and cut <= b
        stop = cut - 10 if ends else b
        if stop - a < 50:
            continue
        resume = cut if ends else min(stop + release, cut) if cut is not None else stop + release
        before = [k for k in keys if k[0] <= a]
        after = [k for k in keys if k[0] > a]
        if not before:
            v = after[0][1]
        elif not after or any(before[-1][0] < c <= after[0][0] for c in cuts):
            v = before[-1][1]
        else:
            p, q = before[-1], after[0]
            v = p[1] + (q[1] - p[1]) * (a - p[0]) / (q[0] - p[0])
        keys = [k for k in keys if k[0] < a] + [(a, v, True), (stop, v, True)] + [k for k in keys if k[0] >= resume and k[0] > stop]
    return sorted((t, round(x, 6), h) for t, x, h in keys)


def three_meeting():
    keys = [(t * 1000, float(t * t % 97)) for t in range(0, 60, 2)]
    return keys, [41_000], [(5_000, 12_300), (12_000, 18_000), (18_700, 24_500), (38_000, 50_000)]


def crowd(seed, n_keys, n_holds):
    r = random.Random(seed)
    times = sorted(r.sample(range(0, n_keys * 40, 5), n_keys))
    cuts = set(r.sample(times, n_keys // 40))
    starts = sorted(r.randrange(-100, n_keys * 40) for _ in range(n_holds))
    return [(t, r.uniform(0, 490)) for t in times], sorted(cuts), [(a, a + r.choice([20, 60, 90, 300, 900])) for a in starts]


@pytest.mark.parametrize("case", [three_meeting(), crowd(1, 400, 150), crowd(2, 4000, 1500), ([(100, 1.0)], [], [(0, 70), (60, 200), (100, 160), (100, 180)])])
def test_holds_that_meet(spark, case):
    keys, cuts, holds = case
    rows = [(7, i, t, x, t in cuts) for i, (t, x) in enumerate(sorted(set(keys) | {(c, 0.0) for c in cuts if c not in dict(keys)}))]
    path = sr.with_shots(spark.createDataFrame(rows, "series_id long, seq long, t_ms long, x double, cut boolean"))
    spans = spark.createDataFrame([(7, i, a, b) for i, (a, b) in enumerate(holds)], "series_id long, hold_id long, a long, b long")
    got = sr.freeze_spans(path, spans, "series_id", 80).collect()
    assert sorted((r.t_ms, round(r.x, 6), r.held) for r in got) == held_path([(t, x) for _, _, t, x, _ in rows], cuts, holds, 80)


def loop_kept(spans, min_len=None):
    out, last = [], None
    for s, e, i in sorted(spans, key=(lambda r: (r[0], r[2])) if min_len is None else None):
        at = s if last is None else max(s, last)
        if (min_len is None and at == s) or (min_len is not None and e - at >= min_len):
            out.append((at, e, i))
            last = e
    return sorted(out)


@pytest.mark.parametrize("n,reach", [(3000, 4000), (3000, 60), (40, 500), (1, 10)])
def test_greedy_lanes_equal_loops(spark, n, reach):
    from chronoweave.operators import intervals as iv
    r = random.Random(n + reach)
    spans = [(a, a + r.choice([0, 30, r.randrange(reach), r.randrange(reach * 9)]), i) for i, a in enumerate(sorted(r.randrange(n * 10) for _ in range(n)))]
    rows = [(k, *s) for k in ("hot", None) for s in (spans if k else spans[: n // 3 + 1])]
    df = spark.createDataFrame(rows, "k string, s long, e long, i long").repartition(4)
    for got, limit in ((iv.drop_overlapping(df, ["k"], "s", "e", "i", []), None), (iv.exclusive_order(df, ["k"], "s", "e", "i", 50), 50)):
        found = {}
        for g in got.collect():
            found.setdefault(g.k, []).append((g.s, g.e, g.i))
        want = {k: loop_kept([x[1:] for x in rows if x[0] == k], limit) for k in ("hot", None)}
        assert {k: sorted(v) for k, v in found.items()} == {k: v for k, v in want.items() if v}


def test_one_island_of_200_000_spans(spark):
    from chronoweave.operators import intervals as iv
    spans = [(i * 10, i * 10 + 15 + i * 7919 % 400, i) for i in range(200_000)]
    df = spark.range(200_000).selectExpr("1 AS k", "id * 10 AS s", "id * 10 + 15 + id * 7919 % 400 AS e", "id AS i")
    assert sorted((g.s, g.e, g.i) for g in iv.drop_overlapping(df, ["k"], "s", "e", "i", []).collect()) == loop_kept(spans)
    assert sorted((g.s, g.e, g.i) for g in iv.exclusive_order(df, ["k"], "s", "e", "i", 50).collect()) == loop_kept(spans, 50)


def test_phrase_search_keeps_word_arrays_in_their_row(spark, sf):
    from chronoweave.plans import mining_plans
    plan = mining_plans.located(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "norms" not in plan.split("Join")[0]
    shuffled = [line for line in mining_plans.q_locate_fuzzy(spark, sf)._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line]
    assert not any("norms" in line for line in shuffled)


def test_phrases_equal_a_loop(spark):
    from chronoweave.operators import mining as mn
    r = random.Random(1)
    docs = [(i, [r.choice("abcdefg") for _ in range(r.choice([0, 1, 2, 3, 40, 300]))]) for i in range(30)] + [(99, None)]
    phrases = [(i, [r.choice("abcdefg") for _ in range(r.choice([0, 2, 3, 4, 9]))]) for i in range(40)] + [(77, None)]
    want = set()
    for d, ws in docs:
        for p, q in phrases:
            for at in range(len(ws or []) - len(q or []) + 1):
                if q and len(q) >= 3 and ws[at] == q[0]:
                    want.add((d, p, at, sum(a == b for a, b in zip(ws[at:], q)), len(q)))
    df = spark.createDataFrame(docs, "project_id long, norms array<string>")
    got = mn.phrase_spots(df, spark.createDataFrame(phrases, "item_id long, q array<string>"), "project_id", "item_id").collect()
    assert {tuple(g) for g in got} == want and len(got) == len(want)
    assert mn.phrase_spots(df, spark.createDataFrame([], "item_id long, q array<string>"), "project_id", "item_id").count() == 0


def test_phrase_places_of_a_share(spark):
    from chronoweave.operators import mining as mn
    r = random.Random(2)
    docs = spark.createDataFrame([(i, [r.choice("abc") for _ in range(200)]) for i in range(8)] + [(99, None)], "project_id long, norms array<string>")
    phrases = spark.createDataFrame([(i, [r.choice("abc") for _ in range(3 + i % 6)]) for i in range(30)] + [(50, list("ab" * 150))], "item_id long, q array<string>")
    every = {tuple(g) for g in mn.phrase_spots(docs, phrases, "project_id", "item_id").collect()}
    for share in (0.2, 0.5, 0.75, 1.0):
        got = mn.phrase_spots(docs, phrases, "project_id", "item_id", share).collect()
        assert {tuple(g) for g in got} == {e for e in every if e[3] / e[4] >= share} and len(set(got)) == len(got)


def test_windows_are_as_long_as_the_phrases_that_begin_so(spark):
    from chronoweave.operators import mining as mn
    phrases = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a", "x", "y", "z"]), (3, ["b"] * 300)], "item_id long, q array<string>")
    one = spark.createDataFrame([(["c", "a", "b", "c", "b"],)], "ws array<string>")
    at = lambda head: [tuple(v) for v in one.select(mn._in_row_lengths(phrases, "q", head, 300)(F.col("ws")).alias("v")).first().v]
    assert at(1) == [(1, 4), (2, 300), (4, 300)] and at(2) == [(1, 3)]


def test_correlation_of_windows_that_do_not_vary(spark):
    rows = [("a", i, 2.0, float(i)) for i in range(12)] + [("b", i, float(i % 5), -float(i % 5)) for i in range(12)] + [("c", i, float(i % 5), 3.0 * (i % 5)) for i in range(12)] + [("d", 0, 1.0, 2.0)]
    out = sr.windowed_pearson(spark.createDataFrame(rows, "k string, i long, x double, y double"), "k", "x", "y", 7, size=4).collect()
    assert len(out) == 37
    assert all(r.corr == 0.0 for r in out if r.k in "abd") and all(abs(r.corr - 1) < 1e-9 for r in out if r.k == "c")


def test_margin_counts_frames_with_two_seats(spark):
    scored = spark.createDataFrame([("a", 0, 0, 0.6, 1.0), ("a", 0, 1, 0.4, 0.5), ("a", 1, 0, 0.35, 0.0), ("a", 1, 1, 0.35, 0.2), ("a", 2, 0, 0.9, 0.9), ("b", 0, 0, 0.5, 0.5)], "k string, f long, seat long, score double, corr double")
    choices = spark.createDataFrame([("a", 0, False), ("a", 1, True), ("b", 0, False)], "k string, f long, switched boolean")
    seen = spark.createDataFrame([("a", 4, 3), ("b", 1, 1)], "k string, n long, seen long")
    r, = sr.winner_margin(scored, choices, seen, "k", "f").collect()
    assert (r.k, r.frames, r.dual, r.switches, r.present) == ("a", 2, 2, 1, 0.75)
    assert [round(x, 6) for x in (r.margin, r.speaker_corr, r.listener_corr)] == [0.1, 0.5, 0.35]
