"""Scans, joins and folds against plain windows, brute force and loops, with one hot key."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from __spark_entry__ import queries
from chronoweave.operators import captions as cp
from chronoweave.operators import catalog as ct
from chronoweave.operators import intervals as iv
from chronoweave.operators import joins
from chronoweave.operators import mining
from chronoweave.operators import series as sr
from chronoweave.operators.scans import following, latest, previous, running_max, running_sum, scan


def skewed(spark, n=600, seed=7):
    rnd = random.Random(seed)
    rows = [(0 if rnd.random() < 0.4 else rnd.randint(1, 9), i, rnd.randint(0, 5000), rnd.choice([None, 1.0, 2.5, 4.0])) for i in range(n)]
    return spark.createDataFrame(rows, "k long, id long, t long, v double")


def test_scan_equals_unbounded_window(spark):
    df = skewed(spark)
    got = scan(df, ["k"], ["t", "id"], F.floor(F.col("t") / 100), s=running_sum(F.lit(1)), m=running_max(F.col("v"), False), p=previous(F.col("v")), l=latest(F.col("v")), n=following(F.col("v")))
    w = Window.partitionBy("k").orderBy("t", "id")
    before, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    after = w.rowsBetween(1, Window.unboundedFollowing)
    want = df.select("*", F.count("*").over(upto).cast("int").alias("s"), F.max("v").over(before).alias("m"), F.last("v", True).over(before).alias("p"),
                     F.last("v", True).over(upto).alias("l"), F.first("v", True).over(after).alias("n"))
    cols = want.columns
    assert sorted(map(str, got.select(*[F.col(c).cast("double") for c in cols]).collect())) == sorted(map(str, want.select(*[F.col(c).cast("double") for c in cols]).collect()))


def test_range_joins_equal_brute_force(spark):
    rnd = random.Random(3)
    spans = [(rnd.randint(0, 2), i, s := rnd.randint(0, 900), s + rnd.randint(0, 200)) for i in range(60)]
    pts = [(rnd.randint(0, 2), i, rnd.randint(0, 1000)) for i in range(80)]
    sd = spark.createDataFrame(spans, "k long, sid long, a long, b long")
    pd_ = spark.createDataFrame(pts, "k long, pid long, t long")
    got = {(r.pid, r.sid) for r in joins.points_in_spans(pd_, sd, ["k"], "t", F.col("a"), F.col("b"), 37.0).collect()}
    assert got == {(p[1], s[1]) for p in pts for s in spans if p[0] == s[0] and s[2] <= p[2] <= s[3]}
    o = sd.select("k", F.col("sid").alias("oid"), F.col("a").alias("oa"), F.col("b").alias("ob"))
    hits = [(r.sid, r.oid) for r in joins.overlaps(sd, o, ["k"], "a", "b", "oa", "ob", 37.0).collect()]
    want = [(x[1], y[1]) for x in spans for y in spans if x[0] == y[0] and x[2] < y[3] and x[3] > y[2]]
    assert sorted(hits) == sorted(want)


def test_cuts_on_a_trim(spark):
    cuts = spark.createDataFrame([(1, 1, 11_000, 12_000, True), (1, 2, 11_800, 12_500, True), (1, 3, 14_000, 15_000, False), (1, 4, 19_350, 25_000, True)], "o long, id long, s long, e long, on boolean")
    m = iv.merge_intervals(cuts, ["o"], "s", "e", "id", 10_000, 20_000, enabled=F.col("on"))
    assert sorted((r.s, r.e) for r in m.collect()) == [(11_000, 12_500), (19_350, 20_000)]
    kept = iv.complement(cuts, m, ["o"], "s", "e", 10_000, 20_000)
    assert sorted((r.s, r.e) for r in kept.collect()) == [(10_000, 11_000), (12_500, 19_350)]
    assert sum(r.e - r.s for r in kept.collect()) == 7_850
    again = iv.merge_intervals(m.withColumn("id", F.col("s")), ["o"], "s", "e", "id", 10_000, 20_000)
    assert sorted((r.s, r.e) for r in again.collect()) == sorted((r.s, r.e) for r in m.collect())


def test_clock_maps_are_inverse_inside_windows(spark):
    win = spark.createDataFrame([(1, 0, 1000, None), (1, 2000, 4000, 0.5), (1, 4000, 5000, 2.0)], "o long, s long, e long, rate double")
    clock = iv.output_clock(win, ["o"], "s", "e", "rate").cache()
    probes = spark.createDataFrame([(1, i, t) for i, t in enumerate((0, 500, 2500, 3999, 4500))], "o long, id long, t long")
    out = iv.locate_on_windows(probes, clock, ["o"], "t", "id", "s", "e", "rate")
    back = iv.output_to_source(out.select("o", "id", "output_ms", F.col("t").alias("orig")), clock, ["o"], "output_ms", "id", "s", "e", "rate")
    assert all(abs(r.source_ms - r.orig) < 1e-9 for r in back.collect())


def test_rolling_mean_tail_repeats(spark):
    xs = [float(x) for x in (3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5)]
    df = spark.createDataFrame([(1, i, i * 10, x, (i + 1) * 10 if i + 1 < len(xs) else None) for i, x in enumerate(xs)], "k long, i long, t_ms long, x double, next_t long")
    got = {r.i: r.mean for r in sr.rolling_mean(df, "k", "x", 5, size=4).collect()}
    for i in range(len(xs)):
        e = min(i + 2, len(xs) - 1)
        part = xs[max(0, e - 4):e + 1]
        assert abs(got[i] - sum(part) / len(part)) < 1e-9


def test_affine_scan_equals_loop(spark):
    xs = [(1, i, float(i % 7)) for i in range(50)]
    df = spark.createDataFrame(xs, "k long, i long, x double")
    got = {r.i: r.value for r in sr.affine_scan(df, ["k"], ["i"], F.floor(F.col("i") / 6), F.lit(0.75), F.col("x") * 0.25, 2.0).collect()}
    s = 2.0
    for _, i, x in xs:
        s = 0.75 * s + 0.25 * x
        assert abs(got[i] - s) < 1e-9


def test_transcript_alignment(spark):
    row = [(1, ["hello", "big", "world"], [0, 400, 800], ["Hello", "new", "world"])]
    df = spark.createDataFrame(row, "id long, old array<string>, t_ms array<long>, new array<string>")
    got = sorted((r.t_ms, r.word, r.hidden) for r in cp.align_transcripts(df, "id").collect())
    assert got == [(0, "Hello new", False), (400, None, True)]


def test_link_tracks_keeps_two_seats_apart(spark):
    rows = [(1, 0, i, i * 10, 100.0 + i if i % 2 == 0 else 400.0 - i) for i in range(12)]
    df = spark.createDataFrame(rows, "series_id long, shot long, seq long, t_ms long, x double")
    got = {r.seq: r.track for r in sr.link_tracks(df, "series_id", 58.8).collect()}
    assert {got[i] for i in range(0, 12, 2)} == {0} and {got[i] for i in range(1, 12, 2)} == {1}


def test_freeze_holds_and_rejoins(spark):
    rows = [(1, i, i * 1000, float(i), False, i, 0, (i + 1) * 1000 if i < 9 else None) for i in range(10)]
    df = spark.createDataFrame(rows, "series_id long, seq long, t_ms long, x double, cut boolean, i long, shot long, next_t long")
    holds = spark.createDataFrame([(1, 1, 2500, 4500)], "series_id long, hold_id long, a long, b long")
    got = sorted((r.t_ms, r.x, r.held) for r in sr.freeze_spans(df, holds, "series_id", 350).collect())
    assert (2500, 2.5, True) in got and (4500, 2.5, True) in got
    assert [t for t, _, h in got if not h] == [0, 1000, 2000, 5000, 6000, 7000, 8000, 9000]


def test_scan_keeps_null_keys(spark):
    rows = [(None, 1, 5), (None, 40, 6), (1, 1, 7), (1, None, 8), (1, 90, 9)]
    df = spark.createDataFrame(rows, "k long, t long, v long")
    out = scan(df, ["k"], ["t", "v"], F.floor(F.col("t") / 30), total=running_sum(F.col("v"))).collect()
    assert {(r.k, r.t): r.total for r in out} == {(None, 1): 5, (None, 40): 11, (1, None): 8, (1, 1): 15, (1, 90): 24}


def test_next_free_name_has_no_end(spark):
    df = spark.createDataFrame([(1, "Outro")] + [(1, f"outro {n}") for n in range(2, 46)] + [(2, "Outro 2")], "owner long, name string")
    assert {r.owner: r.name for r in ct.next_free_name(df, "owner", "name").collect()} == {1: "Outro 46", 2: "Outro"}


def test_quotes_of_any_length(spark, tmp_path):
    texts = [(1, "Alpha beta, gamma delta epsilon zeta"), (2, "nothing here"), (3, None)]
    quotes = [(1, "beta gamma delta"), (2, "alpha beta gamma delta epsilon"), (3, "mma del"), (4, "zeta"), (5, "ab"), (6, "ha"), (7, "eta g"), (8, "missing words")]
    spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "'en' lang", "'s' source", "0L n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(quotes, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.item_id, r.doc_id) for r in queries()["b21_quote_in_note"](spark, str(tmp_path)).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 1), (7, 1)}


def test_alignment_of_a_long_pair(spark):
    old = [f"w{i % 900}" if i % 3 else "the" for i in range(18_000)]
    new = [w for i, w in enumerate(old) if i % 50]
    new[100:100] = ["brand", "new"]
    df = spark.createDataFrame([(1, old, list(range(0, 400 * len(old), 400)), new)], "id long, old array<string>, t_ms array<long>, new array<string>")
    got = cp.align_transcripts(df, "id").collect()
    assert 360 <= len(got) <= 400 and sum("brand new" in (r.word or "") for r in got) == 1


def test_spans_of_more_than_sixty_sentences(spark):
    s = F.transform(F.sequence(F.lit(0), F.lit(299)), lambda i: F.struct((i * 100).alias("start_ms"), (i * 100 + 100).alias("end_ms")))
    d = spark.range(1).select(s.alias("s"))
    grown = mining.fit_span(F.col("s"), F.lit(100), F.lit(101), F.lit(100), 20000, 45000)
    cut = mining.fit_span(F.col("s"), F.lit(0), F.lit(299), F.lit(150), 2000, 10000)
    led = mining.lead_up(F.col("s"), F.struct(F.lit(200).alias("lo"), F.lit(299).alias("hi")), F.lit(20100), 45000)
    r = d.select(grown.alias("a"), cut.alias("b"), led.alias("c")).first()
    assert (tuple(r.a), tuple(r.b), r.c) == ((100, 299), (150, 249), 176)


def test_lines_are_timed_across_blocks(spark):
    from chronoweave.plans.views import BLOCK, timed_lines
    n = 3 * BLOCK + 5
    text = "\n".join(" ".join(["w"] * (1 + i % 4)) + ("\n \n" if i % 7 == 0 else "") for i in range(n))
    got = spark.createDataFrame([(text,), ("",), ("\n \n",), (None,)], "t string").select(timed_lines(F.col("t")).alias("c")).collect()
    w0, want = 0, []
    for i in range(n):
        k = 1 + i % 4
        start = w0 * 400 + i * 900
        want.append((i, start, start + k * 400, w0, k))
        w0 += k
    assert [tuple(c)[:5] for c in got[0].c] == want
    assert [r.c for r in got[1:]] == [[], [], None]


def test_clips_reach_the_end_of_a_transcript(spark, sf):
    from chronoweave.plans import views
    from chronoweave.plans.caption_plans import clip_words
    last = views.words(spark, sf).groupBy("project_id").agg(F.max("t_ms").alias("t")).where("t > 3000")
    seen = clip_words(spark, sf).groupBy("project_id").agg(F.max("t_ms").alias("s"))
    assert last.join(seen, "project_id", "left").where("s IS NULL OR s <> t").count() == 0


def test_update_mode_keeps_the_latest_batch(spark, tmp_path):
    from chronoweave.streaming import jobs as sj
    src = str(tmp_path / "in")
    for part in ([(1, 1, "a"), (2, 5, "b")], [(1, 3, "c")], [(1, 2, "x"), (3, 1, "d")]):
        spark.createDataFrame(part, "k long, rev long, s string").coalesce(1).write.mode("append").parquet(src)
    log = spark.readStream.schema("k long, rev long, s string").option("maxFilesPerTrigger", 1).parquet(src)
    out = sj.run_update(sj.latest_status(log, "k", "rev", ["s"]), ["k"])
    assert sorted(map(tuple, out.collect())) == [(1, 3, "c"), (2, 5, "b"), (3, 1, "d")]
