"""Queries over the interval algebra (owners are event users; one owner may be hot)."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweave.functions.numeric import half_up, half_up_sql
from chronoweave.operators import intervals as iv
from chronoweave.operators.scans import previous, scan
from chronoweave.operators.staging import stage
from chronoweave.plans import views
from chronoweave.plans.registry import query

K = ["owner_id"]
LO, HI = iv.DAY_MS, 29 * iv.DAY_MS
TRACK_VERSION = 16
MERGED = f"""
  m1 AS (SELECT owner_id, span_id, greatest({LO}, start_ms) AS s, least({HI}, end_ms) AS e FROM v_spans WHERE enabled AND lane = 'click'),
  m2 AS (SELECT *, max(e) OVER (PARTITION BY owner_id ORDER BY s, e, span_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM m1 WHERE e - s >= 120),
  m3 AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY owner_id ORDER BY s, e, span_id) AS isl FROM m2),
  merged AS (SELECT owner_id, min(s) AS start_ms, max(e) AS end_ms FROM m3 GROUP BY owner_id, isl)"""
KEPT = MERGED + f""",
  k1 AS (SELECT owner_id, coalesce(lag(end_ms) OVER (PARTITION BY owner_id ORDER BY start_ms), {LO}) AS start_ms, start_ms AS end_ms FROM merged
         UNION ALL SELECT owner_id, max(end_ms), {HI} FROM merged GROUP BY owner_id),
  k2 AS (SELECT * FROM k1 WHERE end_ms - start_ms >= 250),
  kept AS (SELECT * FROM k2 UNION ALL SELECT DISTINCT owner_id, {LO}, {HI} FROM v_spans WHERE owner_id NOT IN (SELECT owner_id FROM k2))"""
SPEED = f"""
  s1 AS (SELECT owner_id, span_id, lane, greatest({LO}, start_ms) AS s, least({HI}, end_ms) AS e FROM v_spans WHERE lane IN ('view','purchase','signup')),
  s2 AS (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY s, span_id) AS rn FROM s1 WHERE e - s >= 150),
  s3 AS (SELECT owner_id, span_id, lane, s, e, rn, TRUE AS keep, e AS last FROM s2 WHERE rn = 1
         UNION ALL SELECT n.owner_id, n.span_id, n.lane, n.s, n.e, n.rn, n.s >= r.last, CASE WHEN n.s >= r.last THEN n.e ELSE r.last END
         FROM s3 r JOIN s2 n ON n.owner_id = r.owner_id AND n.rn = r.rn + 1),
  speed AS (SELECT owner_id, span_id, s AS start_ms, e AS end_ms,
            CASE lane WHEN 'view' THEN 0.5::DOUBLE WHEN 'purchase' THEN 2::DOUBLE ELSE 0::DOUBLE END AS rate FROM s3 WHERE keep)"""
PIECES = KEPT + "," + SPEED + """,
  p1 AS (SELECT k.owner_id, k.start_ms AS ws, k.end_ms AS we, greatest(k.start_ms, o.start_ms) AS s, least(k.end_ms, o.end_ms) AS e, o.rate
         FROM kept k JOIN speed o ON o.owner_id = k.owner_id AND o.start_ms < k.end_ms AND o.end_ms > k.start_ms),
  p2 AS (SELECT owner_id, ws, we, coalesce(lag(e) OVER (PARTITION BY owner_id, ws, we ORDER BY s), ws) AS s, s AS e FROM p1
         UNION ALL SELECT owner_id, ws, we, max(e), we FROM p1 GROUP BY owner_id, ws, we
         UNION ALL SELECT owner_id, start_ms, end_ms, start_ms, end_ms FROM kept k
           WHERE NOT EXISTS (SELECT 1 FROM p1 WHERE p1.owner_id = k.owner_id AND p1.ws = k.start_ms)),
  pieces AS (SELECT owner_id, s AS start_ms, e AS end_ms, rate FROM p1 WHERE e > s
             UNION ALL SELECT owner_id, s, e, NULL FROM p2 WHERE e > s),
  lens AS (SELECT *, CASE WHEN coalesce(rate, 1) > 0 THEN (end_ms - start_ms) / coalesce(rate, 1::DOUBLE) ELSE (end_ms - start_ms)::DOUBLE END AS len FROM pieces),
  clock AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY owner_id ORDER BY start_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS out_before,
            row_number() OVER (PARTITION BY owner_id ORDER BY start_ms) - 1 AS idx FROM lens),
  totals AS (SELECT owner_id, max(out_before + len) AS total, max(end_ms) AS last_ms FROM clock GROUP BY owner_id)"""
LOCATED = PIECES + """,
  probes AS (SELECT owner_id, span_id AS probe_id, start_ms AS t FROM v_spans),
  hit AS (SELECT p.owner_id, p.probe_id, p.t, min(c.idx) AS idx FROM probes p LEFT JOIN clock c ON c.owner_id = p.owner_id AND c.end_ms >= p.t GROUP BY ALL),
  located AS (SELECT h.owner_id, h.probe_id, h.t, c.start_ms AS ws, c.idx AS widx, coalesce(c.rate, 1::DOUBLE) AS r, c.out_before, t.total, t.last_ms
              FROM hit h JOIN totals t ON t.owner_id = h.owner_id LEFT JOIN clock c ON c.owner_id = h.owner_id AND c.idx = h.idx)"""


def cut_spans(spark, sf):
    return views.spans(spark, sf).filter("lane = 'click'")


def merged(spark, sf):
    m = iv.merge_intervals(cut_spans(spark, sf), K, "start_ms", "end_ms", "span_id", LO, HI, enabled=F.col("enabled"))
    return stage(m, "merged")


def kept(spark, sf):
    return stage(iv.complement(views.spans(spark, sf), merged(spark, sf), K, "start_ms", "end_ms", LO, HI), "kept")


def speed(spark, sf):
    s = views.spans(spark, sf).filter(F.col("lane").isin("view", "purchase", "signup"))
    s = s.select("owner_id", "span_id", "lane", F.greatest(F.lit(LO), "start_ms").alias("start_ms"), F.least(F.lit(HI), "end_ms").alias("end_ms"))
    s = s.filter(F.col("end_ms") - F.col("start_ms") >= iv.MIN_SPEED_MS)
    s = stage(iv.drop_overlapping(s, K, "start_ms", "end_ms", "span_id", ["lane"]), "speed")
    kind = F.when(F.col("lane") == "signup", "freeze").otherwise(F.col("lane"))
    return s.select("owner_id", "span_id", "start_ms", "end_ms",
                    iv.speed_rate(kind, F.when(F.col("lane") == "view", 0.5).otherwise(2.0)).alias("rate"))


def pieces(spark, sf):
    return stage(iv.split_by_overlay(kept(spark, sf), speed(spark, sf), K, "start_ms", "end_ms", "rate"), "pieces")


def clock(spark, sf):
    return stage(iv.output_clock(pieces(spark, sf), K, "start_ms", "end_ms", "rate"), "clock")


def probes(spark, sf):
    return views.spans(spark, sf).select("owner_id", F.col("span_id").alias("probe_id"), F.col("start_ms").alias("t"))


def located(spark, sf):
    return iv.locate_on_windows(probes(spark, sf), clock(spark, sf), K, "t", "probe_id", "start_ms", "end_ms", "rate")


@query("e1_merge_intervals", MERGED + " SELECT * FROM merged", "v_spans")
def q_merge(spark, sf):
    return merged(spark, sf).select("owner_id", "start_ms", "end_ms")


@query("e1_merge_padded", f"""
  m1 AS (SELECT owner_id, span_id, greatest({LO}, start_ms - 400) AS s, least({HI}, end_ms + 400) AS e FROM v_spans WHERE lane = 'view'),
  m2 AS (SELECT *, max(e) OVER (PARTITION BY owner_id ORDER BY s, e, span_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM m1 WHERE e - s > 50),
  m3 AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY owner_id ORDER BY s, e, span_id) AS isl FROM m2)
  SELECT owner_id, min(s) AS start_ms, max(e) AS end_ms FROM m3 GROUP BY owner_id, isl""", "v_spans")
def q_merge_padded(spark, sf):
    s = views.spans(spark, sf).filter("lane = 'view'")
    return iv.merge_intervals(s, K, "start_ms", "end_ms", "span_id", LO, HI, min_len=50, pad=400, strict_min=True).drop("island")


@query("e2_complement", KEPT + " SELECT * FROM kept", "v_spans")
def q_complement(spark, sf):
    return kept(spark, sf)


@query("e3_drop_overlapping", SPEED + " SELECT * FROM speed", "v_spans")
def q_drop(spark, sf):
    return speed(spark, sf)


@query("e4_exclusive_order", """
  o1 AS (SELECT owner_id, lane, span_id, start_ms, end_ms, row_number() OVER (PARTITION BY owner_id, lane ORDER BY start_ms, end_ms, span_id) AS rn FROM v_spans),
  o2 AS (SELECT owner_id, lane, span_id, rn, start_ms AS s, end_ms AS e, end_ms - start_ms >= 50 AS keep, CASE WHEN end_ms - start_ms >= 50 THEN end_ms ELSE -1 END AS last FROM o1 WHERE rn = 1
         UNION ALL SELECT n.owner_id, n.lane, n.span_id, n.rn, greatest(n.start_ms, r.last), n.end_ms, n.end_ms - greatest(n.start_ms, r.last) >= 50,
           CASE WHEN n.end_ms - greatest(n.start_ms, r.last) >= 50 THEN n.end_ms ELSE r.last END
         FROM o2 r JOIN o1 n ON n.owner_id = r.owner_id AND n.lane = r.lane AND n.rn = r.rn + 1)
  SELECT owner_id, lane, span_id, s AS start_ms, e AS end_ms FROM o2 WHERE keep""", "v_spans")
def q_exclusive(spark, sf):
    return iv.exclusive_order(views.spans(spark, sf), ["owner_id", "lane"], "start_ms", "end_ms", "span_id").select(
        "owner_id", "lane", "span_id", "start_ms", "end_ms")


@query("e5_split_by_overlay", PIECES + " SELECT owner_id, start_ms, end_ms, rate FROM pieces", "v_spans")
def q_split(spark, sf):
    return pieces(spark, sf)


@query("e6_window_length", PIECES + " SELECT owner_id, start_ms, end_ms, len FROM lens", "v_spans")
def q_length(spark, sf):
    return pieces(spark, sf).select("owner_id", "start_ms", "end_ms", iv.window_length(F.col("start_ms"), F.col("end_ms"), F.col("rate")).alias("len"))


@query("e7_output_duration", PIECES + " SELECT owner_id, sum(len) AS output_ms FROM lens GROUP BY owner_id", "v_spans")
def q_duration(spark, sf):
    return iv.output_duration(pieces(spark, sf), K, "start_ms", "end_ms", "rate")


@query("e8_source_to_output", LOCATED + """ SELECT owner_id, probe_id, t, CASE WHEN widx IS NULL THEN total WHEN t < ws THEN out_before
  ELSE out_before + (t - ws) / CASE WHEN r > 0 THEN r ELSE 1 END END AS output_ms FROM located""", "v_spans")
def q_s2o(spark, sf):
    return located(spark, sf).select("owner_id", "probe_id", "t", "output_ms")


@query("e9_output_to_source", PIECES + """,
  probes AS (SELECT owner_id, span_id AS probe_id, start_ms / 2e0 AS out_ms FROM v_spans),
  hit AS (SELECT p.owner_id, p.probe_id, p.out_ms, min(c.idx) AS idx FROM probes p LEFT JOIN clock c ON c.owner_id = p.owner_id AND c.out_before + c.len >= p.out_ms GROUP BY ALL)
  SELECT h.owner_id, h.probe_id, h.out_ms, CASE WHEN c.idx IS NULL THEN t.last_ms::DOUBLE
    ELSE c.start_ms + greatest(0, h.out_ms - c.out_before) * CASE WHEN coalesce(c.rate, 1) > 0 THEN coalesce(c.rate, 1::DOUBLE) ELSE 1 END END AS source_ms
  FROM hit h JOIN totals t ON t.owner_id = h.owner_id LEFT JOIN clock c ON c.owner_id = h.owner_id AND c.idx = h.idx""", "v_spans")
def q_o2s(spark, sf):
    p = probes(spark, sf).select("owner_id", "probe_id", (F.col("t") / 2.0).alias("out_ms"))
    return iv.output_to_source(p, clock(spark, sf), K, "out_ms", "probe_id", "start_ms", "end_ms", "rate")


@query("e10_next_kept", LOCATED + " SELECT owner_id, probe_id, t, CASE WHEN widx IS NULL THEN last_ms WHEN t < ws THEN ws ELSE t END AS next_kept_ms FROM located", "v_spans")
def q_next(spark, sf):
    return located(spark, sf).select("owner_id", "probe_id", "t", "next_kept_ms")


@query("e11_rate_at", LOCATED + """ SELECT owner_id, probe_id, t, CASE WHEN widx IS NULL OR t < ws THEN -1 ELSE widx END AS window_index,
  CASE WHEN widx IS NULL OR t < ws THEN 1::DOUBLE ELSE r END AS rate_at FROM located""", "v_spans")
def q_rate(spark, sf):
    return located(spark, sf).select("owner_id", "probe_id", "t", "window_index", "rate_at")


GAPS = f"""
  g0 AS (SELECT owner_id, span_id, start_ms AS t FROM v_spans WHERE start_ms >= {LO} - 50 AND start_ms <= {HI}),
  g1 AS (SELECT owner_id, coalesce(lag(t) OVER (PARTITION BY owner_id ORDER BY t, span_id), {LO}) AS start_ms, t AS end_ms FROM g0
         UNION ALL SELECT owner_id, max(t), {HI} FROM g0 GROUP BY owner_id
         UNION ALL SELECT DISTINCT owner_id, {LO}, {HI} FROM v_spans WHERE owner_id NOT IN (SELECT owner_id FROM g0)),
  gaps AS (SELECT * FROM g1 WHERE end_ms - start_ms >= 14400000)"""
PAIRS = """
  l0 AS (SELECT owner_id, span_id, start_ms AS t, lane FROM v_spans WHERE lane IN ('view', 'purchase')),
  l1 AS (SELECT *, last_value(CASE WHEN lane = 'view' THEN t END IGNORE NULLS) OVER w AS open_t,
           last_value(CASE WHEN lane = 'view' THEN span_id END IGNORE NULLS) OVER w AS open_id,
           last_value(CASE WHEN lane = 'purchase' THEN span_id END IGNORE NULLS) OVER w AS close_id FROM l0
         WINDOW w AS (PARTITION BY owner_id ORDER BY t, span_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  pairs AS (SELECT owner_id, open_t AS start_ms, t AS end_ms FROM l1 WHERE lane = 'purchase' AND open_t IS NOT NULL AND (close_id IS NULL OR open_id > close_id))"""


def gaps(spark, sf):
    return stage(iv.onset_gaps(views.spans(spark, sf), K, "start_ms", "span_id", LO, HI, min_gap=14_400_000), "gaps")


def pairs(spark, sf):
    return stage(iv.pair_start_end(views.spans(spark, sf), K, "start_ms", "span_id", F.col("lane") == "view", F.col("lane") == "purchase"), "pairs")


@query("e12_onset_gaps", GAPS + " SELECT * FROM gaps", "v_spans")
def q_gaps(spark, sf):
    return gaps(spark, sf)


@query("e13_pair_start_end", PAIRS + " SELECT * FROM pairs", "v_spans")
def q_pairs(spark, sf):
    return pairs(spark, sf)


NUMBERED = """
  i2 AS (SELECT owner_id, g, greatest({lo}, s + 80) AS start_ms, least({hi}, e - 120) AS end_ms FROM i1),
  i3 AS (SELECT * FROM i2 WHERE end_ms - start_ms >= 180)
  SELECT owner_id, 'pause' || row_number() OVER (PARTITION BY owner_id ORDER BY g, start_ms, end_ms) AS id, start_ms, end_ms, end_ms - start_ms AS saves_ms FROM i3
""".format(lo=LO, hi=HI)


@query("e14_intersect_spans", GAPS + "," + PAIRS + """,
  i1 AS (SELECT g.owner_id, g.start_ms AS g, greatest(g.start_ms, p.start_ms) AS s, least(g.end_ms, p.end_ms) AS e
         FROM gaps g JOIN pairs p ON p.owner_id = g.owner_id WHERE least(g.end_ms, p.end_ms) - greatest(g.start_ms, p.start_ms) >= 380),""" + NUMBERED, "v_spans")
def q_pauses(spark, sf):
    return iv.pause_candidates(gaps(spark, sf), pairs(spark, sf), K, LO, HI)


@query("e14_gaps_without_silence", GAPS + ", i1 AS (SELECT owner_id, start_ms AS g, start_ms + 320 AS s, end_ms AS e FROM gaps)," + NUMBERED, "v_spans")
def q_pauses_blind(spark, sf):
    return iv.pause_candidates(gaps(spark, sf), None, K, LO, HI)


SPEECH = """
  t0 AS (SELECT owner_id, span_id, start_ms AS s, lead(start_ms) OVER (PARTITION BY owner_id ORDER BY start_ms, span_id) AS nx FROM v_spans),
  t1 AS (SELECT owner_id, span_id, s, CASE WHEN nx - s < 7200000 THEN nx ELSE s + 600000 END AS e FROM t0),
  t2 AS (SELECT *, max(e) OVER (PARTITION BY owner_id ORDER BY s, e, span_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM t1),
  t3 AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY owner_id ORDER BY s, e, span_id) AS isl FROM t2),
  speech AS (SELECT owner_id, min(s) AS start_ms, max(e) AS end_ms FROM t3 GROUP BY owner_id, isl)"""


def speech(spark, sf):
    return iv.speech_spans(views.spans(spark, sf), K, "start_ms", "span_id", gap=7_200_000, tail=600_000)


@query("e15_speech_spans", SPEECH + " SELECT * FROM speech", "v_spans")
def q_speech(spark, sf):
    return speech(spark, sf)


@query("e16_covered_at", MERGED + """
  SELECT owner_id, span_id AS probe_id, start_ms AS t FROM v_spans v WHERE EXISTS (SELECT 1 FROM merged m WHERE m.owner_id = v.owner_id AND m.start_ms <= v.start_ms AND v.start_ms < m.end_ms)""", "v_spans")
def q_covered(spark, sf):
    return iv.covered_at(probes(spark, sf), merged(spark, sf), K, "t", "start_ms", "end_ms")


@query("e17_spans_in_window", MERGED + """
  SELECT w.owner_id, w.start_ms AS w_start, w.end_ms AS w_end, s.span_id, greatest(0, s.start_ms - w.start_ms) AS local_start, least(w.end_ms - w.start_ms, s.end_ms - w.start_ms) AS local_end
  FROM merged w JOIN v_spans s ON s.owner_id = w.owner_id AND s.lane = 'purchase' AND s.start_ms - 1000 < w.end_ms AND s.end_ms + 2000 > w.start_ms""", "v_spans")
def q_in_window(spark, sf):
    w = merged(spark, sf).select("owner_id", F.col("start_ms").alias("w_start"), F.col("end_ms").alias("w_end"))
    s = views.spans(spark, sf).filter("lane = 'purchase'").select("owner_id", "span_id", "start_ms", "end_ms")
    return iv.spans_in_window(w, s, K, "w_start", "w_end", "start_ms", "end_ms", 1000, 2000).drop("start_ms", "end_ms")


@query("e18_active_at", """
  SELECT p.owner_id, p.span_id AS probe_id, s.span_id, s.start_ms, s.score FROM v_spans p JOIN v_spans s ON s.owner_id = p.owner_id AND s.enabled
   AND s.start_ms <= p.start_ms AND p.start_ms < s.end_ms WHERE p.lane = 'error'""", "v_spans")
def q_active(spark, sf):
    p = views.spans(spark, sf).filter("lane = 'error'").select("owner_id", F.col("span_id").alias("probe_id"), F.col("start_ms").alias("t"))
    s = views.spans(spark, sf).filter("enabled").select("owner_id", "span_id", "start_ms", "end_ms", "score")
    return iv.active_at(p, s, K, "t", "start_ms", "end_ms").select("owner_id", "probe_id", "span_id", "start_ms", "score")


@query("e19_padded_span_progress", f"""
  s AS (SELECT owner_id, span_id, start_ms, end_ms, CASE WHEN lane = 'click' THEN 0 ELSE 300000 END AS tin, CASE WHEN lane = 'view' THEN 0 ELSE 600000 END AS tout FROM v_spans WHERE enabled),
  h AS (SELECT p.owner_id, p.span_id AS probe_id, p.start_ms AS t, s.*, row_number() OVER (PARTITION BY p.span_id ORDER BY s.span_id) AS rn FROM v_spans p
        JOIN s ON s.owner_id = p.owner_id AND s.start_ms - tin <= p.start_ms AND p.start_ms < s.end_ms + tout WHERE p.lane = 'error')
  SELECT owner_id, probe_id, span_id, {half_up_sql('(t - (start_ms - tin)) / greatest(1e1, (end_ms + tout - (start_ms - tin))::DOUBLE)', 6)} AS progress,
    {half_up_sql('CASE WHEN tin > 0 THEN least(1e0, (t - (start_ms - tin)) / tin) ELSE 1e0 END', 6)} AS in_u,
    {half_up_sql('CASE WHEN tout > 0 THEN greatest(0e0, (t - end_ms) / tout) ELSE 0e0 END', 6)} AS out_u FROM h WHERE rn = 1""", "v_spans")
def q_progress(spark, sf):
    p = views.spans(spark, sf).filter("lane = 'error'").select("owner_id", F.col("span_id").alias("probe_id"), F.col("start_ms").alias("t"))
    s = views.spans(spark, sf).filter("enabled").select(
        "owner_id", "span_id", "start_ms", "end_ms", F.when(F.col("lane") == "click", 0).otherwise(300_000).alias("tin"),
        F.when(F.col("lane") == "view", 0).otherwise(600_000).alias("tout"))
    s = s.withColumn("ps", F.col("start_ms") - F.col("tin")).withColumn("pe", F.col("end_ms") + F.col("tout"))
    hit = iv.active_at(p, s, K, "t", "ps", "pe")
    first = hit.groupBy("owner_id", "probe_id").agg(F.min_by(F.struct("t", "span_id", "start_ms", "end_ms", "tin", "tout"), "span_id").alias("f"))
    out = iv.span_progress(first.select("owner_id", "probe_id", "f.*"), "t", "start_ms", "end_ms", F.col("tin"), F.col("tout"))
    return out.select("owner_id", "probe_id", "span_id", *[half_up(F.col(c), 6).alias(c) for c in ("progress", "in_u", "out_u")])




@query("e20_fade_level", f"""
  h AS (SELECT p.owner_id, p.span_id AS probe_id, s.span_id, p.start_ms AS t, s.start_ms AS a, s.end_ms AS b, (s.end_ms - s.start_ms)::DOUBLE AS sp FROM v_spans p
    JOIN v_spans s ON s.owner_id = p.owner_id AND s.lane = 'purchase' AND s.start_ms <= p.start_ms AND p.start_ms < s.end_ms),
  f AS (SELECT *, greatest(0e0, least(6e5, sp / 2e0)) AS fi, greatest(0e0, least(least(12e2, sp / 6e0), sp / 2e0)) AS fo FROM h)
  SELECT owner_id, probe_id, span_id, {half_up_sql('CASE WHEN sp <= 50 THEN 0e0 ELSE greatest(0e0, (CASE WHEN fi > 5 THEN least(1e0, (t - a) / fi) ELSE 1e0 END) * (CASE WHEN fo > 5 THEN least(1e0, (b - t) / fo) ELSE 1e0 END)) * 22e-2 END', 6)} AS level FROM f""", "v_spans")
def q_fade(spark, sf):
    p = probes(spark, sf)
    s = views.spans(spark, sf).filter("lane = 'purchase'").select("owner_id", "span_id", "start_ms", "end_ms")
    level = iv.fade_level(F.col("t"), F.col("start_ms"), F.col("end_ms"), F.lit(0.22), F.lit(600_000.0), F.lit(None).cast("double"))
    return iv.active_at(p, s, K, "t", "start_ms", "end_ms").select("owner_id", "probe_id", "span_id", half_up(level, 6).alias("level"))


@query("e21_loop_position", "SELECT span_id, (span_id + greatest(0, end_ms - start_ms)) % greatest(500, span_id * 7 % 100000) AS pos_ms FROM v_spans", "v_spans")
def q_loop(spark, sf):
    s = views.spans(spark, sf)
    return s.select("span_id", iv.loop_position(F.col("end_ms"), F.col("start_ms"), F.col("span_id"), F.col("span_id") * 7 % 100000).alias("pos_ms"))


@query("e22_spans_past_end", f"SELECT owner_id, bool_or(CASE WHEN lane = 'purchase' THEN start_ms > {HI} - 20 ELSE end_ms > {HI} + 20 END) AS past_end FROM v_spans GROUP BY owner_id", "v_spans")
def q_past(spark, sf):
    s = views.spans(spark, sf)
    return s.groupBy("owner_id").agg(F.bool_or(F.when(F.col("lane") == "purchase", F.col("start_ms") > HI - 20).otherwise(F.col("end_ms") > HI + 20)).alias("past_end"))


@query("e23_nearest_snap", """
  p AS (SELECT owner_id, span_id AS probe_id, start_ms AS t FROM v_spans WHERE lane = 'click'),
  g AS (SELECT p.probe_id, arg_min(s.start_ms, struct_pack(d := abs(s.start_ms - p.t), t := s.start_ms)) AS best FROM p
        JOIN v_spans s ON s.owner_id = p.owner_id AND s.lane = 'view' AND abs(s.start_ms - p.t) < 3600000 GROUP BY p.probe_id)
  SELECT p.owner_id, p.probe_id, p.t, coalesce(g.best, p.t) AS snapped FROM p LEFT JOIN g ON g.probe_id = p.probe_id""", "v_spans")
def q_snap(spark, sf):
    s = views.spans(spark, sf)
    p = s.filter("lane = 'click'").select("owner_id", F.col("span_id").alias("probe_id"), F.col("start_ms").alias("t"))
    g = s.filter("lane = 'view'").select("owner_id", F.col("start_ms").alias("g"))
    return iv.snap_nearest(p, g, K, "t", "probe_id", "g", within=3_600_000)


@query("e24_covers", """
  SELECT i.owner_id, i.span_id AS inner_id, o.span_id AS outer_id FROM v_spans i JOIN v_spans o ON o.owner_id = i.owner_id AND o.lane = 'view'
   AND o.start_ms <= i.start_ms + 50 AND o.end_ms >= i.end_ms - 50 WHERE i.lane = 'click'""", "v_spans")
def q_covers(spark, sf):
    s = views.spans(spark, sf)
    i = s.filter("lane = 'click'").select("owner_id", F.col("span_id").alias("inner_id"), F.col("start_ms").alias("i_s"), F.col("end_ms").alias("i_e"))
    o = s.filter("lane = 'view'").select("owner_id", F.col("span_id").alias("outer_id"), F.col("start_ms").alias("o_s"), F.col("end_ms").alias("o_e"))
    return iv.covering_pairs(o, i, K, ("o_s", "o_e"), ("i_s", "i_e")).select("owner_id", "inner_id", "outer_id")


@query("e24_track_reuse", """
  w AS (SELECT owner_id, span_id AS window_id, start_ms AS w_start, end_ms AS w_end, CASE WHEN score >= 2e1 THEN 'wide' ELSE 'close' END AS mode FROM v_spans WHERE lane = 'click'),
  c AS (SELECT owner_id, span_id AS track_id, start_ms AS c_start, end_ms AS c_end, CASE WHEN span_id % 2 = 0 THEN 'wide' ELSE 'close' END AS mode FROM v_spans WHERE lane = 'view' AND score >= 5),
  h AS (SELECT w.window_id, c.track_id, row_number() OVER (PARTITION BY w.window_id ORDER BY c.c_end - c.c_start, c.track_id) AS rn FROM w JOIN c ON c.owner_id = w.owner_id AND c.mode = w.mode AND c.c_start <= w.w_start + 50 AND c.c_end >= w.w_end - 50)
  SELECT w.owner_id, w.window_id, w.mode, h.track_id FROM w LEFT JOIN h ON h.window_id = w.window_id AND h.rn = 1""", "v_spans")
def q_reuse(spark, sf):
    s = views.spans(spark, sf)
    w = s.filter("lane = 'click'").select("owner_id", F.col("span_id").alias("window_id"), F.col("start_ms").alias("w_start"), F.col("end_ms").alias("w_end"), F.when(F.col("score") >= 20.0, "wide").otherwise("close").alias("mode"))
    c = s.filter("lane = 'view'").select("owner_id", F.col("span_id").alias("track_id"), F.col("start_ms").alias("c_start"), F.col("end_ms").alias("c_end"), F.when(F.col("span_id") % 2 == 0, "wide").otherwise("close").alias("c_mode"),
                                         F.when(F.col("score") >= 5, TRACK_VERSION).otherwise(TRACK_VERSION - 1).alias("c_version"))
    return iv.reusable(w, c, K, "window_id", "track_id", TRACK_VERSION).select("owner_id", "window_id", "mode", "track_id")


@query("e24_kept_track", """
  n AS (SELECT span_id, lane, enabled, start_ms AS s, end_ms AS e, lag(start_ms) OVER w AS os, lag(end_ms) OVER w AS oe, lag(lane) OVER w AS ol FROM v_spans WINDOW w AS (PARTITION BY owner_id ORDER BY start_ms, span_id)),
  f AS (SELECT *, ol = lane AND oe IS NOT NULL AS same, os <= s + 50 AND oe >= e - 50 AS wide, s <= os + 50 AND e >= oe - 50 AS back FROM n),
  a AS (SELECT *, CASE WHEN same AND wide AND NOT back THEN 'keep' WHEN same AND NOT back THEN 'stitch' ELSE 'replace' END AS action FROM f)
  SELECT span_id, action, CASE action WHEN 'keep' THEN os WHEN 'stitch' THEN least(os, s) ELSE s END AS start_ms, CASE action WHEN 'keep' THEN oe WHEN 'stitch' THEN greatest(oe, e) ELSE e END AS end_ms FROM a""", "v_spans")
def q_kept_track(spark, sf):
    old = F.struct("start_ms", "end_ms", "lane")
    s = scan(views.spans(spark, sf), K, ["start_ms", "span_id"], F.floor(F.col("start_ms") / iv.DAY_MS), old=previous(old))
    act, a, b = iv.kept_track(F.col("old.lane") == F.col("lane"), (F.col("old.start_ms"), F.col("old.end_ms")), (F.col("start_ms"), F.col("end_ms")))
    return s.select("span_id", act.alias("action"), a.alias("start_ms"), b.alias("end_ms"))


@query("e25_clip_window", f"""
  c AS (SELECT span_id, greatest(0, CASE WHEN span_id % 3 = 0 THEN start_ms + 60000 ELSE start_ms END) AS s,
          least(CASE WHEN span_id % 4 = 0 THEN end_ms - 60000 ELSE end_ms END, {15 * iv.DAY_MS}) AS e FROM v_spans)
  SELECT span_id, s AS start_ms, e AS end_ms, CASE WHEN s >= {15 * iv.DAY_MS} - 500 THEN 'past_end' WHEN e - s < 200 THEN 'empty' END AS rejected FROM c""", "v_spans")
def q_clip_window(spark, sf):
    s = views.spans(spark, sf)
    a, b, why = iv.clip_window(F.col("start_ms"), F.col("end_ms"), F.when(F.col("span_id") % 3 == 0, F.col("start_ms") + 60000),
                               F.when(F.col("span_id") % 4 == 0, F.col("end_ms") - 60000), F.lit(15 * iv.DAY_MS))
    return s.select("span_id", a.alias("start_ms"), b.alias("end_ms"), why.alias("rejected"))
