"""Queries over sampled series (one series per event user; one of them may be hot)."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweave.functions.numeric import half_up, half_up_sql
from chronoweave.operators import intervals as iv
from chronoweave.operators import joins
from chronoweave.operators import series as sr
from chronoweave.operators.folds import collect_ordered
from chronoweave.operators.staging import stage
from chronoweave.plans import views
from chronoweave.plans.registry import query

K = "series_id"
W = 490.0
HOUR, DAY = 3_600_000, 86_400_000
END = 31 * DAY
IX = """ix AS (SELECT *, row_number() OVER w - 1 AS i, CAST(sum(CAST(cut AS INT)) OVER (PARTITION BY series_id ORDER BY t_ms, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS shot, lead(t_ms) OVER w AS next_t
  FROM v_series WINDOW w AS (PARTITION BY series_id ORDER BY t_ms, seq))"""


def indexed(spark, sf):
    return stage(sr.with_shots(views.series(spark, sf)), "series")


def positions(spark, sf):
    return views.series(spark, sf).withColumn("x100", half_up(F.col("x") * 100)).withColumn("frame", F.floor(F.col("t_ms") / DAY))


def seats_sql(keys, src, p=""):
    return f"""{p}p0 AS (SELECT {keys}, {half_up_sql('x * 100')} AS x100 FROM {src}),
  {p}p1 AS (SELECT *, lag(x100) OVER (PARTITION BY {keys} ORDER BY x100) AS px FROM {p}p0),
  {p}p2 AS (SELECT *, sum(CASE WHEN x100 - px > 4900 THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY x100 ROWS UNBOUNDED PRECEDING) AS seat FROM {p}p1),
  {p}seats AS (SELECT {keys}, CAST(seat AS BIGINT) AS seat, count(*) AS n, sum(x100) / count(*)::DOUBLE / 1e2 AS centre FROM {p}p2 GROUP BY {keys}, seat)"""


SEATS = seats_sql("series_id", "v_series")
ASSIGN = SEATS + """,
  as0 AS (SELECT s.series_id, s.seq, s.t_ms, s.x, s.t_ms // 86400000 AS frame, q.seat, abs(s.x - q.centre) AS d, row_number() OVER (PARTITION BY s.seq ORDER BY abs(s.x - q.centre), q.seat) AS rn FROM v_series s JOIN seats q ON q.series_id = s.series_id),
  asg AS (SELECT * FROM as0 WHERE rn = 1 AND d < 12e-2 * 49e1)"""
GRID = ASSIGN + """,
  ga AS (SELECT series_id, seat, frame, max(x) AS energy, arg_max(x, struct_pack(t := t_ms, s := seq)) AS pos FROM asg GROUP BY ALL),
  grid AS (SELECT q.series_id, q.seat, q.centre, f.frame, coalesce(g.energy, 0e0) AS energy, g.pos FROM seats q JOIN (SELECT series_id, unnest(range(0, max(t_ms) // 86400000 + 1)) AS frame FROM v_series GROUP BY series_id) f ON f.series_id = q.series_id LEFT JOIN ga g ON g.series_id = q.series_id AND g.seat = q.seat AND g.frame = f.frame)"""
SCORED = GRID + f""",
  au AS (SELECT series_id, t_ms // 86400000 AS frame, sum({half_up_sql('x * 100')}) AS level FROM v_series GROUP BY ALL),
  cw AS (SELECT g.*, count(*) OVER w AS cn, corr(g.energy, coalesce(au.level, 0)::DOUBLE) OVER w AS r FROM grid g LEFT JOIN au ON au.series_id = g.series_id AND au.frame = g.frame WINDOW w AS (PARTITION BY g.series_id, g.seat ORDER BY g.frame ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
  cr AS (SELECT *, {half_up_sql('CASE WHEN cn < 3 OR r IS NULL OR isnan(r) THEN 0e0 ELSE greatest(0e0, r) END', 4)} AS corr FROM cw),
  sc AS (SELECT *, {half_up_sql('CASE WHEN sum(energy) OVER f > 1e-6 THEN energy / sum(energy) OVER f ELSE 1e0 / count(*) OVER f END * (35e-2 + 65e-2 * corr)', 6)} AS score FROM cr WINDOW f AS (PARTITION BY series_id, frame))"""


def seats(spark, sf):
    return stage(sr.seats_1d(positions(spark, sf), [K], "x100", 49_000), "seats")


def assigned(spark, sf, s=None):
    return sr.assign_nearest_gated(positions(spark, sf), s if s is not None else seats(spark, sf), [K], "x", W)


def grid(spark, sf):
    s = seats(spark, sf)
    ends = positions(spark, sf).groupBy(K).agg(F.max("frame").alias("last"))
    return sr.seat_grid(assigned(spark, sf, s), s, ends, K, "frame", "x", "x")


def scored(spark, sf):
    level = positions(spark, sf).groupBy(K, "frame").agg(F.sum("x100").alias("level"))
    g = stage(grid(spark, sf), "grid")
    return sr.share_score(sr.sound_correlation(g, level, K, "frame", 7), [K, "frame"], "energy", F.col("corr"))


@query("f1_frame_change", f"""
  WITH l AS (SELECT vec_id, embedding::DOUBLE[] AS v, lag(embedding::DOUBLE[]) OVER (ORDER BY vec_id) AS p FROM embeddings),
  d AS (SELECT vec_id, {half_up_sql('list_sum(list_transform(range(1, len(v) + 1), lambda i: abs(v[i] - p[i]))) / len(v)', 6)} AS diff FROM l)
  SELECT vec_id, CASE WHEN diff IS NOT NULL THEN diff END AS diff, coalesce(diff > 14e-2, FALSE) AS cut FROM d""")
def q_change(spark, sf):
    return sr.frame_change(views.table(spark, sf, "embeddings"), "vec_id", "embedding", 0.14)


@query("f2_mark_cuts", """
  f AS (SELECT series_id, t_ms // 3600000 AS i, bool_or(lane = 'view') AS cut FROM v_series GROUP BY ALL), z AS (SELECT series_id, max(i) AS last FROM f GROUP BY series_id), c AS (SELECT DISTINCT s.series_id, greatest(1, least(last, CAST(ceil(t_ms / 36e5) AS BIGINT))) AS i FROM v_series s JOIN z ON z.series_id = s.series_id WHERE cut)
  SELECT f.series_id, f.i, f.cut OR c.i IS NOT NULL AS cut FROM f LEFT JOIN c ON c.series_id = f.series_id AND c.i = f.i""", "v_series")
def q_mark(spark, sf):
    s = views.series(spark, sf)
    frames = s.groupBy(K, F.floor(F.col("t_ms") / HOUR).alias("i")).agg(F.bool_or(F.col("lane") == "view").alias("cut"))
    return sr.mark_cuts(frames, s.filter("cut"), K, HOUR)


@query("f3_align_cuts", """
  c AS (SELECT series_id, seq, t_ms AS t FROM v_series WHERE cut), g AS (SELECT c.seq, arg_min(s.t_ms, struct_pack(d := abs(s.t_ms - c.t), t := s.t_ms)) AS best FROM c JOIN v_series s ON s.series_id = c.series_id AND s.lane = 'purchase' AND abs(s.t_ms - c.t) < 7200000 GROUP BY c.seq)
  SELECT c.series_id, c.seq, c.t, coalesce(g.best, c.t) AS snapped FROM c LEFT JOIN g ON g.seq = c.seq""", "v_series")
def q_align(spark, sf):
    s = views.series(spark, sf)
    return iv.snap_nearest(s.filter("cut").select(K, "seq", F.col("t_ms").alias("t")), s.filter("lane = 'purchase'").select(K, F.col("t_ms").alias("g")), [K], "t", "seq", "g", within=2 * HOUR)


@query("f4_shots", IX + " SELECT series_id, shot, min(i) AS from_i, max(i) + 1 AS to_i, count(*) AS n FROM ix GROUP BY ALL", "v_series")
def q_shots(spark, sf):
    return sr.shots(sr.with_shots(views.series(spark, sf)))


@query("f5_presence", "SELECT series_id, count(*) AS n, count(*) FILTER (WHERE x > 12e1) AS seen, CASE WHEN count(*) FILTER (WHERE x > 12e1) / count(*)::DOUBLE < 4e-1 THEN 'static' ELSE 'track' END AS mode FROM v_series GROUP BY series_id", "v_series")
def q_presence(spark, sf):
    return sr.presence(views.series(spark, sf), K, F.col("x") > 120.0)


@query("f6_seats_1d", SEATS + f" SELECT series_id, seat, n, {half_up_sql('centre', 6)} AS centre FROM seats", "v_series")
def q_seats(spark, sf):
    return seats(spark, sf).withColumn("centre", half_up(F.col("centre"), 6))


@query("f7_assign_nearest_gated", ASSIGN + " SELECT series_id, seq, seat FROM asg", "v_series")
def q_assign(spark, sf):
    return assigned(spark, sf).select(K, "seq", "seat")


@query("f8_seat_series", GRID + " SELECT series_id, seat, frame, energy, pos FROM grid", "v_series")
def q_grid(spark, sf):
    return grid(spark, sf).select(K, "seat", "frame", "energy", "pos")


@query("f9_carry_forward", GRID + f" SELECT series_id, seat, frame, {half_up_sql('coalesce(last_value(pos IGNORE NULLS) OVER (PARTITION BY series_id, seat ORDER BY frame ROWS UNBOUNDED PRECEDING), centre)', 6)} AS pos FROM grid", "v_series")
def q_carry(spark, sf):
    g = sr.carry_forward(grid(spark, sf), [K, "seat"], "frame", "pos", F.col("centre"))
    return g.select(K, "seat", "frame", half_up(F.col("pos"), 6).alias("pos"))


@query("f10_rolling_mean", IX + f""",
  t AS (SELECT series_id, i, next_t, avg(x) OVER (PARTITION BY series_id ORDER BY i ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS m FROM ix),
  n AS (SELECT series_id, max(i) AS last FROM ix GROUP BY series_id)
  SELECT ix.series_id, ix.i, {half_up_sql('t.m', 6)} AS mean FROM ix JOIN n ON n.series_id = ix.series_id JOIN t ON t.series_id = ix.series_id AND t.i = least(ix.i + 3, n.last)""", "v_series")
def q_rolling(spark, sf):
    return sr.rolling_mean(indexed(spark, sf), K, "x", 7, size=16).select(K, "i", half_up(F.col("mean"), 6).alias("mean"))


@query("f11_windowed_pearson", IX + f""",
  c AS (SELECT series_id, i, count(*) OVER w AS n, corr(x, t_ms % 86400000 / 1e6) OVER w AS r FROM ix WINDOW w AS (PARTITION BY series_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))
  SELECT series_id, i, {half_up_sql('CASE WHEN n < 3 OR r IS NULL OR isnan(r) THEN 0e0 ELSE greatest(0e0, r) END', 4)} AS corr FROM c""", "v_series")
def q_pearson(spark, sf):
    ix = indexed(spark, sf).withColumn("y", (F.col("t_ms") % DAY) / 1e6)
    return sr.windowed_pearson(ix, K, "x", "y", 7, size=16).select(K, "i", half_up(F.col("corr"), 4).alias("corr"))


@query("f12_share_score", SCORED + " SELECT series_id, seat, frame, score FROM sc", "v_series")
def q_share(spark, sf):
    return scored(spark, sf).select(K, "seat", "frame", "score")


HYST = SCORED + """,
  fs AS (SELECT series_id, frame, arg_min(seat, struct_pack(n := -score, s := seat)) AS best, map_from_entries(list(struct_pack(k := seat, v := score))) AS m FROM sc GROUP BY ALL),
  hy AS (SELECT series_id, frame, best AS cur, CAST(NULL AS BIGINT) AS ch, 0 AS n, FALSE AS switched FROM fs WHERE frame = 0
    UNION ALL SELECT series_id, frame, CASE WHEN sw THEN best ELSE cur END, CASE WHEN lead AND NOT sw THEN best END, CASE WHEN sw THEN 0 ELSE cnt END, sw FROM
      (SELECT *, lead AND cnt >= 2 AS sw FROM (SELECT *, CASE WHEN NOT lead THEN 0 WHEN ch = best THEN n + 1 ELSE 1 END AS cnt FROM
        (SELECT f.series_id, f.frame, f.best, h.cur, h.ch, h.n, f.best <> h.cur AND f.m[f.best] - f.m[h.cur] > 14e-2 AS lead FROM hy h JOIN fs f ON f.series_id = h.series_id AND f.frame = h.frame + 1))))"""


@query("f13_hysteresis_switch", HYST + " SELECT series_id, frame, cur AS seat, switched FROM hy", "v_series")
def q_hysteresis(spark, sf):
    return sr.hysteresis(scored(spark, sf), [K], "frame", 2)


WEEK = seats_sql("series_id, shot", "(SELECT series_id, t_ms // 604800000 AS shot, x FROM v_series)", "k_")


@query("f14_opening_choice", WEEK + """,
  oc AS (SELECT series_id, shot, list(struct_pack(seat := seat, c := centre, v := n / 1e1) ORDER BY seat) AS q, row_number() OVER (PARTITION BY series_id ORDER BY shot) AS rn FROM k_seats GROUP BY series_id, shot),
  od AS (SELECT series_id, shot, rn, list_sort(list_transform(q, lambda x: struct_pack(k := -x.v, seat := x.seat, c := x.c, v := x.v)))[1] AS pick FROM oc WHERE rn = 1
    UNION ALL SELECT series_id, shot, rn, CASE WHEN talk.seat <> near.seat AND talk.v > near.v + 14e-2 * 3 THEN talk ELSE near END FROM
     (SELECT o.series_id, o.shot, o.rn, list_sort(list_transform(o.q, lambda x: struct_pack(k := -x.v, seat := x.seat, c := x.c, v := x.v)))[1] AS talk,
        list_sort(list_transform(o.q, lambda x: struct_pack(k := abs(x.c - d.pick.c), seat := x.seat, c := x.c, v := x.v)))[1] AS near FROM od d JOIN oc o ON o.series_id = d.series_id AND o.rn = d.rn + 1))
  SELECT series_id, shot, pick.seat AS seat FROM od""", "v_series")
def q_opening(spark, sf):
    p = positions(spark, sf).withColumn("shot", F.floor(F.col("t_ms") / (7 * DAY)))
    s = sr.seats_1d(p, [K, "shot"], "x100", 49_000).withColumn("spoken", F.col("n") / 10.0)
    return sr.opening_choice(s, [K], "shot", 3)


EMA = IX + """, em AS (SELECT series_id, i, sqrt(x) AS s FROM ix WHERE i = 0 UNION ALL SELECT n.series_id, n.i, CASE WHEN n.cut THEN sqrt(n.x) ELSE e.s + (sqrt(n.x) - e.s) * 5e-1 END FROM em e JOIN ix n ON n.series_id = e.series_id AND n.i = e.i + 1)"""


@query("f15_ema", EMA + f" SELECT series_id, i, {half_up_sql('s', 4)} AS ema FROM em", "v_series")
def q_ema(spark, sf):
    ix = indexed(spark, sf).withColumn("x", F.sqrt("x"))
    reset = F.col("cut") | (F.col("i") == 0)
    a = F.when(reset, 0.0).otherwise(1.0 - sr.FACE_EMA)
    b = F.when(reset, F.col("x")).otherwise(F.col("x") * sr.FACE_EMA)
    return sr.affine_scan(ix, [K], ["i"], F.floor(F.col("i") / 512), a, b, 0.0).select(K, "i", half_up(F.col("value"), 4).alias("ema"))


@query("f16_deadband_keyframes", IX + """, db AS (SELECT series_id, i, TRUE AS emit, x AS last FROM ix WHERE i = 0 UNION ALL
    SELECT n.series_id, n.i, n.cut OR abs(n.x - d.last) >= 48, CASE WHEN n.cut OR abs(n.x - d.last) >= 48 THEN n.x ELSE d.last END FROM db d JOIN ix n ON n.series_id = d.series_id AND n.i = d.i + 1)
  SELECT series_id, i, last AS x FROM db WHERE emit""", "v_series")
def q_deadband(spark, sf):
    s = collect_ordered(indexed(spark, sf), [K, "shot"], ["i"], ["x"])
    return s.select(K, F.inline(sr.deadband(F.col("items"))))


@query("f17_hold_before_cut", """SELECT series_id, seq, t_ms FROM v_series s WHERE t_ms <= 0 OR NOT EXISTS (SELECT 1 FROM v_series c WHERE c.series_id = s.series_id AND c.cut AND s.t_ms >= c.t_ms - 3600000 AND s.t_ms < c.t_ms)""", "v_series")
def q_hold(spark, sf):
    return sr.hold_before_cut(views.series(spark, sf), K, F.col("cut"), HOUR).select(K, "seq", "t_ms")


@query("f18_winner_margin", HYST + f""",
  r AS (SELECT series_id, frame, list(struct_pack(k := -score, seat := seat, s := score, c := corr) ORDER BY -score, seat) AS s FROM sc GROUP BY ALL),
  m AS (SELECT series_id, count(*) AS frames, sum({half_up_sql('(s[1].s - s[2].s) * 1e6')}) / count(*)::DOUBLE / 1e6 AS margin, sum({half_up_sql('s[1].c * 1e6')}) / count(*)::DOUBLE / 1e6 AS sp, sum({half_up_sql('s[2].c * 1e6')}) / count(*)::DOUBLE / 1e6 AS li,
    count(*) FILTER (WHERE s[1].s >= 34e-2 AND s[2].s >= 34e-2) AS dual FROM r WHERE len(s) > 1 GROUP BY series_id),
  w AS (SELECT series_id, count(*) FILTER (WHERE switched) AS switches FROM hy GROUP BY series_id),
  pr AS (SELECT series_id, count(*) FILTER (WHERE x > 12e1) / count(*)::DOUBLE AS present FROM v_series GROUP BY series_id)
  SELECT m.series_id, frames, {half_up_sql('margin', 5)} AS margin, {half_up_sql('sp', 5)} AS speaker_corr, {half_up_sql('li', 5)} AS listener_corr, dual, switches, {half_up_sql('present', 5)} AS present,
    {half_up_sql('greatest(0e0, least(1e0, 25e-2 + 45e-2 * present + 6e-1 * least(margin, 5e-1)))', 5)} AS confidence FROM m JOIN w ON w.series_id = m.series_id JOIN pr ON pr.series_id = m.series_id""", "v_series")
def q_margin(spark, sf):
    s = stage(scored(spark, sf), "scored")
    m = sr.winner_margin(s, sr.hysteresis(s, [K], "frame", 2), sr.presence(views.series(spark, sf), K, F.col("x") > 120.0), K, "frame")
    return m.select(K, "frames", *[half_up(F.col(c), 5).alias(c) for c in ("margin", "speaker_corr", "listener_corr")], "dual", "switches", half_up(F.col("present"), 5).alias("present"),
                    half_up(sr.confidence(F.col("present"), F.col("margin")), 5).alias("confidence"))


@query("f19_rms_envelope", IX + f""", n AS (SELECT series_id, greatest(1, count(*) // 20) AS per FROM ix GROUP BY series_id), r AS (SELECT ix.series_id, i // per AS frame, sqrt(avg(x * x)) AS rms FROM ix JOIN n ON n.series_id = ix.series_id WHERE i // per < 20 GROUP BY ALL)
  SELECT series_id, frame, {half_up_sql('rms / max(rms) OVER (PARTITION BY series_id)', 5)} AS level FROM r""", "v_series")
def q_rms(spark, sf):
    return sr.rms_envelope(indexed(spark, sf), K, "x", 20).withColumn("level", half_up(F.col("level"), 5))


@query("f20_gaussian_smooth", IX + f""",
  e AS (SELECT series_id, shot, min(t_ms) AS f, max(coalesce(next_t, greatest(t_ms, {END}))) AS u, max(i) AS li FROM ix GROUP BY ALL),
  nx AS (SELECT *, lead(t_ms) OVER w AS nt, lead(x) OVER w AS nxx FROM ix WINDOW w AS (PARTITION BY series_id, shot ORDER BY i)),
  p AS (SELECT b.series_id, b.shot, b.seq, b.t_ms + d.dt AS pt, d.dt FROM ix b JOIN e ON e.series_id = b.series_id AND e.shot = b.shot, range(-21600000, 21600001, 3600000) AS d(dt) WHERE b.t_ms + d.dt >= e.f AND b.t_ms + d.dt < e.u),
  v AS (SELECT p.series_id, p.seq, p.dt, CASE WHEN k.nt IS NULL THEN k.x ELSE k.x + (k.nxx - k.x) * ((p.pt - k.t_ms) / (k.nt - k.t_ms)::DOUBLE) END AS v FROM p JOIN nx k ON k.series_id = p.series_id AND k.shot = p.shot AND k.t_ms <= p.pt AND (k.nt IS NULL OR p.pt < k.nt)),
  g AS (SELECT series_id, seq, sum(exp(-(dt * dt) / (2e0 * 7200000 * 7200000)) * v) / sum(exp(-(dt * dt) / (2e0 * 7200000 * 7200000))) AS v FROM v GROUP BY ALL)
  SELECT b.series_id, b.t_ms, {half_up_sql('coalesce(g.v, b.x)', 4)} AS value, FALSE AS settle FROM ix b LEFT JOIN g ON g.series_id = b.series_id AND g.seq = b.seq
  UNION ALL SELECT b.series_id, b.t_ms + 21600000, {half_up_sql('b.x', 4)}, TRUE FROM ix b JOIN e ON e.series_id = b.series_id AND e.shot = b.shot AND e.li = b.i WHERE b.t_ms + 21600000 < e.u - 1""", "v_series")
def q_gauss(spark, sf):
    g = sr.gaussian_smooth(indexed(spark, sf), K, 2 * HOUR, HOUR, END)
    return g.select(K, "t_ms", half_up(F.col("value"), 4).alias("value"), "settle")


@query("f21_interpolate_asof", IX + f""",
  q AS (SELECT series_id, seq AS pid, t_ms + 5400000 AS t FROM v_series), h AS (SELECT q.*, b.x AS bx, b.t_ms AS bt, b.shot AS bs, a.x AS ax, a.t_ms AS at0, a.shot AS a_s FROM q ASOF LEFT JOIN ix b ON b.series_id = q.series_id AND b.t_ms <= q.t ASOF LEFT JOIN ix a ON a.series_id = q.series_id AND a.t_ms > q.t)
  SELECT series_id, pid, t, {half_up_sql('CASE WHEN bt IS NULL THEN ax WHEN at0 IS NULL OR a_s <> bs THEN bx ELSE bx + (ax - bx) * ((t - bt) / (at0 - bt)::DOUBLE) END', 5)} AS value FROM h""", "v_series")
def q_interpolate(spark, sf):
    p = views.series(spark, sf).select(K, F.col("seq").alias("pid"), (F.col("t_ms") + 5_400_000).alias("t"))
    return sr.interpolate(p, indexed(spark, sf), [K], "t", "pid").select(K, "pid", "t", half_up(F.col("value"), 5).alias("value"))


@query("f22_time_weighted_mean", IX + f""",
  n AS (SELECT *, lead(x) OVER (PARTITION BY series_id, shot ORDER BY i) AS nx, coalesce(next_t, t_ms) - t_ms AS dt FROM ix)
  SELECT series_id, shot, {half_up_sql('CASE WHEN sum(dt) > 0 THEN sum((x + coalesce(nx, x)) / 2e0 * dt) / sum(dt::DOUBLE) ELSE arg_min(x, i) END', 4)} AS mean FROM n GROUP BY series_id, shot""", "v_series")
def q_twm(spark, sf):
    return sr.time_weighted_mean(indexed(spark, sf), K).withColumn("mean", half_up(F.col("mean"), 4))


@query("f23_per_shot_range", IX + f", r AS (SELECT series_id, shot, max(x) - min(x) AS r FROM ix GROUP BY ALL) SELECT series_id, {half_up_sql('max(r) / 49e1', 6)} AS travel FROM r GROUP BY series_id", "v_series")
def q_range(spark, sf):
    return sr.per_shot_range(indexed(spark, sf), K, W).withColumn("travel", half_up(F.col("travel"), 6))


@query("f24_time_weighted_share", IX + f""",
  d AS (SELECT series_id, x / 245e0 - 1 AS y, coalesce(next_t, t_ms) - greatest({2 * DAY}, t_ms) AS d FROM ix),
  g AS (SELECT series_id, sum(d) AS t, coalesce(sum(d) FILTER (WHERE y < -25e-2), 0) AS l, coalesce(sum(d) FILTER (WHERE y > 25e-2), 0) AS r FROM d WHERE d > 0 GROUP BY series_id)
  SELECT series_id, {half_up_sql('(t - l - r) / t * 100')} AS front, {half_up_sql('l / t * 100')} AS "left", {half_up_sql('r / t * 100')} AS "right" FROM g""", "v_series")
def q_time_share(spark, sf):
    return sr.time_share(indexed(spark, sf), K, F.col("x") / 245.0 - 1, 2 * DAY)


@query("f25_freeze_spans", IX + f""",
  ct AS (SELECT series_id, list(t_ms ORDER BY t_ms) FILTER (WHERE cut) AS cs, list(struct_pack(t := t_ms, x := x, held := FALSE) ORDER BY t_ms, seq) AS ks FROM ix GROUP BY series_id),
  h0 AS (SELECT ix.series_id, seq, t_ms AS a, list_filter(coalesce(cs, []), lambda c: c > t_ms)[1] AS c FROM ix JOIN ct ON ct.series_id = ix.series_id WHERE lane = 'signup'),
  h1 AS (SELECT *, CASE WHEN c <= a + 21600000 THEN c - 10 ELSE a + 21600000 END AS stop FROM h0),
  h2 AS (SELECT *, CASE WHEN c <= a + 21600000 THEN c WHEN c IS NOT NULL THEN least(stop + 7200000, c) ELSE stop + 7200000 END AS resume, row_number() OVER (PARTITION BY series_id ORDER BY a, seq) AS rn FROM h1 WHERE stop - a >= 50),
  fo AS (SELECT series_id, 0 AS rn, coalesce(cs, []) AS cs, ks FROM ct
    UNION ALL SELECT series_id, rn, cs, list_concat(list_concat(list_filter(ks, lambda k: k.t < a), [struct_pack(t := a, x := v, held := TRUE), struct_pack(t := stop, x := v, held := TRUE)]), list_filter(ks, lambda k: k.t >= resume AND k.t > stop)) FROM
      (SELECT *, CASE WHEN p IS NULL THEN q.x WHEN q IS NULL OR len(list_filter(cs, lambda c: c > p.t AND c <= q.t)) > 0 THEN p.x ELSE p.x + (q.x - p.x) * (a - p.t) / (q.t - p.t) END AS v FROM
        (SELECT fo.series_id, h2.rn, fo.cs, fo.ks, a, stop, resume, list_filter(fo.ks, lambda k: k.t <= a)[-1] AS p, list_filter(fo.ks, lambda k: k.t > a)[1] AS q FROM fo JOIN h2 ON h2.series_id = fo.series_id AND h2.rn = fo.rn + 1)))
  SELECT series_id, k.t AS t_ms, {half_up_sql('k.x', 6)} AS x, k.held AS held FROM (SELECT series_id, unnest(arg_max(ks, rn)) AS k FROM fo GROUP BY series_id)""", "v_series")
def q_freeze(spark, sf):
    ix = indexed(spark, sf)
    h = ix.filter("lane = 'signup'").select(K, F.col("seq").alias("hold_id"), F.col("t_ms").alias("a"), (F.col("t_ms") + 6 * HOUR).alias("b"))
    return sr.freeze_spans(ix, h, K, 2 * HOUR).withColumn("x", half_up(F.col("x"), 6))


@query("f26_decimate_keep_jumps", IX + """,
  dj AS (SELECT series_id, i, t_ms, x, 0 AS since, count(*) OVER (PARTITION BY series_id) AS n, abs(lead(x) OVER w - x) > 25e-2 * 49e1 AS jump FROM ix WINDOW w AS (PARTITION BY series_id ORDER BY i)),
  per AS (SELECT *, CASE WHEN n <= 20 THEN 1 ELSE CAST(ceil(n / 2e1) AS BIGINT) END AS per FROM dj),
  fo AS (SELECT series_id, i, TRUE AS keep, CASE WHEN jump OR 1 >= per THEN 0 ELSE 1 END AS since FROM per WHERE i = 0
    UNION ALL SELECT p.series_id, p.i, f.since = 0, CASE WHEN p.jump OR f.since + 1 >= p.per THEN 0 ELSE f.since + 1 END FROM fo f JOIN per p ON p.series_id = f.series_id AND p.i = f.i + 1)
  SELECT p.series_id, p.i, p.t_ms, p.x FROM fo JOIN per p ON p.series_id = fo.series_id AND p.i = fo.i WHERE keep""", "v_series")
def q_decimate(spark, sf):
    return sr.decimate(indexed(spark, sf), K, W, 20)


@query("f27_drop_redundant", IX + """,
  n AS (SELECT *, lead(x) OVER w AS nx, lead(t_ms) OVER w AS nt FROM ix WINDOW w AS (PARTITION BY series_id, shot ORDER BY i)), z AS (SELECT *, min(i) OVER (PARTITION BY series_id, shot) AS f FROM n),
  fo AS (SELECT series_id, shot, i, TRUE AS keep, x AS last FROM z WHERE i = f UNION ALL
    SELECT series_id, shot, i, k, CASE WHEN k THEN x ELSE last END FROM (SELECT z.series_id, z.shot, z.i, z.x, fo.last, NOT (abs(z.x - fo.last) <= 4 OR coalesce(z.nt - z.t_ms <= 36000000 AND abs(z.x - fo.last) <= 1225e-1 AND abs(z.nx - z.x) > 1225e-1, FALSE)) AS k FROM fo JOIN z ON z.series_id = fo.series_id AND z.shot = fo.shot AND z.i = fo.i + 1))
  SELECT series_id, i FROM fo WHERE keep""", "v_series")
def q_redundant(spark, sf):
    """Here each shot is one keyframe track."""
    from chronoweave.operators.scans import following, scan
    ix = indexed(spark, sf)
    n = scan(ix, [K, "shot"], ["i"], F.floor(F.col("i") / 65_536), nn=following(F.struct("x", "t_ms")))
    n = n.withColumn("nx", F.col("nn.x")).withColumn("nt", F.col("nn.t_ms"))
    s = collect_ordered(n, [K, "shot"], ["i"], ["t_ms", "x", "nx", "nt"])
    return s.select(K, F.inline(sr.drop_redundant(F.col("items"), W, 10 * HOUR))).select(K, "i")


@query("f28_stitch_series", f"""
  u AS (SELECT series_id, seq, t_ms, CASE WHEN seq % 2 = 0 THEN 'a' ELSE 'b' END AS side FROM v_series WHERE (seq % 2 = 0 AND t_ms < {18 * DAY}) OR (seq % 2 = 1 AND t_ms > {12 * DAY})),
  b AS (SELECT series_id, min(t_ms) FILTER (WHERE side = 'a') AS a0, max(t_ms) FILTER (WHERE side = 'a') AS a1, min(t_ms) FILTER (WHERE side = 'b') AS b0, max(t_ms) FILTER (WHERE side = 'b') AS b1 FROM u GROUP BY series_id),
  m AS (SELECT *, CASE WHEN b0 IS NULL OR (a0 <= b0 + 50 AND a1 >= b1 - 50) THEN 'a' WHEN a0 IS NULL OR (b0 <= a0 + 50 AND b1 >= a1 - 50) THEN 'b' WHEN b0 > a1 + 80 THEN CASE WHEN a1 >= b1 THEN 'a' ELSE 'b' END ELSE 'ab' END AS mode FROM b)
  SELECT u.series_id, seq, t_ms FROM u JOIN m ON m.series_id = u.series_id WHERE CASE WHEN mode = 'ab' THEN CASE WHEN side = 'a' THEN t_ms < b0 ELSE t_ms >= b0 END ELSE mode = side END""", "v_series")
def q_stitch(spark, sf):
    s = views.series(spark, sf).select(K, "seq", "t_ms")
    return sr.stitch(s.filter((F.col("seq") % 2 == 0) & (F.col("t_ms") < 18 * DAY)), s.filter((F.col("seq") % 2 == 1) & (F.col("t_ms") > 12 * DAY)), K)


@query("f29_shift_series", f"SELECT series_id, seq, t_ms - {10 * DAY} AS t_ms, x FROM v_series", "v_series")
def q_shift(spark, sf):
    return views.series(spark, sf).select(K, "seq", (F.col("t_ms") - 10 * DAY).alias("t_ms"), "x")


@query("f30_rows_for_window", IX + f""",
  e AS (SELECT series_id, max(i) FILTER (WHERE t_ms <= {10 * DAY}) AS a, min(i) FILTER (WHERE t_ms >= {12 * DAY}) AS z FROM ix GROUP BY series_id)
  SELECT ix.series_id, seq, t_ms - {10 * DAY} AS t_ms, x FROM ix JOIN e ON e.series_id = ix.series_id WHERE i >= coalesce(a, 0) AND i <= coalesce(z, 1000000000)""", "v_series")
def q_window_rows(spark, sf):
    return sr.rows_for_window(views.series(spark, sf).select(K, "seq", "t_ms", "x"), K, 10 * DAY, 12 * DAY)


AUDIT = """
  k AS (SELECT series_id, t_ms, x FROM v_series WHERE seq % 2 = 0), c AS (SELECT series_id, seq AS cut_id, t_ms AS c FROM v_series WHERE cut),
  h AS (SELECT c.*, b.x AS hx, a.x AS nx, a.t_ms AS nt FROM c ASOF LEFT JOIN k b ON b.series_id = c.series_id AND b.t_ms <= c.c - 1 ASOF LEFT JOIN k a ON a.series_id = c.series_id AND a.t_ms > c.c - 1),
  au AS (SELECT series_id, cut_id, c, CASE WHEN coalesce(abs(nx - hx) > 1225e-1, FALSE) THEN 'snap' ELSE 'hold' END AS kind, CASE WHEN NOT coalesce(abs(nx - hx) > 1225e-1, FALSE) OR abs(CASE WHEN nt <= c THEN nx ELSE hx END - nx) <= 12 THEN 'ok' ELSE 'flash' END AS status FROM h)"""


def audit(spark, sf):
    s = views.series(spark, sf)
    cuts = s.filter("cut").select(K, F.col("seq").alias("cut_id"), F.col("t_ms").alias("c"))
    return sr.cut_audit(s.filter("seq % 2 = 0"), cuts, K, W, "cut_id")


@query("f31_cut_audit", AUDIT + " SELECT * FROM au", "v_series")
def q_audit(spark, sf):
    return audit(spark, sf)


@query("f31_new_cuts", AUDIT + " SELECT series_id, cut_id, status FROM au WHERE NOT EXISTS (SELECT 1 FROM v_series p WHERE p.series_id = au.series_id AND p.cut AND p.seq % 3 = 0 AND p.t_ms // 10 = au.c // 10)", "v_series")
def q_new_cuts(spark, sf):
    known = views.series(spark, sf).filter("cut AND seq % 3 = 0").select(K, F.floor(F.col("t_ms") / 10).alias("tick")).distinct()
    return audit(spark, sf).withColumn("tick", F.floor(F.col("c") / 10)).join(known, [K, "tick"], "left_anti").select(K, "cut_id", "status")


LINK = IX + """,
  z AS (SELECT series_id, shot, seq, t_ms // 86400000 AS frame, x, (t_ms % 86400000) / 864e5 * 49e1 AS y, row_number() OVER (PARTITION BY series_id, shot ORDER BY t_ms // 86400000, seq) AS rn FROM ix),
  lk AS (SELECT series_id, shot, rn, seq, frame, 0 AS track, 1 AS nxt, CAST([] AS STRUCT(id INTEGER, x DOUBLE, y DOUBLE, miss BIGINT)[]) AS live, [struct_pack(id := 0, x := x, y := y, miss := 0::BIGINT)] AS born FROM z WHERE rn = 1
    UNION ALL SELECT series_id, shot, rn, seq, frame, coalesce(hit, nxt), CASE WHEN hit IS NULL THEN nxt + 1 ELSE nxt END,
      list_transform(now, lambda t: CASE WHEN t.id = hit THEN struct_pack(id := t.id, x := t.x * 6e-1 + px * 4e-1, y := t.y * 6e-1 + py * 4e-1, miss := 0::BIGINT) ELSE t END),
      CASE WHEN hit IS NULL THEN list_append(new, struct_pack(id := nxt, x := px, y := py, miss := 0::BIGINT)) ELSE new END FROM
      (SELECT *, list_sort(list_transform(list_filter(list_transform(now, lambda t: struct_pack(d := sqrt((px - t.x) * (px - t.x) + (py - t.y) * (py - t.y)), id := t.id)), lambda q: q.d < 12e-2 * 49e1), lambda q: q))[1].id AS hit FROM
        (SELECT z.series_id, z.shot, z.rn, z.seq, z.frame, z.x AS px, z.y AS py, lk.nxt,
          CASE WHEN z.frame = lk.frame THEN lk.live ELSE list_transform(list_filter(list_concat(lk.live, lk.born), lambda t: t.miss <= 4 AND t.miss + z.frame - lk.frame - 1 <= 4), lambda t: struct_pack(id := t.id, x := t.x, y := t.y, miss := t.miss + z.frame - lk.frame)) END AS now,
          CASE WHEN z.frame = lk.frame THEN lk.born ELSE [] END AS new
        FROM lk JOIN z ON z.series_id = lk.series_id AND z.shot = lk.shot AND z.rn = lk.rn + 1)))"""


@query("f32_link_tracks", LINK + " SELECT series_id, seq, shot, track FROM lk", "v_series")
def q_link(spark, sf):
    """A frame is a day with all its samples; the second coordinate is the time of day."""
    return sr.link_tracks(detections(indexed(spark, sf)), K, 0.12 * W)


def detections(ix):
    return ix.select(K, "shot", "seq", F.floor(F.col("t_ms") / DAY).alias("frame"), "x", ((F.col("t_ms") % DAY) / 86_400_000.0 * 490.0).alias("y"))


@query("f33_envelope_follow", IX + f""", a AS (SELECT *, lag(t_ms) OVER (PARTITION BY series_id ORDER BY i) AS pt FROM ix),
  ev AS (SELECT series_id, i, 1e0 AS env FROM a WHERE i = 0 UNION ALL SELECT n.series_id, n.i, e.env + (CASE WHEN n.x > 12e1 THEN 4e-1 ELSE 1e0 END - e.env) * (1 - exp(-((n.t_ms - n.pt) / (CASE WHEN n.x > 12e1 THEN 36e5 ELSE 432e5 END)))) FROM ev e JOIN a n ON n.series_id = e.series_id AND n.i = e.i + 1)
  SELECT series_id, i, {half_up_sql('env', 5)} AS env FROM ev""", "v_series")
def q_envelope(spark, sf):
    """Target 0.4 while loud (fast attack), 1 otherwise (slow release): linear in the state, so it composes."""
    from chronoweave.operators.scans import previous, scan
    ix = stage(scan(indexed(spark, sf), [K], ["i"], F.floor(F.col("i") / 65_536), pt=previous(F.col("t_ms"))), "env")
    loud = F.col("x") > 120.0
    keep = F.exp(-((F.col("t_ms") - F.col("pt")) / F.when(loud, 3_600_000.0).otherwise(43_200_000.0)))
    a = F.when(F.col("i") == 0, 1.0).otherwise(keep)
    b = F.when(F.col("i") == 0, 0.0).otherwise(F.when(loud, 0.4).otherwise(1.0) * (1 - keep))
    return sr.affine_scan(ix, [K], ["i"], F.floor(F.col("i") / 512), a, b, 1.0).select(K, "i", half_up(F.col("value"), 5).alias("env"))
