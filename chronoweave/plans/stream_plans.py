"""Streaming queries, each drained from the event log and checked as a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweave.plans import views
from chronoweave.plans.registry import query
from chronoweave.plans.series_plans import LINK
from chronoweave.streaming import jobs as sj

DAY = 86_400_000
T_MS = "(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000"


def log(spark, sf):
    return sj.read_log(spark, sf, "events.parquet")


def t_ms():
    return F.floor((F.unix_micros("ts") - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))) / 1000)


@query("k1_latest_status", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def q_latest(spark, sf):
    return sj.run_update(sj.latest_status(log(spark, sf), "user_id", "event_id", ["event_type"]), ["user_id"])


@query("k2_dedupe_jobs", "SELECT DISTINCT user_id || '-' || event_type AS job_id FROM events")
def q_dedupe(spark, sf):
    l = log(spark, sf).withColumn("job_id", F.concat(F.col("user_id").cast("string"), F.lit("-"), "event_type"))
    return sj.run_append(sj.dedupe_jobs(l, "job_id", "60 days"))[0]


@query("k3_stage_throughput", "SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) // 1000000 AS w_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def q_throughput(spark, sf):
    return sj.run_update(sj.stage_throughput(log(spark, sf), "event_type", "1 day"), ["w", "event_type"]).select(F.unix_seconds("w.start").alias("w_start"), "event_type", "n")


@query("k3_stage_throughput_sliding", f"""
  WITH e AS (SELECT event_type, unnest([{T_MS} // 600000, {T_MS} // 600000 - 1]) AS k FROM events)
  SELECT 1704067200 + k * 600 AS w_start, event_type, count(*) AS n FROM e GROUP BY ALL""")
def q_sliding(spark, sf):
    s = sj.stage_throughput(log(spark, sf), "event_type", "20 minutes", "10 minutes")
    return sj.run_update(s, ["w", "event_type"]).select(F.unix_seconds("w.start").alias("w_start"), "event_type", "n")


@query("k4_speech_sessions", f"""
  WITH e AS (SELECT user_id, {T_MS} AS t, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
  s AS (SELECT *, sum(CASE WHEN p IS NULL OR us - p >= 14400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS g FROM e)
  SELECT user_id, min(us) AS start_us, max(us) + 14400000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, g""")
def q_sessions(spark, sf):
    s = sj.run_complete(sj.speech_sessions(log(spark, sf), "user_id", "4 hours"))
    return s.select("user_id", F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "n")


def halves(spark, sf):
    e = views.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    early = t_ms() < 15 * DAY
    return e.filter(early), e.filter(~early)


@query("k5_stalled_jobs", """
  WITH e AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, event_id, event_type = 'purchase' AS done FROM events),
  o AS (SELECT *, lead(ms) OVER w AS nx, coalesce(sum(done::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id)),
  d AS (SELECT user_id, run, ms AS last_ms, unnest(range(ms + 21600000, coalesce(nx, (SELECT max(ms) FROM e) - 3600000 + 1), 21600000)) AS stall_ms FROM o WHERE NOT done),
  f AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY stall_ms) AS redeliveries FROM d),
  z AS (SELECT user_id, min(stall_ms) AS over FROM f WHERE redeliveries = 6 GROUP BY user_id)
  SELECT f.user_id, stall_ms, last_ms, redeliveries, redeliveries = 6 AS final FROM f LEFT JOIN z ON z.user_id = f.user_id WHERE over IS NULL OR stall_ms <= over""")
def q_stalled(spark, sf):
    a, b = halves(spark, sf)
    with sj.keyed_timers(spark):
        return sj.in_turns(spark, [a, b], lambda s: sj.stalled_jobs(s.withColumn("done", F.col("event_type") == "purchase"), "user_id", "event_id", "done", DAY // 4, "1 hour"))[0]


@query("f32_link_tracks_stream", LINK + """ SELECT lk.series_id, lk.seq, lk.shot, lk.track FROM lk JOIN v_series s ON s.seq = lk.seq
  WHERE (s.t_ms // 86400000 + 1) * 86400000 <= (SELECT max(t_ms) FROM v_series) - 3600000""", "v_series")
def q_linked(spark, sf):
    """The same linking on the log, in two deliveries; frames that the watermark has not closed wait."""
    def run(s):
        s = s.select(F.col("user_id").alias("series_id"), F.col("event_id").alias("seq"), "ts", t_ms().alias("t_ms"), F.col("value").alias("x"), (F.col("event_type") == "error").alias("cut"))
        s = s.withColumn("y", (F.col("t_ms") % DAY) / 86_400_000.0 * 490.0)
        return sj.linked_detections(s, "series_id", DAY, 0.12 * 490.0, "1 hour")
    with sj.keyed_timers(spark):
        return sj.in_turns(spark, list(halves(spark, sf)), run)[0]


@query("k6_retry_state", """
  WITH f AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type = 'error')
  SELECT user_id, event_id, n AS attempts, CAST(5 * pow(2, least(n - 1, 30)) AS BIGINT) AS delay_sec, n >= 2 AS final FROM f""")
def q_retry(spark, sf):
    l = log(spark, sf).withColumn("failed", F.col("event_type") == "error")
    return sj.run_append(sj.retry_state(l, "user_id", "event_id", "failed"))[0]


@query("k7_fan_in_progress", "SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS done, count(*) FILTER (WHERE event_type = 'purchase') >= 12 AS complete FROM events GROUP BY user_id")
def q_fan_in(spark, sf):
    return sj.run_update(sj.fan_in_progress(log(spark, sf), "user_id", F.col("event_type") == "purchase", 12), ["user_id"])


SEQ = "s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM e)"


@query("k8_progress_throttle", f"""
  WITH RECURSIVE e AS (SELECT user_id, event_id, {T_MS} AS t, CAST(floor(value) AS BIGINT) % 101 AS pct FROM events), {SEQ},
  r AS (SELECT user_id, event_id, rn, t AS lt, pct AS lp, TRUE AS emit FROM s WHERE rn = 1
    UNION ALL SELECT user_id, event_id, rn, CASE WHEN go THEN t ELSE lt END, CASE WHEN go THEN pct ELSE lp END, go FROM
      (SELECT s.*, r.lt, r.lp, s.pct <> r.lp AND (s.t - r.lt >= 43200000 OR s.pct >= 99) AS go FROM r JOIN s ON s.user_id = r.user_id AND s.rn = r.rn + 1))
  SELECT user_id, event_id, lp AS pct FROM r WHERE emit""")
def q_throttle(spark, sf):
    l = log(spark, sf).withColumn("t_ms", t_ms()).withColumn("pct", F.floor("value") % 101)
    return sj.run_append(sj.progress_throttle(l, "user_id", "event_id", 43_200_000))[0]


@query("k9_switch_detector", f"""
  WITH RECURSIVE e AS (SELECT user_id, event_id, event_type AS best, value > 2e1 AS clear FROM events), {SEQ},
  r AS (SELECT user_id, event_id, rn, best AS cur, '' AS ch, 0 AS n, FALSE AS sw FROM s WHERE rn = 1
    UNION ALL SELECT user_id, event_id, rn, CASE WHEN lead AND c >= 2 THEN best ELSE cur END, CASE WHEN lead AND c < 2 THEN best ELSE '' END, CASE WHEN lead AND c >= 2 THEN 0 ELSE c END, lead AND c >= 2 FROM
      (SELECT *, CASE WHEN NOT lead THEN 0 WHEN ch = best THEN n + 1 ELSE 1 END AS c FROM
        (SELECT s.*, r.cur, r.ch, r.n, s.clear AND s.best <> r.cur AS lead FROM r JOIN s ON s.user_id = r.user_id AND s.rn = r.rn + 1)))
  SELECT user_id, event_id, cur AS choice, sw AS switched FROM r""")
def q_switch(spark, sf):
    l = log(spark, sf).withColumn("best", F.col("event_type")).withColumn("clear", F.col("value") > 20.0)
    return sj.run_append(sj.switch_detector(l, "user_id", "event_id", 2))[0]


@query("k10_crossing_once", f"""
  WITH RECURSIVE e AS (SELECT user_id, event_id, value AS pos FROM events), {SEQ},
  r AS (SELECT user_id, event_id, rn, pos AS prev, 4e1 <= pos AS fired, 4e1 <= pos AS go FROM s WHERE rn = 1
    UNION ALL SELECT user_id, event_id, rn, pos, f OR (prev <= 4e1 AND pos >= 4e1 AND NOT f), prev <= 4e1 AND pos >= 4e1 AND NOT f FROM
      (SELECT s.*, r.prev, r.fired AND s.pos >= r.prev - 1e2 AS f FROM r JOIN s ON s.user_id = r.user_id AND s.rn = r.rn + 1))
  SELECT user_id, event_id, TRUE AS fired FROM r WHERE go""")
def q_crossing(spark, sf):
    l = log(spark, sf).withColumn("pos", F.col("value"))
    return sj.run_append(sj.crossing_once(l, "user_id", "event_id", 40.0, 100.0))[0]


@query("k11_stream_asof_enrich", f"""
  SELECT e.event_id, s.span_id FROM (SELECT event_id, user_id, {T_MS} AS t FROM events WHERE event_type = 'click') e JOIN v_spans s ON s.owner_id = e.user_id AND s.lane = 'view' AND s.start_ms <= e.t AND e.t < s.end_ms""", "v_spans")
def q_enrich(spark, sf):
    l = log(spark, sf).filter("event_type = 'click'").select("event_id", F.col("user_id").alias("owner_id"), t_ms().alias("t"))
    s = views.spans(spark, sf).filter("lane = 'view'").select("owner_id", "span_id", "start_ms", "end_ms")
    return sj.run_append(sj.asof_enrich(l, s, "owner_id", "t", float(DAY)).select("event_id", "span_id"))[0]


@query("k12_late_rows", f"SELECT count(*) FILTER (WHERE {T_MS} >= {15 * DAY}) AS kept, count(*) FILTER (WHERE {T_MS} < {15 * DAY}) AS dropped FROM events")
def q_late(spark, sf):
    a, b = halves(spark, sf)
    return sj.late_rows(spark, [b, a], "event_id", "1 hour")


@query("k13_stage_chain", "SELECT user_id AS project_id, count(*) AS rows_mined FROM events WHERE event_type = 'signup' GROUP BY user_id")
def q_chain(spark, sf):
    out = sj.stage_chain(log(spark, sf), lambda b: b.filter("event_type = 'signup'").select(F.col("user_id").alias("project_id"), "event_id"),
                         lambda t: t.groupBy("project_id").agg(F.count("*").alias("rows_mined")))
    return out.groupBy("project_id").agg(F.sum("rows_mined").alias("rows_mined"))
