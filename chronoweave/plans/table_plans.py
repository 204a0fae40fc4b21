"""Queries over operational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweave.functions.numeric import half_up, half_up_sql
from chronoweave.functions.profiles import PROFILES
from chronoweave.operators import tables as tb
from chronoweave.plans import views
from chronoweave.plans.registry import query

CLIPS = "c AS (SELECT l_orderkey AS project_id, l_linenumber AS rank, l_orderkey * 10 + l_linenumber AS clip_id, CAST(l_quantity AS BIGINT) * 1000 AS start_ms, CAST(l_quantity AS BIGINT) * 1000 + CAST(floor(l_extendedprice) AS BIGINT) AS end_ms, l_returnflag AS flag, l_linestatus AS state, l_quantity / 5e0 AS score, CAST(floor(l_extendedprice) AS BIGINT) AS bytes FROM lineitem)"


def clips(spark, sf):
    l = views.table(spark, sf, "lineitem")
    start = F.col("l_quantity").cast("long") * 1000
    return l.select(F.col("l_orderkey").alias("project_id"), F.col("l_linenumber").alias("rank"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("clip_id"), start.alias("start_ms"),
                    (start + F.floor("l_extendedprice")).alias("end_ms"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("state"), (F.col("l_quantity") / 5.0).alias("score"), F.floor("l_extendedprice").alias("bytes"))


def projects(spark, sf):
    o = views.table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("project_id"), F.col("o_orderstatus").alias("status"), "o_orderdate", "o_orderpriority", "o_custkey", "o_totalprice")


@query("h1_project_list", "SELECT o_orderkey AS project_id, o_orderstatus AS status, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def q_list(spark, sf):
    return tb.project_list(projects(spark, sf), "o_orderdate", "project_id", "F").select("project_id", "status", "o_totalprice")


@query("h2_board", "WITH " + CLIPS + " SELECT c.project_id, o_orderstatus AS status, clip_id, rank, score FROM c JOIN orders ON o_orderkey = c.project_id WHERE flag <> 'R'")
def q_board(spark, sf):
    c = clips(spark, sf).filter("flag <> 'R'").select("project_id", "clip_id", "rank", "score")
    return projects(spark, sf).select("project_id", "status").join(c, "project_id").select("project_id", "status", "clip_id", "rank", "score")


GENRE = "CASE o_orderpriority WHEN '1-URGENT' THEN 'sports_gaming' WHEN '2-HIGH' THEN 'music' WHEN '5-LOW' THEN 'comedy_talk' ELSE 'motivation' END"


def genre():
    p = F.col("o_orderpriority")
    return F.when(p == "1-URGENT", "sports_gaming").when(p == "2-HIGH", "music").when(p == "5-LOW", "comedy_talk").otherwise("motivation")


def profile_rows(spark):
    """The profile registry: a fixed handful of rows, so it is always broadcast."""
    data = [(g, p["label"], p["peak_kind"], ",".join(f"{a}:{'gate' if x else w}" for a, (w, x) in p["axes"].items())) for g, p in PROFILES.items()]
    return F.broadcast(spark.createDataFrame(data, "genre_id string, label string, peak_kind string, axes string"))


@query("h3_serialize_project", f"""SELECT o_orderkey AS project_id, coalesce(nullif('Order ' || o_orderkey % 10, 'Order 3'), 'Untitled') AS title, {GENRE} AS genre_id, CASE {GENRE} WHEN 'music' THEN 'Music / live' WHEN 'comedy_talk' THEN 'Comedy / talk' WHEN 'sports_gaming' THEN 'Sports / gaming' ELSE 'Motivation / advice' END AS genre_label,
  o_orderstatus = 'F' AS ready, o_totalprice > 2e5 AS large FROM orders""")
def q_serialize(spark, sf):
    p = projects(spark, sf).withColumn("genre_id", genre()).join(profile_rows(spark), "genre_id", "left")
    title = F.coalesce(F.nullif(F.concat(F.lit("Order "), (F.col("project_id") % 10).cast("string")), F.lit("Order 3")), F.lit("Untitled"))
    return p.select("project_id", title.alias("title"), "genre_id", F.col("label").alias("genre_label"), (F.col("status") == "F").alias("ready"), (F.col("o_totalprice") > 200000.0).alias("large"))


@query("h4_profiles_catalog", f"""SELECT {GENRE} AS genre_id, CASE {GENRE} WHEN 'music' THEN 'hook:0.3,peak:0.45,energy:0.25' WHEN 'comedy_talk' THEN 'hook:0.25,punchline:0.35,humour:0.25,quotability:0.15,standalone:gate' WHEN 'sports_gaming' THEN 'hook:0.25,spectacle:0.4,stakes:0.35'
  ELSE 'hook:0.35,payoff:0.35,quotability:0.3,standalone:gate' END AS axes, count(*) AS projects FROM orders GROUP BY ALL""")
def q_profiles(spark, sf):
    used = projects(spark, sf).groupBy(genre().alias("genre_id")).agg(F.count("*").alias("projects"))
    return used.join(profile_rows(spark), "genre_id").select("genre_id", "axes", "projects")


@query("h5_progress", f"""SELECT l_orderkey, l_linenumber, 45 + {half_up_sql('l_linenumber / greatest(1, CAST(l_quantity AS BIGINT))::DOUBLE * 50')} AS progress, CASE WHEN l_quantity > 1 THEN 'Mining chunk ' || l_linenumber || '/' || CAST(l_quantity AS BIGINT) ELSE 'Finding the clips' END AS stage FROM lineitem""")
def q_progress(spark, sf):
    pct, stage = tb.progress(F.col("l_linenumber"), F.col("l_quantity").cast("long"))
    return views.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", pct.alias("progress"), stage.alias("stage"))


@query("h6_storage_total", "WITH " + CLIPS + " SELECT o_orderkey AS project_id, CAST(coalesce(sum(CASE WHEN state = 'F' THEN bytes END), 0) AS BIGINT) AS bytes FROM orders LEFT JOIN c ON c.project_id = o_orderkey GROUP BY o_orderkey")
def q_storage(spark, sf):
    c = clips(spark, sf).withColumn("bytes", F.when(F.col("state") == "F", F.col("bytes")))
    return tb.storage_total(projects(spark, sf), c, "project_id", "bytes")


@query("h7_pipeline_timings", f"""
  WITH t AS (SELECT o_orderpriority, CAST(floor(o_totalprice / 1000) AS BIGINT) + o_custkey % 60 AS total FROM orders)
  SELECT o_orderpriority, count(*) AS projects, CAST(sum(total) AS BIGINT) AS total_sec, quantile_cont(total, 0.5)::DOUBLE AS p50, {half_up_sql('quantile_cont(total, 0.9)', 6)} AS p90 FROM t GROUP BY o_orderpriority""")
def q_timings(spark, sf):
    o = projects(spark, sf).withColumn("ingest", F.floor(F.col("o_totalprice") / 1000)).withColumn("mining", F.col("o_custkey") % 60)
    t = tb.pipeline_timings(o, "o_orderpriority", "ingest", "mining")
    return t.withColumn("p90", half_up(F.col("p90"), 6))


@query("h8_usage_rollup", """SELECT l_returnflag, l_linestatus, CAST(GROUPING_ID(l_returnflag, l_linestatus) AS BIGINT) AS level, count(*) AS calls, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS tokens, CAST(sum(CAST(floor(l_extendedprice * 100 + 5e-1) AS BIGINT)) AS BIGINT) AS cost
  FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def q_usage(spark, sf):
    return tb.usage_rollup(views.table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], F.col("l_quantity").cast("long"), half_up(F.col("l_extendedprice") * 100))


@query("h9_merge_clips", "WITH " + CLIPS + """
  SELECT project_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, CAST(sum(end_ms - start_ms) AS BIGINT) AS duration_ms, arg_max(clip_id, struct_pack(s := score, r := -rank)) AS strongest, max(score) AS score, max(rank) + 1 AS rank, count(*) AS parts,
    string_agg('part ' || clip_id, chr(10) || chr(10) ORDER BY rank) AS transcript, array_to_string(list_slice(list_filter(list(flag || state ORDER BY rank, flag || state), lambda x, i: list_position(list(flag || state ORDER BY rank, flag || state), x) = i), 1, 6), ',') AS themes
  FROM c GROUP BY project_id HAVING count(*) >= 2""")
def q_merge(spark, sf):
    c = clips(spark, sf).withColumn("text", F.concat(F.lit("part "), "clip_id")).withColumn("themes", F.array(F.concat("flag", "state")))
    return tb.merge_clips(c.withColumn("pos", F.col("rank")), "project_id", "pos").withColumn("themes", F.array_join("themes", ","))


@query("h10_segments_summary", "WITH " + CLIPS + " SELECT project_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, CAST(sum(end_ms - start_ms) AS BIGINT) AS duration_ms FROM c GROUP BY project_id")
def q_segments(spark, sf):
    return tb.segments_summary(clips(spark, sf), "project_id")


@query("h11_selected_bytes", "WITH " + CLIPS + " SELECT count(*) AS n, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes FROM c WHERE project_id IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def q_selected(spark, sf):
    return tb.selected_bytes(clips(spark, sf), projects(spark, sf).filter("o_orderpriority = '1-URGENT'"), "project_id", "bytes")


@query("h12_batch_keys", "SELECT o_custkey, (row_number() OVER (ORDER BY o_custkey) - 1) // 1000 AS batch FROM (SELECT DISTINCT o_custkey FROM orders)")
def q_batches(spark, sf):
    return tb.batch_keys(views.table(spark, sf, "orders"), "o_custkey", F.floor(F.col("o_custkey") / 10_000))


@query("h13_interval_vs_truth", """SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice < 10000 THEN 'too_small' ELSE 'too_short' END AS reason FROM lineitem WHERE l_extendedprice < 10000 OR l_quantity < (l_linenumber * 5) * 85e-2""")
def q_invalid(spark, sf):
    l = views.table(spark, sf, "lineitem")
    return tb.invalid_renders(l, F.col("l_quantity"), F.col("l_linenumber") * 5, F.col("l_extendedprice")).select("l_orderkey", "l_linenumber", "reason")
