"""Queries over orphans, retention and reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweave.operators import custody as cu
from chronoweave.plans import views
from chronoweave.plans.registry import query

DAY = 86400
OBJ = "WITH o AS (SELECT o_custkey AS project_id, o_orderkey AS key, o_orderstatus AS status, o_orderpriority AS prio, CAST(floor(o_totalprice) AS BIGINT) AS size, CAST(epoch_us(o_orderdate) // 1000000 AS BIGINT) AS modified FROM orders), nw AS (SELECT max(modified) AS now FROM o)"


def objects(spark, sf):
    o = views.table(spark, sf, "orders")
    return o.select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("prio"),
                    F.floor("o_totalprice").alias("size"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("modified"))


def newest(o):
    """The newest object time as a scalar subquery: reports never depend on the wall clock, and planning runs no job."""
    return o.agg(F.max("modified")).scalar()


def clip_rows(spark, sf):
    l = views.table(spark, sf, "lineitem").filter("l_returnflag = 'N'").select(F.col("l_orderkey").alias("key"), (F.col("l_linestatus") == "O").alias("open"), "l_linenumber")
    return l.join(objects(spark, sf).select("key", "project_id"), "key").select("project_id", "key", (F.col("open") & (F.col("l_linenumber") == 7) & (F.col("key") % 5 == 0)).alias("rendering"))


@query("i1_orphan_objects", OBJ + f""", c AS (SELECT o.project_id, l_orderkey AS key, l_linestatus = 'O' AND l_linenumber = 7 AND l_orderkey % 5 = 0 AS rendering FROM lineitem JOIN o ON o.key = l_orderkey WHERE l_returnflag = 'N'),
  x AS (SELECT o.* FROM o WHERE key NOT IN (SELECT key FROM c) AND project_id NOT IN (SELECT project_id FROM c WHERE rendering))
  SELECT project_id, count(*) FILTER (WHERE modified < now - {90 * DAY}) AS orphans, CAST(coalesce(sum(size) FILTER (WHERE modified < now - {90 * DAY}), 0) AS BIGINT) AS bytes, count(*) FILTER (WHERE modified >= now - {90 * DAY}) AS skipped_young FROM x, nw GROUP BY project_id""")
def q_orphans(spark, sf):
    o = objects(spark, sf)
    return cu.orphan_objects(o, clip_rows(spark, sf), "project_id", "key", newest(o), 90 * DAY)


HEXNAME = "CASE WHEN o_orderkey % 10 = 0 THEN 'tmp' || o_custkey ELSE lpad(lower(to_hex(o_custkey)), 24, '0') END"


def hex_name():
    return F.when(F.col("o_orderkey") % 10 == 0, F.concat(F.lit("tmp"), F.col("o_custkey").cast("string"))).otherwise(F.lpad(F.lower(F.hex("o_custkey")), 24, "0"))


@query("i2_orphan_dirs", f"""
  WITH f AS (SELECT {HEXNAME} AS dir, CAST(floor(o_totalprice) AS BIGINT) AS size FROM orders), p AS (SELECT lpad(lower(to_hex(c_custkey)), 24, '0') AS dir FROM customer WHERE c_custkey % 3 <> 0)
  SELECT dir, CAST(sum(size) AS BIGINT) AS bytes FROM f WHERE regexp_matches(dir, '^[0-9a-f]{{24}}$') AND dir NOT IN (SELECT dir FROM p) GROUP BY dir""")
def q_dirs(spark, sf):
    f = views.table(spark, sf, "orders").select(hex_name().alias("dir"), F.floor("o_totalprice").alias("size"))
    p = views.table(spark, sf, "customer").filter("c_custkey % 3 <> 0").select(F.lpad(F.lower(F.hex("c_custkey")), 24, "0").alias("project"))
    return cu.orphan_dirs(f, p, "dir", "project")


@query("i3_unowned_outputs", OBJ + f"""
  SELECT project_id, key, size FROM o, nw WHERE modified < now - {365 * DAY} AND project_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING') AND key NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')""")
def q_unowned(spark, sf):
    o = objects(spark, sf)
    live = views.table(spark, sf, "customer").filter("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("project_id"))
    named = views.table(spark, sf, "lineitem").filter("l_linestatus = 'F'").select(F.col("l_orderkey").alias("key"))
    return cu.unowned_outputs(o, live, named, "project_id", "key", newest(o), 365 * DAY).select("project_id", "key", "size")


@query("i4_abandoned_uploads", "SELECT o_orderkey AS path, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A' UNION SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def q_uploads(spark, sf):
    f = views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("path"), "o_custkey")
    own = views.table(spark, sf, "lineitem").select(F.when(F.col("l_returnflag") == "A", F.col("l_orderkey")).alias("media"), F.when(F.col("l_returnflag") == "R", F.col("l_partkey")).alias("upload"))
    return cu.abandoned_uploads(f, own, "path", ["media", "upload"])


NAME = "CASE key % 4 WHEN 0 THEN 'source.mp4' WHEN 1 THEN 'matte' ELSE 'part' || key END"
PROJ = "p AS (SELECT c_custkey AS project_id, CASE WHEN c_mktsegment IN ('BUILDING', 'FURNITURE') THEN 'ready' ELSE 'downloading' END AS media_status, c_custkey * 10 AS live_key FROM customer WHERE c_custkey % 5 <> 0)"


@query("i5_media_fragments", OBJ + f""", {PROJ}
  SELECT key, CASE WHEN media_status IS NULL THEN 'orphan_dir' WHEN media_status = 'ready' AND live_key = key THEN 'live' WHEN {NAME} = 'matte' THEN 'cache' WHEN modified >= now - {200 * DAY} THEN 'young' ELSE 'fragment' END AS class,
    coalesce(media_status IS NOT NULL AND NOT (media_status = 'ready' AND live_key = key) AND {NAME} = 'source.mp4' AND modified < now - {200 * DAY} AND media_status <> 'ready', FALSE) AS reset_status FROM o CROSS JOIN nw LEFT JOIN p ON p.project_id = o.project_id""")
def q_media(spark, sf):
    o = objects(spark, sf)
    m = F.col("key") % 4
    f = o.withColumn("name", F.when(m == 0, "source.mp4").when(m == 1, "matte").otherwise(F.concat(F.lit("part"), F.col("key").cast("string")))).withColumn("path", F.col("key"))
    c = views.table(spark, sf, "customer").filter("c_custkey % 5 <> 0")
    p = c.select(F.col("c_custkey").alias("project_id"), F.when(F.col("c_mktsegment").isin("BUILDING", "FURNITURE"), "ready").otherwise("downloading").alias("media_status"), (F.col("c_custkey") * 10).alias("media_path"))
    return cu.media_fragments(f, p, "project_id", newest(o), 200 * DAY).select("key", "class", "reset_status")


@query("i6_cache_owner_check", "SELECT l_orderkey, l_partkey AS path, coalesce(o_custkey % 100 = l_partkey % 100, FALSE) AS keep FROM (SELECT l_orderkey, l_partkey FROM lineitem) LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') ON o_orderkey = l_orderkey")
def q_cache(spark, sf):
    c = views.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", (F.col("l_partkey") % 100).alias("path"))
    o = views.table(spark, sf, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 100).alias("path"))
    return cu.cache_owner_check(c, o, "l_orderkey").select("l_orderkey", F.col("l_partkey").alias("path"), "keep")


@query("i7_unreferenced_stock", OBJ + f""", r AS (SELECT DISTINCT unnest([l_orderkey, l_partkey]) AS key FROM lineitem WHERE l_returnflag = 'A')
  SELECT key, size FROM o, nw WHERE status <> 'P' AND modified < now - {30 * DAY} AND key NOT IN (SELECT key FROM r)""")
def q_stock(spark, sf):
    o = objects(spark, sf)
    a = o.withColumn("kind", F.when(F.col("status") == "P", "upload").otherwise("stock"))
    r = views.table(spark, sf, "lineitem").filter("l_returnflag = 'A'").select(F.array("l_orderkey", "l_partkey").alias("refs"))
    return cu.unreferenced(a, r, "key", "refs", newest(o), 30 * DAY).select("key", "size")


@query("i8_ttl_sweep", OBJ + f" SELECT key, size FROM o, nw WHERE modified < now - {1000 * DAY}")
def q_ttl(spark, sf):
    o = objects(spark, sf)
    return cu.ttl_sweep(o, newest(o), 1000 * DAY).select("key", "size")


@query("i9_freed_report", OBJ + """ SELECT status AS sweep, prio AS reason, CAST(GROUPING_ID(status, prio) AS BIGINT) AS level, count(*) AS removed, CAST(sum(size) AS BIGINT) AS bytes FROM o GROUP BY ROLLUP (status, prio)""")
def q_freed(spark, sf):
    return cu.freed_report(objects(spark, sf).select(F.col("status").alias("sweep"), F.col("prio").alias("reason"), "size"))


@query("i10_promote_shared", "SELECT p_name AS name, min(p_partkey) AS item FROM part WHERE p_brand <> 'Brand#1' AND p_name NOT IN (SELECT p_name FROM part WHERE p_brand = 'Brand#1') GROUP BY p_name")
def q_promote(spark, sf):
    p = views.table(spark, sf, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("item"), "p_brand")
    return cu.promote_shared(p.filter("p_brand = 'Brand#1'"), p.filter("p_brand <> 'Brand#1'"), "name", "item")
