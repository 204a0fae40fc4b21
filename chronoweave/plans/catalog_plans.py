"""Queries over catalogue search, matching and choice."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweave.functions.numeric import half_up, half_up_sql
from chronoweave.operators import catalog as ct
from chronoweave.plans import views
from chronoweave.plans.registry import query

STEMS = "list_transform(list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda w: (length(w) >= 2 AND w NOT IN ('the','a','an','of','and','sound','sfx','effect','noise','hit','with'))), lambda w: regexp_replace(w, '(ing|ers|er|es|s|ed)$', ''))"
LTOK = "list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda w: (length(w) >= 3 AND w NOT IN ('the','and','for','with','shot','stock','video','image','photo','footage','clip','of','a','an')))"
SIZES = "320 * (p_size % 7 + 1) AS w, 240 * (p_size % 9 + 1) AS h"
ASK = "CASE s_suppkey % 6 WHEN 0 THEN 'Red widgets and a bolt' WHEN 1 THEN 'the blue bolting sound' WHEN 2 THEN 'small rings' WHEN 3 THEN 'econ gears' WHEN 4 THEN 'wid promo ' || s_name ELSE 'larger standards brand' END"


def part(spark, sf):
    p = views.table(spark, sf, "part")
    return p.withColumn("w", 320 * (F.col("p_size") % 7 + 1)).withColumn("h", 240 * (F.col("p_size") % 9 + 1))


def asks(spark, sf):
    s = views.table(spark, sf, "supplier")
    m = F.col("s_suppkey") % 6
    text = (F.when(m == 0, "Red widgets and a bolt").when(m == 1, "the blue bolting sound").when(m == 2, "small rings").when(m == 3, "econ gears")
            .when(m == 4, F.concat(F.lit("wid promo "), "s_name")).otherwise("larger standards brand"))
    return s.select(F.col("s_suppkey").alias("query_id"), text.alias("text"))


@query("g1_tokenize_stem", f"SELECT p_partkey, array_to_string({STEMS.format(x='p_name || $$ $$ || p_type || $$ sounding glasses$$')}, ',') AS stems FROM part")
def q_stem(spark, sf):
    return part(spark, sf).select("p_partkey", F.array_join(ct.stems(F.concat("p_name", F.lit(" "), "p_type", F.lit(" sounding glasses"))), ",").alias("stems"))


@query("g2_catalog_search", f"""
  WITH q AS (SELECT s_suppkey AS query_id, list_distinct({STEMS.format(x=ASK)}) AS ws FROM supplier),
  a AS (SELECT p_partkey AS asset_id, p_name AS label, p_size % 6 AS quality, {STEMS.format(x='p_name')} AS nm, {STEMS.format(x="p_type || ' ' || p_brand")} AS ds FROM part),
  s AS (SELECT query_id, asset_id, label, list_sum(list_transform(ws, lambda x: (CASE WHEN list_contains(nm, x) THEN 3 WHEN list_contains(ds, x) THEN 2
    WHEN len(list_filter(list_concat(nm, ds), lambda y: (starts_with(y, x) OR starts_with(x, y)))) > 0 THEN 1 ELSE 0 END))) - CASE WHEN quality < 3 THEN 2 ELSE 0 END AS score FROM q, a),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label, asset_id) AS rank FROM s WHERE score > 0)
  SELECT query_id, rank, asset_id, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 40""")
def q_search(spark, sf):
    a = part(spark, sf).select(F.col("p_partkey").alias("asset_id"), F.col("p_name").alias("label"), F.concat("p_type", F.lit(" "), "p_brand").alias("described"), (F.col("p_size") % 6).alias("quality"))
    return ct.catalog_search(asks(spark, sf), a)


@query("g3_best_label_match", f"""
  WITH q AS (SELECT s_suppkey AS query_id, {LTOK.format(x=ASK)} AS ws FROM supplier), a AS (SELECT p_partkey AS asset_id, {LTOK.format(x='p_name')} AS ts FROM part),
  s AS (SELECT query_id, asset_id, len(list_filter(ts, lambda t: list_contains(ws, t))) AS n FROM q, a)
  SELECT query_id, arg_min(asset_id, struct_pack(n := -n, a := asset_id)) AS asset_id, max(n) AS shared FROM s WHERE n > 0 GROUP BY query_id""")
def q_label(spark, sf):
    return ct.best_label_match(asks(spark, sf), part(spark, sf).select(F.col("p_partkey").alias("asset_id"), F.col("p_name").alias("label")))


@query("g4_alias_resolve", """
  WITH v AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN lower(p_type) WHEN 1 THEN p_type || '!' WHEN 2 THEN p_brand WHEN 3 THEN 'Big-' || p_type ELSE split_part(p_name, ' ', 1) END AS value FROM part),
  k AS (SELECT *, regexp_replace(lower(value), '[^a-z0-9]', '', 'g') AS key FROM v)
  SELECT p_partkey, CASE WHEN value IN ('economy', 'small', 'large', 'big_large') THEN value WHEN key IN ('economy', 'cheap') THEN 'economy' WHEN key IN ('small', 'tiny') THEN 'small' WHEN key IN ('large') THEN 'large' WHEN key IN ('biglarge', 'huge') THEN 'big_large'
    WHEN key = 'brand1' THEN 'economy' WHEN key = 'red' THEN 'large' END AS resolved FROM k""")
def q_alias(spark, sf):
    m = F.col("p_partkey") % 5
    value = (F.when(m == 0, F.lower("p_type")).when(m == 1, F.concat("p_type", F.lit("!"))).when(m == 2, F.col("p_brand")).when(m == 3, F.concat(F.lit("Big-"), "p_type"))
             .otherwise(F.split("p_name", " ")[0]))
    entries = [("economy", "Cheap"), ("small", "Tiny"), ("large", "Large"), ("big_large", "Huge")]
    return part(spark, sf).select("p_partkey", ct.alias_resolve(value, entries, {"brand1": "economy", "red": "large"}).alias("resolved"))


@query("g5_choose_rendition", f"""
  WITH f AS (SELECT p_brand, p_partkey, {SIZES} FROM part), g AS (SELECT *, least(w, h) <= 1080 AND greatest(w, h) <= 1920 AS fit, bool_or(h >= w) OVER (PARTITION BY p_brand) AS anyp FROM f),
  r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN fit THEN 0 ELSE 1 END, CASE WHEN fit THEN -h ELSE h END, CASE WHEN fit THEN p_partkey ELSE -p_partkey END) AS rn FROM g WHERE NOT anyp OR h >= w)
  SELECT p_brand, p_partkey, w, h FROM r WHERE rn = 1""")
def q_rendition(spark, sf):
    return ct.choose_rendition(part(spark, sf), "p_brand", "p_partkey", "w", "h")


@query("g6_interleave_sources", f"""
  WITH f AS (SELECT p_type, p_partkey, {SIZES}, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS turn FROM part), t AS (SELECT * FROM f WHERE turn <= 4 ORDER BY turn, p_type LIMIT 24)
  SELECT row_number() OVER (ORDER BY CASE WHEN h < w THEN 1 ELSE 0 END, turn, p_type) AS pos, p_type, p_partkey FROM t""")
def q_interleave(spark, sf):
    return ct.interleave_sources(part(spark, sf), "p_type", "p_partkey", "w", "h", 24, 4)


@query("g7_cover_scale", f"""
  WITH f AS (SELECT p_brand, p_partkey, {SIZES} FROM part), c AS (SELECT *, CASE WHEN h >= w AND least(1e0, w / 108e1, h / 192e1) >= 66e-2 THEN 0 WHEN h >= w THEN 1 ELSE 2 END AS cls FROM f)
  SELECT p_brand, p_partkey, cls FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY cls, p_partkey) AS rn FROM c) WHERE rn = 1""")
def q_cover(spark, sf):
    return ct.pick_cover(part(spark, sf), "p_brand", "p_partkey", "w", "h")


@query("g8_dedupe_by_source", "SELECT p_brand, p_size, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 1 END, p_partkey) AS rn FROM part) WHERE rn = 1")
def q_dedupe(spark, sf):
    p = part(spark, sf).select("p_brand", "p_size", "p_partkey")
    return ct.dedupe_by_source(p.filter("p_partkey % 3 = 0"), p.filter("p_partkey % 3 <> 0"), ["p_brand", "p_size"], "p_partkey")


@query("g9_rated_then_any", """
  WITH q AS (SELECT p_brand, p_partkey, CASE WHEN p_partkey % 7 <> 6 THEN p_partkey % 7 END AS quality, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_size % 5 >= 3 AND p_retailprice > 95e1 THEN 0 ELSE 1 END, p_partkey) AS turn FROM part)
  SELECT p_brand, arg_min(p_partkey, turn) AS p_partkey FROM q WHERE turn <= 3 AND (quality IS NULL OR quality >= 3) GROUP BY p_brand""")
def q_rated(spark, sf):
    p = part(spark, sf).withColumn("quality", F.when(F.col("p_partkey") % 7 != 6, F.col("p_partkey") % 7))
    return ct.rated_then_any(p, "p_brand", "p_partkey", (F.col("p_size") % 5 >= 3) & (F.col("p_retailprice") > 950.0), "quality")


@query("g10_license_split", """
  WITH l AS (SELECT page_id, url, CASE page_id % 4 WHEN 0 THEN 'Creative Commons 0' WHEN 1 THEN 'Attribution' WHEN 2 THEN 'Attribution NonCommercial' ELSE 'Sampling+' END AS license FROM pages)
  SELECT page_id, license, page_id % 4 <> 0 AS needs_credit, '"' || url || '" by u' || page_id || CASE WHEN page_id % 4 <> 0 THEN ' (' || license || ')' ELSE ' (CC0)' END AS attribution FROM l WHERE page_id % 4 <> 3""")
def q_license(spark, sf):
    m = F.col("page_id") % 4
    p = views.table(spark, sf, "pages").select("page_id", "url", F.when(m == 0, "Creative Commons 0").when(m == 1, "Attribution").when(m == 2, "Attribution NonCommercial").otherwise("Sampling+").alias("license"))
    return ct.license_split(p, "license", F.col("url"), F.concat(F.lit("u"), "page_id")).drop("url")


@query("g11_resolve_reference", """
  WITH i AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_id % 4 = 0 AND event_id % 8 = 0 AS known, event_id % 4 = 1 AS gen FROM events),
  t AS (SELECT *, sum(CASE WHEN NOT known AND gen THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM i WHERE n <= 8)
  SELECT user_id, event_id, CASE WHEN known THEN 'lib_' || event_id WHEN gen THEN CASE WHEN g <= 3 THEN 'gen_' || event_id END WHEN event_type IN ('click', 'view') THEN 'stk_' || event_type WHEN event_type = 'purchase' THEN 'lib_match' END AS resolved,
    CASE WHEN NOT known AND gen AND g > 3 THEN 'generation_cap' WHEN NOT known AND NOT gen AND event_type NOT IN ('click', 'view', 'purchase') THEN 'no_media' END AS dropped FROM t""")
def q_reference(spark, sf):
    e = views.table(spark, sf, "events")
    n = F.col("event_id")
    items = e.select("user_id", "event_id", F.when(n % 4 == 0, F.concat(F.lit("lib_"), n.cast("string"))).alias("asset_id"), (n % 4 == 1).alias("generate"), F.lit("video").alias("kind"), F.initcap("event_type").alias("query"))
    known = e.filter(n % 8 == 0).select(F.concat(F.lit("lib_"), n.cast("string")).alias("asset_id"))
    provider = e.filter(F.col("event_type").isin("click", "view")).select(F.lit("video").alias("kind"), F.col("event_type").alias("query"), F.concat(F.lit("stk_"), "event_type").alias("asset_id")).distinct()
    labels = e.filter("event_type = 'purchase'").select(F.col("event_type").alias("query"), F.lit("lib_match").alias("asset_id")).distinct()
    return ct.resolve_reference(items, known, provider, labels, "user_id", "event_id")


@query("g12_merge_libraries", """
  SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, o_orderdate DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def q_merge(spark, sf):
    return ct.merge_libraries(views.table(spark, sf, "orders"), "o_custkey", F.col("o_orderstatus") == "F", "o_orderdate", "o_orderkey", ["o_orderkey", "o_orderstatus"])


@query("g13_default_chain", """
  WITH w AS (SELECT c_custkey, c_custkey * 7 AS r, c_custkey * 3 + 1 AS d FROM customer)
  SELECT w.c_custkey AS o_custkey, coalesce((SELECT o_orderkey FROM orders o WHERE o.o_custkey = w.c_custkey AND o_orderkey = r), (SELECT o_orderkey FROM orders o WHERE o.o_custkey = w.c_custkey AND o_orderkey = d),
    (SELECT min(o_orderkey) FROM orders o WHERE o.o_custkey = w.c_custkey AND o_orderstatus = 'F'), (SELECT min(o_orderkey) FROM orders o WHERE o.o_custkey = w.c_custkey)) AS chosen FROM w""")
def q_default(spark, sf):
    c = views.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_custkey") * 7).alias("r"), (F.col("c_custkey") * 3 + 1).alias("d"))
    return ct.default_chain(c, views.table(spark, sf, "orders"), "o_custkey", "o_orderkey", F.col("o_orderstatus") == "F", ["r", "d"])


@query("g14_next_free_name", """
  WITH u AS (SELECT o_custkey, list(DISTINCT o_orderkey % 7 + 1) AS used FROM orders GROUP BY o_custkey), f AS (SELECT o_custkey, list_min(list_filter(range(1, len(used) + 2), lambda n: NOT list_contains(used, n))) AS n FROM u)
  SELECT o_custkey, CASE WHEN n = 1 THEN 'Outro' ELSE 'Outro ' || n END AS name FROM f""")
def q_name(spark, sf):
    n = F.col("o_orderkey") % 7 + 1
    o = views.table(spark, sf, "orders").select("o_custkey", F.when(n == 1, "OUTRO ").otherwise(F.concat(F.lit("outro "), n.cast("string"))).alias("name"))
    return ct.next_free_name(o, "o_custkey", "name")


@query("g15_preset_override", """
  SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN event_id % 5 END, CASE event_type WHEN 'click' THEN 10 WHEN 'view' THEN 20 END, 3) AS chunk_words, coalesce(CASE WHEN event_id % 4 = 0 THEN 'red' END, CASE WHEN event_type = 'view' THEN 'blue' END, 'white') AS color FROM events""")
def q_preset(spark, sf):
    e = views.table(spark, sf, "events")
    t = F.col("event_type")
    return e.select("event_id", ct.preset_override(F.when(t == "click", 10).when(t == "view", 20), F.lit(3), F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 5)).alias("chunk_words"),
                    ct.preset_override(F.when(t == "view", "blue"), F.lit("white"), F.when(F.col("event_id") % 4 == 0, "red")).alias("color"))
