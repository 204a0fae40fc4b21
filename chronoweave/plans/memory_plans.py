"""Queries over preference memory, edit diffs, job tables and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweave.functions.numeric import half_up, half_up_sql
from chronoweave.functions.text import tokens
from chronoweave.operators import memory as mm
from chronoweave.operators import quality as ql
from chronoweave.plans import views
from chronoweave.plans.registry import query
from chronoweave.plans.text_plans import TOK


def events(spark, sf):
    return views.table(spark, sf, "events")


@query("j1_lessons_for", """
  WITH l AS (SELECT event_id AS lesson_id, CASE WHEN event_id % 50 = 0 THEN NULL ELSE user_id END AS scope, event_id % 10 AS weight, event_id // 7 AS "at" FROM events),
  g AS (SELECT * FROM l WHERE scope IS NULL ORDER BY weight DESC, "at" DESC, lesson_id LIMIT 18),
  b AS (SELECT scope AS project_id, lesson_id, weight, "at" FROM l WHERE scope IS NOT NULL UNION ALL SELECT u.user_id, lesson_id, weight, "at" FROM g, (SELECT DISTINCT user_id FROM events) u)
  SELECT * FROM (SELECT project_id, lesson_id, weight, row_number() OVER (PARTITION BY project_id ORDER BY weight DESC, "at" DESC, lesson_id) AS rank FROM b) WHERE rank <= 18""")
def q_lessons(spark, sf):
    e = events(spark, sf)
    n = F.col("event_id")
    l = e.select(n.alias("lesson_id"), F.when(n % 50 == 0, mm.GLOBAL).otherwise(F.col("user_id").cast("string")).alias("scope"), (n % 10).alias("weight"), F.floor(n / 7).alias("at"))
    out = mm.lessons_for(l, e.select(F.col("user_id").cast("string").alias("project_id")), "project_id")
    return out.select(F.col("project_id").cast("long").alias("project_id"), "lesson_id", "weight", "rank")


@query("j2_review_to_lessons", rf"""
  WITH t AS (SELECT conv_id * 1000 + turn AS clip_id, turn * 3 % 11 AS score, {TOK.format(x='text')} AS w FROM conversations),
  i AS (SELECT clip_id, u.word, u.k FROM t, unnest(list_slice(w, 1, 2)) WITH ORDINALITY AS u(word, k) WHERE score < 8)
  SELECT clip_id, word || ' → fix ' || word AS text, 4 AS weight FROM i WHERE k <> 2 OR clip_id % 2 = 0""")
def q_review(spark, sf):
    c = views.table(spark, sf, "conversations")
    cid = F.col("conv_id") * 1000 + F.col("turn")
    issues = F.transform(tokens(F.col("text")), lambda w, i: F.struct(w.alias("what"), F.when((i != 1) | (cid % 2 == 0), F.concat(F.lit("fix "), w)).alias("fix")))
    raw = F.to_json(F.struct((F.col("turn") * 3 % 11).alias("score"), issues.alias("issues")))
    r = c.select(cid.alias("clip_id"), F.from_json(raw, "score int, issues array<struct<what:string,fix:string>>").alias("review"))
    return mm.review_lessons(r, "clip_id", "review")


@query("j3_feedback_lessons", """
  SELECT doc_id, CASE WHEN quality = 0 THEN 'Avoid: ' ELSE 'Keep doing: ' END || 'toxic ' || toxic AS text, CASE WHEN quality = 0 THEN 9 ELSE 8 END AS weight, CASE WHEN doc_id % 2 = 0 THEN 'global' ELSE doc_id::VARCHAR END AS scope FROM labels WHERE doc_id % 5 <> 0""")
def q_feedback(spark, sf):
    l = views.table(spark, sf, "labels")
    note = F.when(F.col("doc_id") % 5 == 0, " ").otherwise(F.concat(F.lit("toxic "), F.col("toxic").cast("string")))
    out = mm.feedback_lessons(l, F.when(F.col("quality") == 0, "down").otherwise("up"), note, F.when(F.col("doc_id") % 2 == 0, mm.GLOBAL).otherwise(F.col("doc_id").cast("string")))
    return out.select("doc_id", "text", "weight", "scope")


@query("j4_crowded_scopes", """
  WITH l AS (SELECT source AS scope, doc_id AS "at", n_chars % 10 + 1 AS weight, text FROM documents),
  c AS (SELECT scope FROM l GROUP BY scope HAVING count(*) > 5),
  m AS (SELECT scope, max("at") AS "at", arg_max(weight, "at") AS weight, arg_max(text, "at") AS text FROM l GROUP BY scope, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')))
  SELECT * FROM (SELECT scope, "at", weight, text, row_number() OVER (PARTITION BY scope ORDER BY weight DESC, "at" DESC) AS rank FROM m WHERE scope IN (SELECT scope FROM c)) WHERE rank <= 20""")
def q_crowded(spark, sf):
    d = views.table(spark, sf, "documents")
    l = d.select(F.col("source").alias("scope"), F.col("doc_id").alias("at"), (F.col("n_chars") % 10 + 1).alias("weight"), "text")
    return mm.crowded_scopes(l, "scope", "at", above=5)


LANES = """l AS (SELECT user_id, event_type AS lane, event_id, '#' || event_id || ' ' || CAST(floor(value) AS BIGINT) AS line FROM events),
  before AS (SELECT user_id, lane, row_number() OVER (PARTITION BY user_id, lane ORDER BY event_id) - 1 AS line_no, line FROM l),
  after AS (SELECT user_id, lane, row_number() OVER (PARTITION BY user_id, lane ORDER BY event_id) - 1 AS line_no, line FROM l WHERE (lane <> 'click' OR user_id % 2 = 0) AND (lane <> 'view' OR event_id % 100 <> 1))"""


def lanes(spark, sf, after=False):
    e = events(spark, sf)
    if after:
        e = e.filter("(event_type <> 'click' OR user_id % 2 = 0) AND (event_type <> 'view' OR event_id % 100 <> 1)")
    line = F.concat(F.lit("#"), F.col("event_id").cast("string"), F.lit(" "), F.floor("value").cast("string"))
    return mm.describe_plan(e.withColumnRenamed("event_type", "lane"), ["user_id", "lane"], ["event_id"], line, F.floor(F.col("event_id") / 100_000))


@query("j5_lane_diff", "WITH " + LANES + """ SELECT coalesce(b.user_id, a.user_id) AS user_id, coalesce(b.lane, a.lane) AS lane, count(*) AS changed FROM before b FULL JOIN after a ON a.user_id = b.user_id AND a.lane = b.lane AND a.line_no = b.line_no
  WHERE b.line IS DISTINCT FROM a.line GROUP BY ALL""")
def q_lane_diff(spark, sf):
    return mm.lane_diff(lanes(spark, sf), lanes(spark, sf, True), ["user_id", "lane"])


@query("j6_describe_plan", "WITH " + LANES + " SELECT user_id, lane, line_no, line FROM before")
def q_describe(spark, sf):
    return lanes(spark, sf)


@query("j7_apply_selection", """
  SELECT user_id, event_id, TRUE AS enabled, 'user' AS source FROM events WHERE event_type = 'signup'
  UNION ALL SELECT user_id, event_id, event_id % 4 = 0, 'director' FROM events WHERE event_type = 'view'""")
def q_selection(spark, sf):
    e = events(spark, sf)
    cur = e.filter("event_type IN ('signup', 'error')").select("user_id", "event_id", F.lit(True).alias("enabled"), F.when(F.col("event_type") == "signup", "user").otherwise("director").alias("source"))
    cand = e.filter("event_type = 'view'").select("user_id", "event_id")
    return mm.apply_selection(cur, cand, e.filter("event_id % 4 = 0"), ["user_id"], "event_id")


@query("j8_lane_merge", "WITH " + LANES + """, lk AS (SELECT DISTINCT user_id, event_type AS lane FROM events WHERE event_type = 'view' AND user_id % 3 = 0),
  ans AS (SELECT user_id, lane, line_no, 'new ' || line AS line FROM after WHERE user_id % 2 = 1),
  rep AS (SELECT DISTINCT user_id, lane FROM ans WHERE NOT EXISTS (SELECT 1 FROM lk WHERE lk.user_id = ans.user_id AND lk.lane = ans.lane))
  SELECT b.* FROM before b WHERE NOT EXISTS (SELECT 1 FROM rep WHERE rep.user_id = b.user_id AND rep.lane = b.lane) UNION ALL SELECT a.* FROM ans a WHERE EXISTS (SELECT 1 FROM rep WHERE rep.user_id = a.user_id AND rep.lane = a.lane)""")
def q_lane_merge(spark, sf):
    answer = lanes(spark, sf, True).filter("user_id % 2 = 1").withColumn("line", F.concat(F.lit("new "), "line"))
    locked = events(spark, sf).filter("event_type = 'view' AND user_id % 3 = 0").select("user_id", F.col("event_type").alias("lane")).distinct()
    return mm.lane_merge(lanes(spark, sf), answer, locked, ["user_id", "lane"])


@query("j9_place_without_repeat", """
  WITH u AS (SELECT user_id, event_id, CAST(floor(value) AS BIGINT) AS asset FROM events WHERE event_type = 'signup'), p AS (SELECT user_id, event_id, CAST(floor(value) AS BIGINT) AS asset FROM events WHERE event_type = 'view'),
  b AS (SELECT *, 0 AS k FROM u UNION ALL SELECT *, 1 FROM p WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.user_id = p.user_id AND u.asset = p.asset))
  SELECT user_id, event_id, asset, pos FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k, event_id) AS pos FROM b) WHERE pos <= 16""")
def q_place(spark, sf):
    e = events(spark, sf).select("user_id", "event_id", F.floor("value").alias("asset"), "event_type")
    return mm.place_without_repeat(e.filter("event_type = 'signup'").drop("event_type"), e.filter("event_type = 'view'").drop("event_type"), "user_id", "asset", "event_id", 16)


@query("j10_turn_history", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE trim(text) <> '') WHERE n <= 12")
def q_history(spark, sf):
    return mm.turn_history(views.table(spark, sf, "conversations"), "conv_id", "turn").select("conv_id", "turn", "role")


def passes(spark, sf):
    c = views.table(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.when(F.col("role") == "user", "note").when(F.col("turn") % 4 == 1, "pass").alias("kind"), F.when(F.col("turn") % 5 == 0, True).alias("undone"))


def saved(spark, sf):
    return views.table(spark, sf, "conversations").filter("turn % 2 = 1").select("conv_id", "turn", F.concat(F.lit("before "), F.length("text").cast("string")).alias("before"))


STAND = """WITH t AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'note' WHEN turn % 4 = 1 THEN 'pass' END AS kind, CASE WHEN turn % 5 = 0 THEN TRUE END AS undone, length(text) AS n FROM conversations),
  s AS (SELECT conv_id, max(turn) AS turn FROM t WHERE coalesce(kind, 'pass') = 'pass' AND NOT coalesce(undone, FALSE) GROUP BY conv_id),
  st AS (SELECT s.conv_id, s.turn, CASE WHEN s.turn % 2 = 1 THEN 'before ' || t.n END AS before FROM s JOIN t ON t.conv_id = s.conv_id AND t.turn = s.turn)"""


@query("j11_latest_standing", STAND + " SELECT conv_id, turn, before FROM st")
def q_standing(spark, sf):
    return mm.latest_standing(passes(spark, sf), saved(spark, sf), "conv_id", "turn").select("conv_id", "turn", "before")


@query("j12_undo_apply", STAND + """, can AS (SELECT * FROM st WHERE before IS NOT NULL)
  SELECT t.conv_id, t.turn, t.kind, coalesce(t.undone, FALSE) OR coalesce(t.turn = can.turn, FALSE) AS undone FROM t LEFT JOIN can ON can.conv_id = t.conv_id
  UNION ALL SELECT conv_id, max(turn) + 1, 'undo', FALSE FROM t WHERE conv_id IN (SELECT conv_id FROM can) GROUP BY conv_id""")
def q_undo(spark, sf):
    p = passes(spark, sf)
    return mm.undo_apply(p, mm.latest_standing(p, saved(spark, sf), "conv_id", "turn"), "conv_id", "turn")


@query("j13_job_list", "SELECT o_orderkey, o_orderstatus, o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' AS resume FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 40")
def q_jobs(spark, sf):
    o = views.table(spark, sf, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(mm.JOB_LIST)
    return o.select("o_orderkey", "o_orderstatus", ((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "O")).alias("resume"))


@query("j14_job_swap_in", "SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN o_orderstatus = 'F' THEN 'job' || o_custkey END, 'part' || l_partkey) AS asset FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey")
def q_swap(spark, sf):
    s = views.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("part"), "l_partkey").alias("asset"))
    j = views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.concat(F.lit("job"), "o_custkey").alias("asset"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("running").alias("status"))
    return mm.job_swap_in(s, j, "l_orderkey")


@query("j15_retry_exhausted", """
  WITH j AS (SELECT user_id * 100 + event_id % 20 AS job, event_id, event_type = 'error' AS failed FROM events), g AS (SELECT job, count(*) FILTER (WHERE failed) AS failures, arg_max(failed, event_id) AS lf FROM j GROUP BY job)
  SELECT job, failures, CASE WHEN failures >= 2 THEN 'failed' ELSE 'pending' END AS state FROM g WHERE lf""")
def q_retry(spark, sf):
    e = events(spark, sf).withColumn("job", F.col("user_id") * 100 + F.col("event_id") % 20)
    return mm.retry_exhausted(e, "job", F.col("event_type") == "error", "event_id")


@query("j16_lenient_clamp", f"""
  WITH r AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN value::VARCHAR WHEN 1 THEN 'x' WHEN 2 THEN '-3' ELSE '7.6' END AS raw FROM events), n AS (SELECT *, try_cast(raw AS DOUBLE) AS v FROM r)
  SELECT event_id, CASE WHEN v IS NOT NULL THEN greatest(1e0, least(8e0, {half_up_sql('v', 0)}::DOUBLE)) END AS chunk_words, CASE WHEN v IS NULL THEN 'chunkWords is not a number' WHEN v < 1 OR v > 8 THEN 'chunkWords is out of range' END AS strict_error FROM n""")
def q_lenient(spark, sf):
    n = F.col("event_id") % 4
    raw = F.when(n == 0, F.col("value").cast("string")).when(n == 1, "x").when(n == 2, "-3").otherwise("7.6")
    j = events(spark, sf).select("event_id", F.get_json_object(F.to_json(F.struct(raw.alias("chunkWords"))), "$.chunkWords").alias("raw"))
    return j.select("event_id", mm.lenient_number(F.col("raw"), 1.0, 8.0, 0).alias("chunk_words"), mm.strict_number(F.col("raw"), 1, 8, "chunkWords").alias("strict_error"))


@query("q1_check_constraints", """
  SELECT o_orderkey, u.rule FROM (SELECT o_orderkey, list_filter([CASE WHEN NOT o_orderstatus IN ('F', 'O') THEN 'status_enum' END, CASE WHEN NOT (o_totalprice BETWEEN 1e3 AND 4e5) THEN 'price_range' END,
    CASE WHEN NOT regexp_matches(o_orderpriority, '^[1-4]-') THEN 'priority_pattern' END, CASE WHEN length(o_orderpriority) > 12 THEN 'priority_length' END], lambda x: x IS NOT NULL) AS rs FROM orders), unnest(rs) AS u(rule)""")
def q_constraints(spark, sf):
    o = views.table(spark, sf, "orders")
    return ql.check_constraints(o, ["o_orderkey"], {"status_enum": ql.enum("o_orderstatus", ["F", "O"]), "price_range": F.col("o_totalprice").between(1000.0, 400000.0),
                                                    "priority_pattern": F.col("o_orderpriority").rlike("^[1-4]-"), "priority_length": F.length("o_orderpriority") <= 12})


@query("q1_owner_caps", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 10")
def q_caps(spark, sf):
    return ql.cap_violations(views.table(spark, sf, "orders"), "o_custkey", 10)


# table, rule, kind, field, low, high, allowed
RULES = [("customer", "segment_enum", "enum", "c_mktsegment", None, None, ["BUILDING", "HOUSEHOLD", "MACHINERY", "FURNITURE"]), ("customer", "balance_floor", "range", "c_acctbal", 0.0, None, None),
         ("customer", "nation_cap", "cap", "c_nationkey", None, 55.0, None), ("orders", "price_range", "range", "o_totalprice", 1000.0, 400000.0, None), ("orders", "priority_pattern", "pattern", "o_orderpriority", None, None, ["^[1-4]-"]),
         ("orders", "customer_cap", "cap", "o_custkey", None, 10.0, None), ("part", "name_length", "length", "p_name", 1.0, 10.0, None), ("part", "size_range", "range", "p_size", 5.0, 45.0, None),
         ("supplier", "name_required", "required", "s_name", None, None, None), ("supplier", "balance_ceiling", "range", "s_acctbal", None, 9000.0, None), ("events", "type_enum", "enum", "event_type", None, None, ["view", "click", "purchase", "signup"]),
         ("events", "value_range", "range", "value", 1.0, 100.0, None)]


@query("q1_rule_table", """
  SELECT 'customer' AS "table", c_custkey::VARCHAR AS key, 'segment_enum' AS rule, 1::BIGINT AS n FROM customer WHERE c_mktsegment = 'AUTOMOBILE'
  UNION ALL SELECT 'customer', c_custkey::VARCHAR, 'balance_floor', 1 FROM customer WHERE c_acctbal < 0
  UNION ALL SELECT 'customer', c_nationkey::VARCHAR, 'nation_cap', count(*) FROM customer GROUP BY c_nationkey HAVING count(*) > 55
  UNION ALL SELECT 'orders', o_orderkey::VARCHAR, 'price_range', 1 FROM orders WHERE o_totalprice < 1e3 OR o_totalprice > 4e5
  UNION ALL SELECT 'orders', o_orderkey::VARCHAR, 'priority_pattern', 1 FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[1-4]-')
  UNION ALL SELECT 'orders', o_custkey::VARCHAR, 'customer_cap', count(*) FROM orders GROUP BY o_custkey HAVING count(*) > 10
  UNION ALL SELECT 'part', p_partkey::VARCHAR, 'name_length', 1 FROM part WHERE length(p_name) NOT BETWEEN 1 AND 10
  UNION ALL SELECT 'part', p_partkey::VARCHAR, 'size_range', 1 FROM part WHERE p_size NOT BETWEEN 5 AND 45
  UNION ALL SELECT 'supplier', s_suppkey::VARCHAR, 'name_required', 1 FROM supplier WHERE s_name IS NULL
  UNION ALL SELECT 'supplier', s_suppkey::VARCHAR, 'balance_ceiling', 1 FROM supplier WHERE s_acctbal > 9e3
  UNION ALL SELECT 'events', event_id::VARCHAR, 'type_enum', 1 FROM events WHERE event_type NOT IN ('view', 'click', 'purchase', 'signup')
  UNION ALL SELECT 'events', event_id::VARCHAR, 'value_range', 1 FROM events WHERE value < 1 OR value > 100""")
def q_rule_table(spark, sf):
    keys = {"customer": "c_custkey", "orders": "o_orderkey", "part": "p_partkey", "supplier": "s_suppkey", "events": "event_id"}
    rules = spark.createDataFrame(RULES, "table string, rule string, kind string, field string, low double, high double, allowed array<string>")
    return ql.rule_violations({t: (views.table(spark, sf, t), k) for t, k in keys.items()}, rules)


@query("p2_sparse_patch", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 3 = 1 THEN NULL ELSE 'set ' || user_id END AS title FROM events""")
def q_patch(spark, sf):
    n = F.col("event_id") % 3
    return events(spark, sf).select("event_id", ql.sparse_patch(F.col("event_type"), n != 0, F.concat(F.lit("set "), "user_id"), n == 1).alias("title"))


@query("p3_spec_normalise", f"""
  WITH s AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'fast' WHEN 'click' THEN 'freeze' ELSE 'slow' END AS kind, CASE WHEN event_id % 4 <> 0 THEN value / 1e2 END AS rate, CASE WHEN event_id % 5 <> 0 THEN value / 4e2 END AS amount FROM events),
  r AS (SELECT *, greatest(0e0, least(3e0, coalesce(rate, CASE WHEN kind = 'fast' THEN 15e-1 ELSE 5e-1 END))) AS raw FROM s)
  SELECT event_id, kind, CASE kind WHEN 'freeze' THEN 0e0 WHEN 'fast' THEN {half_up_sql('greatest(11e-1, least(3e0, raw))', 3)} ELSE {half_up_sql('greatest(2e-1, least(9e-1, raw))', 3)} END AS rate,
    {half_up_sql('greatest(0e0, least(1e0, coalesce(amount, 7e-1)))', 3)} AS amount, CASE WHEN abs(raw - 1) >= 5e-3 THEN raw END AS zoom FROM r""")
def q_spec(spark, sf):
    t = F.col("event_type")
    kind = F.when(t == "view", "fast").when(t == "click", "freeze").otherwise("slow")
    e = events(spark, sf).select("event_id", kind.alias("kind"), F.when(F.col("event_id") % 4 != 0, F.col("value") / 100.0).alias("rate"), F.when(F.col("event_id") % 5 != 0, F.col("value") / 400.0).alias("amount"))
    raw = F.greatest(F.lit(0.0), F.least(F.lit(3.0), F.coalesce(F.col("rate"), F.when(F.col("kind") == "fast", 1.5).otherwise(0.5))))
    return e.select("event_id", "kind", ql.speed_spec(F.col("kind"), F.col("rate")).alias("rate"), ql.amount_spec(F.col("amount")).alias("amount"), ql.without_default(raw, 1.0).alias("zoom"))


@query("p4_parity_check", "SELECT l_orderkey, l_linenumber, CAST(floor(l_quantity) AS BIGINT) AS v, s.side FROM lineitem, (VALUES ('left'), ('right')) AS s(side) WHERE FALSE UNION ALL SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT), 'left' FROM lineitem WHERE l_quantity = 50 UNION ALL SELECT l_orderkey, l_linenumber, 49, 'right' FROM lineitem WHERE l_quantity = 50")
def q_parity(spark, sf):
    l = views.table(spark, sf, "lineitem")
    a = l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("v"))
    b = l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.least(F.lit(49), F.floor("l_quantity")).cast("long").alias("v"))
    return ql.parity_check(a, b).drop("l_partkey", "l_suppkey")
