"""Points and spans of any mix of lengths against a loop; no key of the join above its matches."""

import random

import pytest
from pyspark.sql import functions as F

from chronoweave.operators import intervals as iv
from chronoweave.operators import joins

DAY = 86_400_000


@pytest.mark.parametrize("unit", [1, 64, 1024])
def test_stabbed_equals_a_loop(spark, unit):
    r = random.Random(unit)
    long = [(k, a, a + r.choice([0, -5, 1, 700, 5_000, 3_600_000, 40 * DAY]), i) for i, (k, a) in enumerate((r.choice(["hot", "hot", "b", None]), r.randrange(-DAY, DAY)) for _ in range(120))]
    spans = [*long, ("hot", None, 5, 900), ("hot", 5, None, 901)]
    points = [(r.choice(["hot", "hot", "b", None]), r.choice([r.randrange(-DAY, 40 * DAY), r.choice(long)[1], r.choice(long)[2]]), i) for i in range(200)] + [("hot", None, 777)]
    want = sorted((p[2], s[3]) for p in points for s in spans if None not in (p[0], p[1], s[1], s[2]) and p[0] == s[0] and s[1] <= p[1] < s[2])
    p = spark.createDataFrame(points, "k string, t long, pid long")
    s = spark.createDataFrame(spans, "k string, a long, b long, sid long")
    got = joins.stabbed(p, s, ["k"], "t", F.col("a"), F.col("b"), unit)
    assert sorted((g.pid, g.sid) for g in got.collect()) == want
    assert joins.stabbed(p, s.limit(0), ["k"], "t", F.col("a"), F.col("b"), unit).count() == 0
    assert joins.stabbed(p.limit(0), s, ["k"], "t", F.col("a"), F.col("b"), unit).count() == 0


def test_nodes_above_the_unit_hold_matches_alone(spark):
    spans = spark.range(2000).selectExpr("id AS sid", "id * 977 % 40000 AS a").withColumn("b", F.col("a") + F.when(F.col("sid") % 50 == 0, 90_000).otherwise(F.col("sid") % 7 + 1))
    nodes = spans.withColumn("n", F.explode(joins._nodes(F.col("a"), F.col("b"))))
    covered = nodes.groupBy("sid", "a", "b").agg(F.sum(F.expr("shiftleft(1L, n.k)")).alias("len"), F.min(F.expr("shiftleft(n.p, n.k)")).alias("lo"), F.max(F.expr("shiftleft(n.p + 1, n.k)")).alias("hi"))
    assert covered.count() == 2000 and covered.filter("len <> b - a OR lo <> a OR hi <> b").count() == 0
    assert nodes.groupBy("sid", "n.k").count().filter("count > 2").count() == 0


def test_tracks_are_reused_by_mode_and_version(spark):
    w = spark.createDataFrame([("o", 1, 1000, 2000, "wide"), ("o", 2, 1000, 2000, "close"), ("p", 3, 0, 10, "wide"), ("o", 4, 950, 9000, "wide"), ("o", 5, 1000, 2000, None), ("o", 6, None, 2000, "wide")], "k string, wid long, w_start long, w_end long, mode string")
    c = spark.createDataFrame([("o", 10, 1050, 1950, "wide", 16), ("o", 11, 0, 9000, "wide", 16), ("o", 12, 1000, 2000, "wide", 15), ("o", 13, 1051, 2000, "close", 16), ("o", 14, 1000, None, "close", 16), ("o", 15, 1000, 2000, "close", None)], "k string, cid long, c_start long, c_end long, c_mode string, c_version int")
    got = {r.wid: r.cid for r in iv.reusable(w, c, ["k"], "wid", "cid", 16).collect()}
    assert got == {1: 10, 2: None, 3: None, 4: 11, 5: None, 6: None}


def test_a_wider_track_stays_and_neighbours_are_stitched(spark):
    rows = [(True, 0, 1000, 100, 900), (True, 0, 1000, 0, 1000), (True, 0, 1000, 500, 2000), (True, 500, 900, 0, 1000), (False, 0, 1000, 100, 900), (True, None, 1000, 1, 2)]
    df = spark.createDataFrame(rows, "same boolean, os long, oe long, s long, e long").coalesce(1)
    act, a, b = iv.kept_track(F.col("same"), (F.col("os"), F.col("oe")), (F.col("s"), F.col("e")))
    got = [tuple(r) for r in df.select(act, a, b).collect()]
    assert got == [("keep", 0, 1000), ("replace", 0, 1000), ("stitch", 0, 2000), ("replace", 0, 1000), ("replace", 100, 900), ("replace", 1, 2)]


def test_a_span_is_copied_twice_at_most(spark):
    spans = spark.range(3000).selectExpr("id AS sid", "id * 977 % 40000 - 9000 AS u").withColumn("v", F.col("u") + F.when(F.col("sid") % 50 == 0, 90_000).otherwise(F.col("sid") % 9))
    level, held = joins._holders(F.col("u"), F.col("v"))
    n = spans.select("u", "v", level.alias("k"), F.explode(held).alias("p")).withColumns({"lo": F.expr("shiftleft(p, k)"), "hi": F.expr("shiftleft(p + 1, k)")})
    per = n.groupBy("u", "v", "k").agg(F.count("*").alias("copies"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    assert per.filter("copies > 2 OR lo > u OR hi <= v OR (k > 0 AND shiftleft(1L, k - 1) > v - u)").count() == 0


def test_sides_of_a_node_join_are_not_broadcast(spark):
    p = spark.createDataFrame([("a", 5, 1)], "k string, t long, pid long")
    s = spark.createDataFrame([("a", 0, 10**9, 1)], "k string, a long, b long, sid long")
    df = joins.stabbed(p, s, ["k"], "t", F.col("a"), F.col("b"))
    assert [(r.pid, r.sid) for r in df.collect()] == [(1, 1)]
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
