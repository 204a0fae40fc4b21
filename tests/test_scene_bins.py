"""Scenes of clip words by bin: as by ``scene_at``, without moving the words again."""

import random

from chronoweave.operators import captions as cp


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]


def test_scene_in_bin_equals_scene_at(spark):
    r = random.Random(4)
    words = spark.createDataFrame([(r.choice([1, 2, None]), k, r.randrange(200_000), f"w{k}") for k in range(300)], "project_id long, word_no long, t_ms long, word string")
    clips = spark.createDataFrame([(p, 10 * p + k, 20_000 * k, 20_000 * k + 31_000) for p in (1, 2, 3) for k in range(9)], "project_id long, clip_id long, c_start long, c_end long")
    scenes = [(r.choice([1, 2]), k % 25, a, a + r.choice([0, 1, 900, 40_000]), k % 25 % 4) for k, a in ((k, r.randrange(200_000)) for k in range(60))]
    scenes = spark.createDataFrame([*scenes, scenes[0]], "project_id long, scene_no long, s_start long, s_end long, size long")
    cols = ["project_id", "clip_id", "word_no", "scene"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        old = cp.scene_at(cp.words_in_window(clips, words, "project_id"), scenes, "project_id", ["clip_id", "word_no"]).select(*cols)
        new = cp.scene_in_bin(cp.words_in_window(clips, words, "project_id", keep_bin=True), scenes, "project_id").select(*cols)
        assert plan(new).count("Exchange hashpartitioning") == 3 < plan(old).count("Exchange hashpartitioning")
        got = sorted(map(tuple, new.collect()), key=repr)
        assert len(got) > 300 and got == sorted(map(tuple, old.collect()), key=repr)
        assert any(g[3] is None for g in got) and any(g[3] for g in got)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
