"""Pinned strings, phrase timing, caption files, sidecars and partition replacement."""

import json

from pyspark.sql import functions as F

from chronoweave.functions import text as tx
from chronoweave.operators import words as wd
from chronoweave.sources import tracks as tr


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_cleaning_order(spark):
    assert one(spark, tx.clean_cue_text(F.lit("&gt;&gt; Hi&#160;<b>you</b> [Music] &amp;lt;"))) == "Hi you &lt;"
    assert one(spark, tx.strip_tags(F.lit("a &lt;b&gt; <i>c</i>"))) == "a <b> c"
    assert one(spark, tx.norm_word(F.lit("Éta-t's!"))) == "tat's"


def test_fillers_and_fluency(spark):
    assert one(spark, tx.strip_fillers(F.lit("Um, so uh people umm decide"))) == "so people decide"
    assert [one(spark, tx.fluency_factor(F.lit(s))) for s in ("a b", "they they go", "they they go go")] == [1.0, 0.55, 0.25]


def test_titles_and_tags(spark):
    t = lambda s: one(spark, tx.sanitize_title(F.lit(s), F.lit("Fallback"), F.lit("Show")))
    assert t("SHOUTING TITLE #shorts") == "Shouting Title"
    assert t("You won't believe this") == "Fallback"
    assert t('"Show: A quiet one"') == "A quiet one"
    assert len(t("word " * 40)) <= 100
    tags = one(spark, tx.hashtag_line(F.array(*[F.lit(x) for x in ("One", "one", "#Two", "x", "a b")])))
    assert tags == "#One #Two #ab #Shorts"


def test_phrase_onsets_split(spark):
    items = F.array(F.struct(F.lit(10_000).alias("t_ms"), F.lit("so I've always").alias("word")), F.struct(F.lit(10_900).alias("t_ms"), F.lit("believed").alias("word")))
    got = one(spark, wd.expand_phrases(items))
    assert [(r.t_ms, r.word) for r in got] == [(10_000, "so"), (10_300, "I've"), (10_600, "always"), (10_900, "believed")]


def test_rolling_track(spark):
    vtt = ("WEBVTT\n\n00:00:01.000 --> 00:00:02.000 align:start\nold line\n<00:00:01.000><c> fresh</c><00:00:01.500><c> words</c>\n\n"
           "00:00:02.000 --> 00:00:02.010\nfresh words\n\n00:00:02.010 --> 00:00:03.000\nfresh words\n<00:00:02.010><c> next</c>")
    got = one(spark, tr.vtt_cues(F.lit(vtt)))
    assert [(r.start_sec, r.text) for r in got] == [(1.0, "fresh words"), (2.01, "next")]
    assert [(r.t, r.word) for r in one(spark, tr.inline_onsets(F.lit(vtt)))] == [(1.0, "fresh"), (1.5, "words"), (2.01, "next")]


def test_source_ids(spark):
    f = lambda s: one(spark, tr.source_id(F.lit(s)))
    assert f("abcdefghijk") == "abcdefghijk"
    assert f("https://youtu.be/abc123?t=5") == "abc123"
    assert f("https://www.youtube.com/watch?v=qq&list=1") == "qq"
    assert f("https://m.youtube.com/shorts/zz9") == "zz9"
    assert f("https://example.com/watch?v=qq") is None


def test_noisy_answers(spark):
    f = lambda s: one(spark, tr.json_answer(F.lit(s), "k int", "k")["k"])
    assert [f(s) for s in ('ok {"k": 1} bye', '```json\n{"k": 2}\n```', 'x {"k": 3,}')] == [1, 2, 3]
    assert f("nothing") is None


def test_files_on_disk(spark, tmp_path):
    good = {"asset_id": 1, "label": "a", "kind": "sfx", "source": "s", "size": 3}
    (tmp_path / "a.json").write_text(json.dumps(good))
    (tmp_path / "b.json").write_text("{broken")
    assert [r.asset_id for r in tr.read_sidecars(spark, str(tmp_path)).collect()] == [1]
    assert tr.list_objects(spark, str(tmp_path)).count() == 2
    out = str(tmp_path / "clips")
    df = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id long, p string, rev int")
    tr.replace_partitions(df, out, "p")
    for _ in range(2):
        tr.replace_partitions(df.filter("p = 'a'").withColumn("rev", F.lit(2)), out, "p")
    assert sorted((r.id, r.rev) for r in spark.read.parquet(out).collect()) == [(1, 2), (2, 1)]
    (tmp_path / "t.vtt").write_text("WEBVTT\n\n00:01.000 --> 00:02.000\nhello")
    t = tr.read_tracks(spark, str(tmp_path / "t.vtt")).select(F.inline(tr.vtt_cues(F.col("vtt")))).first()
    assert (t.start_sec, t.text) == (1.0, "hello")
