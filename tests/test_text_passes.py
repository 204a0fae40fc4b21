"""Lines normalised in one pass, sentences closed from their breaks, tags and clock texts; against plain loops."""

import random
import re

from pyspark.sql import functions as F

from chronoweave.functions import text as tx
from chronoweave.operators import words as wd
from chronoweave.plans.source_plans import clock_text
from chronoweave.sources import tracks as tr

SPACES = "\t\n\x0b\x0c\r       　﻿"
LETTERS = "abAB'09-.,éİΣ\U0001f600\u0085​"


def _lines(n):
    r = random.Random(7)
    word = lambda: "".join(r.choice(LETTERS) for _ in range(r.randint(0, 4)))
    gap = lambda: r.choice([" ", " ", " ", "  "]) if r.random() < 0.7 else "".join(r.choice(SPACES) for _ in range(r.randint(1, 3)))
    return ["".join(word() + gap() for _ in range(r.randint(0, 8))) for _ in range(n)] + ["", " ", "a a a b b", "The the THE", "co-op co op"]


def test_one_pass_over_a_line(spark):
    split = re.compile(f"[{SPACES}\\u2000-\\u200a\\u2029]+")
    norm = lambda w: re.sub("[^a-z0-9']", "", w.lower())
    lines = _lines(400)
    df = spark.createDataFrame([(x,) for x in lines], "x string")
    got = df.select("x", tx.tokens("x").alias("t"), tx.squeeze("x").alias("s"), tx.norm_tokens("x").alias("n"), tx.fluency_factor(F.col("x")).alias("f"),
                    tx.norm_words(F.array_join(tx.tokens("x"), " ")).alias("w")).collect()
    for r in got:
        want = [w for w in split.split(r.x) if w]
        assert (r.t, r.s) == (want, " ".join(want))
        assert r.n == [norm(w) for w in want if norm(w)]
        assert r.w == [norm(w) for w in want] or not want
        runs = re.findall("[a-z0-9']+", r.x.lower())
        twice = sum(a == b for a, b in zip(runs, runs[1:]))
        assert r.f == [1.0, 0.55, 0.25][min(twice, 2)]


def test_sentences_close_at_their_breaks(spark):
    r = random.Random(5)
    cases = [[(r.random() < share, r.random() < share / 2) for _ in range(n)] for n in (0, 1, 3, 4, 33, 34, 35, 37, 38, 69, 200, 1500) for share in (0.0, 0.05, 0.3)]

    def loop(marks):
        units, start, n = [], 0, len(marks)
        for i, (stop, pause) in enumerate(marks):
            length = i + 1 - start
            if ((stop or (pause and i + 1 < n)) and length >= 4) or length >= 34:
                units.append((start, i + 1))
                start = i + 1
        if start < n:
            units[-1:] = [(units[-1][0], n)] if n - start < 4 and units else [*units[-1:], (start, n)]
        return units

    rows, t = [], 0
    for k, marks in enumerate(cases):
        ws, t = [], 0
        for i, (stop, pause) in enumerate(marks):
            ws.append((i, t, t + 400, f"w{i}." if stop else f"w{i}"))
            t += 400 + 750 * pause
        rows.append((k, ws))
    df = spark.createDataFrame(rows, "k int, ws array<struct<word_no:bigint,t_ms:bigint,end_ms:bigint,word:string>>")
    for x in df.select("k", wd.segment_sentences(F.col("ws")).alias("s")).collect():
        assert [(s.word_start, s.word_end) for s in x.s] == loop(cases[x.k]), x.k
        assert [s.text for s in x.s] == [" ".join(w[3] for w in rows[x.k][1][s.word_start:s.word_end]) for s in x.s]


def test_tags_and_clock(spark):
    tags = ["One", "#one", None, "TWO", "two", "é!", "x", "İs", "three", "Three", "four", "five", "six"]
    line = lambda t: spark.range(1).select(tx.hashtag_line(F.array(*[F.lit(x) for x in t])).alias("x")).first().x
    assert line(tags) == "#One #TWO #İs #three #four"
    assert line(["a", None]) == "#Shorts" and line(["SHORTS", "ab", "AB"]) == "#SHORTS #ab"
    spell = spark.range(1).select(tx.distinct_ignore_case(F.array(*[F.lit(x) for x in tags])).alias("a"), tx.distinct_ignore_case(F.array(*[F.lit(x) for x in tags]), 2).alias("b")).first()
    assert spell.a == ["One", "#one", "TWO", "é!", "x", "İs", "three", "four", "five", "six"] and spell.b == ["One", "#one"]
    ms = [0, 999, 59_999, 3_599_999, 3_600_000, 359_999_999, 360_000_000, 3_600_000_000]
    got = spark.createDataFrame([(m,) for m in ms], "ms long").select("ms", clock_text(F.col("ms")).alias("c")).collect()
    assert all(r.c == f"{r.ms // 3600000:02d}:{r.ms // 60000 % 60:02d}:{r.ms // 1000 % 60:02d}.{r.ms % 1000:03d}" for r in got)


def test_best_track_is_built_once(spark):
    rows = [("a", 1, "en", "x"), ("a", 2, "de", "y <c>"), ("a", 3, "de", " "), ("b", 4, "fr", "z"), ("b", 5, None, "w"), ("c", 6, "de", "  "), ("c", 7, "de", None), (None, 8, "en", "v")]
    t = spark.createDataFrame(rows, "source string, doc_id long, lang string, vtt string")
    best = tr.prefer_track(t.withColumn("vtt", F.concat("vtt", F.lit(""))), "source", "lang", "vtt", ["de", "en", "fr"], "doc_id")
    assert sorted(map(tuple, best.collect()), key=str) == sorted([("a", 2, "de"), ("b", 4, "fr"), (None, 8, "en")], key=str)
    assert "trim" not in best._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[-1].split("Project", 1)[-1]


def test_words_of_a_text_equal_those_of_its_cues(spark):
    from chronoweave.plans import views
    texts = ["\n".join(_lines(12)[k:]) for k in range(12)] + ["", " ", "\n \n", "a\n\t\nb", "  a  —  b \r\n c", None]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    for r in df.select(views.text_norms(F.col("x")).alias("a"), views.norms_array(views.timed_lines(F.col("x"))).alias("b")).collect():
        assert r.a == r.b


def test_fillers_go_and_lines_without_are_left(spark):
    lines = _lines(200) + ["um", "(um) over", "Uh-huh, yes", "her um", "é um-", "umm… ER! hmm mhm x", "o'er 'um' um'", "thumb um2 2um"]
    keep = lambda w: not re.fullmatch(r"um+|uh+|er+|ah+|hmm+|mm+|uh-huh|mhm", re.sub(r"^[^\w']+|[^\w']+$", "", w.replace("_", "-")).lower())
    df = spark.createDataFrame([(x,) for x in lines], "x string")
    for r in df.select(tx.tokens("x").alias("t"), tx.strip_fillers(F.col("x")).alias("s")).collect():
        assert r.s == " ".join(w for w in r.t if keep(w))
    plan = df.select(tx.strip_fillers(F.col("x")))._jdf.queryExecution().optimizedPlan().toString()
    assert tx.HOLDS_FILLER in plan
