"""Clips, scenes and edits meet the words in the transcript's row: same rows as loops over single words, and no word is exchanged."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chronoweave.operators import captions as cp
from chronoweave.plans import caption_plans as pl
from chronoweave.plans.registry import QUERIES

NAMES = ["d3_group_captions", "d4_caption_hold", "d5_scene_at", "d6_peak_window", "d7_emphasis_flag", "d8_karaoke_spans", "d9_word_overrides"]


@pytest.mark.parametrize("name", NAMES)
def test_no_word_is_exchanged(spark, sf, name, capsys):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        QUERIES[name](spark, sf).explain("formatted")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = re.findall(r"\) (?:Exchange|Sort|Window)\nInput \[\d+\]: \[(.*?)\]\n", capsys.readouterr().out)
    assert len(moved) >= 3 and not any(re.search(r"\b(word_no|words|next_ms|w)#", x) for x in moved), moved


def _words(text):
    out, start = [], 0
    for k, line in enumerate(x for x in (text or "").split("\n") if x.strip(" ")):
        ws = re.split(" +", line.strip(" "))
        out += [[400 * (start + i) + 900 * k, start + i, w] for i, w in enumerate(ws)]
        start += len(ws)
    return [(t, no, w, out[i + 1][0] if i + 1 < len(out) else None) for i, (t, no, w) in enumerate(out)]


def _expected(docs):
    """All queries by loops over the clips of each id and their words."""
    out = {n: [] for n in NAMES}
    norm = lambda w: re.sub("[^a-z0-9']", "", w.lower())
    for pid in {p for p, _ in docs}:
        per = [_words(t) for p, t in docs if p == pid]
        words = sorted((w for ws in per for w in ws), key=lambda w: w[:2])
        live = []
        for t, no, w, _ in words:
            if pid is None or no % 7 != 3 and no % 5:  # a null id meets no edit
                live.append((t, w))
            elif no % 5:
                live += [(t, "two words")] * per.count(per[0])
        for i, (t, w) in enumerate(live):
            nx = live[i + 1][0] if i + 1 < len(live) else None
            toks = [x for x in re.split("[\\s　]+", w) if x]
            span = nx - t if nx is not None and nx > t + 40 else max(140 * len(toks), 280)
            out["d9_word_overrides"] += [(pid, int(t + span / len(toks) * k + 0.5), x) for k, x in enumerate(toks)]
        if pid is None or not words:
            continue
        total = words[-1][0] + 400
        scene = lambda t: next(((k, 1 + (pid + k) % 4) for k in range(total // 4000 + 1) if 1000 + 4000 * k <= t < 4500 + 4000 * k), None)  # noqa: E731, B023
        out["d5_scene_at"] += [(pid, no, scene(t)[0]) for t, no, _, _ in words if scene(t)]
        for k in range(total // 9000 + 1):
            clip, start, dur = pid * 1_000_000 + k, 3000 + 9000 * k, 12000 + 1000 * (pid % 7)
            ws = [(t - start, no, w, None if nx is None else nx - start) for t, no, w, nx in words if start - 50 <= t <= start + dur - 41 for _ in per]
            if not ws:
                continue
            phrase = [norm(w[2]) for w in ws[5:10] if norm(w[2])]
            at = next((i for i, w in enumerate(ws) if clip % 3 and w[0] >= dur // 2 - 50), None)
            probe = phrase[:4]
            if at is None and probe:
                at = next((i for i in range(len(ws) - len(probe) + 1) if [norm(w[2]) for w in ws[i:i + len(probe)]] == probe), None)
            peak = None
            if at is not None:
                after = at + max(1, len(phrase))
                a = max(0, ws[at][0])
                peak = (a, min(dur, ws[after][0] if after < len(ws) else a + 2500))
                peak = peak if peak[1] > peak[0] else None
            out["d6_peak_window"] += [(clip, *peak)] if peak else []
            runs = []
            for w in ws:
                s = scene(w[0] + start)
                if not runs or runs[-1][0] != s:
                    runs.append((s, []))
                runs[-1][1].append(w)
            for s, run in runs:
                size = s[1] if s else 3
                for g in (run[i:i + size] for i in range(0, len(run), size)):
                    a, nx = max(0, g[0][0]), g[-1][3]
                    b = min(max(a + 40, dur - 40), min(nx, a + 1150) if nx is not None else a + 360)
                    if b <= a:
                        continue
                    out["d4_caption_hold"].append((clip, g[0][1], a, b))
                    out["d3_group_captions"].append((clip, g[0][1], len(g), s[0] if s else -1, " ".join(w[2] for w in g)))
                    out["d7_emphasis_flag"].append((clip, g[0][1], bool(peak and b > peak[0] and a < peak[1])))
                    for i, w in enumerate(g if len(g) > 1 else []):
                        x = max(a, w[0])
                        y = max(x, g[i + 1][0]) if i + 1 < len(g) else b
                        out["d8_karaoke_spans"] += [(clip, g[0][1] + i, w[2], x, y)] if y - x >= 20 else []
    return out


def test_rows_equal_loops(spark, tmp_path):
    r = random.Random(3)
    text = lambda n: "\n".join(" ".join(r.choice(["a", "Bee", "c,", "De-e", "it's", "é", "a　b"]) for _ in range(r.randint(1, 14))) + " " * r.randint(0, 2) for _ in range(n))
    twice = text(9)
    docs = [(1, text(30)), (2, twice), (2, twice), (3, None), (4, " \n "), (5, "one"), (6, text(2)), (7, text(60)), (None, text(4))]
    spark.createDataFrame(docs, "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("source", F.lit("s")).write.parquet(f"{tmp_path}/documents.parquet")
    want = _expected(docs)
    for name in NAMES:
        got = Counter(map(tuple, QUERIES[name](spark, str(tmp_path)).collect()))
        assert sum(got.values()) > 20 and got == Counter(want[name]), name


def test_first_of_overlapping_scenes(spark):
    r = random.Random(8)
    rows, spans = [], []
    for p in range(40):
        rows.append((p, sorted((r.randrange(9000), k) for k in range(r.randrange(30)))))
        spans += [(p, k % 7, a, a + r.choice([-1, 0, 1, 300, 4000]), 2) for k, a in ((k, r.randrange(9000)) for k in range(r.randrange(1, 12)))]
    docs = spark.createDataFrame(rows, "key long, items array<struct<t_ms:long,word_no:long>>")
    words = cp.row_words(F.transform("items", lambda x: F.struct(x["t_ms"], x["word_no"], F.lit("w").alias("word"), F.lit(None).cast("long").alias("next_ms"))))
    d = cp.scenes_beside(docs, spark.createDataFrame(spans, "key long, scene_no long, s_start long, s_end long, size long"), "key").withColumn("ws", words)
    got = d.select("key", "items", cp.scenes_of_words(F.col("ws"), cp.scenes_in_row(F.col("ws"), F.col("scenes")), F.lit(False)).alias("s")).collect()
    assert len(got) == 40
    for x in got:
        assert x.s == [min((n for p, n, a, b, _ in spans if p == x.key and a <= w.t_ms < b), default=None) for w in x["items"]]


def test_words_of_a_clip(spark, sf):
    w = pl.clip_words(spark, sf).filter("rel < -50 OR rel > duration - 41")
    assert w.count() == 0
