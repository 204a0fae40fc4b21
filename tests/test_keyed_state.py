"""Timers and keyed state against loops, whatever the deliveries; empty logs."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from chronoweave.operators import series as sr
from chronoweave.streaming import jobs as sj

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
LOG = "job long, seq long, ts timestamp, done boolean"


def at(ms):
    return T0 + dt.timedelta(milliseconds=ms)


def loop_stalls(rows, timeout, end):
    out = []
    for job in {r[0] for r in rows}:
        deadline, last, n, final = None, None, 0, False
        events = sorted((ms, seq, done) for j, seq, ms, done in rows if j == job)
        for ms, _, done in [*events, (None, None, None)]:
            while deadline is not None and not final and (deadline < ms if ms is not None else deadline <= end):
                n += 1
                final = n > 5
                out.append((job, deadline, last, n, final))
                deadline += timeout
            if final or ms is None:
                break
            deadline, last, n = (None, ms, 0) if done else (ms + timeout, ms, n)
    return sorted(out)


@pytest.mark.parametrize("cuts", [[], [4000], [1500, 3000, 6500]])
def test_stalled_jobs_by_timers(spark, cuts):
    r = random.Random(4)
    rows = [(j, i, r.randrange(0, 8000) if j else r.randrange(0, 300), r.random() < 0.1) for j in range(6) for i in range(j * 10, j * 10 + 9)]
    rows += [(9, 900, 100, False), (7, 700, 100, False), (7, 701, 200, True), (8, 800, 9000, False)]  # only timers; done; the newest
    parts = [[x for x in rows if lo <= x[2] < hi] for lo, hi in zip([0, *cuts], [*cuts, 10**9])]
    frames = [spark.createDataFrame([(j, s, at(ms), d) for j, s, ms, d in p], LOG) for p in parts]
    with sj.keyed_timers(spark):
        got = sj.in_turns(spark, frames, lambda s: sj.stalled_jobs(s, "job", "seq", "done", 700, "0 seconds"))[0].collect()
    base = int(T0.timestamp() * 1000)
    assert sorted((g.job, g.stall_ms - base, g.last_ms - base, g.redeliveries, g.final) for g in got) == loop_stalls(rows, 700, 9000)
    assert any(g.job == 9 and g.final for g in got) and not any(g.job == 7 for g in got)


def loop_links(rows, gate):
    """rows: (seq, frame, shot, x, y); the rule written out."""
    out, shot_at = {}, None
    for shot, frame in sorted({(r[2], r[1]) for r in rows}):
        if shot != shot_at:
            tracks, fresh, before, shot_at = {}, 0, None, shot
        for f in range(frame if before is None else before + 1, frame + 1):
            for t in tracks.values():
                t[2] += 1
            if f < frame:
                tracks = {i: t for i, t in tracks.items() if t[2] <= 4}
        new = {}
        for seq, _, _, x, y in sorted(r for r in rows if r[1:3] == (frame, shot)):
            near = min(((math.sqrt((x - t[0]) ** 2 + (y - t[1]) ** 2), i) for i, t in tracks.items()), default=(gate, None))
            if near[0] < gate:
                t = tracks[near[1]]
                t[:] = [t[0] * 0.6 + x * 0.4, t[1] * 0.6 + y * 0.4, 0]
                out[seq] = (shot, near[1])
            else:
                new[fresh] = [x, y, 0]
                out[seq] = (shot, fresh)
                fresh += 1
        tracks = {i: t for i, t in {**tracks, **new}.items() if t[2] <= 4}
        before = frame
    return out


def crowded(seed):
    r = random.Random(seed)
    rows = []
    for frame in sorted(r.sample(range(60), 40)):
        for _ in range(r.randrange(1, 6)):
            rows.append((len(rows), frame * 1000 + len(rows) % 900, r.randrange(100), r.randrange(100), r.random() < 0.02))
    return rows


def test_links_of_all_detections_batch_and_stream(spark):
    rows = crowded(3)
    log = spark.createDataFrame([(1, s, at(t), t, float(x), float(y), c) for s, t, x, y, c in rows], "series_id long, seq long, ts timestamp, t_ms long, x double, y double, cut boolean")
    shots = {}
    n = 0
    for s, t, x, y, c in rows:
        n += c
        shots[s] = n
    plain = loop_links([(s, t // 1000, shots[s], float(x), float(y)) for s, t, x, y, _ in rows], 25.0)
    flat = spark.createDataFrame([(1, shots[s], t // 1000, s, float(x), float(y)) for s, t, x, y, _ in rows], "series_id long, shot long, frame long, seq long, x double, y double")
    assert {g.seq: (g.shot, g.track) for g in sr.link_tracks(flat.repartition(3), "series_id", 25.0).collect()} == plain
    parts = [log.filter("t_ms < 20500"), log.filter("t_ms >= 20500")]
    with sj.keyed_timers(spark):
        got = sj.in_turns(spark, parts, lambda s: sj.linked_detections(s, "series_id", 1000, 25.0, "0 seconds"))[0].collect()
    last = max(t for _, t, *_ in rows)
    assert {g.seq: (g.shot, g.track) for g in got} == {s: plain[s] for s, t, *_ in rows if (t // 1000 + 1) * 1000 <= last}
    assert len(got) > len(rows) / 2


def test_one_timer_a_key_links_all_frames_that_are_over(spark):
    rows = crowded(5)
    log = spark.createDataFrame([(1, s, at(t), t, float(x), float(y), c) for s, t, x, y, c in rows], "series_id long, seq long, ts timestamp, t_ms long, x double, y double, cut boolean")
    parts = [log.filter("t_ms < 20500"), log.filter("t_ms >= 20500")]
    with sj.keyed_timers(spark):
        got, progress = sj.in_turns(spark, parts, lambda s: sj.linked_detections(s, "series_id", 1000, 25.0, "0 seconds"))
    timers = sum(int(o.get("customMetrics", {}).get("numRegisteredTimers", 0)) for p in progress for o in p["stateOperators"])
    assert got.count() > len(rows) / 2 and 1 <= timers <= 2 * len(progress)


def test_empty_log(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/events.parquet").limit(0).coalesce(1).write.parquet(str(tmp_path / "e"))
    part = next((tmp_path / "e").glob("part-*.parquet"))
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "events.parquet").write_bytes(part.read_bytes())
    for name in ("k1_latest_status", "k3_stage_throughput", "k4_speech_sessions", "k7_fan_in_progress"):
        assert queries()[name](spark, str(tmp_path / "log")).count() == 0, name
