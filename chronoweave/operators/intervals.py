"""Interval algebra over any owner key.

Times are integer milliseconds, so the merge and touch tolerances of the float
rules (1e-6 s) become exact comparisons. Every operator is ``DataFrame ->
DataFrame``; long owners are split by time buckets or at points where the state
provably resets, never gathered whole.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.operators import joins
from chronoweave.operators.scans import following, previous, running_max, running_sum, scan
from chronoweave.operators.staging import stage

# Fixed values (milliseconds).
MIN_CUT_MS = 120
MIN_KEPT_MS = 250
MIN_SPEED_MS = 150
MIN_LANE_MS = 50
MIN_GAP_MS = 550
MIN_SILENCE_MS = 380
HEAD_PAD_MS = 80
TAIL_PAD_MS = 120
BLIND_LEAD_MS = 320
SPEECH_GAP_MS = 700
SPEECH_TAIL_MS = 350
SNAP_MS = 180
COVER_SLACK_MS = 50
MIN_RATE, MAX_RATE = 0.2, 3.0
FADE_CAP_MS = 1200.0
DAY_MS = 86_400_000
KEPT_BLOCK, NONE_KEPT = 512, -(1 << 62)


def _bucket(col: str, width: int = DAY_MS) -> Column:
    return F.floor(F.col(col) / width)


def islands(df: DataFrame, keys: list[str], start: str, end: str, tie: str, touch: bool = True,
            slack: int = 0, name: str = "island", bucket_ms: int = DAY_MS) -> DataFrame:
    """Number runs of spans chained by overlap (``touch`` also chains spans that only meet)."""
    df = scan(df, keys, [start, end, tie], _bucket(start, bucket_ms), __prev_end=running_max(F.col(end), inclusive=False))
    edge = F.col("__prev_end") + slack
    fresh = F.col("__prev_end").isNull() | ((F.col(start) > edge) if touch else (F.col(start) >= edge))
    df = stage(df.withColumn("__fresh", fresh.cast("long")), "islands")
    return scan(df, keys, [start, end, tie], _bucket(start, bucket_ms), **{name: running_sum(F.col("__fresh"))}).drop("__prev_end", "__fresh")


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str, tie: str, lo: int, hi: int,
                    min_len: int = MIN_CUT_MS, pad: int = 0, enabled: Column | None = None,
                    strict_min: bool = False) -> DataFrame:
    """Clip to ``[lo, hi]`` (padded), drop short spans, merge what overlaps or touches."""
    if enabled is not None:
        df = df.filter(enabled)
    df = df.select(*keys, tie, F.greatest(F.lit(lo), F.col(start) - pad).alias(start),
                   F.least(F.lit(hi), F.col(end) + pad).alias(end))
    length = F.col(end) - F.col(start)
    df = df.filter(length > min_len if strict_min else length >= min_len)
    return (islands(df, keys, start, end, tie).groupBy(*keys, "island")
            .agg(F.min(start).alias(start), F.max(end).alias(end)))


def complement(owners: DataFrame, merged: DataFrame, keys: list[str], start: str, end: str, lo: int, hi: int,
               min_len: int = MIN_KEPT_MS) -> DataFrame:
    """Windows of ``[lo, hi]`` outside ``merged``; an owner with none keeps the whole trim."""
    prev = scan(merged, keys, [start], _bucket(start), __p=previous(F.col(end)))
    gaps = prev.select(*keys, F.coalesce("__p", F.lit(lo)).alias(start), F.col(start).alias(end))
    tails = merged.groupBy(*keys).agg(F.max(end).alias(start)).withColumn(end, F.lit(hi).cast("long"))
    kept = gaps.unionByName(tails).filter(F.col(end) - F.col(start) >= min_len)
    whole = owners.select(*keys).distinct().join(kept.select(*keys).distinct(), keys, "left_anti")
    whole = whole.select(*keys, F.lit(lo).cast("long").alias(start), F.lit(hi).cast("long").alias(end))
    return kept.unionByName(whole)


def _exits(until: np.ndarray, end: np.ndarray) -> tuple[list[int], list[int]]:
    """A block of steps "m becomes ``end`` if it is at most ``until``" as one step function: for m up to t[k] it ends as x[k], beyond the last t it stays.

    From the last row back: a row's end meets the first later row that takes it. The rows that can be first
    for some m are those whose ``until`` exceeds all before; they are what is left on the stack.
    """
    ends = end.tolist()
    stack, low = [], []  # rows, and minus their ``until``, which falls towards the block's start
    for i in range(len(ends) - 1, -1, -1):
        k = bisect_right(low, -ends[i])
        if k:
            ends[i] = ends[stack[k - 1]]
        u = int(until[i])
        while low and -low[-1] <= u:
            low.pop(), stack.pop()
        low.append(-u), stack.append(i)
    t, x = [], []
    for u, i in zip(reversed(low), reversed(stack)):
        if x and x[-1] == ends[i]:
            t[-1] = -u
        else:
            t.append(-u), x.append(ends[i])
    return t, x


def _lists(column: pa.Array) -> list[np.ndarray]:
    return [v.values.to_numpy() for v in column]


def last_kept(df: DataFrame, keys: list[str], order: list[str], until: Column, end: Column, out: str) -> DataFrame:
    """Add ``out``: the ``end`` of the last kept row before each row, null if there is none; a row is kept if that is at most ``until``.

    Exact, and linear in the rows. Rows are numbered along a key and cut into blocks; a
    block composes into one step function, all blocks at once. What runs in order per key
    is one look-up a block, streaming over those functions; then all blocks are walked at
    once from the value that enters them. No island or key is ever one array. Columns
    of ``order`` are longs, or any that sort; the first one is a time in milliseconds.
    """
    base = df.columns
    n = scan(df.withColumns({"__until": until.cast("long"), "__end": end.cast("long")}), keys, order, _bucket(order[0]), __no=running_sum(F.lit(1).cast("long"), False))
    row = F.struct("__no", *[F.col(c) for c in [*base, "__until", "__end"]])
    blocks = n.groupBy(*keys, F.floor(F.col("__no") / KEPT_BLOCK).alias("__b")).agg(F.array_sort(F.collect_list(row), lambda a, b: (a["__no"] - b["__no"]).cast("int")).alias("__rows"))
    blocks = stage(blocks.withColumn("__id", F.monotonically_increasing_id()), "blocks")
    of = lambda f: F.transform("__rows", lambda r: r[f])

    def table(u: pa.Array, e: pa.Array) -> pa.Array:
        both = [_exits(a, b) for a, b in zip(_lists(u), _lists(e))]
        kind = pa.list_(pa.int64())
        return pa.StructArray.from_arrays([pa.array([t for t, _ in both], kind), pa.array([x for _, x in both], kind)], ["t", "x"])

    def entering(batches):
        key, m = None, NONE_KEPT
        for b in batches:
            ids, got = b.column("__id"), []
            for k, t, x in zip(zip(*(b.column(c).to_pylist() for c in keys)), _lists(b.column("t")), _lists(b.column("x"))):
                if k != key:
                    key, m = k, NONE_KEPT
                got.append(m)
                at = int(np.searchsorted(t, m))
                m = int(x[at]) if at < len(x) else m
            yield pa.RecordBatch.from_arrays([ids, pa.array(got, pa.int64())], ["__id", "__m"])

    def walked(m: pa.Array, u: pa.Array, e: pa.Array) -> pa.Array:
        out = []
        for now, us, es in zip(m.to_pylist(), _lists(u), _lists(e)):
            before = []
            for a, b in zip(us.tolist(), es.tolist()):
                before.append(now)
                if now <= a:
                    now = b
            out.append([None if v == NONE_KEPT else v for v in before])
        return pa.array(out, pa.list_(pa.int64()))

    functions = blocks.select(*keys, "__b", "__id", F.arrow_udf(table, "struct<t: array<bigint>, x: array<bigint>>")(of("__until"), of("__end")).alias("f")).select(*keys, "__b", "__id", "f.*")
    carries = functions.repartition(*keys).sortWithinPartitions(*keys, "__b").mapInArrow(entering, "__id bigint, __m bigint")
    walk = F.arrow_udf(walked, "array<bigint>")(F.col("__m"), of("__until"), of("__end"))
    rows = blocks.join(carries, "__id").select("__rows", walk.alias("__before")).select(F.explode(F.arrays_zip("__rows", "__before")).alias("z"))
    return rows.select(*[F.col("z.__rows")[c].alias(c) for c in base], F.col("z.__before").alias(out))


def drop_overlapping(df: DataFrame, keys: list[str], start: str, end: str, tie: str, fields: list[str]) -> DataFrame:
    """Keep a span only if it starts at or after the end of the last *kept* one; in order of start, then ``tie``."""
    s = last_kept(df.select(*keys, start, tie, end, *fields), keys, [start, tie], F.col(start), F.col(end), "__last")
    return s.filter(F.col("__last").isNull() | (F.col(start) >= F.col("__last"))).drop("__last")


def exclusive_order(df: DataFrame, keys: list[str], start: str, end: str, tie: str, min_len: int = MIN_LANE_MS) -> DataFrame:
    """Push each start to the end of the last kept span; drop what becomes too short."""
    long = F.col(end) - F.col(start) >= min_len
    s = last_kept(df.select(*keys, start, end, tie), keys, [start, end, tie], F.when(long, F.col(end) - min_len).otherwise(NONE_KEPT - 1), F.col(end), "__last")
    s = s.withColumn(start, F.greatest(start, "__last"))
    return s.filter(F.col(end) - F.col(start) >= min_len).drop("__last")


def speed_rate(kind: Column, rate: Column) -> Column:
    return F.when(kind == "freeze", F.lit(0.0)).otherwise(F.greatest(F.lit(MIN_RATE), F.least(F.lit(MAX_RATE), rate)))


def split_by_overlay(windows: DataFrame, overlay: DataFrame, keys: list[str], start: str, end: str, rate: str,
                     bin_ms: int = DAY_MS) -> DataFrame:
    """Cut each window at the edges of the (disjoint) overlay spans; overlay pieces carry its rate."""
    o = overlay.select(*keys, F.col(start).alias("__os"), F.col(end).alias("__oe"), rate)
    hit = joins.overlaps(windows, o, keys, start, end, "__os", "__oe", bin_ms)
    inside = stage(hit.select(*keys, F.col(start).alias("__ws"), F.col(end).alias("__we"),
                              F.greatest(start, "__os").alias("s"), F.least(end, "__oe").alias("e"), rate), "overlay")
    wk = [*keys, "__ws", "__we"]
    prev = scan(inside, wk, ["s"], _bucket("s"), __p=previous(F.col("e")))
    before = prev.select(*wk, F.coalesce("__p", "__ws").alias("s"), F.col("s").alias("e"), F.lit(None).cast("double").alias(rate))
    tail = inside.groupBy(*wk).agg(F.max("e").alias("s")).select(*wk, "s", F.col("__we").alias("e"), F.lit(None).cast("double").alias(rate))
    whole = windows.select(*keys, F.col(start).alias("__ws"), F.col(end).alias("__we")).join(inside.select(*wk).distinct(), wk, "left_anti")
    whole = whole.select(*wk, F.col("__ws").alias("s"), F.col("__we").alias("e"), F.lit(None).cast("double").alias(rate))
    pieces = inside.unionByName(before).unionByName(tail).unionByName(whole).filter("e > s")
    return pieces.select(*keys, F.col("s").alias(start), F.col("e").alias(end), rate)


def window_length(start: Column, end: Column, rate: Column) -> Column:
    """Output length; a freeze (rate 0) lasts as long as its source."""
    src = F.greatest(F.lit(0), end - start).cast("double")
    r = F.coalesce(rate, F.lit(1.0))
    return F.when(r > 0, src / r).otherwise(src)


def output_clock(windows: DataFrame, keys: list[str], start: str, end: str, rate: str) -> DataFrame:
    """Windows with index, length and the output time at which each begins and ends."""
    w = windows.withColumn("len", window_length(F.col(start), F.col(end), F.col(rate)))
    w = scan(w, keys, [start], _bucket(start), out_before=running_sum(F.col("len"), False), idx=running_sum(F.lit(1).cast("long"), False))
    return w.withColumn("out_end", F.col("out_before") + F.col("len"))


def output_duration(windows: DataFrame, keys: list[str], start: str, end: str, rate: str) -> DataFrame:
    return windows.groupBy(*keys).agg(F.sum(window_length(F.col(start), F.col(end), F.col(rate))).alias("output_ms"))


def locate_on_windows(probes: DataFrame, clock: DataFrame, keys: list[str], t: str, probe_id: str,
                      start: str, end: str, rate: str, bucket_ms: int = DAY_MS) -> DataFrame:
    """For each source instant: output time, next kept instant, window index and rate in force.

    One as-of pass finds the first window ending at or after the instant.
    """
    totals = clock.groupBy(*keys).agg(F.max("out_end").alias("__total"), F.max(end).alias("__last"))
    hit = joins.asof(probes, clock.withColumn("__rt", F.col(end)), keys, t, "__rt", [start, end, rate, "out_before", "idx"],
                     bucket_ms, before=None, after="w", tolerance=-0.5, left_id=probe_id)
    hit = hit.join(totals, keys)
    r = F.coalesce(F.col("w")[rate], F.lit(1.0))
    inside = F.col("w").isNotNull() & (F.col(t) >= F.col("w")[start])
    to_out = F.when(F.col("w").isNull(), F.col("__total")).when(~inside, F.col("w")["out_before"]).otherwise(
        F.col("w")["out_before"] + (F.col(t) - F.col("w")[start]) / F.when(r > 0, r).otherwise(F.lit(1.0)))
    nxt = F.when(F.col("w").isNull(), F.col("__last")).when(~inside, F.col("w")[start]).otherwise(F.col(t))
    return hit.select(*probes.columns, to_out.alias("output_ms"), nxt.alias("next_kept_ms"),
                      F.when(inside, F.col("w")["idx"]).otherwise(F.lit(-1)).cast("long").alias("window_index"),
                      F.when(inside, r).otherwise(F.lit(1.0)).alias("rate_at"))


def output_to_source(probes: DataFrame, clock: DataFrame, keys: list[str], out: str, probe_id: str,
                     start: str, end: str, rate: str, bucket_ms: int = DAY_MS) -> DataFrame:
    """Inverse of the clock map, clamped to the last window's end."""
    last = clock.groupBy(*keys).agg(F.max(end).alias("__last"))
    hit = joins.asof(probes, clock.withColumn("__rt", F.col("out_end")), keys, out, "__rt", [start, rate, "out_before"],
                     bucket_ms, before=None, after="w", tolerance=-0.125, left_id=probe_id).join(last, keys)
    r = F.coalesce(F.col("w")[rate], F.lit(1.0))
    src = F.col("w")[start] + F.greatest(F.lit(0.0), F.col(out) - F.col("w")["out_before"]) * F.when(r > 0, r).otherwise(F.lit(1.0))
    return hit.select(*probes.columns, F.when(F.col("w").isNull(), F.col("__last").cast("double")).otherwise(src).alias("source_ms"))


def onset_gaps(onsets: DataFrame, keys: list[str], t: str, tie: str, lo: int, hi: int, min_gap: int = MIN_GAP_MS) -> DataFrame:
    """Pauses between onsets, head and tail of the window included."""
    inside = onsets.filter((F.col(t) >= lo - 50) & (F.col(t) <= hi))
    prev = scan(inside, keys, [t, tie], _bucket(t), __p=previous(F.col(t)))
    gaps = prev.select(*keys, F.coalesce("__p", F.lit(lo)).alias("start_ms"), F.col(t).alias("end_ms"))
    tails = inside.groupBy(*keys).agg(F.max(t).alias("start_ms")).withColumn("end_ms", F.lit(hi).cast("long"))
    empty = onsets.select(*keys).distinct().join(inside.select(*keys).distinct(), keys, "left_anti")
    empty = empty.select(*keys, F.lit(lo).cast("long").alias("start_ms"), F.lit(hi).cast("long").alias("end_ms"))
    return gaps.unionByName(tails).unionByName(empty).filter(F.col("end_ms") - F.col("start_ms") >= min_gap)


def pair_start_end(log: DataFrame, keys: list[str], t: str, tie: str, is_start: Column, is_end: Column) -> DataFrame:
    """Pair each end row with the latest start since the previous end."""
    log = log.filter(is_start | is_end)
    at = F.struct(F.col(t), F.col(tie))
    s = scan(log, keys, [t, tie], _bucket(t), __s=previous(F.when(is_start, at)), __e=previous(F.when(is_end, at)))
    ok = is_end & F.col("__s").isNotNull() & (F.col("__e").isNull() | (F.col("__s") > F.col("__e")))
    return s.filter(ok).select(*keys, F.col("__s")[t].alias("start_ms"), F.col(t).alias("end_ms"))


def pause_candidates(gaps: DataFrame, silences: DataFrame | None, keys: list[str], lo: int, hi: int,
                     bin_ms: int = DAY_MS) -> DataFrame:
    """Gap ∩ silence, padded inward and numbered per owner; without silences the gap is shortened instead."""
    if silences is None:
        both = gaps.select(*keys, (F.col("start_ms") + BLIND_LEAD_MS).alias("s"), F.col("end_ms").alias("e"), F.col("start_ms").alias("g"))
    else:
        sil = silences.select(*keys, F.col("start_ms").alias("ss"), F.col("end_ms").alias("se"))
        hit = joins.overlaps(gaps, sil, keys, "start_ms", "end_ms", "ss", "se", bin_ms)
        both = hit.select(*keys, F.greatest("start_ms", "ss").alias("s"), F.least("end_ms", "se").alias("e"), F.col("start_ms").alias("g"))
        both = both.filter(F.col("e") - F.col("s") >= MIN_SILENCE_MS)
    cut = both.select(*keys, "g", F.greatest(F.lit(lo), F.col("s") + HEAD_PAD_MS).alias("start_ms"),
                      F.least(F.lit(hi), F.col("e") - TAIL_PAD_MS).alias("end_ms"))
    cut = cut.filter(F.col("end_ms") - F.col("start_ms") >= MIN_SILENCE_MS - HEAD_PAD_MS - TAIL_PAD_MS)
    cut = scan(cut, keys, ["g", "start_ms", "end_ms"], _bucket("g"), n=running_sum(F.lit(1).cast("long")))
    return cut.select(*keys, F.concat(F.lit("pause"), F.col("n").cast("string")).alias("id"), "start_ms", "end_ms",
                      (F.col("end_ms") - F.col("start_ms")).alias("saves_ms"))


def speech_spans(onsets: DataFrame, keys: list[str], t: str, tie: str, gap: int = SPEECH_GAP_MS, tail: int = SPEECH_TAIL_MS,
                 bucket_ms: int = DAY_MS) -> DataFrame:
    """Runs of speech: a word lasts to the next onset when close, else a short tail; touching runs merge."""
    w = scan(onsets.select(*keys, t, tie), keys, [t, tie], _bucket(t, bucket_ms), __n=following(F.col(t)))
    w = w.select(*keys, tie, F.col(t).alias("start_ms"),
                 F.when(F.col("__n") - F.col(t) < gap, F.col("__n")).otherwise(F.col(t) + tail).alias("end_ms"))
    return (islands(w, keys, "start_ms", "end_ms", tie, touch=True, slack=1, bucket_ms=bucket_ms).groupBy(*keys, "island")
            .agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("island"))


def covered_at(probes: DataFrame, spans: DataFrame, keys: list[str], t: str, start: str, end: str, bin_ms: int = DAY_MS) -> DataFrame:
    """Probes that fall inside any span (semi join, ``start <= t < end``)."""
    return joins.points_in_spans(probes, spans, keys, t, F.col(start), F.col(end) - 1, bin_ms, how="left_semi")


def active_at(probes: DataFrame, spans: DataFrame, keys: list[str], t: str, start: str, end: str) -> DataFrame:
    """All spans in force at each instant (``start <= t < end``), second-long and month-long ones alike."""
    return joins.stabbed(probes, spans, keys, t, F.col(start), F.col(end))


def spans_in_window(windows: DataFrame, spans: DataFrame, keys: list[str], w_start: str, w_end: str, start: str, end: str,
                    pad_in: int = 0, pad_out: int = 0, bin_ms: int = DAY_MS) -> DataFrame:
    """Spans that touch a window (padded at both ends), with clipped window-local times."""
    s = spans.withColumn("__ps", F.col(start) - pad_in).withColumn("__pe", F.col(end) + pad_out)
    hit = joins.overlaps(windows, s, keys, w_start, w_end, "__ps", "__pe", bin_ms)
    return (hit.withColumn("local_start", F.greatest(F.lit(0), F.col(start) - F.col(w_start)))
            .withColumn("local_end", F.least(F.col(w_end) - F.col(w_start), F.col(end) - F.col(w_start)))
            .drop("__ps", "__pe"))


def span_progress(hit: DataFrame, t: str, start: str, end: str, t_in: Column, t_out: Column) -> DataFrame:
    """Progress and edge fractions of a span extended by its edge lengths, at instant ``t``."""
    s, e = F.col(start) - t_in, F.col(end) + t_out
    return hit.select("*",
        ((F.col(t) - s) / F.greatest(F.lit(10.0), (e - s).cast("double"))).alias("progress"),
        F.when(t_in > 0, F.least(F.lit(1.0), (F.col(t) - s) / t_in)).otherwise(F.lit(1.0)).alias("in_u"),
        F.when(t_out > 0, F.greatest(F.lit(0.0), (F.col(t) - F.col(end)) / t_out)).otherwise(F.lit(0.0)).alias("out_u"))


def fade_ms(explicit: Column, span: Column) -> Column:
    f = F.coalesce(explicit.cast("double"), F.least(F.lit(FADE_CAP_MS), span / 6.0))
    return F.greatest(F.lit(0.0), F.least(f, span / 2.0))


def fade_level(t: Column, start: Column, end: Column, gain: Column, fade_in: Column, fade_out: Column) -> Column:
    """Level of a bed at ``t``: gain through its fades, 0 outside its span."""
    span = (end - start).cast("double")
    fi, fo = fade_ms(fade_in, span), fade_ms(fade_out, span)
    up = F.when(fi > 5.0, F.least(F.lit(1.0), (t - start) / fi)).otherwise(F.lit(1.0))
    down = F.when(fo > 5.0, F.least(F.lit(1.0), (end - t) / fo)).otherwise(F.lit(1.0))
    outside = (span <= 50.0) | (t < start) | (t >= end)
    return F.when(outside, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), up * down) * gain)


def loop_position(t: Column, start: Column, offset: Column, length: Column) -> Column:
    return F.pmod(offset + F.greatest(F.lit(0), t - start), F.greatest(F.lit(500), length))


def snap_nearest(points: DataFrame, grid: DataFrame, keys: list[str], t: str, pid: str, g: str,
                 within: int = SNAP_MS, bucket_ms: int = DAY_MS) -> DataFrame:
    """Move a time to the nearest grid value strictly within the tolerance; the earlier one wins a tie."""
    hit = joins.asof(points, grid, keys, t, g, [], bucket_ms, before="b", after="a", left_id=pid)
    db, da = F.col(t) - F.col("b.t"), F.col("a.t") - F.col(t)
    best = F.when(db <= F.coalesce(da, F.lit(1 << 40)), F.col("b.t")).otherwise(F.col("a.t"))
    delta = F.least(db, da)
    return hit.select(*points.columns, F.when(delta < within, best).otherwise(F.col(t)).alias("snapped"))


def covering_pairs(outer: DataFrame, inner: DataFrame, keys: list[str], o: tuple[str, str], i: tuple[str, str],
                   slack: int = COVER_SLACK_MS) -> DataFrame:
    """Pairs where the outer span contains the inner one, with slack at both edges."""
    return joins.stabbed(inner, outer, keys, i[0], F.col(o[0]) - slack, F.col(o[1]) + slack + 1, predicate=covers(o, i, slack))


def covers(o: tuple[str, str], i: tuple[str, str], slack: int = COVER_SLACK_MS) -> Column:
    return (F.col(o[0]) <= F.col(i[0]) + slack) & (F.col(o[1]) >= F.col(i[1]) - slack)


def reusable(windows: DataFrame, cached: DataFrame, keys: list[str], wid: str, cid: str, version: int, slack: int = COVER_SLACK_MS) -> DataFrame:
    """The stored track a window can be read from: it covers the window, has its mode and the rules' version.

    ``windows`` hold ``w_start``, ``w_end``, ``mode``; ``cached`` hold ``c_start``, ``c_end``, ``c_mode``,
    ``c_version``. Of several the shortest, then the smallest id. One row per window, null where none serves:
    a track of another mode, of an older rule or without a span never does.
    """
    live = cached.filter((F.col("c_version") == version) & F.col("c_mode").isNotNull())
    live = live.select(*keys, cid, "c_start", "c_end", F.col("c_mode").alias("mode"))
    hit = covering_pairs(live, windows.filter("w_end >= w_start"), [*keys, "mode"], ("c_start", "c_end"), ("w_start", "w_end"), slack)
    best = hit.groupBy(*keys, wid).agg(F.min(F.struct((F.col("c_end") - F.col("c_start")).alias("len"), F.col(cid).alias("id"))).alias("__b"))
    best = best.select(F.col(wid).alias("__w"), *[F.col(k).alias(f"__o_{k}") for k in keys], F.col("__b.id").alias(cid))
    on = F.col(wid) == F.col("__w")
    for k in keys:
        on = on & (F.col(k) == F.col(f"__o_{k}"))
    return windows.join(best, on, "left").drop("__w", *[f"__o_{k}" for k in keys])


def kept_track(same: Column, old: tuple[Column, Column], new: tuple[Column, Column], slack: int = COVER_SLACK_MS) -> tuple[Column, Column, Column]:
    """What is stored when a new track meets an old one: action, start and end.

    ``same``: both have one mode and the rules' version. A strictly wider old track stays, a new one that
    covers the old replaces it, others are stitched to their union; without ``same`` the new one is stored.
    """
    wide = (old[0] <= new[0] + slack) & (old[1] >= new[1] - slack)
    back = (new[0] <= old[0] + slack) & (new[1] >= old[1] - slack)
    same = F.coalesce(same & old[0].isNotNull() & old[1].isNotNull(), F.lit(False))
    act = F.when(same & wide & ~back, "keep").when(same & ~back, "stitch").otherwise("replace")
    s = F.when(act == "keep", old[0]).when(act == "stitch", F.least(old[0], new[0])).otherwise(new[0])
    e = F.when(act == "keep", old[1]).when(act == "stitch", F.greatest(old[1], new[1])).otherwise(new[1])
    return act, s, e


def clip_window(start: Column, end: Column, trim_start: Column, trim_end: Column, source_ms: Column) -> tuple[Column, Column, Column]:
    """Effective window (edit over mined, clamped to the source) and its rejection reason, if any."""
    s = F.greatest(F.lit(0), F.coalesce(trim_start, start))
    e = F.least(F.coalesce(trim_end, end), source_ms)
    why = F.when(s >= source_ms - 500, "past_end").when(e - s < 200, "empty")
    return s, e, why
