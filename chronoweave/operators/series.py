"""Sampled series per key: shots, smoothing, correlation, folds, as-of interpolation.

Order along a series is (t_ms, seq). Frames of neighbouring rows use index
buckets with a halo of copied edge rows, so a hot series is cut into many
partitions; linear recurrences compose per bucket; other folds run per shot,
because a cut resets their state.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.functions.binding import let
from chronoweave.operators import joins
from chronoweave.operators.folds import collect_ordered
from chronoweave.operators.scans import Running, composed, following, previous, running_sum, scan
from chronoweave.operators.staging import stage

# Fixed values.
MIN_PRESENCE = 0.4
SEAT_GAP, SEAT_GATE = 0.1, 0.12
SWITCH_MARGIN, DUAL_SCORE = 0.14, 0.34
FACE_EMA = 0.5
MOVE_PX = 48.0
SAME_PX, SNAP_SHARE = 4.0, 0.25
TRACK_KEEP, TRACK_NEW, MAX_MISSES = 0.6, 0.4, 4
DAY_MS = 86_400_000
IDX_BUCKET = 65_536
BATCH_BYTES = 32 << 20
ORDER = ["t_ms", "seq"]


def _tb(width: int = DAY_MS) -> Column:
    return F.floor(F.col("t_ms") / width)


def frame_change(frames: DataFrame, order: str, vec: str, threshold: float, bucket: int = 100_000) -> DataFrame:
    """Mean absolute difference to the previous frame; above the threshold it is a cut."""
    f = frames.select(F.lit(0).alias("__k"), order, F.col(vec).cast("array<double>").alias("v"))
    s = scan(f, ["__k"], [order], F.floor(F.col(order) / bucket), p=previous(F.col("v")))
    total = F.aggregate(F.zip_with("v", "p", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda acc, x: acc + x)
    return s.withColumn("diff", F.floor(total / F.size("v") * 1e6 + 0.5) / 1e6).select(order, "diff", F.coalesce(F.col("diff") > threshold, F.lit(False)).alias("cut"))


def mark_cuts(frames: DataFrame, cuts: DataFrame, key: str, bin_ms: int) -> DataFrame:
    """External cut times flag the first bin at or after them: never a series' first bin, nor one past its last."""
    last = frames.groupBy(key).agg(F.max("i").alias("__last"))
    at = F.greatest(F.lit(1), F.least(F.col("__last"), F.ceil(F.col("t_ms") / bin_ms)))
    c = cuts.select(key, "t_ms").join(last, key).select(key, at.cast("long").alias("i")).distinct().withColumn("__x", F.lit(True))
    return frames.join(c, [key, "i"], "left").select(key, "i", (F.col("cut") | F.coalesce("__x", F.lit(False))).alias("cut"))


def with_shots(series: DataFrame, key: str = "series_id") -> DataFrame:
    """Add the row index, the shot (cuts so far) and the next row's time."""
    return scan(series, [key], ORDER, _tb(), i=running_sum(F.lit(1).cast("long"), False), shot=running_sum(F.col("cut").cast("long")), next_t=following(F.col("t_ms")))


def shots(indexed: DataFrame, key: str = "series_id") -> DataFrame:
    return indexed.groupBy(key, "shot").agg(F.min("i").alias("from_i"), (F.max("i") + 1).alias("to_i"), F.count("*").alias("n"))


def presence(series: DataFrame, key: str, present: Column) -> DataFrame:
    g = series.groupBy(key).agg(F.count("*").alias("n"), F.count_if(present).alias("seen"))
    share = F.col("seen") / F.col("n")
    return g.select(key, "n", "seen", F.when(share < MIN_PRESENCE, "static").otherwise("track").alias("mode"))


def seats_1d(series: DataFrame, keys: list[str], x100: str, width100: int) -> DataFrame:
    """Positions split where the gap exceeds a tenth of the width; mean per cluster.

    Positions are counted first, and a break needs a tenth of the width, so a
    group has at most eleven seats.
    """
    c = series.groupBy(*keys, x100).agg(F.count("*").alias("n"))
    gap = int(width100 * SEAT_GAP)
    c = scan(c, keys, [x100], F.floor(F.col(x100) / 1000), __p=previous(F.col(x100)))
    c = stage(c.withColumn("__new", (F.col("__p").isNotNull() & (F.col(x100) - F.col("__p") > gap)).cast("long")), "seats")
    c = scan(c, keys, [x100], F.floor(F.col(x100) / 1000), seat=running_sum(F.col("__new")))
    g = c.groupBy(*keys, "seat").agg(F.sum(F.col(x100) * F.col("n")).alias("sx"), F.sum("n").alias("n"))
    return g.select(*keys, "seat", "n", (F.col("sx") / F.col("n") / 100.0).alias("centre"))


def seat_arrays(seats: DataFrame, keys: list[str]) -> DataFrame:
    return seats.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seat", "centre"))).alias("seats"))  # at most eleven


def assign_nearest_gated(series: DataFrame, seats: DataFrame, keys: list[str], x: str, width: float) -> DataFrame:
    """Nearest seat strictly inside the gate; rows without one are dropped."""
    j = series.join(seat_arrays(seats, keys), keys)
    best = F.array_min(F.transform("seats", lambda s: F.struct(F.abs(F.col(x) - s["centre"]).alias("d"), s["seat"].alias("seat"))))
    j = j.withColumn("__b", best).filter(F.col("__b.d") < SEAT_GATE * width)
    return j.withColumn("seat", F.col("__b.seat")).drop("__b", "seats")


def seat_grid(assigned: DataFrame, seats: DataFrame, ends: DataFrame, key: str, frame: str, energy: str, pos: str) -> DataFrame:
    """Dense (seat × frame) rows up to the ``last`` frame that ``ends`` has for a series: loudest energy (0 when absent) and the last position seen in the frame."""
    a = assigned.groupBy(key, "seat", frame).agg(F.max(energy).alias("energy"), F.max_by(pos, F.struct(*ORDER)).alias("pos"))
    g = seats.join(ends, key).select(key, "seat", "centre", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last").cast("long"))).alias(frame))
    return g.join(a, [key, "seat", frame], "left").withColumn("energy", F.coalesce("energy", F.lit(0.0)))


def carry_forward(grid: DataFrame, keys: list[str], frame: str, value: str, seed: Column) -> DataFrame:
    """A missing sample takes the value before it, the seed when there is none."""
    from chronoweave.operators.scans import latest
    return scan(grid, keys, [frame], F.floor(F.col(frame) / 10_000), __v=latest(F.col(value))).withColumn(value, F.coalesce("__v", seed)).drop("__v")


def with_halo(indexed: DataFrame, before: int, after: int, size: int = IDX_BUCKET) -> DataFrame:
    """Copy rows near an index-bucket edge into the neighbour; ``own`` marks the original."""
    b, r = F.floor(F.col("i") / size), F.col("i") % size
    copies = F.array(F.struct(b.alias("b"), F.lit(True).alias("own")), F.when(r >= size - before, F.struct((b + 1).alias("b"), F.lit(False).alias("own"))),
                     F.when(r < after, F.struct((b - 1).alias("b"), F.lit(False).alias("own"))))
    h = indexed.withColumn("__h", F.explode(F.filter(copies, lambda c: c.isNotNull())))
    return h.withColumn("b", F.col("__h.b")).withColumn("own", F.col("__h.own")).drop("__h")


def rolling_mean(indexed: DataFrame, key: str, x: str, w: int, size: int = IDX_BUCKET) -> DataFrame:
    """Centred queue mean: short at the head; the last rows repeat the mean of the final ``w`` samples."""
    half = w // 2
    h = with_halo(indexed, w - 1, 0, size)
    win = Window.partitionBy(key, "b").orderBy("i").rowsBetween(-(w - 1), 0)
    t = h.withColumn("mean", F.avg(x).over(win)).filter("own")
    last = F.sequence(F.greatest(F.col("i") - half, F.lit(0)), F.col("i"))
    one = F.when(F.col("i") >= half, F.array(F.col("i") - half))
    return t.select(key, F.explode(F.when(F.col("next_t").isNull(), last).otherwise(one)).alias("i"), "mean")


def windowed_pearson(indexed: DataFrame, key: str | list[str], a: str, b: str, w: int, size: int = IDX_BUCKET) -> DataFrame:
    """Correlation over a centred window; too few rows or no variance count as 0, negatives floor at 0."""
    half, keys = w // 2, [key] if isinstance(key, str) else key
    h = with_halo(indexed, half, half, size)
    win = Window.partitionBy(*keys, "b").orderBy("i").rowsBetween(-half, half)
    # corr() itself divides by zero where a window does not vary
    spread = F.stddev_pop(a).over(win) * F.stddev_pop(b).over(win)
    t = h.withColumn("__n", F.count("*").over(win)).withColumn("__r", F.try_divide(F.covar_pop(a, b).over(win), spread)).filter("own")
    r = F.when((F.col("__n") < 3) | F.col("__r").isNull() | F.isnan("__r"), 0.0).otherwise(F.greatest(F.lit(0.0), F.col("__r")))
    return t.select(*keys, "i", r.alias("corr"))


def sound_correlation(grid: DataFrame, sound: DataFrame, key: str, frame: str, w: int, size: int = IDX_BUCKET) -> DataFrame:
    """Add ``corr``: how well a seat's energy follows the series' ``level`` around each frame, to four digits; frames without sound have level 0."""
    g = grid.join(sound.select(key, frame, "level"), [key, frame], "left").withColumn("__level", F.coalesce(F.col("level").cast("double"), F.lit(0.0)))
    r = windowed_pearson(g.withColumn("i", F.col(frame)), [key, "seat"], "energy", "__level", w, size)
    r = r.select(F.col(key).alias("__k"), F.col("seat").alias("__s"), F.col("i").alias("__f"), (F.floor(F.col("corr") * 1e4 + 0.5) / 1e4).alias("corr"))
    return grid.join(r, (F.col(key) == F.col("__k")) & (F.col("seat") == F.col("__s")) & (F.col(frame) == F.col("__f"))).drop("__k", "__s", "__f")


def share_score(grid: DataFrame, keys: list[str], energy: str, corr: Column) -> DataFrame:
    """Share of the frame's energy times how well it tracks the sound; equal shares in a silent frame."""
    w = Window.partitionBy(*keys)  # one frame: at most eleven seats
    total, n = F.sum(energy).over(w), F.count("*").over(w)
    share = F.when(total > 1e-6, F.col(energy) / total).otherwise(1.0 / n)
    return grid.withColumn("score", F.floor(share * (0.35 + 0.65 * corr) * 1e6 + 0.5) / 1e6)


def frame_blocks(rows: DataFrame, keys: list[str], frame: str, size: int, **fields: str) -> DataFrame:
    """One staged row per key and ``size`` values of ``frame``: its frames in order, how many rows each holds, and the rows' fields as flat arrays of type ``fields``.

    A frame's rows are in the order of their fields; rows without a frame are left out.
    """
    one = rows.filter(F.col(frame).isNotNull()).groupBy(*keys, F.col(frame).cast("long").alias("__f"))
    one = one.agg(F.array_sort(F.collect_list(F.struct(*[F.col(f).cast(t).alias(f) for f, t in fields.items()]))).alias("__r"))
    cut = collect_ordered(one.withColumn("__b", F.floor(F.col("__f") / size)), [*keys, "__b"], ["__f"], ["__r"], "__rows")
    per = F.transform("__rows", lambda r: r["__r"])
    flat = [F.transform("__rows", lambda r: r["__f"]).alias("__f"), F.transform(per, lambda r: F.size(r)).alias("__n"), *[F.flatten(per)[f].alias(f) for f in fields]]
    return stage(cut.select(*keys, "__b", F.monotonically_increasing_id().alias("__id"), *flat), "blocks")


def transduced(blocks: DataFrame, keys: list[str], summary: Callable, advance: Callable, walk: Callable, out: str) -> DataFrame:
    """Run a state machine along each key, exact, with all blocks worked on at once.

    ``summary(*arrays)`` sums a block up for any state that may enter it, ``advance(summary,
    state)`` is the state that leaves it (None enters a key's first block), ``walk(state,
    *arrays)`` gives the output columns of type ``out``. What runs in order per key is
    ``advance`` alone, streaming over one small summary a block; no key is ever one array.
    """
    blocks.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    arrays = blocks.columns[len(keys) + 2:]

    def summed(batches):
        for b in batches:
            b["__sum"] = [json.dumps(summary(*r)) for r in zip(*(b.pop(a) for a in arrays))]
            yield b

    def entering(batches):
        key, state = None, None
        for b in batches:
            got = []
            for k, s in zip(zip(*(b[c].astype(object).where(b[c].notna(), None) for c in keys)), b["__sum"]):
                if k != key:
                    key, state = k, None
                got.append(json.dumps(state))
                state = advance(json.loads(s), state)
            yield pd.DataFrame({"__id": b["__id"], "__state": got})

    def walked(batches):
        for b in batches:
            for i, s, *r in zip(b["__id"], b["__state"], *(b[a] for a in arrays)):
                yield pd.DataFrame(dict(zip(names, [np.full(len(r[0]), i), *walk(json.loads(s), *r)])))

    kinds = ", ".join(f"`{c}` {blocks.schema[c].dataType.simpleString()}" for c in keys)
    names = ["__id", *[f.split()[0] for f in out.split(", ")]]
    sums = blocks.select(*keys, "__b", "__id", *arrays).mapInPandas(summed, f"{kinds}, __b long, __id long, __sum string")
    states = sums.repartition(*keys).sortWithinPartitions(*keys, "__b").mapInPandas(entering, "__id long, __state string")
    rows = blocks.select("__id", *arrays).join(states, "__id").mapInPandas(walked, f"__id long, {out}")
    return blocks.select("__id", *keys).join(rows, "__id").drop("__id")


class _Leads:
    """A block of frames seen from every seat: the best seat by place, where it leads that seat, and for how many frames on end."""

    def __init__(self, n, seat, score, hold: int, margin: float):
        self.seats, place = np.unique(seat, return_inverse=True)
        self.size, self.hold = len(n), hold
        table = np.full((self.seats.size, self.size), -np.inf)
        table[place, np.repeat(np.arange(self.size), n)] = score
        self.best = table.argmax(axis=0)
        top = table[self.best, np.arange(self.size)]
        self.lead = (self.best != np.arange(self.seats.size)[:, None]) & (table > -np.inf) & (top - table > margin)
        same = np.zeros(self.lead.shape, dtype=bool)
        same[:, 1:] = self.lead[:, :-1] & (self.best[1:] == self.best[:-1])
        at = np.arange(self.size)
        self.run = np.where(self.lead, at - np.maximum.accumulate(np.where(self.lead & ~same, at, 0), axis=1) + 1, 0)
        self.full = [np.flatnonzero(r >= hold) for r in self.run]

    def follow(self, cur: int, ch: int = -1, n: int = 0) -> tuple[list[tuple[int, int]], tuple[int, int, int]]:
        """Switches (frame, seat) if entered with choice ``cur`` and challenger ``ch`` ahead for ``n`` frames, and the state that leaves."""
        j, out = 0, []
        if n:
            broken = np.flatnonzero(~(self.lead[cur] & (self.best == ch))[: self.hold - n])
            if broken.size:
                j = int(broken[0])
            elif self.size < self.hold - n:
                return out, (cur, ch, n + self.size)
            else:
                j, cur = self.hold - n, ch
                out.append((j - 1, ch))
        while j < self.size:
            # a run that began before j counts from j on
            hit = int(np.searchsorted(self.full[cur], j + self.hold - 1))
            if hit == self.full[cur].size:
                n = min(int(self.run[cur, -1]), self.size - j)
                return out, (cur, int(self.best[-1]) if n else -1, n)
            j = int(self.full[cur][hit])
            cur = int(self.best[j])
            out.append((j, cur))
            j += 1
        return out, (cur, -1, 0)


def hysteresis(scored: DataFrame, keys: list[str], frame: str, hold: int, margin: float = SWITCH_MARGIN, size: int = 4096) -> DataFrame:
    """Choice per frame (``seat``, ``switched``): a challenger takes over after leading by the margin ``hold`` frames in a row.

    ``scored`` holds one row per key, frame and seat. A series of any length is cut into blocks:
    a block is followed from every seat at its start, and from each with the first frame's best
    one already ahead for 1 to ``hold - 1`` frames. A seat with a null or missing score leads
    nobody and is led by nobody; null frames are left out, frames without any score too.
    """
    f = scored.filter(F.col("score").isNotNull() & ~F.isnan("score") & F.col("seat").isNotNull())

    def summary(frames, n, seat, score):
        x = _Leads(n, seat, score, hold, margin)
        names, leave = x.seats.tolist(), {}
        for c, s in enumerate(names):
            ahead = range(1, hold) if x.lead[c, 0] else ()
            for k in (0, *ahead):
                cur, ch, m = x.follow(c, int(x.best[0]), k)[1]
                leave[f"{s} {k}"] = [names[cur], names[ch] if m else None, m]
        return {"first": names[int(x.best[0])], "leave": leave}

    def enter(first, state, led):
        """The state without a challenger that the first frame ends."""
        if state is None:
            return [first, None, 0]
        cur, ch, n = state
        return state if n and ch == first and led(cur) else [cur, None, 0]

    def advance(s, state):
        cur, _, n = enter(s["first"], state, lambda c: f"{c} 1" in s["leave"])
        return s["leave"].get(f"{cur} {n}", [cur, None, 0])

    def walk(state, frames, n, seat, score):
        x = _Leads(n, seat, score, hold, margin)
        place = {s: i for i, s in enumerate(x.seats.tolist())}
        cur, ch, m = enter(x.seats[x.best[0]], state, lambda c: c in place and x.lead[place[c], 0])
        choice, switched = np.full(x.size, cur), np.zeros(x.size, dtype=bool)
        for j, s in x.follow(place[cur], place[ch] if m else -1, m)[0] if cur in place else ():
            choice[j:], switched[j] = x.seats[s], True
        return frames, choice, switched

    return transduced(frame_blocks(f, keys, frame, size, seat="long", score="double"), keys, summary, advance, walk, f"{frame} long, seat long, switched boolean")


def opening_choice(seats: DataFrame, keys: list[str], shot: str, rows: int, margin: float = SWITCH_MARGIN, size: int = 4096) -> DataFrame:
    """Opening ``seat`` per shot: the one nearest the previous shot's unless another clearly speaks.

    ``seats`` holds one row per key, shot and seat, with its ``centre`` and how much it has ``spoken``. After a
    block's first shot the choice is one of that shot's seats, so a block is followed from each of them.
    Ties go to the smaller seat; seats without a centre or a spoken value, and null shots, are left out.
    """
    s = seats.filter(F.col("centre").isNotNull() & F.col("spoken").isNotNull() & F.col("seat").isNotNull())

    def pick(at, before):
        """The seat (number, centre, spoken) chosen after ``before``, the centre last chosen."""
        talk = min(at, key=lambda x: (-x[2], x[0]))
        near = talk if before is None else min(at, key=lambda x: (abs(x[1] - before), x[0]))
        return talk if talk[2] > near[2] + margin * rows else near

    def shots_of(n, *flat):
        items, at = list(zip(*(f.tolist() for f in flat))), np.cumsum([0, *n]).tolist()
        return [items[a:b] for a, b in zip(at, at[1:])]

    def summary(shots, n, *flat):
        at = shots_of(n, *flat)
        leave = {x: x[1] for x in at[-1]}
        for a, b in zip(at[-2::-1], at[:0:-1]):
            leave = {x: leave[pick(b, x[1])] for x in a}
        return {"first": at[0], "leave": [leave[x] for x in at[0]]}

    def advance(s, state):
        return s["leave"][s["first"].index(pick(s["first"], state))]

    def walk(state, shots, n, *flat):
        chosen = []
        for at in shots_of(n, *flat):
            seat, state, _ = pick(at, state)
            chosen.append(seat)
        return shots, np.array(chosen)

    return transduced(frame_blocks(s, keys, shot, size, seat="long", centre="double", spoken="double"), keys, summary, advance, walk, f"{shot} long, seat long")


def affine_scan(df: DataFrame, keys: list[str], order: list[str], bucket: Column, a: Column, b: Column, seed: float) -> DataFrame:
    """Linear recurrence ``s = a * s + b`` along each key, exact and split by buckets.

    Rows of a bucket compose into one (A, B) pair; the pairs of a key fold into
    each bucket's incoming state; every row then applies its own prefix.
    """
    x = df.select(*keys, *order, a.alias("__a"), b.alias("__b"), bucket.cast("long").alias("__k"))
    loc = collect_ordered(x, [*keys, "__k"], order, ["__a", "__b"], "r")

    def step(acc, r):
        na, nb = r["__a"] * acc["a"], r["__a"] * acc["b"] + r["__b"]
        row = F.struct(*[r[o].alias(o) for o in order], na.alias("pa"), nb.alias("pb"))
        return F.struct(na.alias("a"), nb.alias("b"), F.concat(acc["out"], F.array(row)).alias("out"))

    kinds = ",".join(f"{o}:bigint" for o in order)
    init = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.array().cast(f"array<struct<{kinds},pa:double,pb:double>>").alias("out"))
    loc = stage(loc.select(*keys, "__k", F.aggregate("r", init, step).alias("f")), "affine")
    sums = collect_ordered(loc.select(*keys, "__k", F.col("f.a").alias("A"), F.col("f.b").alias("B")), keys, ["__k"], ["A", "B"], "bs")

    def carry(acc, s):
        row = F.struct(s["__k"].alias("__k"), acc["s"].alias("s0"))
        return F.struct((s["A"] * acc["s"] + s["B"]).alias("s"), F.concat(acc["out"], F.array(row)).alias("out"))

    start = F.struct(F.lit(seed).alias("s"), F.array().cast("array<struct<__k:bigint,s0:double>>").alias("out"))
    carries = sums.select(*keys, F.inline(F.aggregate("bs", start, carry, lambda q: q["out"])))
    rows = loc.join(carries, [*keys, "__k"]).select(*keys, "s0", F.inline("f.out"))
    return rows.select(*keys, *order, (F.col("pa") * F.col("s0") + F.col("pb")).alias("value"))


def deadband(items: Column, move: float = MOVE_PX) -> Column:
    """Emit a sample when it moved far enough from the last emitted one; the first always."""
    def step(acc, x):
        go = acc["last"].isNull() | (F.abs(x["x"] - acc["last"]) >= move)
        return F.struct(F.when(go, x["x"]).otherwise(acc["last"]).alias("last"), F.when(go, F.concat(acc["out"], F.array(x))).otherwise(acc["out"]).alias("out"))
    init = F.struct(F.lit(None).cast("double").alias("last"), F.filter(items, lambda x: F.lit(False)).alias("out"))
    return F.aggregate(items, init, step, lambda a: a["out"])


def drop_redundant(items: Column, width: float, quick_ms: int) -> Column:
    """Drop samples equal to the last kept one, or sitting still just before a snap. One keyframe track per array."""
    jump = SNAP_SHARE * width

    def step(acc, x):
        same = F.abs(x["x"] - acc["last"]) <= SAME_PX
        before_snap = (x["nt"] - x["t_ms"] <= quick_ms) & (F.abs(x["x"] - acc["last"]) <= jump) & (F.abs(x["nx"] - x["x"]) > jump)
        keep = acc["last"].isNull() | ~(same | F.coalesce(before_snap, F.lit(False)))
        return F.struct(F.when(keep, x["x"]).otherwise(acc["last"]).alias("last"), F.when(keep, F.concat(acc["out"], F.array(x))).otherwise(acc["out"]).alias("out"))

    init = F.struct(F.lit(None).cast("double").alias("last"), F.filter(items, lambda x: F.lit(False)).alias("out"))
    return F.aggregate(items, init, step, lambda a: a["out"])


def hold_before_cut(series: DataFrame, key: str, is_cut: Column, hold_ms: int) -> DataFrame:
    """Drop samples in the bin that leads into a cut (range anti join by the next cut)."""
    s = scan(series, [key], ORDER, _tb(), __c=following(F.when(is_cut, F.col("t_ms"))))
    near = (F.col("t_ms") > 0) & (F.col("t_ms") >= F.col("__c") - hold_ms) & (F.col("t_ms") < F.col("__c"))
    return s.filter(~F.coalesce(near, F.lit(False))).drop("__c")


def winner_margin(scored: DataFrame, choices: DataFrame, presence: DataFrame, key: str, frame: str) -> DataFrame:
    """How sure the choices of a series are: means over the frames with two seats or more, and its switches.

    ``margin``: lead of the best seat over the second; ``speaker_corr``, ``listener_corr``: how well those
    two follow the sound; ``dual``: frames with both active; ``present``: share of rows with a face.
    Means are sums of whole millionths, so they do not depend on the order of rows. Series that never
    have two seats are left out; the lower seat wins a tie.
    """
    s = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), "seat", "corr")))
    f = scored.groupBy(key, frame).agg(s.alias("s")).filter(F.size("s") > 1)
    micro = lambda x: F.floor(x * 1e6 + 0.5)
    a, b = F.col("s")[0], F.col("s")[1]
    f = f.select(key, micro(b["neg"] - a["neg"]).alias("m"), micro(a["corr"]).alias("ca"), micro(b["corr"]).alias("cb"), ((-a["neg"] >= DUAL_SCORE) & (-b["neg"] >= DUAL_SCORE)).alias("dual"))
    mean = lambda c: F.sum(c) / F.count("*") / 1e6
    m = f.groupBy(key).agg(F.count("*").alias("frames"), mean("m").alias("margin"), mean("ca").alias("speaker_corr"), mean("cb").alias("listener_corr"), F.count_if("dual").alias("dual"))
    n = choices.groupBy(key).agg(F.count_if("switched").alias("switches"))
    return m.join(n, key).join(presence.select(key, (F.col("seen") / F.col("n")).alias("present")), key)


def confidence(presence_share: Column, margin: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.25 + 0.45 * presence_share + 0.6 * F.least(margin, F.lit(0.5))))


def rms_envelope(indexed: DataFrame, key: str, x: str, frames: int) -> DataFrame:
    """Root mean square per frame of equal sample counts, normalised by the loudest frame."""
    n = indexed.groupBy(key).agg(F.count("*").alias("n"))
    s = indexed.join(n, key).withColumn("per", F.greatest(F.lit(1), F.floor(F.col("n") / frames))).withColumn("frame", F.floor(F.col("i") / F.col("per")))
    r = s.filter(F.col("frame") < frames).groupBy(key, "frame").agg(F.sqrt(F.avg(F.col(x) * F.col(x))).alias("rms"))
    peak = F.max("rms").over(Window.partitionBy(key))  # at most ``frames`` rows
    return r.withColumn("level", F.when(peak > 0, F.col("rms") / peak).otherwise(0.0)).select(key, "frame", "level")


def interpolate(points: DataFrame, indexed: DataFrame, key: list[str], t: str, pid: str, bucket_ms: int = DAY_MS) -> DataFrame:
    """Value at each instant: linear between neighbours, held past the ends and across a cut."""
    hit = joins.asof(points, indexed.select(*key, "t_ms", "x", *([] if "shot" in key else ["shot"])), key, t, "t_ms",
                     ["x"] if "shot" in key else ["x", "shot"], bucket_ms, before="__b", after="__a", left_id=pid)
    u = (F.col(t) - F.col("__b.t")) / (F.col("__a.t") - F.col("__b.t"))
    lin = F.col("__b.x") + (F.col("__a.x") - F.col("__b.x")) * u
    same = F.lit(True) if "shot" in key else F.col("__a.shot") == F.col("__b.shot")
    v = F.when(F.col("__b").isNull(), F.col("__a.x")).when(F.col("__a").isNull() | ~same, F.col("__b.x")).otherwise(lin)
    return hit.select(*points.columns, v.alias("value"))


def gaussian_smooth(indexed: DataFrame, key: str, sigma_ms: int, step_ms: int, horizon: int = 0) -> DataFrame:
    """Time-weighted Gaussian over the interpolated path of the same shot, plus a settle row at its end.

    A shot ends where the next begins; the last one is held to the horizon, or to its last row if that is later.
    """
    reach = 3 * sigma_ms
    k = [key, "shot"]
    ends = indexed.groupBy(*k).agg(F.min("t_ms").alias("s_from"), F.max(F.coalesce("next_t", F.greatest("t_ms", F.lit(horizon)))).alias("s_to"), F.max(F.struct(*ORDER)).alias("s_last"))
    base = indexed.select(*k, "seq", "t_ms", "x").join(ends, k)
    offs = F.sequence(F.lit(-reach), F.lit(reach), F.lit(step_ms))
    pts = base.select(*k, "seq", "t_ms", "s_from", "s_to", F.explode(offs).alias("dt")).withColumn("pt", F.col("t_ms") + F.col("dt"))
    pts = pts.filter((F.col("pt") >= F.col("s_from")) & (F.col("pt") < F.col("s_to"))).select(*k, "seq", "pt", "dt")
    v = interpolate(pts, indexed, k, "pt", "seq")
    w = F.exp(-(F.col("dt").cast("double") * F.col("dt")) / (2.0 * sigma_ms * sigma_ms))
    g = v.groupBy(key, "seq").agg((F.sum(w * F.col("value")) / F.sum(w)).alias("v"))
    out = base.join(g, [key, "seq"], "left").select(key, "t_ms", F.coalesce("v", "x").alias("value"), F.lit(False).alias("settle"))
    rest = base.filter((F.col("s_last.seq") == F.col("seq")) & (F.col("t_ms") + reach < F.col("s_to") - 1))
    return out.unionByName(rest.select(key, (F.col("t_ms") + reach).alias("t_ms"), F.col("x").alias("value"), F.lit(True).alias("settle")))


def time_weighted_mean(indexed: DataFrame, key: str) -> DataFrame:
    """Trapezoid mean per shot; the last value is held to the shot's end (the next shot, or the series' last row). A shot without length has its first value."""
    nx = scan(indexed, [key], ORDER, _tb(), __n=following(F.struct("x", "shot")))
    dt = (F.coalesce("next_t", "t_ms") - F.col("t_ms")).cast("double")
    y = F.when(F.col("__n.shot") == F.col("shot"), (F.col("x") + F.col("__n.x")) / 2.0).otherwise(F.col("x"))
    g = nx.withColumn("dt", dt).groupBy(key, "shot").agg(F.sum(y * F.col("dt")).alias("s"), F.sum("dt").alias("d"), F.min_by("x", F.struct(*ORDER)).alias("x"))
    return g.select(key, "shot", F.when(F.col("d") > 0, F.col("s") / F.col("d")).otherwise(F.col("x")).alias("mean"))


def per_shot_range(indexed: DataFrame, key: str, width: float) -> DataFrame:
    r = indexed.groupBy(key, "shot").agg((F.max("x") - F.min("x")).alias("r"))
    return r.groupBy(key).agg((F.max("r") / width).alias("travel"))


def time_share(indexed: DataFrame, key: str, value: Column, lo: int, hi: int | None = None) -> DataFrame:
    """Share of the window (to the series' last row if ``hi`` is not given) spent left of, right of and inside the band; null under a second."""
    a, end = F.greatest(F.lit(lo), F.col("t_ms")), F.coalesce("next_t", "t_ms" if hi is None else F.lit(hi))
    b = end if hi is None else F.least(F.lit(hi), end)
    g = indexed.withColumn("d", b - a).filter("d > 0").groupBy(key).agg(F.sum("d").alias("t"), F.coalesce(F.sum(F.when(value < -0.25, F.col("d"))), F.lit(0)).alias("l"), F.coalesce(F.sum(F.when(value > 0.25, F.col("d"))), F.lit(0)).alias("r"))
    pct = lambda c: F.when(F.col("t") >= 1000, F.floor(c / F.col("t") * 100 + 0.5))
    return g.select(key, pct(F.col("t") - F.col("l") - F.col("r")).alias("front"), pct(F.col("l")).alias("left"), pct(F.col("r")).alias("right"))


def _kept_or(a: Column, b: Column) -> Column:
    """Compose two steps "m stays if it is at least ``t``, else it becomes ``c``" (c < t)."""
    return F.struct(F.greatest(a["t"], b["t"]).alias("t"), F.when(a["c"] >= b["t"], a["c"]).otherwise(b["c"]).alias("c"))


def freeze_spans(indexed: DataFrame, holds: DataFrame, key: str, release_ms: int, bin_ms: float = float(DAY_MS)) -> DataFrame:
    """Hold the value of each span's first instant through it, then rejoin the path after the release or at the next cut.

    ``holds``: key, hold_id, a, b; applied in order of (a, hold_id), each to the path that
    those before have left. Where holds meet, one starts from what an earlier one shows:
    the same value inside it, the glide back to the path on its release. That value is
    linear in the earlier one's, and the last instant an earlier hold still shows is a
    step function of the one before, so both compose and a chain of any length is cut
    into buckets. Holds of less than 50 ms, after a cut has ended them, do nothing.
    """
    cuts = indexed.filter("cut").select(key, F.col("t_ms").alias("c"))
    h = joins.asof(holds, cuts, [key], "a", "c", [], DAY_MS, before=None, after="n", left_id="hold_id")
    on_cut = F.coalesce(F.col("n.t") <= F.col("b"), F.lit(False))
    h = h.withColumn("stop", F.when(on_cut, F.col("n.t") - 10).otherwise(F.col("b")))
    h = h.withColumn("resume", F.when(on_cut, F.col("n.t")).otherwise(F.least(F.col("stop") + release_ms, F.col("n.t")))).filter(F.col("stop") - F.col("a") >= 50)
    h = stage(h.select(key, "hold_id", "a", "stop", "resume"), "holds")
    order, day = ["a", "hold_id"], F.floor(F.col("a") / DAY_MS)
    n = stage(scan(h, [key], order, day, no=running_sum(F.lit(1).cast("long"), False), free=Running("max", F.col("resume"), False)), "holds")
    few = F.floor(F.col("no") / 512)
    n = composed(n, [key], ["no"], few, F.struct(F.col("resume").alias("t"), F.col("stop").alias("c")), _kept_or, "shown")
    n = n.withColumn("shown", F.col("shown.c"))  # the last instant that holds before this one show
    n = n.withColumn("from", F.greatest(F.col("a"), F.coalesce(F.col("free") - 1, F.col("a")))).withColumn("at", F.coalesce("shown", "a"))
    path = indexed.select(key, "t_ms", "x", "shot")
    n = joins.asof(n, path, [key], "a", "t_ms", ["x", "shot"], DAY_MS, before="p", after=None, left_id="hold_id")
    n = joins.asof(n, path, [key], "from", "t_ms", ["x", "shot"], DAY_MS, before=None, after="q", left_id="hold_id")
    n = joins.asof(n, cuts, [key], "at", "c", [], DAY_MS, before=None, after="k", left_id="hold_id")
    glide = lambda t0, t1: (F.col("a") - t0) / (t1 - t0)
    onto = F.col("q").isNotNull() & ~F.coalesce(F.col("k.t") <= F.col("q.t"), F.lit(False))  # no cut before the path is met again
    u = F.when((F.col("a") > F.col("shown")) & onto, glide(F.col("shown"), F.col("q.t"))).otherwise(0.0)
    own = F.col("shown").isNull() | ((F.col("a") > F.col("shown")) & F.coalesce(F.col("p.t") >= F.col("free"), F.lit(False)))
    alone = F.when(F.col("p").isNull(), F.col("q.x")).when(F.col("q").isNull() | (F.col("q.shot") != F.col("p.shot")), F.col("p.x")).otherwise(
        F.col("p.x") + (F.col("q.x") - F.col("p.x")) * glide(F.col("p.t"), F.col("q.t")))
    v = affine_scan(n, [key], ["no"], few, F.when(own, 0.0).otherwise(1 - u), F.when(own, alone).otherwise(F.when(u > 0, u * F.col("q.x")).otherwise(0.0)), 0.0)
    v = stage(n.join(v, [key, "no"]).select(key, "no", "a", "stop", "resume", F.col("value").alias("x")), "held")
    new = v.select(key, "no", F.explode(F.array(F.struct(F.col("a").alias("t_ms"), F.lit(True).alias("first")), F.struct(F.col("stop").alias("t_ms"), F.lit(False).alias("first")))).alias("e"), "x")
    new = new.select(key, F.col("no").alias("own"), "e.t_ms", "x")
    new = joins.points_in_spans(new, v.select(key, "no", "a", "resume"), [key], "t_ms", F.col("a"), F.col("resume") - 1, bin_ms, how="left_anti", predicate=F.col("no") > F.col("own"))
    kept = joins.points_in_spans(indexed.select(key, "t_ms", "x"), v.select(key, "a", "resume"), [key], "t_ms", F.col("a"), F.col("resume") - 1, bin_ms, how="left_anti")
    return kept.withColumn("held", F.lit(False)).unionByName(new.select(key, "t_ms", "x", F.lit(True).alias("held")))


def decimate(indexed: DataFrame, key: str, width: float, most: int) -> DataFrame:
    """First row of every group of ⌈n/max⌉; a jump ends a group, so positions count from the last jump."""
    s = scan(indexed, [key], ORDER, _tb(), __p=previous(F.col("x")))
    jump = F.coalesce(F.abs(F.col("x") - F.col("__p")) > SNAP_SHARE * width, F.lit(False))
    s = stage(s.withColumn("__j", F.when(jump | F.col("__p").isNull(), F.col("i"))), "decimate")
    s = scan(s, [key], ORDER, _tb(), __from=_latest(F.col("__j")))
    n = indexed.groupBy(key).agg(F.count("*").alias("n"))
    s = s.join(n, key).withColumn("per", F.when(F.col("n") <= most, 1).otherwise(F.ceil(F.col("n") / most)))
    return s.filter((F.col("i") - F.col("__from")) % F.col("per") == 0).select(key, "i", "t_ms", "x")


def _latest(c: Column):
    from chronoweave.operators.scans import latest
    return latest(c)


def stitch(left: DataFrame, right: DataFrame, key: str, gap_ms: int = 80, slack: int = 50) -> DataFrame:
    """Join two tracks per key: a containing one wins; otherwise the earlier one's head and the later one's tail."""
    bounds = lambda d, p: d.groupBy(key).agg(F.min("t_ms").alias(f"{p}0"), F.max("t_ms").alias(f"{p}1"))
    b = bounds(left, "a").join(bounds(right, "b"), key, "full")
    a_has = F.col("b0").isNull() | ((F.col("a0") <= F.col("b0") + slack) & (F.col("a1") >= F.col("b1") - slack))
    b_has = F.col("a0").isNull() | ((F.col("b0") <= F.col("a0") + slack) & (F.col("b1") >= F.col("a1") - slack))
    a_first = F.col("a0") <= F.col("b0")
    apart = F.when(a_first, F.col("b0") > F.col("a1") + gap_ms).otherwise(F.col("a0") > F.col("b1") + gap_ms)
    later_a = F.when(a_first, F.col("a1") >= F.col("b1")).otherwise(~(F.col("b1") >= F.col("a1")))
    mode = F.when(a_has, "a").when(b_has, "b").when(apart, F.when(later_a, "a").otherwise("b")).when(a_first, "ab").otherwise("ba")
    b = b.select(key, mode.alias("mode"), F.greatest("a0", "b0").alias("join_at"))
    u = left.withColumn("side", F.lit("a")).unionByName(right.withColumn("side", F.lit("b"))).join(b, key)
    m, first = F.col("mode"), F.substring("mode", 1, 1) == F.col("side")
    keep = F.when(F.length(m) == 1, m == F.col("side")).when(first, F.col("t_ms") < F.col("join_at")).otherwise(F.col("t_ms") >= F.col("join_at"))
    return u.filter(keep).drop("mode", "join_at", "side")


def rows_for_window(series: DataFrame, key: str, lo: int, hi: int) -> DataFrame:
    """Rows a window can show, re-based: the one in force at its start up to the first past its end."""
    o = F.struct(*ORDER)
    edge = series.groupBy(key).agg(F.max(F.when(F.col("t_ms") <= lo, o)).alias("__a"), F.min(F.when(F.col("t_ms") >= hi, o)).alias("__z"))
    s = series.join(edge, key).filter((F.col("__a").isNull() | (o >= F.col("__a"))) & (F.col("__z").isNull() | (o <= F.col("__z"))))
    return s.withColumn("t_ms", F.col("t_ms") - lo).drop("__a", "__z")


def cut_audit(keys_: DataFrame, cuts: DataFrame, key: str, width: float, cut_id: str) -> DataFrame:
    """Per cut: does the geometry jump, and is the new value in force on its first instant?"""
    hit = joins.asof(cuts, keys_.select(key, "t_ms", "x"), [key], "c", "t_ms", ["x"], DAY_MS, before="h", after="n", tolerance=-1.0, left_id=cut_id)
    jump = F.coalesce(F.abs(F.col("n.x") - F.col("h.x")) > SNAP_SHARE * width, F.lit(False))
    on_time = F.col("n.t") <= F.col("c")
    shown = F.when(on_time, F.col("n.x")).otherwise(F.col("h.x"))
    ok = ~jump | (F.abs(shown - F.col("n.x")) <= 12)
    return hit.select(*cuts.columns, F.when(jump, "snap").otherwise("hold").alias("kind"), F.when(ok, "ok").otherwise("flash").alias("status"))


class Linker:
    """Live tracks of one shot: ``(id, x, y, misses)`` in order of birth; a few numbers, whatever the shot's length."""

    def __init__(self, gate: float, live: list | None = None, following_id: int = 0, frame: int | None = None):
        self.gate, self.live, self.next, self.frame = gate, [tuple(t) for t in live or []], following_id, frame

    def link(self, frame: int, detections: list[tuple[float, float]]) -> list[int]:
        """Track ids of a frame's detections, in order.

        Every detection takes the nearest track inside the gate and pulls it along;
        those without one start tracks that only later frames see. A track that is
        missed for more than ``MAX_MISSES`` frames, empty ones included, ends.
        """
        gap = 0 if self.frame is None else frame - self.frame
        live = [(i, x, y, m + gap) for i, x, y, m in self.live if m + gap - 1 <= MAX_MISSES]
        born, out = [], []
        for px, py in detections:
            best, least = None, self.gate
            for k, (_, x, y, _) in enumerate(live):
                d = math.sqrt((px - x) * (px - x) + (py - y) * (py - y))
                if d < least:
                    best, least = k, d
            if best is None:
                born.append((self.next, px, py, 0))
                out.append(self.next)
                self.next += 1
            else:
                i, x, y, _ = live[best]
                live[best] = (i, x * TRACK_KEEP + px * TRACK_NEW, y * TRACK_KEEP + py * TRACK_NEW, 0)
                out.append(i)
        self.live, self.frame = [t for t in live + born if t[3] <= MAX_MISSES], frame
        return out


def link_tracks(detections: DataFrame, key: str, gate: float) -> DataFrame:
    """``key, seq, shot, track``: all detections of a frame linked in two dimensions, frame after frame.

    ``detections``: key, shot, frame, seq (order within the frame), x, y; without ``frame`` every
    row is a frame of its own in order of (t_ms, seq), without ``y`` all lie on a line. A cut
    clears every identity. Rows stream in order past one ``Linker`` per shot, so a shot of any length
    takes the memory of its live tracks and of one frame.
    """
    kind = detections.schema[key].dataType.simpleString()
    if "frame" not in detections.columns:
        detections = scan(detections, [key, "shot"], ORDER, _tb(), frame=running_sum(F.lit(1).cast("long")))
    if "y" not in detections.columns:
        detections = detections.withColumn("y", F.lit(0.0))

    def run(batches):
        held, at, linker = [], None, None

        def flush():
            ids = linker.link(at[2], [(x, y) for _, x, y in held])
            return [(*at[:2], seq, t) for (seq, _, _), t in zip(held, ids)]

        for b in batches:
            out = []
            for k, shot, frame, seq, x, y in zip(*(b[c].tolist() for c in (key, "shot", "frame", "seq", "x", "y"))):
                if (k, shot, frame) != at:
                    if held:
                        out += flush()
                    if at is None or (k, shot) != at[:2]:
                        linker = Linker(gate)
                    held, at = [], (k, shot, frame)
                held.append((seq, x, y))
            yield pd.DataFrame(out, columns=[key, "shot", "seq", "track"])[[key, "seq", "shot", "track"]]
        if held:
            yield pd.DataFrame(flush(), columns=[key, "shot", "seq", "track"])[[key, "seq", "shot", "track"]]

    rows = detections.select(key, "shot", "frame", "seq", "x", "y").repartition(key, "shot").sortWithinPartitions(key, "shot", "frame", "seq")
    return rows.mapInPandas(run, f"{key} {kind}, seq bigint, shot bigint, track bigint")
