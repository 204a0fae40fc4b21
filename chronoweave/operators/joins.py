"""Range, as-of and nearest joins expressed as equi-joins on time bins.

Bins spread a hot key over many tasks; within a bin the exact predicate is
checked. Nothing is broadcast by hand: AQE picks a broadcast only when the
measured side is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.operators.scans import following, latest, scan

BIN = "__bin"


def bins(start: Column, end: Column, width: float) -> Column:
    return F.sequence(F.floor(start / width), F.floor(F.greatest(start, end) / width))


def points_in_spans(
    points: DataFrame, spans: DataFrame, keys: list[str], t: str, start: Column, end: Column,
    width: float, how: str = "inner", predicate: Column | None = None, keep_bin: bool = False,
) -> DataFrame:
    """Join each point to every span with ``start <= t <= end`` (or a stricter predicate).

    A point has one bin, so each pair appears once. ``start``/``end`` bound the
    span columns used for binning (widen them there when the predicate has slack).
    With ``keep_bin`` the point's bin stays, and a further join on key and bin needs no
    new shuffle of the result.
    """
    p = points.withColumn(BIN, F.floor(F.col(t) / width))
    s = (spans.withColumn("__s", start).withColumn("__e", end)
         .withColumn(BIN, F.explode(bins(F.col("__s"), F.col("__e"), width))))
    s = s.select(*[F.col(c).alias(f"__k_{c}") for c in keys], F.col(BIN).alias("__sbin"),
                 *[c for c in s.columns if c not in keys and c != BIN])
    cond = F.col(BIN) == F.col("__sbin")
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"__k_{k}"))
    cond = cond & (F.col(t) >= F.col("__s")) & (F.col(t) <= F.col("__e"))
    if predicate is not None:
        cond = cond & predicate
    out = p.join(s, cond, how)
    return out.drop("__sbin", "__s", "__e", *[f"__k_{k}" for k in keys], *[] if keep_bin else [BIN])


def _nodes(a: Column, b: Column) -> Column:
    """The at most two dyadic nodes a level whose ranges make up ``[a, b)``: level ``k``, node ``p`` is ``[p * 2^k, (p + 1) * 2^k)``."""
    def at(k: Column) -> Column:
        shift = lambda x: F.call_function("shiftright", x, k)
        lo, hi = -shift(-a), shift(b)
        node = lambda p: F.struct(k.alias("k"), p.alias("p"))
        left = F.when((lo < hi) & (lo.bitwiseAND(F.lit(1)) == 1), node(lo))
        right = F.when((lo < hi) & (hi.bitwiseAND(F.lit(1)) == 1), node(hi - 1))
        return F.array(left, right)

    levels = F.sequence(F.lit(0), F.length(F.bin(b - a)) - 1)
    return F.filter(F.flatten(F.transform(levels, at)), lambda n: n.isNotNull())


def _holders(u: Column, v: Column) -> tuple[Column, Column]:
    """Lowest level whose nodes are at least as long as the units ``u`` to ``v``, and the one or two nodes there that hold them."""
    level = F.when(u == v, 0).otherwise(F.length(F.bin(v - u)))
    at = lambda x: F.call_function("shiftright", x, level)
    return level, F.array_distinct(F.array(at(u), at(v)))


def stabbed(
    points: DataFrame, spans: DataFrame, keys: list[str], t: str, start: Column, end: Column,
    unit: int = 1024, predicate: Column | None = None,
) -> DataFrame:
    """Pairs of a point and a span with ``start <= t < end``, for spans of any mix of lengths; all in long milliseconds.

    Time is cut into units and the units into dyadic nodes. A span goes to the one or two
    nodes that hold it at the lowest level whose nodes are as long as the span, a point to
    the node above its unit at every level some span is on. A point and a span share at
    most one node. A node holds spans longer than half of it only, so where points lie
    evenly a fourth of the pairs compared or more are matches. Spans that are empty,
    reversed or null at an end, and points without a time, match nothing. Null keys match
    nothing. Sides are shuffled: a node holds far more rows than the source's size tells,
    so neither is left to be broadcast.
    """
    s = spans.withColumns({"__s": start.cast("long"), "__e": end.cast("long")}).filter("__s < __e")
    level, held = _holders(F.floor(F.col("__s") / unit), F.floor((F.col("__e") - 1) / unit))
    levels = s.select(F.array_sort(F.collect_set(level)))
    s = s.select(*[F.col(c).alias(f"__k_{c}") for c in keys], level.alias("__sk"), F.explode(held).alias("__sp"), *[c for c in s.columns if c not in keys])
    p = points.filter(F.col(t).isNotNull()).withColumn("__k", F.explode(levels.scalar()))
    p = p.withColumn("__p", F.call_function("shiftright", F.floor(F.col(t) / unit).cast("long"), F.col("__k")))
    cond = (F.col("__k") == F.col("__sk")) & (F.col("__p") == F.col("__sp"))
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"__k_{k}"))
    cond = cond & (F.col(t) >= F.col("__s")) & (F.col(t) < F.col("__e"))
    if predicate is not None:
        cond = cond & predicate
    return p.join(s.hint("merge"), cond).drop("__k", "__p", "__sk", "__sp", "__s", "__e", *[f"__k_{k}" for k in keys])


def overlaps(
    left: DataFrame, right: DataFrame, keys: list[str],
    l_start: str, l_end: str, r_start: str, r_end: str, width: float,
) -> DataFrame:
    """Pairs with ``l_start < r_end and l_end > r_start``; each pair is kept in its first shared bin."""
    a = left.withColumn(BIN, F.explode(bins(F.col(l_start), F.col(l_end), width)))
    b = right.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys], *[c for c in right.columns if c not in keys],
        F.explode(bins(F.col(r_start), F.col(r_end), width)).alias("__rbin"))
    cond = (F.col(BIN) == F.col("__rbin")) & (F.col(l_start) < F.col(r_end)) & (F.col(l_end) > F.col(r_start))
    cond = cond & (F.col(BIN) == F.floor(F.greatest(F.col(l_start), F.col(r_start)) / width))
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"__k_{k}"))
    return a.join(b, cond).drop(BIN, "__rbin", *[f"__k_{k}" for k in keys])


def asof(
    left: DataFrame, right: DataFrame, keys: list[str], t: str, rt: str, values: list[str],
    bucket_width: float, before: str | None = "before", after: str | None = None,
    tolerance: float = 0.0, left_id: str | None = None,
) -> DataFrame:
    """Attach the right row in force at ``t`` and/or the next one, as structs.

    ``before`` gets the last right row with ``rt <= t + tolerance``; ``after`` the
    first with ``rt > t + tolerance``. Both come from one scan over the union,
    bucketed on time, so a hot key is split.
    """
    l = left.select(*keys, F.struct(*[F.col(c) for c in left.columns]).alias("__row"))
    r = right.select(*keys, F.struct(F.col(rt).alias("t"), *[F.col(v) for v in values]).alias("__pay"))
    u = l.unionByName(r, allowMissingColumns=True)
    # Only keys and rows are exchanged; the order follows from them. Ties of the right side go by the text of their values.
    probe = F.col("__row").isNotNull()
    at = F.when(probe, F.col(f"__row.{t}") + tolerance).otherwise(F.col("__pay.t"))
    tie = F.to_json(F.struct(*[F.col(f"__pay.{v}") for v in values])) if values else F.lit("")
    late = {"__t": at, "__side": probe.cast("int"), "__id": F.when(probe, F.col(f"__row.{left_id}").cast("string") if left_id else F.lit("0")).otherwise(tie)}
    outs = {}
    if before:
        outs[before] = latest(F.col("__pay"))
    if after:
        outs[after] = following(F.col("__pay"))
    res = scan(u, keys, ["__t", "__side", "__id"], F.floor(at / bucket_width), late, **outs)
    return res.filter("__row IS NOT NULL").select("__row.*", *outs)
