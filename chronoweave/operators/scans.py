"""Ordered scans over keys that may hold a large share of all rows.

A plain ``Window.partitionBy(key).orderBy(t)`` sends one key to one task. Here
every key's time axis is cut into buckets: the window runs per (key, bucket), a
map-side-combined aggregate summarises each bucket, a window over those
summaries (one row per bucket, bounded by time range / bucket width) gives what
a bucket inherits, and a join on (key, bucket) puts both together. The result is
exactly the unbounded window.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.operators.folds import collect_ordered
from chronoweave.operators.staging import stage

BUCKET = "__bucket"
# what stands for null in a key column beside its flag; other types are keyed by their JSON
_STAND_IN = {"long": 0, "integer": 0, "short": 0, "byte": 0, "string": "", "boolean": False, "double": 0.0, "float": 0.0, "date": "1970-01-01", "timestamp": "1970-01-01 00:00:00"}


@dataclass(frozen=True)
class Running:
    """One scan output.

    kind: ``sum`` | ``max`` | ``min`` | ``last`` (most recent non-null value).
    inclusive: whether the current row counts.
    reverse: scan from the end (``last`` then means the next non-null value).
    """

    kind: str
    value: Column
    inclusive: bool = True
    reverse: bool = False


def running_sum(value: Column, inclusive: bool = True) -> Running:
    return Running("sum", value, inclusive)


def running_max(value: Column, inclusive: bool = True) -> Running:
    return Running("max", value, inclusive)


def previous(value: Column) -> Running:
    """Most recent non-null value strictly before the row."""
    return Running("last", value, False)


def latest(value: Column) -> Running:
    """Most recent non-null value up to and including the row."""
    return Running("last", value, True)


def following(value: Column, inclusive: bool = False) -> Running:
    """Next non-null value after (or at) the row."""
    return Running("last", value, inclusive, reverse=True)


def _local(spec: Running, fwd, bwd) -> Column:
    w = bwd if spec.reverse else fwd
    w = w.rowsBetween(Window.unboundedPreceding, 0 if spec.inclusive else -1)
    if spec.kind == "sum":
        return F.sum(spec.value).over(w)
    if spec.kind == "max":
        return F.max(spec.value).over(w)
    if spec.kind == "min":
        return F.min(spec.value).over(w)
    return F.last(spec.value, ignorenulls=True).over(w)


def _total(spec: Running, rank: Column) -> Column:
    if spec.kind == "sum":
        return F.sum(spec.value)
    if spec.kind == "max":
        return F.max(spec.value)
    if spec.kind == "min":
        return F.min(spec.value)
    at = F.when(spec.value.isNotNull(), rank)
    return F.min_by(spec.value, at) if spec.reverse else F.max_by(spec.value, at)


def _carry(spec: Running, total: str, fwd, bwd) -> Column:
    w = (bwd if spec.reverse else fwd).rowsBetween(Window.unboundedPreceding, -1)
    col = F.col(total)
    if spec.kind == "sum":
        return F.sum(col).over(w)
    if spec.kind == "max":
        return F.max(col).over(w)
    if spec.kind == "min":
        return F.min(col).over(w)
    return F.last(col, ignorenulls=True).over(w)


def _combine(spec: Running, local: Column, carry: Column) -> Column:
    if spec.kind == "sum":
        return F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))
    if spec.kind == "max":
        return F.greatest(local, carry)
    if spec.kind == "min":
        return F.least(local, carry)
    return F.coalesce(local, carry)


def scan(df: DataFrame, keys: list[str], order: list[str], bucket: Column, late: dict[str, Column] | None = None, **outs: Running) -> DataFrame:
    """Add running columns ordered by ``order`` within ``keys``.

    ``late`` are columns of ``order`` that follow from the others: they are made after the rows are exchanged.

    ``order`` must be a total order; ``bucket`` must be monotone in it. Rows with
    null keys form a key of their own; rows with a null bucket come first.

    A nullable key is split into its value (a stand-in where null) and a null
    flag, so the windows and the join share one partitioning by plain equality:
    data rows are exchanged once.
    """
    base = df.columns
    df = df.withColumn(BUCKET, F.coalesce(bucket.cast("long"), F.lit(-(2**63))))
    plain = []
    for c in keys:
        f = df.schema[c]
        if not f.nullable:
            plain.append(c)
            continue
        stand = _STAND_IN.get(f.dataType.typeName())
        flag, value = f"__n_{c}", f"__v_{c}"
        df = df.withColumn(flag, F.col(c).isNull())
        df = df.withColumn(value, F.coalesce(F.col(c), F.lit(stand).cast(f.dataType)) if stand is not None else F.coalesce(F.to_json(F.struct(F.col(c))), F.lit("")))
        plain += [value, flag]
    part = [*plain, BUCKET]
    fwd = Window.partitionBy(*part).orderBy(*[F.col(c) for c in order])
    bwd = Window.partitionBy(*part).orderBy(*[F.col(c).desc() for c in order])
    rank = F.struct(*[F.col(c) for c in order])
    whole = df.withColumns(late) if late else df
    df = df.repartition(*part).withColumns(late) if late else df
    totals = whole.groupBy(*part).agg(*[_total(s, rank).alias(f"__t_{n}") for n, s in outs.items()])
    cf = Window.partitionBy(*plain).orderBy(BUCKET)
    cb = Window.partitionBy(*plain).orderBy(F.col(BUCKET).desc())
    carries = totals.select(*part, *[_carry(s, f"__t_{n}", cf, cb).alias(f"__c_{n}") for n, s in outs.items()])
    local = df.select("*", *[_local(s, fwd, bwd).alias(f"__l_{n}") for n, s in outs.items()])
    return local.join(carries, part).select(*base, *[_combine(s, F.col(f"__l_{n}"), F.col(f"__c_{n}")).alias(n) for n, s in outs.items()])


def composed(df: DataFrame, keys: list[str], order: list[str], bucket: Column, element: Column, compose: Callable[[Column, Column], Column], out: str) -> DataFrame:
    """Add ``out``: the composition of the ``element`` structs of all rows before this one in its key; null at the first.

    For state machines whose steps compose into one small struct (``compose(earlier,
    later)``, associative). Rows of a (key, bucket) compose in one array, bounded by the
    bucket; the bucket's own struct, one row, is all that meets per key. ``order`` must be
    a total order of long columns, ``bucket`` monotone in it.
    """
    kind = df.select(element.alias("e")).schema["e"].dataType.simpleString()
    x = df.select(*keys, bucket.cast("long").alias(BUCKET), *order, element.alias("__e"))

    def chain(items: Column, fields: list[str]) -> Column:
        """Per item its fields and the composition before it, and the composition of all."""
        null = F.lit(None).cast(kind)
        kinds = ",".join(f"{f}:bigint" for f in fields)
        init = F.struct(null.alias("all"), F.array().cast(f"array<struct<{kinds},before:{kind}>>").alias("rows"))

        def step(acc, r):
            now = F.when(acc["all"].isNull(), r["__e"]).otherwise(compose(acc["all"], r["__e"]))
            return F.struct(now.alias("all"), F.concat(acc["rows"], F.array(F.struct(*[r[f].alias(f) for f in fields], acc["all"].alias("before")))).alias("rows"))

        return F.aggregate(items, init, step)

    local = collect_ordered(x, [*keys, BUCKET], order, ["__e"], "__r")
    local = stage(local.select(*keys, BUCKET, chain(F.col("__r"), order).alias("__f")), "composed")
    totals = collect_ordered(local.select(*keys, BUCKET, F.col("__f.all").alias("__e")), keys, [BUCKET], ["__e"], "__r")
    carries = totals.select(*keys, F.inline(chain(F.col("__r"), [BUCKET])["rows"])).withColumnRenamed("before", "__carry")
    rows = local.join(carries, [*keys, BUCKET]).select(*keys, "__carry", F.inline("__f.rows"))
    whole = F.when(F.col("__carry").isNull(), F.col("before")).when(F.col("before").isNull(), F.col("__carry")).otherwise(compose(F.col("__carry"), F.col("before")))
    return df.join(rows.select(*keys, *order, whole.alias(out)), [*keys, *order])
