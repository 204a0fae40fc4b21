"""Declared constraints, sparse patches, normalisation and parity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check_constraints(df: DataFrame, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """One row per violated rule. A rule is a boolean that must hold; null counts as held (absent field)."""
    bad = F.array(*[F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in rules.items()])
    return df.select(*key, F.explode(F.filter(bad, lambda r: r.isNotNull())).alias("rule"))


def cap_violations(df: DataFrame, owner: str, cap: int) -> DataFrame:
    """Owners with more rows than the cap; a plain aggregate, no per-owner window."""
    return df.groupBy(owner).agg(F.count("*").alias("n")).filter(F.col("n") > cap)


def rule_violations(tables: dict[str, tuple[DataFrame, str]], rules: DataFrame) -> DataFrame:
    """``table, key, rule, n`` for every rule of a rule table that a row or an owner breaks.

    ``tables``: name to its rows and key column. ``rules`` holds ``table, rule, kind, field, low, high, allowed``:
    ``enum`` (value, as text, is in ``allowed``), ``range`` and ``length`` (between ``low`` and ``high``, null is no bound),
    ``pattern`` (``allowed[0]`` is found), ``required`` (not null) and ``cap`` (at most ``high`` rows share a value of
    ``field``, counted in ``n``). A null value breaks ``required`` alone. The rules are few and read once; a table's row
    rules are one pass over it, a cap is one aggregate. Keys are given as text; unknown tables, kinds and null
    arguments raise.
    """
    out = []
    by_table: dict[str, list] = {}
    for r in rules.orderBy("table", "rule").collect():
        by_table.setdefault(r["table"], []).append(r)
    for name, rows in by_table.items():
        df, key = tables[name]
        held = [(r["rule"], _holds(r)) for r in rows if r["kind"] != "cap"]
        if held:
            bad = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(True)), F.lit(rule)) for rule, ok in held]), lambda x: x.isNotNull())
            out.append(df.select(F.lit(name).alias("table"), F.col(key).cast("string").alias("key"), F.explode(bad).alias("rule"), F.lit(1).cast("long").alias("n")))
        for r in (x for x in rows if x["kind"] == "cap"):
            over = df.filter(F.col(r["field"]).isNotNull()).groupBy(F.col(r["field"]).cast("string").alias("key")).agg(F.count("*").alias("n")).filter(F.col("n") > r["high"])
            out.append(over.select(F.lit(name).alias("table"), "key", F.lit(r["rule"]).alias("rule"), "n"))
    empty = rules.sparkSession.createDataFrame([], "table string, key string, rule string, n long")
    return reduce(DataFrame.unionByName, out, empty)


def _holds(r) -> Column:
    x = F.col(r["field"])
    if r["kind"] in ("range", "length"):
        x = F.length(x) if r["kind"] == "length" else x
        low, high = (F.lit(True) if b is None else x >= b if low_side else x <= b for b, low_side in ((r["low"], True), (r["high"], False)))
        return F.when(x.isNotNull(), low & high)
    if r["kind"] == "enum":
        return x.cast("string").isin(*r["allowed"])
    if r["kind"] == "pattern":
        return x.rlike(r["allowed"][0])
    if r["kind"] == "required":
        return x.isNotNull()
    raise ValueError(f"unknown kind of rule: {r['kind']}")


def enum(col: str, allowed: list[str]) -> Column:
    return F.col(col).isin(*allowed)


def sparse_patch(old: Column, given: Column, new: Column, clear: Column) -> Column:
    """Absent keeps, an explicit empty clears, a value sets."""
    return F.when(~given, old).when(clear, F.lit(None)).otherwise(new)


# Speed and effect defaults.
MIN_RATE, MAX_RATE = 0.2, 3.0
FAST_DEFAULT, SLOW_DEFAULT, AMOUNT_DEFAULT = 1.5, 0.5, 0.7


def speed_spec(kind: Column, rate: Column) -> Column:
    """A speed's rate on its kind's side of 1, rounded to three decimals; a freeze has none."""
    r3 = lambda x: F.floor(x * 1000.0 + 0.5) / 1000.0
    raw = F.greatest(F.lit(0.0), F.least(F.lit(MAX_RATE), F.coalesce(rate, F.when(kind == "fast", FAST_DEFAULT).otherwise(SLOW_DEFAULT))))
    fast = r3(F.greatest(F.lit(1.1), F.least(F.lit(MAX_RATE), raw)))
    slow = r3(F.greatest(F.lit(MIN_RATE), F.least(F.lit(0.9), raw)))
    return F.when(kind == "freeze", 0.0).when(kind == "fast", fast).otherwise(slow)


def amount_spec(amount: Column) -> Column:
    x = F.coalesce(amount, F.lit(AMOUNT_DEFAULT))
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)) * 1000.0 + 0.5) / 1000.0


def without_default(x: Column, default: float, tol: float = 0.005) -> Column:
    """A value close to its default is left absent, so an untouched row round-trips."""
    return F.when(F.abs(x - default) >= tol, x)


def parity_check(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows only one of two implementations produced."""
    cols = left.columns
    a = left.exceptAll(right.select(*cols)).withColumn("side", F.lit("left"))
    return a.unionByName(right.select(*cols).exceptAll(left).withColumn("side", F.lit("right")))
