"""Bind an array expression once inside a larger expression.

A lambda that mentions an outer expression evaluates it once per element; bound
as the start of an ``aggregate`` without steps it is evaluated once per row. (A
one-element ``transform`` binds as well, but copies the body's whole result, field by
field, at every level of nesting.)
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    return F.aggregate(F.array().cast("array<int>"), x, lambda bound, _: bound, body)


def rows(df: DataFrame, keep: list, items: Column, name: str, pos: str | None = None) -> DataFrame:
    """One output row per array element.

    The outer form keeps the optimizer from adding a ``size(items) > 0`` filter
    below the generator, which would evaluate a heavy expression twice.
    """
    if pos:
        out = df.select(*keep, F.posexplode_outer(items).alias(pos, name))
        return out.filter(F.col(pos).isNotNull())
    return df.select(*keep, F.explode_outer(items).alias(name)).filter(F.col(name).isNotNull())


def part(items: Column, start: Column, n: Column, pick: Callable[[Column], Column]) -> Column:
    """``pick`` of ``n >= 1`` elements from a zero-based start.

    Reads only those elements; ``slice`` would first unpack the whole array.
    """
    return F.transform(F.sequence(start, start + n - 1), lambda i: pick(F.get(items, i)))


def same_words(items: Column, start: Column, probe: Column) -> Column:
    """Does ``probe`` (non-empty) occur in ``items`` at a zero-based position? Stops at the first difference."""
    return F.forall(F.sequence(F.lit(0), F.size(probe) - 1), lambda j: F.get(items, start + j) == F.get(probe, j))
