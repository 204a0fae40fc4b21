"""Ordered state machines as Catalyst ``aggregate`` expressions.

A fold runs over an array that is already bounded: the cues or words of one
transcript row, or one island / shot of a longer series. Long keys are first cut
at the points where the state provably resets, so a hot key becomes many folds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def collect_ordered(df: DataFrame, keys: list[str], order: list[str], fields: list[str], name: str = "items") -> DataFrame:
    """One row per key with its rows as an array of structs sorted by ``order``."""
    cols = [*order, *[f for f in fields if f not in order]]
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))


def fold(items: Column, init: Column, step: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(items, init, step)
