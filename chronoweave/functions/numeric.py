"""Rounding and number helpers shared by every operator.

Times follow the half-up-towards-plus-infinity rule (``floor(x + 0.5)``), which
differs from Spark's ``round`` on negative halves.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 0) -> Column:
    """``floor(x * 10^digits + 0.5) / 10^digits`` as double (long when digits is 0)."""
    if digits == 0:
        return F.floor(x + F.lit(0.5))
    scale = float(10**digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def half_up_sql(x: str, digits: int = 0) -> str:
    """The same rounding as SQL text, for the independent checks."""
    if digits == 0:
        return f"CAST(floor(({x}) + 5e-1) AS BIGINT)"
    return f"(floor(({x}) * 1e{digits} + 5e-1) / 1e{digits})"


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def finite_or(x: Column, default: float) -> Column:
    """Replace null, NaN and infinities by a default."""
    return F.when(F.abs(x) < F.lit(float("inf")), x).otherwise(F.lit(default))  # NaN is above infinity
