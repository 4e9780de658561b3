"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int) -> Column:
    """x rounded half up by floor, which gives the same result in every engine."""
    return F.floor(x * 10.0**digits + 0.5) / 10.0**digits


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    """x within [low, high]; 0 where it is missing."""
    return F.coalesce(F.least(F.greatest(x, F.lit(low)), F.lit(high)), F.lit(0.0))


def holds(condition: Column) -> Column:
    """The condition, with unknown as false."""
    return F.coalesce(condition, F.lit(False))


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is zero or missing."""
    return a / F.nullif(b, F.lit(0.0))


def finite(x: Column) -> Column:
    """x as double, with NaN and infinities as null."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
