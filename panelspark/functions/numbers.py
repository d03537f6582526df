"""Small column expressions on numbers: missing values are null here, never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-12


def finite(c: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def number(name: str) -> Column:
    """The column as a finite double, or null."""
    return finite(F.col(name).try_cast("double"))


def positive(name: str) -> Column:
    """The column as a finite double above zero, or null."""
    return F.when(number(name) > 0, number(name))


def ratio(a: Column, b: Column, least: float = EPSILON) -> Column:
    """a / b, null where |b| is at most ``least``."""
    return F.when(F.abs(b) > least, a / b)


def clip(c: Column, low: float, high: float) -> Column:
    """The column within [low, high]; null stays null."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high))))
