"""Event variance from two expiries: one ladder of failure codes for prices, quotes and surfaces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.numbers import number

# Why an event has no implied variance.
TOO_FEW, TIME_GAP, NEGATIVE, STALE, NONPOSITIVE, NONMONOTONE = "no_two_event_covering_expiries", "nonpositive_time_gap", "negative_extracted_ivar", "stale_or_missing_iv", "nonpositive_total_variance", "nonmonotone_total_variance"
DAYS_IN_YEAR = {"ACT/365": 365.0, "TRADING/252": 252.0}


def year_fraction(dte: Column, convention: str = "ACT/365") -> Column:
    """Days to expiry as a part of a year; 0 for none."""
    return F.when(dte <= 0, 0.0).otherwise(dte / DAYS_IN_YEAR[convention])


def edge_variance(forecast: Column, implied: Column) -> Column:
    return forecast - implied


def event_variance(w1: Column, w2: Column, t1: Column, t2: Column, usable: Column | None = None) -> tuple[Column, Column]:
    """(variance of the event, why there is none) of total variances at two expiries; times are tested before variances."""
    v = (t2 * w1 - t1 * w2) / (t2 - t1)
    known = w1.isNotNull() & w2.isNotNull()
    good = known if usable is None else F.coalesce(usable, F.lit(False)) & known
    reason = F.when(~good, STALE).when((t2 <= t1) | (t1 <= 0), TIME_GAP).when((w1 <= 0) | (w2 <= 0), NONPOSITIVE).when(w2 < w1, NONMONOTONE).when(v < 0, NEGATIVE)
    return F.when(reason.isNull(), v), reason


def first_two(points: DataFrame, event: str, expiration: str, keep: Sequence[str]) -> DataFrame:
    """Per event how many expiries there are (expiries) and, of its first two, expiration_1, expiration_2 and the columns of ``keep`` likewise."""
    n = F.row_number().over(Window.partitionBy(event).orderBy(expiration))
    placed = points.where(F.col(expiration).isNotNull()).withColumn("_n", n)
    at = lambda i, c: F.max(F.when(F.col("_n") == i, F.struct(c)))[c].alias(f"{c}_{i}")
    return placed.groupBy(event).agg(F.count("*").alias("expiries"), *[at(i, c) for c in dict.fromkeys([expiration, *keep]) for i in (1, 2)])


def two_expiry_variance(points: DataFrame, events: DataFrame, event: str = "event_id", expiration: str = "expiration", dte: str = "dte_days", iv: str = "iv", stale: str | None = None, event_date: str = "event_date", exit_date: str = "exit_date", convention: str = "ACT/365") -> DataFrame:
    """``events`` with the variance that the first two expiries covering them imply, or the reason there is none.

    An expiry covers the event if it isn't before its exit date (without one: the day after the event). The first two
    count whether usable or not. Total variance is iv^2 t. ``points``: one row per event and expiry; where it has a
    column time_convention, a row of another convention than the run's is an error.
    """
    until = F.coalesce(F.col(exit_date), F.date_add(event_date, 1))
    rows = points.alias("p")
    if "time_convention" in points.columns:
        mixed = F.when(F.col("time_convention") == convention, F.col(dte)).otherwise(F.raise_error(F.lit("time conventions must not be mixed")).cast("int"))
        rows = points.withColumn(dte, mixed).alias("p")
    covering = rows.join(events.select(event, until.alias("_until")).alias("e"), event).where(F.col(expiration) >= F.col("_until"))
    old = F.coalesce(F.col(stale), F.lit(False)) if stale else F.lit(False)
    two = first_two(covering.select(event, expiration, F.col(dte).alias("dte"), F.when(~old, number(iv)).alias("iv")), event, expiration, ["dte", "iv"])
    t1, t2 = (year_fraction(F.col(f"dte_{i}"), convention) for i in (1, 2))
    two = two.withColumns({"t1": t1, "t2": t2}).withColumns({"w1": F.col("iv_1") * F.col("iv_1") * F.col("t1"), "w2": F.col("iv_2") * F.col("iv_2") * F.col("t2")})
    v, reason = event_variance(F.col("w1"), F.col("w2"), F.col("t1"), F.col("t2"))
    enough = F.coalesce("expiries", F.lit(0)) >= 2
    out = events.join(two, event, "left").withColumns({"ivar_event": F.when(enough, v), "ivar_failure_reason": F.when(~enough, TOO_FEW).otherwise(reason), "expiry_gap_days": F.datediff(f"{expiration}_2", f"{expiration}_1")})
    unusable = F.coalesce(F.col("ivar_failure_reason").isin(TOO_FEW), F.lit(False))
    return out.withColumns({c: F.when(~unusable, F.col(c)) for c in ("t1", "t2", "w1", "w2", "dte_1", "dte_2", "iv_1", "iv_2", f"{expiration}_1", f"{expiration}_2", "expiry_gap_days")})


def failures(panel: DataFrame) -> DataFrame:
    """The events without an implied variance, for a report."""
    return panel.where(F.col("ivar_failure_reason").isNotNull())
