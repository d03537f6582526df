"""A US-equity trading calendar as a table, and event windows on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Closures that no rule gives.
CLOSURES = ("2018-12-05", "2025-01-09", "2012-10-29", "2012-10-30")

# Fixed rules: name, month, day (observed on the nearest weekday), or the n-th weekday of a month (1 = Sunday).
FIXED = (("new_year", 1, 1, 0), ("juneteenth", 6, 19, 2022), ("independence", 7, 4, 0), ("christmas", 12, 25, 0))
NTH = (("mlk", 1, 2, 3), ("presidents", 2, 2, 3), ("labor", 9, 2, 1), ("thanksgiving", 11, 5, 4))


def holidays(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """holiday (date) and name, by rule for each year."""
    years = spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("y"))
    rules = []
    for name, m, d, since in FIXED:
        day = f"make_date(y, {m}, {d})"
        # a Sunday is observed on Monday, a Saturday on Friday (but not New Year's Day, which would fall in the old year)
        saturday = day if name == "new_year" else f"date_sub({day}, 1)"
        rules.append(f"SELECT CASE dayofweek({day}) WHEN 1 THEN date_add({day}, 1) WHEN 7 THEN {saturday} ELSE {day} END AS holiday, '{name}' AS name FROM {{y}} WHERE y >= {since}")
    for name, m, weekday, n in NTH:
        first = f"make_date(y, {m}, 1)"
        rules.append(f"SELECT date_add({first}, pmod({weekday} - dayofweek({first}), 7) + 7 * {n - 1}), '{name}' FROM {{y}}")
    rules.append("SELECT date_sub(make_date(y, 5, 31), pmod(dayofweek(make_date(y, 5, 31)) - 2, 7)), 'memorial' FROM {y}")
    easter = """SELECT y, a, h, l, (a + 11 * h + 22 * l) DIV 451 AS m FROM (SELECT y, a, h, pmod(32 + 2 * (b % 4) + 2 * (c DIV 4) - h - c % 4, 7) AS l FROM
      (SELECT y, y % 19 AS a, y DIV 100 AS b, y % 100 AS c, pmod(19 * (y % 19) + y DIV 100 - (y DIV 100) DIV 4 - (y DIV 100 - (y DIV 100 + 8) DIV 25 + 1) DIV 3 + 15, 30) AS h FROM {y}))"""
    rules.append(f"SELECT date_sub(make_date(y, (h + l - 7 * m + 114) DIV 31, (h + l - 7 * m + 114) % 31 + 1), 2), 'good_friday' FROM ({easter})")
    rules += [f"SELECT date'{d}', 'closure' FROM {{y}} WHERE y = {d[:4]}" for d in CLOSURES]
    return spark.sql(" UNION ALL ".join(rules), y=years)


def trading_days(spark: SparkSession, start: str, end: str) -> DataFrame:
    """date, is_trading_day, close_minutes (after midnight ET), prev_day, next_day (strictly) and index of trading days."""
    hol = holidays(spark, int(start[:4]), int(end[:4])).select(F.col("holiday").alias("date"), "name").dropDuplicates(["date"])
    days = spark.sql(f"SELECT explode(sequence(date'{start}', date'{end}')) AS date").join(F.broadcast(hol), "date", "left")
    days = days.withColumn("is_trading_day", ~F.dayofweek("date").isin(1, 7) & F.col("name").isNull())
    n_week = F.dayofweek("date")
    after_thanksgiving = (F.month("date") == 11) & (n_week == 6) & F.dayofmonth("date").between(23, 29)
    eve = (((F.month("date") == 7) & (F.dayofmonth("date") == 3)) | ((F.month("date") == 12) & (F.dayofmonth("date") == 24))) & n_week.isin(2, 3, 4, 5)
    days = days.withColumn("close_minutes", F.when(F.col("is_trading_day"), F.when(after_thanksgiving | eve, 13 * 60).otherwise(16 * 60)))
    # a calendar is a few thousand rows however large the data are
    own = F.when(F.col("is_trading_day"), F.col("date"))
    past, future = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("date").rowsBetween(1, Window.unboundedFollowing)
    index = F.sum(F.col("is_trading_day").cast("int")).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    return days.select("date", "is_trading_day", "close_minutes", F.last(own, True).over(past).alias("prev_day"), F.first(own, True).over(future).alias("next_day"), index.cast("int").alias("index"))


def align_events(events: DataFrame, days: DataFrame, date: str, timing: str, source_timing: str | None = None, bars: DataFrame | None = None, ticker: str = "ticker") -> DataFrame:
    """Entry and exit dates: after the close the event falls between its day and the next, before the open between the day before and its own.

    exclusion_reason is the first of: the source's own timing (``source_timing``) speaks against the calendar's or for midday, the
    day isn't a trading day, the timing isn't known, a date lies outside the calendar, or (with ``bars``: ticker, date) one of
    the two days has no bar.
    """
    cal = days.select(F.col("date").alias(date), "is_trading_day", "prev_day", "next_day")
    out = events.join(F.broadcast(cal), date, "left")  # a row a day
    amc, bmo, trading = F.col(timing) == "AMC", F.col(timing) == "BMO", F.coalesce("is_trading_day", F.lit(False))
    told = F.col(source_timing) if source_timing else F.lit(None).cast("string")
    mismatch = F.coalesce((told == "DMH") | (told.isin("BMO", "AMC") & (amc | bmo) & (told != F.col(timing))), F.lit(False))
    reason = F.when(mismatch, "source_timestamp_timing_mismatch").when(~F.coalesce(amc | bmo, F.lit(False)), "non_bmo_amc").when(~trading, "announcement_date_not_trading_day").when(F.when(amc, F.col("next_day")).otherwise(F.col("prev_day")).isNull(), "missing_entry_or_exit_date")
    ok = reason.isNull()
    entry = F.when(ok, F.when(amc, F.col(date)).otherwise(F.col("prev_day")))
    exit_ = F.when(ok, F.when(amc, F.col("next_day")).otherwise(F.col(date)))
    out = out.select(*events.columns, entry.alias("entry_date"), exit_.alias("exit_date"), reason.alias("exclusion_reason"))
    if bars is None:
        return out
    for side in ("entry_date", "exit_date"):
        have = bars.select(ticker, F.col("date").alias(side)).distinct().withColumn(f"_{side}", F.lit(True))
        out = out.join(have, [ticker, side], "left")
    missing = F.col("exclusion_reason").isNull() & (F.col("_entry_date").isNull() | F.col("_exit_date").isNull())
    return out.withColumn("exclusion_reason", F.when(missing, "missing_underlying_entry_or_exit_bar").otherwise(F.col("exclusion_reason"))).select(*events.columns, "entry_date", "exit_date", "exclusion_reason")


def nearest_days(days: DataFrame) -> DataFrame:
    """Each date's trading days around it: prev_day and next_day (strictly), on_or_before and on_or_after."""
    own = F.when(F.col("is_trading_day"), F.col("date"))
    return days.select("date", "prev_day", "next_day", F.coalesce(own, F.col("prev_day")).alias("on_or_before"), F.coalesce(own, F.col("next_day")).alias("on_or_after"))


def sequence_plan(events: DataFrame, dates: DataFrame, entry: str, date: str, steps: int = 20) -> DataFrame:
    """For each event its last ``steps`` available dates up to its entry: source_date and seq_index.

    The sequence is right-aligned: the latest date has index steps - 1, and an event with fewer dates starts later.
    Events before the first date have no rows. Dates are a calendar, one row a day, so they are sent to all tasks.
    """
    last = events.agg(F.max(entry)).head()[0]
    order = Window.orderBy("source_date")
    known = dates.select(F.col(date).cast("date").alias("source_date")).where("source_date IS NOT NULL").distinct()
    known = known.select("source_date", F.row_number().over(order).alias("_index"), F.lead("source_date").over(order).alias("_next"))
    until = F.coalesce(F.date_sub("_next", 1), F.greatest("source_date", F.lit(last).cast("date")))
    days = known.select(F.explode(F.sequence("source_date", until)).alias("_day"), F.col("_index").alias("_last"))
    placed = events.join(F.broadcast(days), F.col(entry) == F.col("_day"))
    spread = placed.withColumn("_index", F.explode(F.sequence(F.greatest(F.lit(1), F.col("_last") - steps + 1), F.col("_last"))))
    out = spread.join(F.broadcast(known.select("source_date", "_index")), "_index")
    return out.select(*events.columns, "source_date", (steps - 1 - (F.col("_last") - F.col("_index"))).alias("seq_index"))


def sequence_coverage(steps: DataFrame, key: str, valid: str, length: int = 20, least: int = 12) -> DataFrame:
    """Per event: valid steps, those among the latest five, and whether both suffice."""
    ok = F.coalesce(F.col(valid), F.lit(False))
    out = steps.groupBy(key).agg(F.count_if(ok).alias("valid_days"), F.count_if(ok & (F.col("seq_index") >= length - 5)).alias("latest5_days"))
    return out.withColumn("eligible", (F.col("valid_days") >= least) & (F.col("latest5_days") >= 1))


def coverage_by_event(steps: DataFrame, key: str, length: int = 20, least: int = 12, thresholds: tuple[int, ...] = (8, 12, 16, 20)) -> DataFrame:
    """Per event: steps, valid ones, those among the latest five, days without a price or without options, and why it isn't eligible.

    ``steps``: seq_index, source_date, is_valid_sequence_day, has_underlying_close, missing_options.
    """
    ok = F.coalesce(F.col("is_valid_sequence_day"), F.lit(False))
    out = steps.groupBy(key).agg(
        F.count("source_date").alias("sequence_days"), F.count_if(ok).alias("valid_days"), F.count_if(ok & (F.col("seq_index") >= length - 5)).alias("latest5_days"), F.count_if(~F.coalesce(F.col("has_underlying_close"), F.lit(False))).alias("missing_underlying_days"),
        F.count_if(F.coalesce(F.col("missing_options"), F.lit(False))).alias("missing_options_days"), F.max("source_date").alias("max_source_date"),
    )
    recent = F.col("latest5_days") >= 1
    out = out.withColumns({"eligible": (F.col("valid_days") >= least) & recent} | {f"eligible_min_{t}_days": (F.col("valid_days") >= t) & recent for t in thresholds})
    return out.withColumn("eligibility_reason", F.when(F.col("eligible"), "eligible").when(F.col("valid_days") < least, "insufficient_valid_sequence_days").otherwise("insufficient_latest_5_call_put_pairs"))


def coverage_report(coverage: DataFrame, thresholds: tuple[int, ...] = (8, 12, 16, 20), risk: float = 0.1) -> DataFrame:
    """One row: events, how many reach each number of valid steps, the share dropped, and whether that is a risk."""
    at = [F.count_if(F.col("valid_days") >= t).alias(f"at_least_{t}") for t in thresholds]
    out = coverage.agg(F.count("*").alias("events"), *at, F.avg((~F.col("eligible")).cast("int")).alias("drop_rate"))
    return out.withColumn("at_risk", F.col("drop_rate") > risk)
