"""Index covariates at an event's entry: each index's second bars and the surface of its options, side by side.

The options that describe an index on a day are chosen once for a (symbol, day), and everything that follows from them and
from bars is made once for each distinct entry instant of that day, however many events share it. An index's bars are summed up
by instant and read through interval states, so that an entry costs rows, not pairs of bars; the bars of an option meet the
entries of their own hour.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.numbers import number
from panelspark.operators.intervals import exact, inside_intervals
from panelspark.operators.staging import materialise, parts_for
from panelspark.operators.surface import index_candidates, index_surface

# The indices, and what is kept of each of them.
SYMBOLS = ("SPY", "QQQ")
SURFACE = (
    "candidate_contracts", "priced_contracts", "valid_pair_count", "surface_missing_rate", "option_volume_sum",
    "atm_iv_proxy", "skew_proxy", "term_slope_proxy", "butterfly_proxy", "straddle_premium_to_spot",
)
UNDERLYING = ("close", "vwap", "return_in_buffer", "volume_sum", "transactions_sum", "rows")
#: What the features of an index depend on: events of one entry instant share them.
INSTANT = ["entry_date", "event_entry_timestamp"]
HOUR = 3_600_000_000  # in microseconds
PART_CONTRACTS = 500_000  # contracts of entry instants that a task joins with their bars


def _windows(events: DataFrame, keep: Sequence[str], seconds: int) -> DataFrame:
    """The span of so many seconds up to each entry, both ends included."""
    end = F.col("event_entry_timestamp")
    return events.select(*keep, (end - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))).alias("start_ts"), end.alias("end_ts"))


def _hour(c: Column) -> Column:
    """The hour that a time lies in, by its start; a full hour is the end of the one before it."""
    before = F.unix_micros(c) - 1
    return before - F.pmod(before, F.lit(HOUR))


def underlying_features(bars: DataFrame, asked: DataFrame, lookback_seconds: int, buffer_seconds: int) -> DataFrame:
    """Entry instant, symbol, and of the index's bars (symbol, ts, close, volume, transactions) before the entry: the last close, the mean price
    weighted by volume over the lookback, the return, volume and transactions over the buffer, and a status."""
    keys = [*INSTANT, "symbol"]
    rows = bars.select("symbol", "ts", number("close").alias("_p"), number("volume").alias("_v"), F.coalesce("transactions", F.lit(0)).cast("long").alias("_n")).where("_p > 0")
    # of the bars of an instant the highest is the last, the lowest the first; sums are exact, and numbers are summed up without a sort
    sound = F.col("_v") > 0
    one = rows.groupBy("symbol", "ts").agg(
        F.max("_p").alias("_high"), F.min("_p").alias("_low"), F.count("*").alias("_rows"), F.sum("_n").alias("_transactions"), exact(F.sum(exact(F.coalesce("_v", F.lit(0.0))))).alias("_volume"),
        exact(F.sum(F.when(sound, exact(F.col("_p") * F.col("_v"))))).alias("_pv"), exact(F.sum(F.when(sound, exact(F.col("_v"))))).alias("_weight"),
    )
    both = [_windows(asked, keys, seconds).withColumn("_wide", F.lit(wide)) for seconds, wide in ((buffer_seconds, True), (lookback_seconds, False))]
    sums = {n: F.col(n) for n in ("_rows", "_transactions", "_volume", "_pv", "_weight")}
    found = inside_intervals(one, both[0].unionByName(both[1]), ["symbol"], "ts", [*keys, "_wide"], sums, last=F.struct("ts", "_high"), first=F.struct("ts", "_low"))
    at = lambda wide, c: F.max(F.when(F.col("_wide") == wide, c))
    zero = lambda n: F.coalesce(at(True, F.col(n)), F.lit(0))
    some = F.col("_rows") > 0
    return found.groupBy(*keys).agg(
        F.when(zero("_rows") > 0, "ok").otherwise("missing").alias("status"), at(True, F.col("_last._high")).alias("close"), at(False, F.when(F.col("_weight") > 0, F.col("_pv").cast("double") / F.col("_weight").cast("double"))).alias("vwap"),
        at(True, F.col("_last._high") / F.col("_first._low") - 1).alias("return_in_buffer"), F.coalesce(at(True, F.when(some, F.col("_volume").cast("double"))), F.lit(0)).alias("volume_sum"),
        zero("_transactions").alias("transactions_sum"), zero("_rows").alias("rows"),
    )


def priced_contracts(bars: DataFrame, each: DataFrame, lookback_seconds: int) -> DataFrame:
    """The rows of ``each`` (an entry instant's contracts) that have bars in the seconds up to their entry, with vwap and volume of these.

    Contract and hour are the join's key: a contract's entries in an hour are few, and at most as many as its seconds.
    """
    trades = bars.select("options_ticker", F.col("ts").alias("_at"), number("option_vwap").alias("_p"), number("volume").alias("_v")).where("_p > 0 AND _v > 0").withColumn("_h", _hour(F.col("_at")))
    start = F.col("event_entry_timestamp") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(lookback_seconds))
    asked = each.select("*", F.explode(F.sequence(_hour(start), _hour(F.col("event_entry_timestamp")), F.lit(HOUR))).alias("_h"))
    asked = asked.repartition(parts_for(each.sparkSession, each.count(), PART_CONTRACTS), "options_ticker", "_h")
    met = asked.join(trades.hint("merge"), ["options_ticker", "_h"]).where(F.col("_at").between(start, F.col("event_entry_timestamp")))
    sums = met.groupBy(*each.columns).agg(F.sum(exact(F.col("_p") * F.col("_v"))).alias("_pv"), F.sum(exact(F.col("_v"))).alias("_sum"))
    return sums.select(*each.columns, (F.col("_pv").cast("double") / F.col("_sum").cast("double")).alias("vwap"), F.col("_sum").cast("long").alias("volume"))


def index_covariates(
    events: DataFrame, options: DataFrame, spots: DataFrame, underlying: DataFrame, option_bars: DataFrame,
    symbols: Sequence[str] = SYMBOLS, lookback_seconds: int = 900, buffer_minutes: int = 60, volatility: Column | None = None,
) -> DataFrame:
    """One row for each event with an entry date: market_second_status, and <symbol>_second_<name> for the index and its options' surface.

    ``events``: event_id, entry_date, event_entry_timestamp. ``options``: symbol, date, options_ticker, expiration, strike, right, dte,
    option_close. ``spots``: symbol, date, spot. ``underlying``: symbol, ts, close, volume, transactions. ``option_bars``: options_ticker,
    ts, option_vwap, volume, transactions. ``volatility`` takes the place of the implied one, where it is given.
    An event without an entry instant, or on a day without options, has just that as its status.
    """
    one = events.where("event_id IS NOT NULL AND entry_date IS NOT NULL").dropDuplicates(["event_id"]).select("event_id", "entry_date", "event_entry_timestamp")
    held = options.select(F.col("date").alias("entry_date")).distinct().withColumn("_options", F.lit(True))
    status = F.when(F.col("event_entry_timestamp").isNull(), "invalid_event_entry_timestamp").when(F.col("_options").isNull(), "missing_options_day_aggs").otherwise("ok")
    base = one.join(held, "entry_date", "left").withColumn("market_second_status", status).drop("_options")
    known = spots.where(number("spot").isNotNull()).select("symbol", F.col("date").alias("entry_date"), number("spot").alias("spot"))
    instants = materialise(base.where("market_second_status = 'ok'").select(*INSTANT).distinct(), "index-instants")
    asked = instants.select(*INSTANT, F.explode(F.array(*map(F.lit, symbols))).alias("symbol"))
    asked = asked.join(known, ["symbol", "entry_date"], "left")
    there = asked.where("spot IS NOT NULL")
    under = underlying_features(underlying, there, lookback_seconds, 60 * buffer_minutes)

    # once a symbol and day, then once an instant of that day
    day = options.withColumnRenamed("date", "entry_date").join(known, ["symbol", "entry_date"])
    chosen = index_candidates(day, ["symbol", "entry_date"]).select("symbol", "entry_date", "options_ticker", "expiration", "strike", "right", "dte", "spot")
    keys = [*INSTANT, "symbol"]
    each = materialise(chosen.join(there.select(*keys), ["symbol", "entry_date"]), "index-asked")
    shaped = index_surface(priced_contracts(option_bars, each, lookback_seconds), each, keys, volatility=volatility)

    every = asked.select(*keys, F.col("spot").isNull().alias("_none")).join(under, keys, "left").withColumn("status", F.when(F.col("_none"), "missing_underlying_day_aggs").otherwise(F.col("status")))
    every = every.join(shaped.withColumnRenamed("status", "surface_status"), keys, "left")
    pick = lambda s, c: F.max(F.when(F.col("symbol") == s, F.col(c)))
    wide = every.groupBy(*INSTANT).agg(*[
        pick(s, c).alias(f"{s.lower()}_second_{n}")
        for s in symbols
        for c, n in [("status", "underlying_status"), *[(u, f"underlying_{u}") for u in UNDERLYING], ("surface_status", "status"), *[(v, v) for v in SURFACE]]
    ])
    return base.join(wide, INSTANT, "left")
