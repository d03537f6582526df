"""From bars to the event panel: tickers, liquidity universes, targets, pairs at the money and histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.numbers import number, positive
from panelspark.functions.texts import stripped
from panelspark.operators.asof import asof_backward


# Where common equities trade, and words of funds' names.
EXCHANGES, FUND_WORDS = ("nasdaq", "nyse", "nyse american", "nyse arca"), (" etf", " fund", " trust", " etn", " index")


def eligible_equities(listings: DataFrame) -> DataFrame:
    """ticker, exchange, eligible and filter_reason of listings (ticker, name, exchange): no other exchange, no fund by its name."""
    name = F.concat(F.lit(" "), F.lower(F.coalesce(F.col("name").cast("string"), F.lit(""))))
    exchange = F.lower(stripped(F.coalesce("exchange", F.lit(""))))
    odd = (exchange != "") & ~exchange.isin(*EXCHANGES)
    fund = F.greatest(*[F.contains(name, F.lit(w)) for w in FUND_WORDS])
    reason = F.when(odd, "unsupported_exchange").when(fund, "fund_or_index_like_name").otherwise("eligible_common_equity")
    out = listings.select(F.upper(stripped("ticker")).alias("ticker"), F.nullif(F.upper(exchange), F.lit("")).alias("exchange"), reason.alias("filter_reason")).where("ticker <> ''")
    return out.withColumn("eligible", F.col("filter_reason") == "eligible_common_equity")


def ticker_mapping(requested: DataFrame, available: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """ticker, mapped_ticker, mapping_status and candidates of requested tickers: the one of itself and its aliases that is available.

    ``aliases``: ticker, alias. Two that are available are ambiguous.
    """
    asked = requested.select(F.upper("ticker").alias("ticker")).distinct()
    every = asked.select("ticker", F.col("ticker").alias("candidate"))
    if aliases is not None:
        every = every.unionByName(aliases.select(F.upper("ticker").alias("ticker"), F.upper("alias").alias("candidate")).join(asked, "ticker", "left_semi"))
    known = available.select(F.upper("ticker").alias("candidate")).distinct().withColumn("_known", F.lit(True))
    found = every.distinct().join(known, "candidate", "left").groupBy("ticker").agg(F.count("_known").alias("n"), F.min(F.when(F.col("_known"), F.col("candidate"))).alias("one"), F.array_join(F.sort_array(F.collect_set("candidate")), ",").alias("candidate_tickers"))
    return found.select("ticker", F.when(F.col("n") == 1, F.col("one")).alias("mapped_ticker"), F.when(F.col("n") == 1, "ok").when(F.col("n") > 1, "ticker_mapping_ambiguous").otherwise("ticker_not_found").alias("mapping_status"), "candidate_tickers")


def mean_volume_universe(rows: DataFrame, ticker: str, volume: str, top_n: int) -> DataFrame:
    """The ``top_n`` tickers by mean volume with their rank; ties go to the ticker that sorts last."""
    means = rows.groupBy(F.col(ticker).alias("ticker")).agg(F.avg(F.coalesce(number(volume), F.lit(0.0))).alias("mean_volume"))
    top = means.orderBy(F.desc("mean_volume"), F.desc("ticker")).limit(top_n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean_volume"), F.desc("ticker"))))  # top_n rows


def universe_membership(events: DataFrame, universe: DataFrame, ticker: str, date: str) -> DataFrame:
    """Events with the rank of their ticker in the latest universe of their month or before, and why they have none."""
    month = events.withColumn("_month", F.trunc(date, "MM"))
    out = asof_backward(month, universe.select(ticker, "universe_month", "rank"), [ticker], "_month", "universe_month", ["rank"])
    status = F.when(F.col("_month").isNull(), "bad_event_month").when(F.col("matched_universe_month").isNull(), "no_universe_membership").otherwise("in_universe")
    return out.withColumn("universe_filter_status", status).withColumnsRenamed({"rank": "universe_rank", "matched_universe_month": "universe_month"}).drop("_month")


def halted(bars: DataFrame, vendor_flag: str | None = None) -> Column:
    """The reason to think that trading was halted, or null: the vendor says so, or nothing was traded at one price."""
    told = F.col(vendor_flag).cast("boolean") if vendor_flag and vendor_flag in bars.columns else F.lit(False)
    still = (F.col("volume") == 0) & (F.col("open") == F.col("high")) & (F.col("open") == F.col("low")) & (F.col("open") == F.col("close"))
    return F.when(told, "vendor_halt_flag").when(still, "proxy_zero_volume_unchanged_ohlc")


def telemetry_bucket(date: Column) -> Column:
    return F.when(date.between(F.lit("2020-01-01").cast("date"), F.lit("2020-09-30").cast("date")), "covid_shock").otherwise("steady_proxy")


TARGETS = ("day", "jump", "reaction")
# The names of targets.
TARGET_IDS = {"day": "day_c2c", "jump": "jump_c2o", "reaction": "reaction_o2c"}


def month_liquidity(bars: DataFrame, ticker: str, date: str, price: Column, volume: Column, multiplier: float = 100.0) -> DataFrame:
    """month, ticker, liquidity (sum of price x volume x multiplier) and rows. Partial sums come before the shuffle."""
    value = price * volume * F.lit(multiplier)
    return bars.where(price.isNotNull() & volume.isNotNull()).groupBy(F.trunc(date, "MM").alias("month"), F.col(ticker).alias("ticker")).agg(F.sum(value).alias("liquidity"), F.count("*").alias("row_count"))


def trailing_universe(liquidity: DataFrame, trailing_months: int, top_n: int) -> DataFrame:
    """universe_month, ticker, trailing liquidity and rank: the top tickers by the months before (this one excluded).

    Each month's sum is sent to the months that look back on it, so the range join is an explode and one sum.
    """
    ahead = F.explode(F.sequence(F.lit(1), F.lit(trailing_months)))
    spread = liquidity.select("ticker", "liquidity", "month", ahead.alias("_k")).select("ticker", "liquidity", F.add_months("month", F.col("_k")).alias("universe_month"))
    span = liquidity.agg(F.min("month").alias("_a"), F.max("month").alias("_b"))
    sums = spread.groupBy("universe_month", "ticker").agg(F.sum("liquidity").alias("trailing_liquidity")).join(F.broadcast(span), F.col("universe_month").between(F.add_months("_a", 1), F.add_months("_b", 1)))
    n = F.row_number().over(Window.partitionBy("universe_month").orderBy(F.desc(F.round("trailing_liquidity", 4)), "ticker"))
    return sums.withColumn("rank", n).where(F.col("rank") <= top_n).select("universe_month", "ticker", "trailing_liquidity", "rank")


def return_targets(windows: DataFrame, bars: DataFrame, ticker: str, floor: float = 1e-6) -> DataFrame:
    """Adds the log returns close-to-close, close-to-open and open-to-close of each window, their squares, identities and shares.

    ``bars``: ticker, date, open, close and, if known, volume. A price that isn't a finite number above zero is missing. A
    window with an exclusion_reason keeps its row, without targets.
    """
    has_volume = F.coalesce(number("volume") > 0, F.lit(False)) if "volume" in bars.columns else F.lit(False)
    entry = bars.select(ticker, F.col("date").alias("entry_date"), positive("close").alias("close_before"))
    exit_ = bars.select(ticker, F.col("date").alias("exit_date"), positive("open").alias("open_after"), positive("close").alias("close_after"), has_volume.alias("open_after_volume_available"))
    out = windows.join(entry, [ticker, "entry_date"], "left").join(exit_, [ticker, "exit_date"], "left")
    if "exclusion_reason" in windows.columns:
        kept = F.coalesce(F.col("exclusion_reason"), F.lit("")) == ""
        out = out.withColumns({c: F.when(kept, F.col(c)) for c in ("close_before", "open_after", "close_after", "open_after_volume_available")})
    out = out.withColumns({"r_day": F.ln(F.col("close_after") / F.col("close_before")), "r_jump": F.ln(F.col("open_after") / F.col("close_before")), "r_reaction": F.ln(F.col("close_after") / F.col("open_after"))})
    out = out.withColumns({f"rvar_{k}": F.col(f"r_{k}") * F.col(f"r_{k}") for k in ("day", "jump", "reaction")} | {"cross_term": 2 * F.col("r_jump") * F.col("r_reaction")})
    out = out.withColumns({"rvar_reconstructed": F.col("rvar_jump") + F.col("rvar_reaction") + F.col("cross_term"), "residual": F.col("r_day") - F.col("r_jump") - F.col("r_reaction")})
    out = out.withColumns({"cross_term_share_raw": F.abs("cross_term") / F.nullif(F.col("rvar_reconstructed"), F.lit(0.0)), "cross_term_share_floored": F.abs("cross_term") / F.greatest(F.abs("rvar_reconstructed"), F.lit(floor))})
    known = F.col("open_after").isNotNull()
    return out.withColumns({"s_before": F.col("close_before"), "s_after": F.col("close_after"), "rvar_event": F.col("rvar_day"), "open_after_status": F.when(known, "vendor_regular_ohlc_assumed").otherwise("unavailable"), "open_after_source": F.when(known, "underlying_day_aggs_open"), "open_after_volume_available": F.coalesce("open_after_volume_available", F.lit(False))})


def targets_long(targets: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per event and target."""
    return targets.unpivot(list(keep), ["rvar_day", "rvar_jump", "rvar_reaction"], "target_id", "rvar").where("rvar IS NOT NULL")


def target_frames(panel: DataFrame, ivar: str = "ivar_event") -> DataFrame:
    """The panel once for each target, with its variance as rvar_event and its realised edge over the implied variance."""
    each = F.inline(F.array(*[F.struct(F.lit(TARGET_IDS[t]).alias("target_id"), number(f"rvar_{t}").alias("_rvar")) for t in TARGETS]))
    out = panel.select("*", each).withColumn("rvar_event", F.col("_rvar")).drop("_rvar")
    return out.withColumn("edge_var_realized", F.col("rvar_event") - number(ivar))


def pair_at_the_money(quotes: DataFrame, by: Sequence[str], spot: str) -> DataFrame:
    """Per group the strike nearest the spot with both a call and a put (then larger volume, smaller strike): pair premium and mean IV.

    Calls and puts meet by conditional aggregation on (group, strike): one shuffle, no self-join.
    """
    side = lambda r, c: F.max(F.when(F.col("right") == r, F.col(c)))
    pairs = quotes.groupBy(*by, "strike").agg(side("call", "price").alias("call_price"), side("put", "price").alias("put_price"), side("call", "iv").alias("_ci"), side("put", "iv").alias("_pi"), F.sum("volume").alias("volume"), F.max(spot).alias("spot"))
    pairs = pairs.where("call_price IS NOT NULL AND put_price IS NOT NULL").withColumn("moneyness", F.abs(F.col("strike") / F.col("spot") - 1))
    best = F.row_number().over(Window.partitionBy(*by).orderBy("moneyness", F.desc("volume"), "strike"))
    return pairs.withColumn("_n", best).where("_n = 1").select(*by, "strike", "spot", "moneyness", "call_price", "put_price", (F.col("call_price") + F.col("put_price")).alias("premium"), ((F.col("_ci") + F.col("_pi")) / 2).alias("iv"), "volume")


def rolling_variance(bars: DataFrame, ticker: str, date: str, close: str, k: int = 5) -> DataFrame:
    """Adds the daily return and the sample variance of the last ``k`` returns (two at least)."""
    w = Window.partitionBy(ticker).orderBy(date)
    ret = F.col(close) / F.lag(close).over(w) - 1
    out, last = bars.withColumn("ret", ret), w.rowsBetween(-(k - 1), 0)
    return out.withColumn("rv", F.when(F.count("ret").over(last) >= 2, F.var_samp("ret").over(last)))


def sequence_aggregates(steps: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """Per key: steps, mean, last, population deviation and least-squares slope of the value over its position."""
    x = F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("double")
    placed = steps.withColumn("_x", x)
    v = F.col(value)
    slope = F.coalesce(F.regr_slope(v, F.col("_x")), F.lit(0.0))
    return placed.groupBy(key).agg(F.count(v).alias("steps"), F.avg(v).alias("mean"), F.max_by(v, F.when(v.isNotNull(), F.col("_x"))).alias("last"), F.coalesce(F.stddev_pop(v), F.lit(0.0)).alias("std"), slope.alias("slope"))
