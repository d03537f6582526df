"""Option contracts of events: discovery, reference checks, near-the-money picks, parity forwards, and straddles with their exits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.black_scholes import implied_volatility
from panelspark.functions.numbers import number, positive
from panelspark.functions.texts import stripped
from panelspark.operators import ranks
from panelspark.operators.asof import interval_vwap
from panelspark.operators.quotes import close_time

# Statuses of a contract, in the order in which they are tested, and of what is made of it.
NO_METADATA, NON_STANDARD, OUTSIDE_DTE, NOT_COVERING, OK = "missing_contract_metadata", "non_standard_excluded", "outside_dte_range", "does_not_cover_event_window", "ok"
SUPPORT_ONLY, UNVALIDATED = "ivar_support_only", "contract_reference_unvalidated_excluded"
INTRINSIC, EXPIRED, NO_PRECLOSE, PRECLOSE = "intrinsic_value_at_underlying_exit", "expiration_at_exit_intrinsic", "missing_exit_preclose_vwap_intrinsic_fallback", "exit_preclose_15m_option_second_agg_vwap"
MISSING_LEG = "missing_leg_vwap"
POST_OPEN = {"0_5": (0, 5), "5_15": (5, 15)}
MULTIPLIER, HAIRCUT = 100.0, 0.10
YES = ("true", "1", "yes", "y", "t", "corporate_action", "adjusted")


def flag(c: Column) -> Column:
    """A yes or no told in words; nothing told is no."""
    return F.coalesce(F.lower(stripped(c.cast("string"))).isin(*YES), F.lit(False))


def discover(events: DataFrame, contracts: DataFrame, dte_min: int = 5, dte_max: int = 14) -> DataFrame:
    """Every event with its ticker's contracts, days to expiry, the first test that each fails, and three flags.

    Missing multiplier, size and deliverable mean a standard contract. An event without contracts has one row, without metadata.
    """
    have = lambda c, default: F.col(c) if c in contracts.columns else F.lit(default)
    size = F.coalesce(have("option_multiplier", None).try_cast("double"), F.lit(100.0))
    made = contracts.select(
        F.upper("ticker").alias("ticker"), F.col("expiration").cast("date").alias("expiration"), number("strike").alias("strike"), F.lower("right").alias("right"), F.coalesce(*[F.col(c) for c in ("options_ticker", "option_symbol") if c in contracts.columns], F.lit(None).cast("string")).alias("options_ticker"),
        size.alias("option_multiplier"), F.coalesce(have("contract_size", None).try_cast("double"), size).alias("contract_size"), F.coalesce(F.lower(stripped(have("deliverable_status", None).cast("string"))), F.lit("standard")).alias("deliverable_status"), flag(have("corporate_action_flag", None)).alias("corporate_action_flag"),
    )
    out = events.withColumn("ticker", F.upper("ticker")).join(made, "ticker", "left")
    out = out.withColumns({"option_multiplier": F.coalesce("option_multiplier", F.lit(100.0)), "contract_size": F.coalesce("contract_size", F.lit(100.0)), "deliverable_status": F.coalesce("deliverable_status", F.lit("standard")), "corporate_action_flag": F.coalesce("corporate_action_flag", F.lit(False))})
    until = F.coalesce(F.col("exit_date"), F.col("entry_date")) if "exit_date" in events.columns else F.col("entry_date")
    out = out.withColumns({"dte": F.datediff("expiration", "entry_date"), "covers_event_window": F.coalesce(F.col("expiration") >= until, F.lit(False))})
    has = F.col("expiration").isNotNull() & F.col("strike").isNotNull() & F.coalesce(F.col("right").isin("call", "put", "c", "p"), F.lit(False))
    standard = (F.col("option_multiplier") == 100) & (F.col("contract_size") == 100) & (F.col("deliverable_status") == "standard") & ~F.col("corporate_action_flag")
    status = F.when(~has, NO_METADATA).when(~standard, NON_STANDARD).when(~F.col("dte").between(dte_min, dte_max), OUTSIDE_DTE).when(~F.col("covers_event_window"), NOT_COVERING).otherwise(OK)
    out = out.withColumn("contract_discovery_status", status).withColumn("eligible_for_quote_pool", F.col("contract_discovery_status") == OK)
    within = lambda a, b: F.col("eligible_for_quote_pool") & F.col("dte").between(a, b)
    return out.withColumns({"is_main_dte_5_14": within(5, 14), "is_robustness_dte_3_21": within(3, 21)})


def day_contracts(events: DataFrame, options: DataFrame, dte_min: int = 5, dte_max: int = 14, support_max: int = 45) -> DataFrame:
    """Each event's contracts that traded on its entry day (positive close and volume), expire by its exit day or later and within ``support_max`` days.

    ``options``: ticker (the underlying), date, options_ticker, expiration, strike, right, close, volume, transactions. Those
    outside the asked days to expiry only support the implied variance.
    """
    day = options.select(F.upper("ticker").alias("ticker"), F.col("date").alias("entry_date"), "options_ticker", "expiration", "strike", "right", positive("close").alias("option_close"), F.coalesce(number("volume"), F.lit(0.0)).cast("long").alias("volume"), F.coalesce(number("transactions"), F.lit(0.0)).cast("long").alias("transactions"))
    met = events.select("event_id", F.upper("ticker").alias("ticker"), "entry_date", "exit_date", number("s_before").alias("spot")).join(day.where("option_close IS NOT NULL AND volume > 0"), ["ticker", "entry_date"])
    met = met.withColumn("dte", F.datediff("expiration", "entry_date")).where(F.col("dte").between(0, support_max) & (F.col("expiration") >= F.col("exit_date")))
    asked = F.col("dte").between(dte_min, dte_max)
    return met.withColumns({
        "moneyness_abs": F.abs(F.col("strike") / F.col("spot") - 1), "contract_discovery_status": F.when(asked, OK).otherwise(SUPPORT_ONLY), "eligible_for_quote_pool": asked, "is_main_dte_5_14": asked & F.col("dte").between(5, 14),
        "is_robustness_dte_3_21": asked & F.col("dte").between(3, 21), "is_ivar_support_only": ~asked,
    })


def near_the_money(contracts: DataFrame, strikes: int) -> DataFrame:
    """Per event and expiry the contracts of the few strikes nearest the spot; strikes with call and put come first, if there are any."""
    keys = ["event_id", "expiration"]
    each = contracts.groupBy(*keys, "strike").agg((F.count_distinct("right") >= 2).alias("_pair"), F.min("moneyness_abs").alias("_m"))
    w = Window.partitionBy(*keys)
    pool = each.withColumn("_any", F.max("_pair").over(w)).where(F.col("_pair") | ~F.col("_any"))
    best = pool.withColumn("_n", F.row_number().over(w.orderBy("_m", "strike"))).where(F.col("_n") <= strikes).select(*keys, "strike")
    return contracts.join(best, [*keys, "strike"], "left_semi")


def reference_fields(reports: DataFrame, json_col: str = "payload") -> DataFrame:
    """options_ticker, reference_status and what reference payloads (JSON) say: shares per contract and whether the deliverable is adjusted."""
    get = lambda name: F.get_json_object(json_col, f"$.results.{name}")
    known = get("ticker").isNotNull()
    more = F.coalesce(F.json_array_length(get("additional_underlyings")), F.lit(0))
    return reports.select("options_ticker", "reference_status", "checked_at", get("shares_per_contract").try_cast("double").alias("shares_per_contract"), F.when(known, more > 0).alias("has_adjusted_deliverable"), known.alias("deliverable_known"))


def validate_reference(candidates: DataFrame, report: DataFrame) -> DataFrame:
    """Candidates with what a reference said of their contract, whether a proxy may use them and from what source.

    ``report``: options_ticker, reference_status, checked_at, shares_per_contract, has_adjusted_deliverable, deliverable_known; of
    one contract the last report counts. A validated contract of other than 100 shares or with an adjusted deliverable is
    excluded as non-standard. One that the reference lacks is usable just if its discovery was ok, it is of standard size and
    its deliverable is known not to be adjusted. All others are excluded until they are validated.
    """
    n = F.row_number().over(Window.partitionBy("options_ticker").orderBy(F.col("checked_at").desc_nulls_last(), "reference_status"))
    fields = ("shares_per_contract", "has_adjusted_deliverable", "deliverable_known")
    last = report.withColumn("_n", n).where("_n = 1").select("options_ticker", "reference_status", *fields)
    out = candidates.drop("reference_status", *fields).join(last, "options_ticker", "left").withColumn("reference_status", F.coalesce("reference_status", F.lit("not_requested")))
    # what was found before the reference was asked
    before = F.when(F.col("is_ivar_support_only"), SUPPORT_ONLY).otherwise(OK) if "is_ivar_support_only" in candidates.columns else F.col("contract_discovery_status")
    out = out.withColumns({"contract_discovery_status_pre_reference": before, "reference_validated": F.col("reference_status") == "validated"})
    yes = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False))
    standard = F.coalesce(F.col("option_multiplier") == 100, F.lit(False)) | F.coalesce(F.col("contract_size") == 100, F.lit(False))
    fallback = F.col("reference_status").isin("missing_reference", "not_requested") & (F.col("contract_discovery_status_pre_reference") == OK) & standard & yes("deliverable_known") & ~F.coalesce(F.col("has_adjusted_deliverable").cast("boolean"), F.lit(True))
    shares = F.col("shares_per_contract").try_cast("double")
    odd = F.col("reference_validated") & (F.coalesce(shares != 100, F.lit(True)) | yes("has_adjusted_deliverable"))
    out = out.withColumns({"reference_proxy_usable": F.col("reference_validated") | fallback, "_odd": odd, "option_multiplier": F.when(F.col("reference_validated"), F.coalesce(shares, F.col("option_multiplier"))).otherwise(F.col("option_multiplier")), "contract_size": F.when(F.col("reference_validated"), F.coalesce(shares, F.col("contract_size"))).otherwise(F.col("contract_size"))})
    usable = F.col("reference_proxy_usable")
    status = F.when(F.col("_odd"), NON_STANDARD).when(~usable & (F.col("contract_discovery_status_pre_reference") == OK), UNVALIDATED).otherwise(F.col("contract_discovery_status_pre_reference"))
    out = out.withColumns({"contract_discovery_status": status, "reference_proxy_source": F.when(F.col("reference_validated"), "validated_reference").when(usable, "missing_reference_standard_contract_fallback").otherwise("excluded")})
    lost = F.col("_odd") | ~usable
    out = out.withColumns({c: F.col(c) & ~lost for c in ("eligible_for_quote_pool", "is_main_dte_5_14", "is_robustness_dte_3_21") if c in candidates.columns})
    return out.drop("_odd")


def strict_quotes(quotes: DataFrame, dte_min: int = 5, dte_max: int = 14, most_spread: float = 0.30, most_moneyness: float = 0.10) -> DataFrame:
    """Quotes of an event (with its entry_date and spot) that parity may use: known by the entry day, two-sided, tight and near the money."""
    mid = (F.col("bid") + F.col("ask")) / 2
    out = quotes.withColumns({"mid": mid, "spread_over_mid": (F.col("ask") - F.col("bid")) / F.nullif(mid, F.lit(0.0)), "dte": F.datediff("expiration", "entry_date"), "moneyness_abs": F.abs(F.col("strike") / F.col("spot") - 1), "right": F.substring(F.lower("right"), 1, 1)})
    known = F.lit(True)
    if "ts" in quotes.columns:
        known = known & (F.col("ts") < F.date_add("entry_date", 1).cast("timestamp"))
    if "quote_date" in quotes.columns:
        known = known & (F.col("quote_date") <= F.col("entry_date"))
    return out.where(known & F.col("dte").between(dte_min, dte_max) & F.col("right").isin("c", "p") & (F.col("bid") > 0) & (F.col("ask") > F.col("bid")) & (F.col("spread_over_mid") <= most_spread) & (F.col("moneyness_abs") <= most_moneyness))


def ex_dividend_events(events: DataFrame, dividends: DataFrame, start: str, end: str) -> DataFrame:
    """event_id of the events whose ticker goes ex dividend between two dates, both included."""
    d = dividends.select(F.upper("ticker").alias("_t"), F.col("ex_dividend_date").alias("_x"))
    met = (F.upper(F.col("ticker").cast("string")) == F.col("_t")) & (F.col("_x") >= F.col(start)) & (F.col("_x") <= F.col(end))
    return events.join(d, met, "left_semi").select("event_id")


def parity_forward(events: DataFrame, quotes: DataFrame, dividends: DataFrame | None = None, **bounds) -> DataFrame:
    """``events`` with the forward that call and put at one strike imply (K + C - P), or the spot where they can't.

    The pair nearest the spot counts, then the tighter. An ex-dividend date up to the second expiry, no pair, or a forward
    that isn't positive falls back to the spot.
    """
    second = quotes.select("event_id", "expiration").distinct().withColumn("_n", F.row_number().over(Window.partitionBy("event_id").orderBy("expiration"))).where("_n <= 2").groupBy("event_id").agg(F.max("expiration").alias("_second"))
    out = events.join(second, "event_id", "left").withColumn("_second", F.coalesce(*[F.col(c) for c in ("expiration_2",) if c in events.columns], F.col("_second"), F.col("entry_date")))
    own = quotes.drop("entry_date", "spot").join(events.select("event_id", "entry_date", "spot"), "event_id")
    keys = ["event_id", "expiration", "strike", *[c for c in ("ts", "quote_date") if c in quotes.columns]]
    leg = lambda r: F.min(F.when(F.col("right") == r, F.struct("spread_over_mid", "mid")))
    pairs = strict_quotes(own, **bounds).groupBy(*keys).agg(leg("c").alias("c"), leg("p").alias("p"), F.min("moneyness_abs").alias("far")).where("c IS NOT NULL AND p IS NOT NULL")
    order = F.struct("far", F.col("c.spread_over_mid").alias("sc"), F.col("p.spread_over_mid").alias("sp"), *keys[1:])
    best = pairs.groupBy("event_id").agg(F.min_by(F.col("strike") + F.col("c.mid") - F.col("p.mid"), order).alias("_f"))
    out = out.join(best, "event_id", "left")
    paying = F.lit(False)
    if dividends is not None:
        hit = ex_dividend_events(out, dividends, "entry_date", "_second").distinct().withColumn("_pays", F.lit(True))
        out = out.join(hit, "event_id", "left")
        paying = F.coalesce(F.col("_pays"), F.lit(False))
    sound = F.coalesce((F.col("_f") > 0) & ~paying, F.lit(False))
    out = out.withColumns({"forward_source": F.when(sound, "put_call_parity").otherwise("spot_fallback"), "forward_price": F.when(sound, F.col("_f")).otherwise(F.col("spot")), "atm_selection_method": F.when(sound, "ATMF").otherwise("nearest_spot_atm"), "american_forward_caveat_flag": sound})
    return out.drop("_second", "_f", "_pays")


def flag_small_moves(panel: DataFrame, rvar: str = "rvar_event", ivar: str = "ivar_event", share: float = 0.75, most: float = 0.25) -> DataFrame:
    """Adds whether the event hardly moved though much variance was implied (at or above the 75th percentile of positive ones)."""
    i, r = number(ivar), number(rvar)
    cut = ranks.quantiles(panel.select(i.alias("i")).where("i > 0"), "i", [], {"_cut": share})
    out = panel.crossJoin(F.broadcast(cut))  # one row
    test = (i > 0) & (i >= F.coalesce("_cut", F.lit(0.0))) & (r >= 0) & (r <= i * most) & (r < i)
    return out.withColumn("possible_preannouncement_or_prior_guidance", F.coalesce(test, F.lit(False))).drop("_cut")


def attach_iv(prices: DataFrame, events: DataFrame) -> DataFrame:
    """Entry prices with the volatility they imply and why there is none."""
    out = prices.join(events.select("event_id", number("s_before").alias("_spot")), "event_id", "left")
    t, call = F.col("dte") / 365.0, F.lower("right") == "call"
    iv = implied_volatility(F.col("proxy_price"), F.col("_spot"), F.col("strike"), t, call)
    priced = (F.col("proxy_status") == "ok") & F.col("proxy_price").isNotNull()
    out = out.withColumn("local_iv", F.when(priced, iv))
    intrinsic = F.greatest(F.when(call, F.col("_spot") - F.col("strike")).otherwise(F.col("strike") - F.col("_spot")), F.lit(0.0))
    positive_ = (F.col("_spot") > 0) & (F.col("strike") > 0) & (t > 0) & (F.col("proxy_price") > 0)
    status = F.when(~priced, F.coalesce(F.nullif("proxy_status", F.lit("ok")), F.lit("missing_proxy_price"))).when(~F.coalesce(positive_, F.lit(False)), "invalid_iv_inputs").when(F.col("proxy_price") < intrinsic, "price_below_intrinsic").when(F.col("local_iv").isNull(), "iv_root_not_bracketed").otherwise("ok")
    return out.withColumn("local_iv_status", status).drop("_spot")


def strike_pairs(prices: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Per group and strike with both a call and a put of known ``value``: their tickers and prices, mean value, volume and transactions."""
    leg = lambda r: F.min(F.when(F.lower("right") == r, F.struct("options_ticker", F.col("proxy_price").alias("price"))))
    out = prices.where(F.col(value).isNotNull()).groupBy(*by, "strike").agg(leg("call").alias("call"), leg("put").alias("put"), F.avg(value).alias("mean"), F.sum("proxy_volume").alias("volume"), F.sum("proxy_transactions").alias("transactions"))
    return out.where("call IS NOT NULL AND put IS NOT NULL")


def iv_inputs(prices: DataFrame, events: DataFrame) -> DataFrame:
    """Per event and expiry the mean volatility of call and put at the strike nearest the spot (then the larger volume)."""
    pairs = strike_pairs(prices, "local_iv", ["event_id", "expiration"]).join(events.select("event_id", "ticker", F.col("announcement_date").alias("event_date"), F.col("exit_date").alias("event_exit_date"), "entry_date", number("s_before").alias("_spot")), "event_id")
    far = F.abs(F.col("strike") / F.col("_spot") - 1)
    n = F.row_number().over(Window.partitionBy("event_id", "expiration").orderBy(far, F.desc("volume"), "strike"))
    best = pairs.withColumn("_n", n).where("_n = 1")
    return best.select("event_id", "ticker", "event_date", "event_exit_date", "entry_date", "expiration", F.col("mean").alias("iv"), F.datediff("expiration", "entry_date").alias("dte_days"), "strike", (1 + far).alias("moneyness"), "volume", "transactions")


def leg_windows(straddles: DataFrame, days: DataFrame, kind: str) -> DataFrame:
    """Each straddle leg with its windows on the exit day: after the open (0-5 and 5-15 minutes) or the quarter before the close."""
    leg = F.explode(F.array("call_options_ticker", "put_options_ticker")).alias("options_ticker")
    each = straddles.select("event_id", "exit_date", leg).where("options_ticker IS NOT NULL")
    minute = lambda n: F.make_dt_interval(F.lit(0), F.lit(0), F.lit(n))
    if kind == "post_open":
        opening = F.to_utc_timestamp(F.col("exit_date").cast("timestamp") + minute(570), "America/New_York")
        made = F.array(*[F.struct(F.lit(n).alias("window_label"), (opening + minute(a)).alias("start_ts"), (opening + minute(b)).alias("end_ts")) for n, (a, b) in POST_OPEN.items()])
        return each.select("*", F.inline(made))
    met = each.join(F.broadcast(close_time(days)), F.col("exit_date") == F.col("date"), "left").drop("date")  # a row a day
    return met.withColumns({"window_label": F.lit("preclose_15m"), "start_ts": F.col("close_ts") - minute(15), "end_ts": F.col("close_ts")}).drop("close_ts")


def exit_prices(bars: DataFrame, straddles: DataFrame, days: DataFrame, price: str = "option_vwap") -> DataFrame:
    """Window prices of every straddle leg after the open and before the close of its exit day, in one join with the bars."""
    asked = leg_windows(straddles, days, "post_open").unionByName(leg_windows(straddles, days, "preclose"))
    return interval_vwap(bars, asked, ["options_ticker"], "ts", price, "volume", ["event_id", "options_ticker", "window_label"], transactions="transactions")


def choose_straddles(prices: DataFrame, events: DataFrame) -> DataFrame:
    """Per event the first expiry with a call and put priced at one strike, at the strike nearest the spot (then the larger volume)."""
    pairs = strike_pairs(prices.where("proxy_status = 'ok'"), "proxy_price", ["event_id", "expiration"]).join(events.select("event_id", "ticker", "entry_date", "exit_date", number("s_before").alias("_spot"), number("s_after").alias("s_after"), positive("open_after").alias("open_after")), "event_id")
    n = F.row_number().over(Window.partitionBy("event_id").orderBy("expiration", F.abs(F.col("strike") / F.col("_spot") - 1), F.desc("volume"), "strike"))
    best = pairs.withColumn("_n", n).where("_n = 1").drop("_n", "_spot", "mean")
    return best.withColumns({"call_options_ticker": F.col("call.options_ticker"), "put_options_ticker": F.col("put.options_ticker"), "entry_premium_usd": (F.col("call.price") + F.col("put.price")) * MULTIPLIER}).drop("call", "put")


def straddle_diagnostics(prices: DataFrame, events: DataFrame, exits: DataFrame | None = None, haircut: float = HAIRCUT) -> DataFrame:
    """One-contract straddles per event: premium, exit value and result, close to close, to the open, and from the open on.

    The exit is the price before the close of the exit day; the intrinsic value where that is missing or the contract
    expires by then. Results after a haircut lose that share of what was paid.
    """
    out = choose_straddles(prices, events)
    labels = [*POST_OPEN, "preclose_15m"]
    if exits is not None:
        at = lambda side, label: F.max(F.when((F.col("window_label") == label) & (F.col("options_ticker") == F.col(f"{side}_options_ticker")), F.struct("vwap", "volume", "transactions", "rows"))).alias(f"_{side}_{label}")
        legs = out.select("event_id", "call_options_ticker", "put_options_ticker").join(exits.select("event_id", "options_ticker", "window_label", "vwap", "volume", "transactions", "rows"), "event_id")
        out = out.join(legs.groupBy("event_id").agg(*[at(s, n) for s in ("call", "put") for n in labels]), "event_id", "left")
    else:
        empty = F.lit(None).cast("struct<vwap:double,volume:bigint,transactions:bigint,rows:bigint>")
        out = out.withColumns({f"_{s}_{n}": empty for s in ("call", "put") for n in labels})
    paid = F.col("entry_premium_usd")
    for n in labels:
        name = "exit_option_vwap_preclose_15m" if n == "preclose_15m" else f"post_open_option_vwap_{n}"
        both = (F.col(f"_call_{n}.vwap") > 0) & (F.col(f"_put_{n}.vwap") > 0)
        value = F.when(both, (F.col(f"_call_{n}.vwap") + F.col(f"_put_{n}.vwap")) * MULTIPLIER)
        total = lambda c: F.coalesce(F.col(f"_call_{n}.{c}"), F.lit(0)) + F.coalesce(F.col(f"_put_{n}.{c}"), F.lit(0))  # noqa: B023, E731
        out = out.withColumns({f"{name}_value_usd": value, f"gross_{name}_pnl_usd": value - paid, f"{name}_haircut_pnl_usd": value - paid - haircut * paid, f"{name}_status": F.when(F.coalesce(both, F.lit(False)), "ok").otherwise(MISSING_LEG), f"{name}_volume": total("volume"), f"{name}_transactions": total("transactions"), f"{name}_rows": total("rows")})
    gone, preclose = F.col("expiration") <= F.col("exit_date"), F.col("exit_option_vwap_preclose_15m_value_usd")
    fallback = F.coalesce(gone, F.lit(False)) | preclose.isNull()
    out = out.withColumn("exit_intrinsic_usd", F.abs(F.col("s_after") - F.col("strike")) * MULTIPLIER)
    out = out.withColumns({"exit_option_value_usd": F.when(fallback, F.col("exit_intrinsic_usd")).otherwise(preclose), "option_exit_price_status": F.when(gone, EXPIRED).when(preclose.isNotNull(), "ok").otherwise(NO_PRECLOSE), "option_exit_price_source": F.when(fallback, INTRINSIC).otherwise(PRECLOSE), "used_intrinsic_fallback": fallback})
    opened = F.abs(F.col("open_after") - F.col("strike")) * MULTIPLIER
    out = out.withColumns({"gross_proxy_pnl_usd": F.col("exit_option_value_usd") - paid, "c2o_exit_intrinsic_usd": opened, "gross_c2o_intrinsic_proxy_pnl_usd": opened - paid, "c2o_haircut_pnl_usd": opened - paid - haircut * paid, "c2o_proxy_pnl_status": F.when(opened.isNotNull(), "ok").otherwise("missing_open_after")})
    out = out.withColumn("haircut_pnl_usd", F.col("gross_proxy_pnl_usd") - haircut * paid)
    for n in POST_OPEN:
        anchor = F.col(f"post_open_option_vwap_{n}_value_usd")
        gross = F.col("exit_option_value_usd") - anchor
        out = out.withColumns({f"gross_reaction_o2c_option_vwap_{n}_pnl_usd": gross, f"reaction_o2c_option_vwap_{n}_haircut_pnl_usd": gross - haircut * anchor, f"reaction_o2c_option_vwap_{n}_status": F.when(anchor.isNotNull(), "ok").otherwise("missing_open_option_vwap"), f"option_proxy_decomposition_residual_{n}_usd": F.col("gross_proxy_pnl_usd") - F.col(f"gross_post_open_option_vwap_{n}_pnl_usd") - gross})
    return out.drop(*[f"_{s}_{n}" for s in ("call", "put") for n in labels])
