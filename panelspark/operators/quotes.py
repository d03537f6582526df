"""From quote ticks to executable marks: windows, the latest valid quote in each, fills, straddles and the variance they imply."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.black_scholes import implied_volatility
from panelspark.functions.numbers import number
from panelspark.operators.intervals import inside_intervals
from panelspark.operators.variance import TIME_GAP, TOO_FEW, event_variance, first_two, year_fraction

# Windows, statuses of a mark and of an implied volatility, and the bounds of both.
ENTRY, EXIT = "entry_preclose_15m", "exit_preclose_15m"
OK, MISSING, INVALID, STALE, WIDE = "ok", "missing_quote", "invalid_bid_ask", "stale_quote", "wide_spread"
LOOKBACK, STALE_SECONDS, WIDE_SHARE, MULTIPLIER = 900, 60, 0.25, 100.0
KEY = ("event_id", "options_ticker", "window_label")
META = ("ticker", "announcement_date", "announcement_timing", "entry_date", "exit_date")


def band(score: Column) -> Column:
    """high from 0.8, medium from 0.5, low above 0, else missing."""
    return F.when(score >= 0.8, "high").when(score >= 0.5, "medium").when(score > 0, "low").otherwise("missing")


def close_time(days: DataFrame) -> DataFrame:
    """date and close_ts, the instant of the close, of a trading calendar."""
    minutes = F.coalesce(F.col("close_minutes"), F.lit(16 * 60))
    local = F.col("date").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), minutes)
    return days.select("date", F.to_utc_timestamp(local, "America/New_York").alias("close_ts"))


def window_requests(contracts: DataFrame, windows: DataFrame, days: DataFrame, entry_seconds: int = LOOKBACK, exit_seconds: int = LOOKBACK, max_events: int | None = None, event_offset: int = 0) -> DataFrame:
    """Each event's contract twice: the quarter of an hour before its entry and the one before the close of its exit day.

    Entry is event_entry_timestamp or else the close of the entry day; ``days`` is the trading calendar (a row a day).
    Contracts marked as outside the quote pool are left out. ``max_events`` and ``event_offset`` count events by id.
    """
    chosen = windows
    if max_events is not None or event_offset:
        some = windows.select("event_id").distinct().orderBy("event_id").offset(event_offset)
        chosen = windows.join(some if max_events is None else some.limit(max_events), "event_id", "left_semi")
    pool = contracts.where(F.coalesce(F.col("eligible_for_quote_pool").cast("boolean"), F.lit(False))) if "eligible_for_quote_pool" in contracts.columns else contracts
    more = [c for c in ("ticker", "announcement_date", "announcement_timing", "event_entry_timestamp", "s_before", "close_before", "spot") if c in windows.columns and (c not in contracts.columns)]
    met = pool.join(chosen.select("event_id", *more).dropDuplicates(["event_id"]), "event_id")
    close = close_time(days)
    met = met.join(F.broadcast(close.select(F.col("date").alias("entry_date"), F.col("close_ts").alias("_entry"))), "entry_date", "left").join(F.broadcast(close.select(F.col("date").alias("exit_date"), F.col("close_ts").alias("_exit"))), "exit_date", "left")
    entry = F.coalesce(F.col("event_entry_timestamp"), F.col("_entry")) if "event_entry_timestamp" in met.columns else F.col("_entry")
    before = lambda end, n: end - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(n))
    window = lambda name, end, n: F.struct(F.lit(name).alias("window_label"), before(end, n).alias("window_start"), end.alias("window_end"))
    both = F.inline(F.array(window(ENTRY, entry, entry_seconds), window(EXIT, F.col("_exit"), exit_seconds)))
    out = met.select("*", both).drop("_entry", "_exit")
    return out.withColumn("quote_date", F.to_date(F.from_utc_timestamp("window_end", "America/New_York")))


def window_marks(quotes: DataFrame, requests: DataFrame, stale_seconds: int = STALE_SECONDS, wide: float = WIDE_SHARE, key: Sequence[str] = KEY, contract: str = "options_ticker", ts: str = "ts", tie: Sequence[str] = ("bid", "ask")) -> DataFrame:
    """Each request with the latest valid quote of its contract and day inside it (both ends included) and what to think of it.

    A quote is valid if bid >= 0, ask > 0 and ask >= bid. Stale beats wide. Of quotes at one instant the one with the
    largest ``tie`` counts.
    """
    day = ["quote_date"] if "quote_date" in requests.columns and "quote_date" in quotes.columns else []
    asked = requests.select(*key, *[c for c in (contract, *day) if c not in key], F.col("window_start").alias("start_ts"), F.col("window_end").alias("end_ts"))
    ticks = quotes.select(contract, *day, F.col(ts).alias("_at"), number("bid").alias("bid"), number("ask").alias("ask"), *[c for c in tie if c not in ("bid", "ask")])
    valid = (F.col("bid") >= 0) & (F.col("ask") > 0) & (F.col("ask") >= F.col("bid"))
    latest = F.when(valid, F.struct("_at", *tie, F.col("bid").alias("_b"), F.col("ask").alias("_a")))
    found = inside_intervals(ticks, asked, [contract, *day], "_at", key, {"quote_count": F.lit(1).cast("long")}, last=latest).withColumnRenamed("_last", "_q")
    out = requests.join(found, list(key), "left").withColumn("quote_count", F.coalesce("quote_count", F.lit(0)))
    out = out.withColumns({"quote_timestamp": F.col("_q._at"), "bid": F.col("_q._b"), "ask": F.col("_q._a")})
    out = out.withColumns({"mid": (F.col("bid") + F.col("ask")) / 2, "spread": F.col("ask") - F.col("bid"), "quote_age_seconds": (F.unix_micros("window_end") - F.unix_micros("quote_timestamp")) / 1e6})
    out = out.withColumn("spread_over_mid", F.when(F.col("mid") > 0, F.col("spread") / F.col("mid")))
    out = out.withColumns({"stale_quote": F.coalesce(F.col("quote_age_seconds") > stale_seconds, F.lit(False)), "wide_spread": F.coalesce(F.col("spread_over_mid") > wide, F.lit(False))})
    status = F.when(F.col("quote_count") == 0, MISSING).when(F.col("_q").isNull(), INVALID).when(F.col("stale_quote"), STALE).when(F.col("wide_spread"), WIDE).otherwise(OK)
    score = F.when(F.col("quote_status") == OK, 1.0).when(F.col("quote_status").isin(STALE, WIDE), 0.5).otherwise(0.0)
    return out.withColumn("quote_status", status).withColumn("quote_score", score).drop("_q")


def _meta(df: DataFrame, names: Sequence[str] = META) -> list[Column]:
    """What a group's rows say alike (where they differ, the least)."""
    return [F.min(c).alias(c) for c in names if c in df.columns]


def execution_confidence(marks: DataFrame) -> DataFrame:
    """Per event how many marks of each status there are, the oldest, the median spread, the mean score and its band."""
    count = lambda s, name: F.count_if(F.col("quote_status") == s).alias(name)
    out = marks.groupBy("event_id").agg(
        *_meta(marks, META[:3]), F.count("*").alias("required_quote_marks"), count(OK, "ok_quote_marks"), count(MISSING, "missing_quote_marks"), count(INVALID, "invalid_quote_marks"), count(STALE, "stale_quote_marks"), count(WIDE, "wide_spread_marks"),
        F.max("quote_age_seconds").alias("max_quote_age_seconds"), F.percentile("spread_over_mid", F.lit(0.5)).alias("median_spread_over_mid"), F.avg(F.coalesce("quote_score", F.lit(0.0))).alias("execution_confidence_score"),
    )
    return out.withColumn("execution_confidence_band", band(F.col("execution_confidence_score")))


def execution_legs(marks: DataFrame) -> DataFrame:
    """Marks with the fill of a long position: entries buy at the ask, exits sell at the bid."""
    side = F.when(F.col("window_label").startswith("entry"), "buy_to_open").when(F.col("window_label").startswith("exit"), "sell_to_close").otherwise("unknown")
    out = marks.withColumn("execution_side", side).withColumn("long_fill_price", F.when(F.col("execution_side") == "buy_to_open", F.col("ask")).when(F.col("execution_side") == "sell_to_close", F.col("bid")))
    return out.withColumns({"long_fill_value_usd": F.col("long_fill_price") * MULTIPLIER, "mid_fill_value_usd": F.col("mid") * MULTIPLIER})


def _first_spot(df: DataFrame) -> Column:
    """The group's spot: of spot, s_before and close_before the first that has a value; not positive is none."""
    some = F.coalesce(*[F.min(number(c)) for c in ("spot", "s_before", "close_before") if c in df.columns])
    return F.when(some > 0, some)


def straddle_execution(marks: DataFrame) -> DataFrame:
    """Per event, expiry and strike the cost of buying call and put at entry and the value of selling both at exit.

    One group-by with conditional aggregates (of several marks in one place the smallest ticker's counts).
    """
    def leg(window: str, right: str) -> Column:
        here = (F.col("window_label") == window) & (F.lower("right") == right)
        return F.min(F.when(here, F.struct("options_ticker", "bid", "mid", "ask", F.coalesce("quote_status", F.lit(MISSING)).alias("status"))))

    legs = {f"{w}_{r}": leg(label, r) for w, label in (("entry", ENTRY), ("exit", EXIT)) for r in ("call", "put")}
    out = marks.groupBy("event_id", "expiration", "strike").agg(*_meta(marks), _first_spot(marks).alias("spot"), *[c.alias(f"_{n}") for n, c in legs.items()])
    out = out.withColumns({f"{n}_status": F.coalesce(F.col(f"_{n}.status"), F.lit(MISSING)) for n in legs})
    both = lambda w, side: (F.col(f"_{w}_call.{side}") + F.col(f"_{w}_put.{side}")) * MULTIPLIER
    out = out.withColumns({f"entry_{s}_cost_usd": both("entry", s) for s in ("bid", "mid", "ask")} | {f"exit_{s}_value_usd": both("exit", s) for s in ("bid", "mid", "ask")})
    share = lambda s: F.when(F.col("spot") > 0, F.pow(F.col(f"entry_{s}_cost_usd") / MULTIPLIER / F.col("spot"), F.lit(2.0)))
    every = lambda test: test("entry_call_status") & test("entry_put_status") & test("exit_call_status") & test("exit_put_status")
    full = every(lambda c: F.col(c) == OK)
    mids = every(lambda c: F.col(c) != MISSING) & F.col("entry_mid_cost_usd").isNotNull() & F.col("exit_mid_value_usd").isNotNull()
    out = out.withColumns({
        "quote_bidask_pnl_usd": F.col("exit_bid_value_usd") - F.col("entry_ask_cost_usd"), "quote_mid_pnl_usd": F.col("exit_mid_value_usd") - F.col("entry_mid_cost_usd"),
        "quote_premium_var_mid": share("mid"), "quote_premium_var_ask": share("ask"), "complete_bidask_pair": full, "complete_mid_pair": mids, "paper_grade_execution": full & F.col("spot").isNotNull(),
    })
    out = out.withColumns({f"quote_entry_{s}_premium_pct_spot": F.sqrt(f"quote_premium_var_{s}") for s in ("mid", "ask")})
    return out.drop(*[f"_{n}" for n in legs])


def _best_by_expiry(pairs: DataFrame, complete: Sequence[str]) -> DataFrame:
    """Per event and expiry the strike with the more complete marks, then nearest the spot, then the smallest."""
    near = F.abs(number("strike") / number("spot") - 1)
    order = [F.coalesce(F.col(c), F.lit(False)).desc() for c in complete]
    n = F.row_number().over(Window.partitionBy("event_id", "expiration").orderBy(*order, near.asc_nulls_last(), "strike"))
    return pairs.where(F.col("expiration").isNotNull()).withColumn("_n", n).where("_n = 1").drop("_n")


def _two_expiry_quotes(chosen: DataFrame, events: DataFrame, kinds: dict[str, tuple[str, str]], prefix: str) -> DataFrame:
    """``events`` (event_id, entry_date, …) with the first two expiries of ``chosen`` and, per kind, variance and failure."""
    keep = list(dict.fromkeys(["strike", "spot", *[c for pair in kinds.values() for c in pair]]))
    two = first_two(chosen, "event_id", "expiration", keep)
    out = events.join(two, "event_id", "left").withColumn("expiries", F.coalesce("expiries", F.lit(0)))
    enough = (F.col("expiries") >= 2) & F.col("entry_date").isNotNull()
    dte = lambda i: F.datediff(f"expiration_{i}", "entry_date")
    forward = enough & (dte(1) > 0) & (dte(2) > 0)
    out = out.withColumns({"dte_1": F.when(enough, dte(1)), "dte_2": F.when(enough, dte(2)), "t1": F.when(forward, year_fraction(dte(1))), "t2": F.when(forward, year_fraction(dte(2))), "expiry_gap_days": F.when(enough, F.datediff("expiration_2", "expiration_1"))})
    for kind, (total, complete) in kinds.items():
        v, reason = event_variance(F.col(f"{total}_1"), F.col(f"{total}_2"), F.col("t1"), F.col("t2"), F.col(f"{complete}_1") & F.col(f"{complete}_2"))
        out = out.withColumns({f"{prefix}_{kind}_ivar_event": F.when(forward, v), f"{prefix}_{kind}_ivar_failure_reason": F.when(~enough, TOO_FEW).when(~forward, TIME_GAP).otherwise(reason)})
    return out


def quote_ivar(straddles: DataFrame) -> DataFrame:
    """Per event the variance that quoted premiums imply: the squared share of the spot counts as total variance.

    Only expiries that cover the event count: not before its exit date, or, without one, before the announcement's day
    (before the open) or the day after (else).
    """
    events = straddles.groupBy("event_id").agg(*_meta(straddles))
    fallback = F.when(F.upper("announcement_timing") == "BMO", F.col("announcement_date")).otherwise(F.date_add("announcement_date", 1))
    until = F.coalesce(F.col("exit_date"), fallback)
    best = _best_by_expiry(straddles, ["complete_mid_pair", "complete_bidask_pair"])
    covering = best.join(events.select("event_id", until.alias("_until")), "event_id").where(F.col("_until").isNull() | (F.col("expiration") >= F.col("_until")))
    return _two_expiry_quotes(covering, events.withColumn("exit_date", until), {"mid": ("quote_premium_var_mid", "complete_mid_pair"), "ask": ("quote_premium_var_ask", "complete_bidask_pair")}, "quote")


def iv_failure(iv: Column, price: Column, spot: Column, strike: Column, t: Column, call: Column) -> Column:
    """Why a price has no implied volatility, or null."""
    intrinsic = F.greatest(F.when(call, spot - strike).otherwise(strike - spot), F.lit(0.0))
    none = lambda c: ~F.coalesce(c > 0, F.lit(False))
    return F.when(none(spot) | none(strike), "nonpositive_spot_or_strike").when(none(t), "nonpositive_time_to_expiry").when(none(price), "missing_or_nonpositive_option_price").when(price < intrinsic, "option_price_below_intrinsic").when(iv.isNull(), "implied_vol_root_not_bracketed")


def iv_surface(marks: DataFrame) -> DataFrame:
    """Entry marks with the volatilities that bid, mid and ask imply and why one has none.

    A mark that is missing, invalid or stale gives its status as the reason where there is no other.
    """
    rows = marks.where(F.col("window_label") == ENTRY)
    names = [c for c in ("spot", "s_before", "close_before") if c in rows.columns]
    entry = F.coalesce(*[F.col(c).cast("date") for c in ("entry_date", "announcement_date") if c in rows.columns])
    rows = rows.withColumn("_spot", F.coalesce(*[number(c) for c in names])).drop("spot").withColumnRenamed("_spot", "spot").withColumn("dte", F.datediff("expiration", entry))
    rows = rows.withColumns({"time_to_expiry": F.when(F.col("dte") > 0, year_fraction(F.col("dte"))), "right": F.lower("right"), "strike": number("strike")})
    s, k, t, call = F.col("spot"), F.col("strike"), F.col("time_to_expiry"), F.col("right") == "call"
    out = rows.withColumns({f"quote_{x}_iv": implied_volatility(F.col(x), s, k, t, F.coalesce(call, F.lit(False))) for x in ("bid", "mid", "ask")})
    status = F.when(F.col("quote_status").isin(MISSING, INVALID, STALE), F.col("quote_status"))
    out = out.withColumns({f"quote_{x}_iv_failure_reason": F.coalesce(iv_failure(F.col(f"quote_{x}_iv"), F.col(x), s, k, t, call), status) for x in ("bid", "mid", "ask")})
    ok = F.col("quote_status") == OK
    none = lambda x: F.col(f"quote_{x}_iv_failure_reason").isNull()
    return out.withColumns({"paper_grade_quote_iv_mid": ok & none("mid"), "paper_grade_quote_iv_bidask": ok & none("bid") & none("ask")})


def iv_surface_pairs(surface: DataFrame) -> DataFrame:
    """Per event, expiry and strike the volatilities of call and put side by side, their means (of both or none), skew and total variances."""
    leg = lambda r: F.min(F.when(F.lower("right") == r, F.struct("options_ticker", "quote_bid_iv", "quote_mid_iv", "quote_ask_iv", "time_to_expiry", F.coalesce("quote_status", F.lit(MISSING)).alias("status"))))
    out = surface.groupBy("event_id", "expiration", "strike").agg(*_meta(surface, META[:4]), F.min("dte").alias("dte"), F.min("spot").alias("spot"), leg("call").alias("_call"), leg("put").alias("_put"))
    out = out.withColumns({f"{r}_{x}_iv": F.col(f"_{r}.quote_{x}_iv") for r in ("call", "put") for x in ("bid", "mid", "ask")} | {f"{r}_status": F.coalesce(F.col(f"_{r}.status"), F.lit(MISSING)) for r in ("call", "put")})
    t = F.coalesce(F.when(F.col("_call").isNotNull(), F.col("_call.time_to_expiry")), F.when(F.col("_call").isNull(), F.col("_put.time_to_expiry")))
    out = out.withColumns({f"mean_{x}_iv": (F.col(f"call_{x}_iv") + F.col(f"put_{x}_iv")) / 2 for x in ("bid", "mid", "ask")} | {"time_to_expiry": t, "skew_put_minus_call_mid_iv": F.col("put_mid_iv") - F.col("call_mid_iv")})
    out = out.withColumns({f"quote_{x}_total_variance": F.col(f"mean_{x}_iv") * F.col(f"mean_{x}_iv") * F.col("time_to_expiry") for x in ("bid", "mid", "ask")})
    has = lambda x: F.col(f"quote_{x}_total_variance").isNotNull()
    out = out.withColumns({"complete_mid_surface_pair": has("mid"), "complete_bidask_surface_pair": has("bid") & has("ask")})
    return out.withColumn("paper_grade_quote_iv_surface_pair", (F.col("call_status") == OK) & (F.col("put_status") == OK) & F.col("complete_bidask_surface_pair")).drop("_call", "_put")


def quote_surface_ivar(pairs: DataFrame) -> DataFrame:
    """Per event the variance that the quoted surface implies. Unlike ``quote_ivar`` it asks no expiry to cover the event."""
    events = pairs.groupBy("event_id").agg(*_meta(pairs, META[:4]))
    best = _best_by_expiry(pairs, ["complete_mid_surface_pair", "complete_bidask_surface_pair"])
    both = "complete_bidask_surface_pair"
    return _two_expiry_quotes(best, events, {"mid": ("quote_mid_total_variance", "complete_mid_surface_pair"), "bid": ("quote_bid_total_variance", both), "ask": ("quote_ask_total_variance", both)}, "quote_surface")
