"""Option surfaces by day and by five minutes, event sequences made of them, and what models read from sequences."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.black_scholes import implied_volatility
from panelspark.functions.numbers import number, ratio
from panelspark.operators.panel import rolling_variance
from panelspark.operators.selection import column_quantiles
from panelspark.operators.staging import materialise, parts_for

STRIKES, DTE_RANGE, TARGET_DTE, NEAR, FAR_DTE = 4, (3, 45), 14, (3, 14), (15, 45)
BINS, BIN_MINUTES, DAILY_STEPS, MOST_MONEYNESS = 12, 5, 19, 0.05
PART_ROWS = 1_000_000  # last bars that a task sums up
RUNUP = ("atm_iv_proxy", "event_ivar_proxy", "iv_skew_proxy", "iv_butterfly_proxy", "straddle_premium_to_spot", "option_volume_sum", "option_transactions_sum", "surface_missing_rate")


def with_iv(options: DataFrame, price: str, spot: str, volatility: Column | None = None) -> DataFrame:
    """Adds iv_proxy, with at least a day to expiry; or the given volatility of priced rows."""
    if volatility is not None:
        return options.withColumn("iv_proxy", F.when(F.col(price).isNotNull(), volatility))
    t = F.greatest(F.col("dte") / 365.0, F.lit(1 / 365.0))
    return options.withColumn("iv_proxy", implied_volatility(F.col(price), F.col(spot), F.col("strike"), t, F.lower("right") == "call"))


def surface_shape(rows: DataFrame, keys: Sequence[str], price: str, spot: str) -> DataFrame:
    """Per key of rows with iv_proxy: at-the-money volatility, skew, straddle premium over spot, term slope, butterfly and iv_pairs.

    Only strikes with a call and a put of an expiry count. The nearest to the spot is at the money (then by days from 14,
    expiry, strike); the butterfly is that of the strike nearest the spot and its neighbours.
    """
    pairs = rows.where("iv_proxy IS NOT NULL").groupBy(*keys, "expiration", "strike").agg(*_strike_sums(price, spot))
    return _shape_of_pairs(pairs.where("ci IS NOT NULL AND pi IS NOT NULL"), keys)


def _strike_sums(price: str, spot: str) -> list[Column]:
    """What the shape needs of the rows with iv_proxy of one strike and expiry."""
    has = F.col("iv_proxy").isNotNull()
    side = lambda c, r: F.avg(F.when(has & (F.lower("right") == r), F.col(c)))
    return [
        side("iv_proxy", "call").alias("ci"), side("iv_proxy", "put").alias("pi"), side(price, "call").alias("cp"), side(price, "put").alias("pp"), F.avg("iv_proxy").alias("iv"), F.sum("iv_proxy").alias("ivs"), F.count("iv_proxy").alias("n"),
        F.min(F.when(has, F.col("dte"))).alias("dte"), F.min(F.when(has, F.col(spot))).alias("spot"),
    ]


def _shape_of_pairs(cells: DataFrame, keys: Sequence[str], also: dict[str, Callable] | None = None) -> DataFrame:
    """The shape of each key's cells (``_strike_sums`` of an expiry and strike); cells without a call and a put count for ``also`` only.

    ``also``: columns of the cells and their sum, minimum or maximum per key. Strikes are summed up inside their key, so that
    rows which are dealt out by key, or by a part of it, are shuffled no more and nothing is joined.
    """
    pair, also = F.col("ci").isNotNull() & F.col("pi").isNotNull(), also or {}
    near = [F.abs(F.col("strike") / F.col("spot") - 1).alias("far"), F.abs(F.col("dte") - TARGET_DTE).alias("days"), F.col("expiration"), F.col("strike").alias("at")]
    part = lambda c, span=None: F.sum(F.when(pair & F.col("dte").between(*span) if span else pair, F.col(c)))
    spans = {"far": FAR_DTE, "near": NEAR}
    by_strike = cells.groupBy(*keys, "strike").agg(
        F.min(F.when(pair, F.struct(*near, "iv", "ci", "pi", "cp", "pp", "spot"))).alias("atm"), F.count_if(pair).alias("iv_pairs"), (part("ivs") / part("n")).alias("_iv"), F.min(F.when(pair, F.col("spot"))).alias("_spot"),
        *[part(c, span).alias(f"_{name}_{c}") for name, span in spans.items() for c in ("ivs", "n")], *[f(c).alias(c) for c, f in also.items()],
    )
    # strikes without a pair come last, so that they are no neighbours
    w = Window.partitionBy(*keys).orderBy(F.col("_iv").isNull(), "strike")
    sided = by_strike.withColumn("_fly", F.lag("_iv").over(w) + F.lead("_iv").over(w) - 2 * F.col("_iv"))
    middle = F.when(F.col("_iv").isNotNull(), F.struct(F.abs(F.col("strike") - F.col("_spot")), "strike"))
    mean = lambda name: F.sum(f"_{name}_ivs") / F.sum(f"_{name}_n")
    out = sided.groupBy(*keys).agg(F.min("atm").alias("atm"), F.sum("iv_pairs").alias("iv_pairs"), (mean("far") - mean("near")).alias("term_slope_proxy"), F.min_by("_fly", middle).alias("butterfly_proxy"), *[f(c).alias(c) for c, f in also.items()])
    return out.withColumns({"atm_iv_proxy": F.col("atm.iv"), "skew_proxy": F.col("atm.pi") - F.col("atm.ci"), "straddle_premium_to_spot": (F.col("atm.cp") + F.col("atm.pp")) / F.col("atm.spot")}).drop("atm")


def missing_rate(pairs: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.least(pairs, F.lit(10)) / 10.0)


def daily_surface(options: DataFrame, keys: Sequence[str], spot: str = "spot", days_to_event: str | None = None, volatility: Column | None = None) -> DataFrame:
    """Per key (an event and a day) the surface of its options' closes: the four strikes nearest the spot of each expiry and right.

    ``options``: keys, expiration, strike, right, dte, option_close, option_volume, option_transactions and spot. Volumes
    and pairs count all options from 3 to 45 days; a day without a pair is wholly missing and not valid.
    """
    frame = options.where(F.col("dte").between(*DTE_RANGE) & (number(spot) > 0))
    v = lambda r=None: F.sum(F.when(F.lower("right") == r, F.coalesce(number("option_volume"), F.lit(0.0))) if r else F.coalesce(number("option_volume"), F.lit(0.0)))
    # all that is compared lies inside a key: rows are shuffled once, volatilities are found once, and strikes are written down
    n = F.row_number().over(Window.partitionBy(*keys, "expiration", "right").orderBy(F.abs(F.col("strike") / F.col(spot) - 1), "strike"))
    rows = frame.repartition(*keys).withColumn("_n", n)
    chosen = F.col("_n") <= STRIKES
    rows = with_iv(rows.withColumn("_price", F.when(chosen, F.col("option_close"))), "_price", spot, volatility)
    cells = rows.groupBy(*keys, "expiration", "strike").agg(F.coalesce(F.min("right") < F.max("right"), F.lit(False)).alias("pair"), v().alias("v"), F.coalesce(v("call"), F.lit(0.0)).alias("c"), F.coalesce(v("put"), F.lit(0.0)).alias("p"), F.sum(F.coalesce(number("option_transactions"), F.lit(0.0))).alias("t"), *_strike_sums("_price", spot))
    cells = materialise(cells, "surface-strikes")
    sums = cells.groupBy(*keys).agg(F.count_if("pair").alias("valid_pair_count"), F.sum("v").alias("option_volume_sum"), F.sum("t").alias("option_transactions_sum"), ((F.sum("c") - F.sum("p")) / F.nullif(F.sum("c") + F.sum("p"), F.lit(0.0))).alias("call_put_volume_imbalance"), F.max(F.when(F.col("n") > 0, F.lit(True))).alias("_any"))
    shape = _shape_of_pairs(cells.where("ci IS NOT NULL AND pi IS NOT NULL"), keys)
    out = sums.join(shape.hint("merge"), list(keys), "left").withColumnsRenamed({"skew_proxy": "iv_skew_proxy", "butterfly_proxy": "iv_butterfly_proxy"})
    rate = F.when((F.col("valid_pair_count") == 0) | F.col("_any").isNull(), 1.0).otherwise(missing_rate(F.col("valid_pair_count")))
    out = out.withColumns({"surface_missing_rate": rate, "is_valid_sequence_day": (F.col("valid_pair_count") > 0) & F.col("atm_iv_proxy").isNotNull()})
    if days_to_event:
        days = options.groupBy(*keys).agg(F.max(F.greatest(F.col(days_to_event), F.lit(1))).alias("_days"))
        out = out.join(days, list(keys)).withColumn("event_ivar_proxy", F.pow(F.greatest("atm_iv_proxy", F.lit(0.0)), F.lit(2.0)) * F.col("_days") / 365.0).drop("_days")
        out = out.withColumn("event_ivar_proxy", F.when(F.col("atm_iv_proxy").isNotNull(), F.col("event_ivar_proxy")))
    return out.drop("_any", "iv_pairs")


def intraday_surface(bars: DataFrame, contracts: DataFrame, events: DataFrame, event: str = "event_id", contract: str = "options_ticker", ts: str = "ts", cutoff: str = "event_entry_timestamp", spot: str = "s_before") -> DataFrame:
    """Per event and five-minute bin of its last hour the surface of the last bar of each contract within 5 % of the spot; a bar on an edge is in both bins.

    Bins without a bar have a row: nothing valid, all missing. ``contracts``: event, contract, expiration, strike, right, dte.
    Bars are dealt out once, by contract, and meet the contract's distinct entry instants (few, as a contract lives for some weeks). Only
    the last bars go on; they are dealt out once, by event, and all the rest is done there.
    """
    asked = events.where(F.col(cutoff).isNotNull()).select(event, F.col(spot).alias("spot"), F.col(cutoff).alias("_cut"))
    near = (F.abs(F.col("strike") / F.col("spot") - 1) <= MOST_MONEYNESS) & (F.col("spot") > 0)
    # both sides of these joins grow with the events: none is broadcast
    each = materialise(contracts.select(event, contract, "expiration", "strike", "right", "dte").hint("merge").join(asked, event).where(near), "intraday-asked")
    width = BIN_MINUTES * 60_000_000
    trades = bars.select(contract, F.col(ts).alias("_at"), number("option_vwap").alias("price"), "volume", "transactions")
    left = F.unix_micros("_cut") - F.unix_micros("_at")
    met = trades.join(each.select(contract, "_cut").distinct().hint("shuffle_hash"), contract).where(left.between(0, BINS * width))
    # the latest of a contract; of bars at one instant the one with the highest price
    last = lambda i: F.max(F.when(left.between((BINS - 1 - i) * width, (BINS - i) * width), F.struct("_at", "price", "volume", "transactions")))
    lasts = met.groupBy(contract, "_cut").agg(F.array(*[last(i) for i in range(BINS)]).alias("_bars")).withColumnRenamed("_cut", "_till")
    # instants are compared as a difference, as the contract alone is what both sides are dealt out by
    rows = lasts.join(each.hint("shuffle_hash"), contract).where(F.unix_micros("_till") - F.unix_micros("_cut") == 0)
    rows = rows.select(event, "_cut", "expiration", "strike", "right", "dte", "spot", F.posexplode("_bars").alias("bin", "_bar")).select("*", "_bar.*").drop("_bar")
    rows = with_iv(rows.where("price > 0"), "price", "spot").where("iv_proxy IS NOT NULL")
    # an event itself is a row too, without a strike and in no bin
    rows = rows.unionByName(asked.select(event, "_cut"), allowMissingColumns=True).repartition(parts_for(each.sparkSession, each.count() * BINS, PART_ROWS), event)
    keys = [event, "bin"]
    sums = {"option_volume_sum": number("volume"), "option_transactions_sum": number("transactions")}
    cells = rows.groupBy(*keys, "expiration", "strike").agg(*_strike_sums("price", "spot"), *[F.sum(c).alias(n) for n, c in sums.items()], F.max("_at").alias("_at"), F.max("_cut").alias("_cut"))
    found = _shape_of_pairs(cells, keys, {n: F.sum for n in sums} | {"_at": F.max, "_cut": F.max})
    # each row, and the bins after it up to the next that has one
    after = F.coalesce(F.lead("bin").over(Window.partitionBy(event).orderBy("bin")), F.lit(BINS))
    every = found.withColumn("_next", after).select("*", F.explode(F.sequence(F.coalesce("bin", F.lit(-1)), F.col("_next") - 1)).alias("_bin")).where("_bin >= 0")
    own = {c: F.when(F.col("_bin") == F.col("bin"), F.col(c)) for c in found.columns if c not in (*keys, "_cut")}
    end = F.col("_cut") - F.make_dt_interval(F.lit(0), F.lit(0), BIN_MINUTES * (BINS - 1 - F.col("_bin")))
    out = every.withColumns({**own, "end_ts": end}).select(event, F.col("_bin").alias("bin"), "end_ts", *own).withColumnRenamed("iv_pairs", "valid_pair_count")
    out = out.withColumn("valid_pair_count", F.coalesce("valid_pair_count", F.lit(0)))
    rate = F.when(F.col("valid_pair_count") == 0, 1.0).otherwise(missing_rate(F.col("valid_pair_count")))
    has = F.col("valid_pair_count") > 0
    age = (F.unix_micros("end_ts") - F.unix_micros("_at")) / 1e6
    return out.withColumns({"surface_missing_rate": rate, "event_ivar_proxy": F.when(has, F.pow("atm_iv_proxy", F.lit(2.0)) / 365.0), "hybrid_valid_step": has & F.col("atm_iv_proxy").isNotNull(), "latest_option_trade_bar_age_seconds": F.when(has, age)}).drop("_at")


def index_candidates(options: DataFrame, keys: Sequence[str], spot: str = "spot", targets: Sequence[int] = (7, 14, 30), strikes: int = STRIKES) -> DataFrame:
    """Per key (a symbol and a day) the options at the few strikes nearest the spot, with a call and a put, of the expiries nearest 7, 14 and 30 days."""
    frame = options.where(F.col("dte").between(*DTE_RANGE) & (number("option_close") > 0) & (number(spot) > 0))
    for k in (*keys, "expiration", "strike"):
        frame = frame.where(F.col(k).isNotNull())
    # rows are shuffled once, by key; all that is compared lies inside a key
    day, chain, one = Window.partitionBy(*keys), Window.partitionBy(*keys, "expiration"), Window.partitionBy(*keys, "expiration", "strike")
    nearest = [F.min(F.struct(F.abs(F.col("dte") - t), "dte", "expiration")).over(day)["expiration"] for t in targets]
    wanted = frame.withColumn("_wanted", F.array(*nearest)).where(F.array_contains("_wanted", F.col("expiration"))).drop("_wanted")
    sides = wanted.withColumns({"_low": F.min("right").over(one), "_high": F.max("right").over(one), "_s": F.min(spot).over(one)}).where("_low < _high")
    n = F.dense_rank().over(chain.orderBy(F.abs(F.col("strike") - F.col("_s")), "strike"))
    return sides.withColumn("_n", n).where(F.col("_n") <= strikes).drop("_low", "_high", "_s", "_n")


def index_surface(priced: DataFrame, candidates: DataFrame, keys: Sequence[str], price: str = "vwap", spot: str = "spot", volatility: Column | None = None) -> DataFrame:
    """Per key the surface of the priced candidates, and how many candidates and prices there were."""
    rows = with_iv(priced.where(F.col(price).isNotNull()), price, spot, volatility)
    counted = candidates.groupBy(*keys).agg(F.count("*").alias("candidate_contracts"))
    got = {"priced_contracts": F.count("*"), "option_volume_sum": F.sum(number("volume"))}
    cells = rows.where("iv_proxy IS NOT NULL").groupBy(*keys, "expiration", "strike").agg(*_strike_sums(price, spot), *[c.alias(n) for n, c in got.items()])
    out = counted.join(_shape_of_pairs(cells, keys, {n: F.sum for n in got}), list(keys), "left").withColumnRenamed("iv_pairs", "valid_pair_count")
    most = F.greatest(F.col("candidate_contracts") / 2.0, F.lit(1.0))
    pairs = F.coalesce("valid_pair_count", F.lit(0))
    return out.withColumns({"valid_pair_count": pairs, "priced_contracts": F.coalesce("priced_contracts", F.lit(0)), "surface_missing_rate": 1 - F.least(pairs.cast("double"), most) / most, "status": F.when(pairs > 0, "ok").otherwise("no_prices")})


def prefixed_by_symbol(features: DataFrame, key: str, symbol: str, symbols: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per key with each symbol's features side by side: spy_second_<name>, qqq_second_<name>."""
    pick = lambda s, v: F.max(F.when(F.upper(symbol) == s, F.col(v))).alias(f"{s.lower()}_second_{v}")
    return features.groupBy(key).agg(*[pick(s, v) for s in symbols for v in values])


def same_day_returns(bars: DataFrame, date: str, ticker: str, ret: str, symbols: Sequence[str] = ("SPY", "QQQ")) -> DataFrame:
    """Adds the day's return of each index as <symbol>_return_1d (a few columns a day, one row a date)."""
    pick = lambda s: F.max(F.when(F.upper(F.col(ticker).cast("string")) == s, F.col(ret))).alias(f"{s.lower()}_return_1d")
    wide = bars.where(F.upper(F.col(ticker).cast("string")).isin(*symbols)).groupBy(date).agg(*[pick(s) for s in symbols])
    return bars.join(wide, date, "left")


def sequence_long(plan: DataFrame, parts: Sequence[DataFrame], on: Sequence[Sequence[str]]) -> DataFrame:
    """The plan's steps with what each part knows of them; steps that a part lacks have nulls there."""
    out = plan
    for part, keys in zip(parts, on):
        out = out.join(part, list(keys), "left")
    return out.withColumn("is_valid_sequence_day", F.coalesce("is_valid_sequence_day", F.lit(False)))


def level_as_of(levels: DataFrame, most_days: int = 5) -> DataFrame:
    """date, level, level_date: for every day the level of the latest earlier one, not older than ``most_days``. ``levels``: date, level; one row a day."""
    w = Window.orderBy("date")  # days of a calendar
    until = F.least(F.date_add("date", most_days), F.coalesce(F.lead("date").over(w), F.date_add("date", most_days)))
    known = levels.where("level IS NOT NULL AND date IS NOT NULL").select("date", "level", until.alias("_until"))
    return known.select(F.explode(F.sequence(F.date_add("date", 1), "_until")).alias("day"), "level", F.col("date").alias("level_date")).withColumnRenamed("day", "date")


def surface_sequence_long(plan: DataFrame, options: DataFrame, bars: DataFrame, levels: DataFrame, ticker: str = "ticker", date: str = "source_date", volatility: Column | None = None) -> DataFrame:
    """Every step of every event's plan with its ticker's option surface of that day, the day's return and rolling variance (ret, rv5), and
    the index level of the latest day before it (at most five days back).

    ``plan``: event_id, ticker, seq_index, source_date. ``options``: ticker, date, expiration, strike, right, dte, option_close, option_volume,
    option_transactions, spot. ``bars``: ticker, date, close. ``levels``: date, level. Surfaces and variances are made once for a
    ticker and day, however many events' plans hold it, and meet on that key; steps are shuffled once.
    """
    keys = [ticker, "date"]
    surfaces = daily_surface(options, keys, volatility=volatility)
    returns = rolling_variance(bars.select(*keys, "close"), ticker, "date", "close").select(*keys, "ret", F.col("rv").alias("rv5"))
    days = surfaces.join(returns, keys, "full").withColumnRenamed("date", date)
    steps = sequence_long(plan, [days], [[ticker, date]])
    return steps.join(F.broadcast(level_as_of(levels).withColumnRenamed("date", date)), date, "left")  # five rows a day of the calendar at most


def hybrid_daily(daily: DataFrame, event: str = "event_id", date: str = "source_date", entry: str = "entry_date", steps: int = DAILY_STEPS) -> DataFrame:
    """The last 19 daily steps before the entry date, right-aligned in seq_index, stamped at 16:00 New York time."""
    before = daily.where(F.col(date) < F.col(entry))
    n = F.row_number().over(Window.partitionBy(event).orderBy(F.desc(date)))
    out = before.withColumn("_n", n).where(F.col("_n") <= steps).withColumn("seq_index", F.lit(steps) - F.col("_n")).drop("_n")
    stamp = F.to_utc_timestamp(F.col(date).cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(16)), "America/New_York")
    return out.withColumns({"source_timestamp": stamp, "step_type": F.lit("daily"), "hybrid_valid_step": F.col("is_valid_sequence_day"), "iv_extraction_source": F.lit("daily_close_trade")})


def hybrid_sequence(daily: DataFrame, intraday: DataFrame, event: str = "event_id", entry_ts: str = "event_entry_timestamp") -> DataFrame:
    """Daily steps followed by the bins of the last hour, with time since the step before and time to the entry."""
    bins = intraday.withColumns({"seq_index": F.col("bin") + DAILY_STEPS, "source_timestamp": F.col("end_ts"), "step_type": F.lit("intraday"), "iv_extraction_source": F.lit("intraday_5min_last_trade")}).drop("bin", "end_ts")
    return time_features(daily.unionByName(bins, allowMissingColumns=True), event, entry_ts)


def time_features(steps: DataFrame, event: str, entry_ts: str, ts: str = "source_timestamp", order: str = "seq_index") -> DataFrame:
    """Adds the logarithm of minutes since the step before (a day for the first, a minute at least) and the time to entry in units of 20 days."""
    minutes = lambda a, b: (F.unix_micros(a) - F.unix_micros(b)) / 60e6
    since = minutes(F.col(ts), F.lag(ts).over(Window.partitionBy(event).orderBy(order)))
    return steps.withColumns({"log_delta_minutes_from_prev_step": F.log1p(F.greatest(F.coalesce(since, F.lit(1440.0)), F.lit(1.0))), "normalized_time_to_entry": minutes(F.col(ts), F.col(entry_ts)) / (20 * 24 * 60)})


def hybrid_coverage(steps: DataFrame, features: Sequence[str], event: str = "event_id") -> DataFrame:
    """Per event: steps, valid bins, whether the last bin is valid, the share of numbers that are there, and whether all that suffices."""
    bin_ = F.col("step_type") == "intraday"
    there = sum((number(f).isNotNull().cast("int") for f in features[1:]), number(features[0]).isNotNull().cast("int"))
    out = steps.groupBy(event).agg(
        F.count("*").alias("hybrid_steps"), F.count_if(bin_ & F.coalesce("hybrid_valid_step", F.lit(False))).alias("intraday_valid_bin_count"),
        F.coalesce(F.max_by("hybrid_valid_step", F.when(bin_, F.col("seq_index"))), F.lit(False)).alias("latest_5min_valid_surface"), (F.sum(there) / (F.count("*") * len(features))).alias("hybrid_feature_mask_density"),
    )
    return out.withColumn("hybrid_sequence_eligible", (F.col("intraday_valid_bin_count") >= 8) & (F.col("hybrid_feature_mask_density") >= 0.5))


def hybrid_report(coverage: DataFrame, total_events: int) -> DataFrame:
    """One row: events with 8 valid bins, the median density, and whether sequences are too sparse to use."""
    one = coverage.agg(F.count_if(F.col("intraday_valid_bin_count") >= 8).alias("events_with_8_valid_bins"), F.coalesce(F.percentile("hybrid_feature_mask_density", F.lit(0.5)), F.lit(0.0)).alias("median_density"))
    return one.withColumns({"total_events": F.lit(total_events).cast("long"), "too_sparse": (F.col("events_with_8_valid_bins") < -(-7 * max(1, total_events) // 10)) | (F.col("median_density") < 0.5)})


def distribution_audit(steps: DataFrame, source: str, metrics: Sequence[str]) -> DataFrame:
    """Per source and metric: n, mean, population deviation, three percentiles and the share missing."""
    held = materialise(steps.select(source, *[number(m).alias(m) for m in metrics]), "audited")  # read by every pass of the quantiles
    long = held.unpivot([source], list(metrics), "metric", "value")
    keys = [source, "metric"]
    one = long.groupBy(*keys).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.avg(F.col("value").isNull().cast("int")).alias("missing_rate"))
    cuts = column_quantiles(held, metrics, [source], {"p01": 0.01, "p50": 0.5, "p99": 0.99}).withColumnRenamed("feature", "metric")
    return one.alias("l").join(cuts.alias("r"), F.col(f"l.{source}").eqNullSafe(F.col(f"r.{source}")) & (F.col("l.metric") == F.col("r.metric")), "left").select("l.*", "r.p01", "r.p50", "r.p99")


def _slope(value: Column, x: Column) -> Column:
    """Least-squares slope of the values that are there; one value has none."""
    return F.regr_slope(value, x)


def flat_aggregates(steps: DataFrame, event: str, branch: str, feature: str, order: str = "seq_index") -> DataFrame:
    """Per event and branch (daily, intraday) of one feature: mean, std, min, max, last, and slope over the observed values' own positions."""
    seen = steps.select(event, branch, order, number(feature).alias("v")).where("v IS NOT NULL")
    x = F.row_number().over(Window.partitionBy(event, branch).orderBy(order)).cast("double")
    return seen.withColumn("x", x).groupBy(event, branch).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"), F.max_by("v", "x").alias("last_value"), F.coalesce(_slope(F.col("v"), F.col("x")), F.lit(0.0)).alias("simple_slope"))


def runup_features(steps: DataFrame, event: str, features: Sequence[str] = RUNUP, windows: Sequence[int] = (1, 3, 5, 10), volumes: Sequence[str] = ("option_volume_sum", "option_transactions_sum"), order: str = "seq_index") -> DataFrame:
    """Per event, feature and window of last steps: mean, change, slope and (volumes) how far above the mean of the steps before, in long form."""
    back = F.row_number().over(Window.partitionBy(event).orderBy(F.desc(order)))
    placed = steps.select(event, back.alias("back"), *[number(f).alias(f) for f in features])
    long = placed.unpivot([event, "back"], list(features), "feature", "v").where("v IS NOT NULL")
    each = long.select("*", F.explode(F.array(*[F.lit(w) for w in windows])).alias("window"))
    tail = each.where(F.col("back") <= F.col("window"))
    x = F.row_number().over(Window.partitionBy(event, "feature", "window").orderBy(F.desc("back"))).cast("double")
    keys = [event, "feature", "window"]
    some = F.count("*") > 1
    out = tail.withColumn("x", x).groupBy(*keys).agg(F.avg("v").alias("mean"), F.when(some, F.max_by("v", "x") - F.min_by("v", "x")).alias("delta"), F.when(some, _slope(F.col("v"), F.col("x"))).alias("slope"))
    earlier = each.where((F.col("back") > F.col("window")) & F.col("feature").isin(*volumes)).groupBy(*keys).agg(F.avg("v").alias("_prior"))
    return out.join(earlier, keys, "left").withColumn("abnormal", ratio(F.col("mean"), F.col("_prior")) - 1).drop("_prior")


def latest_shape(steps: DataFrame, event: str, order: str = "seq_index", floor: float = 1e-6) -> DataFrame:
    """Per event of its last step: coverage, slope and curvature of the surface, and both over the at-the-money volatility."""
    last = steps.groupBy(event).agg(F.max_by(F.struct(number("atm_iv_proxy").alias("atm"), number("iv_skew_proxy").alias("skew"), number("iv_butterfly_proxy").alias("fly"), number("surface_missing_rate").alias("missing")), order).alias("s"))
    base = F.when(F.col("s.atm").isNotNull(), F.greatest(F.abs("s.atm"), F.lit(floor)))
    return last.select(event, (1 - F.col("s.missing")).alias("grid_coverage"), F.col("s.skew").alias("left_right_slope"), F.col("s.fly").alias("curvature"), (F.col("s.skew") / base).alias("tail_asymmetry"), (F.col("s.fly") / base).alias("concavity"))


def underlying_runup(steps: DataFrame, event: str, ret: str = "underlying_return_1d", rv: str = "rv5", order: str = "seq_index") -> DataFrame:
    """Per event the compounded return of its last 5 and 10 known days, the last realised variance and the mean of its last 5."""
    def tail(c: str, name: str) -> DataFrame:
        back = F.row_number().over(Window.partitionBy(event).orderBy(F.desc(order)))
        return steps.select(event, order, number(c).alias(name)).where(F.col(name).isNotNull()).withColumn("_back", back).where("_back <= 10")

    # signs apart, as a return below -1 has no logarithm
    def compounded(k: int) -> Column:
        inside = F.when(F.col("_back") <= k, 1 + F.col("r"))
        size = F.exp(F.sum(F.ln(F.abs(F.nullif(inside, F.lit(0.0))))))
        odd = F.sum((inside < 0).cast("int")) % 2 == 1
        return F.when(F.count_if(inside == 0) > 0, F.lit(-1.0)).otherwise(F.when(odd, -size).otherwise(size) - 1)

    r = tail(ret, "r").groupBy(event).agg(compounded(5).alias("return_5d"), compounded(10).alias("return_10d"))
    v = tail(rv, "v").groupBy(event).agg(F.min_by("v", "_back").alias("rv5_last"), F.avg(F.when(F.col("_back") <= 5, F.col("v"))).alias("rv5_mean_5d"))
    return steps.select(event).distinct().join(r, event, "left").join(v, event, "left")


def sequence_matrix(steps: DataFrame, event: str, features: Sequence[str], step: str = "seq_index", length: int = 20) -> DataFrame:
    """One row per event with seq_t00_<feature> … (the mean where a step repeats); steps are given, so no pass looks for them."""
    pick = lambda i, f: F.avg(F.when(F.col(step) == i, number(f))).alias(f"seq_t{i:02d}_{f}")
    # narrow rows are shuffled and summed where they arrive: sums made before would be a row of all columns for each step
    return steps.select(event, step, *features).repartition(event).groupBy(event).agg(*[pick(i, f) for f in features for i in range(length)])


def sequence_arrays(matrix: DataFrame, event: str, features: Sequence[str], length: int = 20) -> DataFrame:
    """The matrix as one array of steps (each an array of features) and one of masks."""
    cell = lambda i, f: F.col(f"seq_t{i:02d}_{f}")
    x = F.array(*[F.array(*[cell(i, f) for f in features]) for i in range(length)])
    return matrix.select(event, x.alias("x"), F.transform(x, lambda row: F.transform(row, lambda v: v.isNotNull())).alias("mask"))


LOGGED = ("volume", "count", "age", "transactions")


def robust_scaled(steps: DataFrame, features: Sequence[str], step_type: str = "step_type", split: str = "split") -> DataFrame:
    """Features less their median over their interquartile range, both of train rows of the step's type; missing becomes 0, in <feature>_mask false.

    Volumes, counts, ages and transactions are taken as logarithms first. A range of nothing divides by 1.
    """
    out = steps
    for f in features:
        v = number(f)
        out = out.withColumn(f, F.when(v.isNotNull(), F.log1p(F.greatest(v, F.lit(0.0)))) if any(x in f for x in LOGGED) else v)
    out = materialise(out, "scaled-steps")  # read by every pass of the quantiles and again with them
    cuts = column_quantiles(out.where(F.col(split) == "train"), list(features), [step_type], {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    pick = lambda f, c: F.max(F.when(F.col("feature") == f, F.col(c))).alias(f"_{c}_{f}")
    wide = F.broadcast(cuts.groupBy(step_type).agg(*[pick(f, c) for f in features for c in ("q1", "q2", "q3")]))  # a row for each step type
    out = out.join(wide, step_type, "left")
    spread = lambda f: F.when(F.abs(F.col(f"_q3_{f}") - F.col(f"_q1_{f}")) > 1e-12, F.col(f"_q3_{f}") - F.col(f"_q1_{f}")).otherwise(1.0)
    scaled = {f: F.coalesce((F.col(f) - F.coalesce(F.col(f"_q2_{f}"), F.lit(0.0))) / spread(f), F.lit(0.0)) for f in features}
    masks = {f"{f}_mask": F.col(f).isNotNull() for f in features}
    return out.withColumns(scaled | masks).drop(*[f"_{c}_{f}" for f in features for c in ("q1", "q2", "q3")])


def sequence_tensor(scaled: DataFrame, event: str, features: Sequence[str], length: int, order: str = "seq_index") -> DataFrame:
    """Per event ``length`` steps in order: x (an array of features each), mask alike, and step types; absent steps are 0 and not observed."""
    item = F.struct(F.col(order).cast("int").alias("at"), F.array(*features).alias("x"), F.array(*[f"{f}_mask" for f in features]).alias("m"), F.col("step_type").alias("t"))
    held = scaled.where(F.col(order).between(0, length - 1)).groupBy(event).agg(F.map_from_entries(F.collect_list(F.struct(F.col(order).cast("int"), item))).alias("s"))
    none = {"x": F.array(*[F.lit(0.0)] * len(features)), "m": F.array(*[F.lit(False)] * len(features)), "t": F.lit(None).cast("string")}
    every = lambda name: F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.coalesce(F.col("s")[i][name], none[name]))
    return held.select(event, every("x").alias("x"), every("m").alias("mask"), every("t").alias("step_types"))


def sequence_quality(tensor: DataFrame, event: str) -> DataFrame:
    """Per event: observed steps in all, daily and in the last hour, the share of numbers missing, and whether that is good enough."""
    steps = F.zip_with("mask", "step_types", lambda m, t: F.struct(F.exists(m, lambda v: v).alias("seen"), t.alias("t")))
    n = lambda *kind: F.size(F.filter(steps, lambda s: s["seen"] & (F.coalesce(s["t"], F.lit("")) == kind[0] if kind else F.lit(True))))
    cells = F.flatten("mask")
    out = tensor.select(event, n().alias("valid_len"), n("daily").alias("daily_valid_len"), n("intraday").alias("intraday_valid_len"), (F.size(F.filter(cells, lambda v: ~v)) / F.size(cells)).alias("missing_rate"))
    good = (F.col("intraday_valid_len") >= 8) & (F.col("missing_rate") <= 0.5)
    return out.withColumns({"high_quality_sequence": good, "sequence_gate_reason": F.when(good, "eligible").otherwise("low_quality_or_sparse")})
