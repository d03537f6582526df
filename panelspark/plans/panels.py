"""Queries on panels: universes, as-of joins, targets, histories, splits and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.texts import WHITE
from panelspark.operators import asof, calendar, comparison, features, filings, metrics, options, panel, quality, quotes, ranks, strategy, variance
from panelspark.plans.common import BARS, DAYS, EV, LIQ, TICKS, UNI, bars, day_bars, load, order_events, query, rounded, ticks
from panelspark.sources import tables


def liquidity(spark, sf):
    return panel.month_liquidity(bars(spark, sf), "ticker", "date", F.col("price"), F.col("volume"))


def universe(spark, sf):
    return panel.trailing_universe(liquidity(spark, sf), 6, 50)


@query(f"WITH {BARS}, {LIQ} SELECT month, ticker, round(liquidity, 2) AS liquidity, row_count FROM liq")
def ticker_month_liquidity(spark, sf):
    return rounded(liquidity(spark, sf), 2)


@query(f"WITH {BARS}, {UNI} SELECT universe_month, ticker, round(trailing_liquidity, 2) AS trailing_liquidity, rank FROM top")
def monthly_top_universe(spark, sf):
    return rounded(universe(spark, sf), 2)


@query(f"WITH {BARS}, {UNI}, {EV} SELECT event_id, ev.ticker, event_date, arg_max(rank, universe_month) AS universe_rank, max(universe_month) AS universe_month, CASE WHEN max(universe_month) IS NULL THEN 'no_universe_membership' ELSE 'in_universe' END AS universe_filter_status FROM ev LEFT JOIN top ON top.ticker = ev.ticker AND universe_month <= date_trunc('month', event_date) GROUP BY 1, 2, 3")
def universe_membership_asof(spark, sf):
    e = order_events(spark, sf).select("event_id", "ticker", "event_date")
    return rounded(panel.universe_membership(e, universe(spark, sf), "ticker", "event_date"))


@query(f"WITH {DAYS}, {EV}, m AS (SELECT event_id, ev.ticker, event_date, arg_max(close, date) AS close, max(date) AS d FROM ev LEFT JOIN days ON days.ticker = ev.ticker AND date < event_date GROUP BY 1, 2, 3) SELECT event_id, ticker, event_date, CASE WHEN event_date - d <= 5 THEN round(close, 7) END AS close, CASE WHEN event_date - d <= 5 THEN d END AS matched_date FROM m")
def prior_close_asof_lag5(spark, sf):
    e = order_events(spark, sf).select("event_id", "ticker", "event_date")
    return rounded(asof.asof_backward(e, day_bars(spark, sf), ["ticker"], "event_date", "date", ["close"], strict=True, max_lag_days=5), 7)


GATE = """m AS (SELECT event_id, ev.ticker, event_date, price, date, row_number() OVER (PARTITION BY event_id ORDER BY date DESC, orderkey DESC, line DESC, price DESC) AS n
 FROM ev JOIN bars ON bars.ticker = ev.ticker AND ((line % 2 = 0 AND date <= event_date) OR (line % 2 = 1 AND date < event_date)))"""


@query(f"WITH {BARS}, {EV}, {GATE} SELECT ev.event_id, ev.ticker, ev.event_date, round(max(price) FILTER (n = 1), 7) AS latest, round(max(price) FILTER (n = 2), 7) AS previous, max(date) FILTER (n = 1) AS known_date FROM ev LEFT JOIN m USING (event_id) GROUP BY 1, 2, 3")
def two_tier_asof_gate(spark, sf):
    """Lines of even number are accepted at midnight of their day, the others only filed on it."""
    e = order_events(spark, sf).select("event_id", "ticker", "event_date").withColumn("at", F.col("event_date").cast("timestamp"))
    b = bars(spark, sf).select("ticker", "price", "orderkey", "line", F.when(F.col("line") % 2 == 0, F.col("date").cast("timestamp")).alias("accepted"), F.col("date").alias("filed"))
    out = asof.gated_latest(e, b, ["ticker"], "at", "accepted", "filed", ["orderkey", "line"], "price")
    return rounded(out.select("event_id", "ticker", "event_date", "latest", "previous", F.to_date("known_at").alias("known_date")), 7)


def requests(spark, sf):
    """Two windows for every purchase: the 15 minutes before it and the hour after it."""
    e = ticks(spark, sf).where("event_type = 'purchase'").select("event_id", "contract", "ts")
    m = lambda n: F.expr(f"make_dt_interval(0, 0, {n}, 0)")
    return asof.window_requests(e, "event_id", {"entry": (F.col("ts") - m(900), F.col("ts")), "exit": (F.col("ts"), F.col("ts") + m(1440))}, ["contract"])


REQ = TICKS + ", req AS (SELECT event_id, contract, w.n AS \"window\", w.a AS start_ts, w.b AS end_ts FROM (SELECT event_id, contract, unnest([{'n': 'entry', 'a': ts - INTERVAL 900 MINUTE, 'b': ts}, {'n': 'exit', 'a': ts, 'b': ts + INTERVAL 1440 MINUTE}]) AS w FROM ticks WHERE event_type = 'purchase'))"
MARKS = REQ + """, mk AS (SELECT r.event_id, r."window", count(t.ts) AS tick_count, count(*) FILTER (t.value > 20) AS valid_count, arg_max(t.value, {'t': t.ts, 'e': t.event_id}) FILTER (t.value > 20) AS mark, max(t.ts) FILTER (t.value > 20) AS mark_ts, any_value(r.end_ts) AS end_ts
 FROM req r LEFT JOIN ticks t ON t.contract = r.contract AND t.ts BETWEEN r.start_ts AND r.end_ts GROUP BY 1, 2),
 ms AS (SELECT *, epoch(date_trunc('second', end_ts))::BIGINT - epoch(date_trunc('second', mark_ts))::BIGINT AS age_seconds FROM mk), mm AS (SELECT *, CASE WHEN tick_count = 0 THEN 'missing' WHEN valid_count = 0 THEN 'invalid' WHEN age_seconds > 36000 THEN 'stale' ELSE 'ok' END AS status FROM ms)"""


def latest_marks(spark, sf):
    return asof.interval_latest(ticks(spark, sf).withColumnRenamed("event_id", "tick_id"), requests(spark, sf), ["contract"], "ts", "value", F.col("value") > 20, ["event_id", "window"], "tick_id", 36000)


@query(f"WITH {MARKS} SELECT event_id, \"window\", tick_count, valid_count, round(mark, 4) AS mark, age_seconds, status FROM mm")
def window_latest_mark(spark, sf):
    return rounded(latest_marks(spark, sf).select("event_id", "window", "tick_count", "valid_count", "mark", "age_seconds", "status"))


@query(f"WITH {MARKS}, s AS (SELECT event_id, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'stale') AS stale, max(age_seconds) AS max_age, quantile_cont(mark, 0.5) AS median_mark, avg(CASE status WHEN 'ok' THEN 1.0 WHEN 'stale' THEN 0.5 ELSE 0 END) AS score FROM mm GROUP BY 1) SELECT event_id, ok, stale, max_age, round(median_mark, 4) AS median_mark, score::DOUBLE AS score, CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.5 THEN 'medium' WHEN score > 0 THEN 'low' ELSE 'missing' END AS band FROM s")
def mark_confidence_band(spark, sf):
    s = F.when(F.col("status") == "ok", 1.0).when(F.col("status") == "stale", 0.5).otherwise(0.0)
    out = latest_marks(spark, sf).groupBy("event_id").agg(F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "stale").alias("stale"), F.max("age_seconds").alias("max_age"), F.percentile("mark", F.lit(0.5)).alias("median_mark"), F.avg(s).alias("score"))
    return rounded(out.withColumn("band", quotes.band(F.col("score"))))


@query(f"WITH {REQ} SELECT r.event_id, r.\"window\", round(sum(value * volume) / sum(volume), 7) AS vwap, coalesce(sum(volume), 0)::BIGINT AS volume, count(t.ts) AS rows, CASE WHEN count(t.ts) > 0 THEN 'ok' ELSE 'no_trade_in_cutoff_window' END AS status FROM req r LEFT JOIN ticks t ON t.contract = r.contract AND t.ts BETWEEN r.start_ts AND r.end_ts AND value > 0 AND volume > 0 GROUP BY 1, 2")
def window_vwap(spark, sf):
    t = ticks(spark, sf).withColumnRenamed("event_id", "tick_id")
    return rounded(asof.interval_vwap(t, requests(spark, sf), ["contract"], "ts", "value", "volume", ["event_id", "window"]).select("event_id", "window", "vwap", "volume", "rows", "status"), 7)


def span_calendar(spark, sf):
    a, b = order_events(spark, sf).agg(F.min("event_date"), F.max("event_date")).head()
    return calendar.trading_days(spark, f"{a.year - 1}-01-01", f"{b.year + 1}-12-31")


# the calendar's rules once more, with DuckDB's date functions (its week days count from Sunday 0)
CALENDAR = """span AS (SELECT make_date(year(min(o_orderdate)) - 1, 1, 1) AS a, make_date(year(max(o_orderdate)) + 1, 12, 31) AS b FROM orders),
yrs AS (SELECT y FROM span, range(year(a), year(b) + 1) t(y)),
fixed AS (SELECT y, m, make_date(y, m, d) AS day FROM yrs, (VALUES (1, 1, 0), (6, 19, 2022), (7, 4, 0), (12, 25, 0)) f(m, d, since) WHERE y >= since),
nth AS (SELECT make_date(y, m, 1) + ((w - dayofweek(make_date(y, m, 1)) + 7) % 7 + 7 * (n - 1))::INT AS h FROM yrs, (VALUES (1, 1, 3), (2, 1, 3), (9, 1, 1), (11, 4, 4)) f(m, w, n)),
e1 AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM yrs), e2 AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM e1),
e3 AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM e2), e4 AS (SELECT *, (a + 11 * h + 22 * l) // 451 AS m FROM e3),
hol AS (SELECT CASE WHEN dayofweek(day) = 0 THEN day + 1 WHEN dayofweek(day) = 6 AND m <> 1 THEN day - 1 ELSE day END AS h FROM fixed UNION SELECT h FROM nth
 UNION SELECT make_date(y, 5, 31) - ((dayofweek(make_date(y, 5, 31)) + 6) % 7)::INT FROM yrs UNION SELECT make_date(y, (h + l - 7 * m + 114) // 31, (h + l - 7 * m + 114) % 31 + 1) - 2 FROM e4
 UNION SELECT unnest([DATE '2018-12-05', DATE '2025-01-09', DATE '2012-10-29', DATE '2012-10-30'])),
alld AS (SELECT unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS date FROM span),
opens AS (SELECT date, date NOT IN (SELECT h FROM hol WHERE h IS NOT NULL) AND dayofweek(date) BETWEEN 1 AND 5 AS is_trading_day FROM alld),
cal AS (SELECT date, is_trading_day, CASE WHEN is_trading_day THEN CASE WHEN (month(date) = 11 AND dayofweek(date) = 5 AND day(date) BETWEEN 23 AND 29) OR (((month(date) = 7 AND day(date) = 3) OR (month(date) = 12 AND day(date) = 24)) AND dayofweek(date) BETWEEN 1 AND 4) THEN 780 ELSE 960 END END AS close_minutes,
 max(CASE WHEN is_trading_day THEN date END) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_day, min(CASE WHEN is_trading_day THEN date END) OVER (ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_day,
 coalesce(sum(is_trading_day::INT) OVER (ORDER BY date), 0)::BIGINT AS "index" FROM opens)"""


@query(f"WITH {CALENDAR} SELECT date, is_trading_day, close_minutes::BIGINT AS close_minutes, prev_day, next_day, \"index\", coalesce(CASE WHEN is_trading_day THEN date END, prev_day) AS on_or_before, coalesce(CASE WHEN is_trading_day THEN date END, next_day) AS on_or_after FROM cal")
def trading_calendar(spark, sf):
    days = span_calendar(spark, sf)
    return rounded(days.join(calendar.nearest_days(days).select("date", "on_or_before", "on_or_after"), "date"))


WINDOWS = f"""{EV}, {CALENDAR}, {DAYS}, aligned AS (SELECT ev.event_id, ev.ticker, ev.event_date, ev.timing, CASE WHEN event_id % 11 = 0 THEN 'DMH' WHEN event_id % 13 = 0 THEN 'AMC' END AS told, is_trading_day, prev_day, next_day FROM ev LEFT JOIN cal ON cal.date = event_date),
reasoned AS (SELECT *, CASE WHEN told = 'DMH' OR (told IN ('BMO', 'AMC') AND timing IN ('BMO', 'AMC') AND told <> timing) THEN 'source_timestamp_timing_mismatch' WHEN timing NOT IN ('AMC', 'BMO') THEN 'non_bmo_amc' WHEN NOT is_trading_day THEN 'announcement_date_not_trading_day' END AS reason FROM aligned),
placed AS (SELECT *, CASE WHEN reason IS NULL THEN CASE timing WHEN 'AMC' THEN event_date ELSE prev_day END END AS entry_date, CASE WHEN reason IS NULL THEN CASE timing WHEN 'AMC' THEN next_day ELSE event_date END END AS exit_date FROM reasoned)"""


@query(f"WITH {WINDOWS} SELECT p.event_id, p.entry_date, p.exit_date, CASE WHEN reason IS NULL AND (a.date IS NULL OR b.date IS NULL) THEN 'missing_underlying_entry_or_exit_bar' ELSE reason END AS exclusion_reason FROM placed p LEFT JOIN days a ON a.ticker = p.ticker AND a.date = p.entry_date LEFT JOIN days b ON b.ticker = p.ticker AND b.date = p.exit_date")
def event_windows(spark, sf):
    told = F.when(F.col("event_id") % 11 == 0, "DMH").when(F.col("event_id") % 13 == 0, "AMC")
    e = order_events(spark, sf).withColumn("told", told)
    return calendar.align_events(e, span_calendar(spark, sf), "event_date", "timing", "told", bars(spark, sf)).select("event_id", "entry_date", "exit_date", "exclusion_reason")


TARGETS = f"""{DAYS}, w AS (SELECT ticker, date AS entry_date, lead(date) OVER (PARTITION BY ticker ORDER BY date) AS exit_date FROM days),
t AS (SELECT w.ticker, w.entry_date, w.exit_date, ln(b.close / a.close) AS r_day, ln(b.open / a.close) AS r_jump, ln(b.close / b.open) AS r_reaction FROM w LEFT JOIN days a ON a.ticker = w.ticker AND a.date = w.entry_date LEFT JOIN days b ON b.ticker = w.ticker AND b.date = w.exit_date)"""


def targets(spark, sf):
    from pyspark.sql import Window

    d = day_bars(spark, sf)
    w = d.select("ticker", F.col("date").alias("entry_date"), F.lead("date").over(Window.partitionBy("ticker").orderBy("date")).alias("exit_date"))
    return panel.return_targets(w, d, "ticker")


@query(f"WITH {TARGETS} SELECT ticker, entry_date, exit_date, round(r_day, 6) AS r_day, round(r_jump * r_jump, 6) AS rvar_jump, round(2 * r_jump * r_reaction, 6) AS cross_term, abs(r_day - r_jump - r_reaction) < 1e-9 AS identity_holds, round(abs(2 * r_jump * r_reaction) / greatest(abs(r_jump * r_jump + r_reaction * r_reaction + 2 * r_jump * r_reaction), 1e-6), 5) AS share_floored, CASE WHEN r_jump IS NULL THEN 'unavailable' ELSE 'vendor_regular_ohlc_assumed' END AS open_after_status FROM t")
def return_targets(spark, sf):
    return rounded(targets(spark, sf).select("ticker", "entry_date", "exit_date", "r_day", "rvar_jump", "cross_term", (F.abs("residual") < 1e-9).alias("identity_holds"), F.round("cross_term_share_floored", 5).alias("share_floored"), "open_after_status"), 6)


@query(f"WITH {TARGETS} SELECT target_id, count(*) AS n, round(avg(v), 6) AS mean, round(max(v), 6) AS largest FROM (SELECT 'rvar_day' AS target_id, r_day * r_day AS v FROM t UNION ALL SELECT 'rvar_jump', r_jump * r_jump FROM t UNION ALL SELECT 'rvar_reaction', r_reaction * r_reaction FROM t) WHERE v IS NOT NULL GROUP BY 1")
def targets_long(spark, sf):
    return rounded(panel.targets_long(targets(spark, sf), ["ticker", "entry_date"]).groupBy("target_id").agg(F.count("*").alias("n"), F.avg("rvar").alias("mean"), F.max("rvar").alias("largest")), 6)


@query("""SELECT concat(l_orderkey, '-', l_linenumber) AS options_ticker, date_diff('day', o_orderdate::DATE, l_shipdate::DATE) AS dte, CASE WHEN l_returnflag = 'R' THEN 'missing_contract_metadata' WHEN l_linestatus <> 'O' OR l_linenumber = 6 THEN 'non_standard_excluded' WHEN NOT date_diff('day', o_orderdate::DATE, l_shipdate::DATE) BETWEEN 5 AND 60 THEN 'outside_dte_range' WHEN l_shipdate::DATE < o_orderdate::DATE + 10 THEN 'does_not_cover_event_window' ELSE 'ok' END AS contract_discovery_status,
 l_returnflag <> 'R' AND l_linestatus = 'O' AND l_linenumber <> 6 AND date_diff('day', o_orderdate::DATE, l_shipdate::DATE) BETWEEN 10 AND 14 AS is_main_dte_5_14 FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def contract_status_ladder(spark, sf):
    li, o = load(spark, sf, "lineitem"), load(spark, sf, "orders")
    e = o.select(F.col("o_orderkey").cast("string").alias("ticker"), F.to_date("o_orderdate").alias("entry_date"), F.date_add(F.to_date("o_orderdate"), 10).alias("exit_date"))
    c = li.select(F.col("l_orderkey").cast("string").alias("ticker"), F.to_date("l_shipdate").alias("expiration"), F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).alias("strike"), F.when(F.col("l_linenumber") % 2 == 0, "call").otherwise("put").alias("right"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("options_ticker"), F.when(F.col("l_linestatus") == "O", "Standard").otherwise("adjusted").alias("deliverable_status"), F.when(F.col("l_linenumber") == 6, "yes").alias("corporate_action_flag"))
    out = options.discover(e, c, 5, 60).where(F.col("options_ticker").isNotNull())
    return rounded(out.select("options_ticker", "dte", "contract_discovery_status", "is_main_dte_5_14"))


@query("""WITH q AS (SELECT l_partkey AS event_id, round(l_quantity / 5) AS strike, CASE WHEN l_linenumber % 2 = 0 THEN 'call' ELSE 'put' END AS side, l_extendedprice AS price, l_discount AS iv, l_quantity AS volume, p_size / 5.0 AS spot FROM lineitem JOIN part ON l_partkey = p_partkey),
p AS (SELECT event_id, strike, max(price) FILTER (side = 'call') AS call_price, max(price) FILTER (side = 'put') AS put_price, max(iv) FILTER (side = 'call') AS ci, max(iv) FILTER (side = 'put') AS pi, sum(volume) AS volume, max(spot) AS spot FROM q GROUP BY 1, 2)
SELECT event_id, strike::DOUBLE AS strike, round(call_price + put_price, 4) AS premium, round((ci + pi) / 2, 4) AS iv, volume FROM p WHERE call_price IS NOT NULL AND put_price IS NOT NULL QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY abs(strike / spot - 1), volume DESC, strike) = 1""")
def pair_pivot_atm(spark, sf):
    q = load(spark, sf, "lineitem").join(load(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_partkey").alias("event_id"), F.round(F.col("l_quantity") / 5).alias("strike"), F.when(F.col("l_linenumber") % 2 == 0, "call").otherwise("put").alias("right"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("iv"), F.col("l_quantity").alias("volume"), (F.col("p_size") / 5.0).alias("spot"))
    return rounded(panel.pair_at_the_money(q, ["event_id"], "spot").select("event_id", "strike", "premium", "iv", "volume"))


POINTS = """e AS (SELECT o_custkey AS event_id, min(o_orderdate)::DATE AS event_date FROM orders GROUP BY 1), x AS (SELECT event_id, event_date, CASE WHEN event_id % 3 > 0 THEN event_date + 6 END AS exit_date FROM e),
p AS (SELECT o_custkey AS event_id, 1 + (l_linenumber * 7) % 40 AS dte, avg(l_discount + 0.2) AS iv FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
o AS (SELECT p.event_id, dte, iv, row_number() OVER (PARTITION BY p.event_id ORDER BY dte) AS n FROM p JOIN x USING (event_id) WHERE event_date + dte >= coalesce(exit_date, event_date + 1)),
t AS (SELECT event_id, count(*) AS k, max(dte) FILTER (n = 1) / 365.0::DOUBLE AS t1, max(dte) FILTER (n = 2) / 365.0::DOUBLE AS t2, max(iv) FILTER (n = 1) AS a, max(iv) FILTER (n = 2) AS b FROM o GROUP BY 1),
v AS (SELECT event_id, coalesce(k, 0) AS k, t1, t2, a * a * t1 AS w1, b * b * t2 AS w2 FROM x LEFT JOIN t USING (event_id)),
f AS (SELECT *, CASE WHEN k < 2 THEN 'no_two_event_covering_expiries' WHEN w1 <= 0 OR w2 <= 0 THEN 'nonpositive_total_variance' WHEN w2 < w1 THEN 'nonmonotone_total_variance' WHEN (t2 * w1 - t1 * w2) / (t2 - t1) < 0 THEN 'negative_extracted_ivar' END AS reason FROM v)"""


@query(f"WITH {POINTS} SELECT event_id, reason AS ivar_failure_reason, CASE WHEN reason IS NULL THEN round((t2 * w1 - t1 * w2) / (t2 - t1), 6) END AS ivar_event FROM f")
def two_expiry_variance(spark, sf):
    li, o = load(spark, sf, "lineitem"), load(spark, sf, "orders")
    e = o.groupBy(F.col("o_custkey").alias("event_id")).agg(F.to_date(F.min("o_orderdate")).alias("event_date"))
    e = e.withColumn("exit_date", F.when(F.col("event_id") % 3 > 0, F.date_add("event_date", 6)))
    p = li.join(o, li["l_orderkey"] == o["o_orderkey"]).groupBy(F.col("o_custkey").alias("event_id"), (1 + (F.col("l_linenumber") * 7) % 40).cast("int").alias("dte_days")).agg(F.avg(F.col("l_discount") + 0.2).alias("iv"))
    p = p.join(e.select("event_id", "event_date"), "event_id").select("event_id", "dte_days", "iv", F.date_add("event_date", F.col("dte_days")).alias("expiration"))
    return rounded(variance.two_expiry_variance(p, e).select("event_id", "ivar_failure_reason", "ivar_event"), 6)


PRIOR = "OVER (PARTITION BY ticker ORDER BY epoch_us(event_date::TIMESTAMP) RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


# the mean weighted towards the latest of the n earlier values, in the order of date and id
EWM = "ewm AS (SELECT event_id, sum(w * value) / sum(w) AS m FROM (SELECT a.event_id, b.value, exp(CASE WHEN count(*) OVER p = 1 THEN -1.5 ELSE -1.5 + 1.5 * (row_number() OVER q - 1) / (count(*) OVER p - 1) END) AS w FROM ev a JOIN ev b ON a.ticker = b.ticker AND b.event_date < a.event_date WINDOW p AS (PARTITION BY a.event_id), q AS (PARTITION BY a.event_id ORDER BY b.event_date, b.event_id)) GROUP BY 1)"


@query(f"WITH {EV}, {EWM} SELECT event_id, count(value) {PRIOR} AS prior_earnings_count, round(quantile_cont(value, 0.5) {PRIOR}, 6) AS prior_day_rvar_median, round(quantile_cont(value, 0.75) {PRIOR}, 6) AS prior_day_rvar_p75, round(quantile_cont(value, 0.9) {PRIOR}, 6) AS prior_day_rvar_p90, round(stddev_pop(value) {PRIOR} + 1e-7, 5) AS prior_day_rvar_std, round(max(value) {PRIOR}, 6) AS prior_day_rvar_max, date_diff('day', max(event_date) {PRIOR}, event_date)::DOUBLE AS prior_days_since_earnings, round(avg((value > 150000)::INT) {PRIOR}, 6) AS prior_day_rvar_gt_ivar_hit_rate, round(m + 1e-7, 5) AS prior_day_rvar_ewm FROM ev LEFT JOIN ewm USING (event_id)")
def strict_prior_history(spark, sf):
    e = order_events(spark, sf).withColumn("implied", F.lit(150000.0))
    out = features.earnings_history(e, "ticker", "event_date", "event_id", {"day": "value"}, "implied")
    six = ("prior_day_rvar_median", "prior_day_rvar_p75", "prior_day_rvar_p90", "prior_day_rvar_max", "prior_day_rvar_gt_ivar_hit_rate", "prior_days_since_earnings")
    return out.select("event_id", "prior_earnings_count", *[F.round(c, 6).alias(c) for c in six], *[F.round(F.col(c) + 1e-7, 5).alias(c) for c in ("prior_day_rvar_std", "prior_day_rvar_ewm")])


LAST4 = "c AS (SELECT a.event_id, b.value FROM ev a JOIN ev b ON a.ticker = b.ticker AND b.event_date < a.event_date QUALIFY row_number() OVER (PARTITION BY a.event_id ORDER BY b.event_date DESC, b.event_id DESC) <= 4), l4 AS (SELECT event_id, avg(value) AS m FROM c GROUP BY 1)"


@query(f"WITH {EV}, {LAST4} SELECT ev.event_id, round(m, 6) AS prior_last_mean FROM ev LEFT JOIN l4 USING (event_id)")
def strict_prior_mean_last4(spark, sf):
    return rounded(features.prior_last_mean(order_events(spark, sf), "ticker", "event_date", "event_id", "value").select("event_id", "prior_last_mean"), 6)


# all values before the day, as one running sum over days
GLOBAL = "gd AS (SELECT event_date, sum(value) AS s, count(*) AS c FROM ev GROUP BY 1), gp AS (SELECT event_date, sum(s) OVER w / sum(c) OVER w AS g FROM gd WINDOW w AS (ORDER BY event_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"


@query(f"WITH {EV}, {LAST4}, {GLOBAL}, j AS (SELECT ev.event_id, 150000.0::DOUBLE AS market, m, g, ev.value FROM ev LEFT JOIN l4 USING (event_id) LEFT JOIN gp USING (event_date)) SELECT event_id, round(greatest(coalesce(m, g, market), 0) + 1e-8, 6) AS forecast_last_four_rvar, round(greatest(market + coalesce(m - 150000, g - 150000, 0), 0) + 1e-8, 6) AS forecast_trailing_spread, m IS NULL AND g IS NULL AS fallback_spread_used, round(coalesce(m, g, market) - 150000 + 1e-8, 6) AS prior_rv_iv_spread FROM j")
def benchmark_forecasts(spark, sf):
    e = order_events(spark, sf).withColumn("implied", F.lit(150000.0))
    out = features.benchmarks(e, "ticker", "event_date", "event_id", "value", "implied")
    # means of two to the n amounts end in a five: both sides lean the same way
    leaning = lambda c: F.round(F.col(c) + 1e-8, 6).alias(c)
    return out.select("event_id", leaning("forecast_last_four_rvar"), leaning("forecast_trailing_spread"), "fallback_spread_used", leaning("prior_rv_iv_spread"))


@query(f"WITH {DAYS}, r AS (SELECT *, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM days) SELECT ticker, date, round(ret, 6) AS ret, CASE WHEN count(ret) OVER w >= 2 THEN round(var_samp(ret) OVER w, 6) END AS rv FROM r WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def rolling_rv5(spark, sf):
    return rounded(panel.rolling_variance(day_bars(spark, sf), "ticker", "date", "close").select("ticker", "date", "ret", "rv"), 6)


@query(f"WITH {DAYS}, p AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date)::DOUBLE AS x FROM days) SELECT ticker, count(close) AS steps, round(avg(close), 7) AS mean, round(arg_max(close, x), 7) AS last, round(stddev_pop(close), 7) AS std, round(coalesce(regr_slope(close, x), 0), 7) AS slope FROM p GROUP BY 1")
def sequence_aggregates(spark, sf):
    return rounded(panel.sequence_aggregates(day_bars(spark, sf), "ticker", ["date"], "close"), 7)


SPLIT = EV + ", n AS (SELECT *, row_number() OVER (ORDER BY event_date, event_id) AS r, count(*) OVER () AS n FROM ev), cut AS (SELECT *, greatest(1, floor(0.7 * n)) AS c1 FROM n), sp AS (SELECT *, CASE WHEN r <= c1 THEN 'train' WHEN r <= least(greatest(c1 + 1, floor(0.85 * n)), n - 1) THEN 'validation' ELSE 'test' END AS split FROM cut)"


def split_events(spark, sf):
    return ranks.chronological_split(order_events(spark, sf), "event_id", "event_date")


@query(f"WITH {SPLIT} SELECT event_id, split FROM sp")
def chronological_split(spark, sf):
    return split_events(spark, sf).select("event_id", "split")


@query(f"WITH {SPLIT}, f AS (SELECT quantile_cont(value, 0.5) AS m, stddev_pop(value) AS s, count(*) AS fitted FROM sp WHERE split = 'train'), b AS (SELECT value AS v, count(*) FILTER (split = 'train') AS c FROM sp GROUP BY 1), u AS (SELECT v, sum(c) OVER (ORDER BY v) AS upto FROM b) SELECT event_id, split, round((value - m) / s, 4) AS z, round(upto / fitted, 6) AS rank FROM sp JOIN u ON v = value, f")
def train_fit_normalise(spark, sf):
    out = ranks.train_fit(split_events(spark, sf), "value")
    return out.select("event_id", "split", F.round("z", 4).alias("z"), F.round("rank", 6).alias("rank"))


@query(f"WITH {SPLIT} SELECT count(*) AS n_fit, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS center, round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.9), 6) AS p90, round(stddev_pop(value), 4) AS scale FROM sp WHERE split IN ('train', 'validation')")
def train_parameters(spark, sf):
    out = ranks.train_params(split_events(spark, sf), "value", fit=("train", "validation"))
    return out.select("n_fit", *[F.round(c, 6).alias(c) for c in ("p10", "p25", "center", "p75", "p90")], F.round("scale", 4).alias("scale"))


#: Five columns of events: amounts, their logarithm, few values with gaps, one value for a third of the rows, days.
FIVE = {"value": "value", "log_value": "ln(value)", "digits": "CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 13 END", "spike": "CASE WHEN event_id % 3 = 0 THEN 0 ELSE ticker END", "days": "event_date - DATE '1990-01-01'"}
FIVE_SQL = f"WITH {SPLIT}, fv AS (SELECT event_id, split, {', '.join(f'({x})::DOUBLE AS {n}' for n, x in FIVE.items())} FROM sp), " + ", ".join(
    f"p_{n} AS (SELECT quantile_cont({n}, 0.5) AS m, stddev_pop({n}) AS s, count({n}) AS k FROM fv WHERE split = 'train'), "
    f"u_{n} AS (SELECT v, sum(c) OVER (ORDER BY v) AS upto FROM (SELECT {n} AS v, count(*) FILTER (split = 'train') AS c FROM fv WHERE {n} IS NOT NULL GROUP BY 1))"
    for n in FIVE
)


@query(FIVE_SQL + " SELECT event_id, " + ", ".join(f"round(({n} - p_{n}.m) / p_{n}.s, 4) AS {n}_train_z, round(u_{n}.upto / p_{n}.k, 6) AS {n}_train_rank" for n in FIVE) + " FROM fv " + " ".join(f"LEFT JOIN u_{n} ON u_{n}.v = fv.{n}" for n in FIVE) + ", " + ", ".join(f"p_{n}" for n in FIVE))
def train_fit_columns(spark, sf):
    e = split_events(spark, sf)
    days = F.datediff("event_date", F.lit("1990-01-01"))
    five = e.select("event_id", "split", *[(days if n == "days" else F.expr(x)).cast("double").alias(n) for n, x in FIVE.items()])
    out = ranks.train_fit(five, list(FIVE), key="event_id")
    return out.select("event_id", *[F.round(f"{n}_train_{k}", places).alias(f"{n}_train_{k}") for n in FIVE for k, places in (("z", 4), ("rank", 6))])


PARAMETERS = ("p10", 0.1), ("p25", 0.25), ("center", 0.5), ("p75", 0.75), ("p90", 0.9)


@query(FIVE_SQL + " " + " UNION ALL ".join(f"SELECT '{n}' AS feature, count({n}) AS n_fit, " + ", ".join(f"round(quantile_cont({n}, {q}), 6) AS {c}" for c, q in PARAMETERS) + f", round(stddev_pop({n}), 4) AS scale FROM fv WHERE split = 'train'" for n in FIVE))
def train_parameters_columns(spark, sf):
    days = F.datediff("event_date", F.lit("1990-01-01"))
    five = split_events(spark, sf).select("split", *[(days if n == "days" else F.expr(x)).cast("double").alias(n) for n, x in FIVE.items()])
    out = ranks.train_params(five, list(FIVE))
    return out.select("feature", "n_fit", *[F.round(c, 6).alias(c) for c, _ in PARAMETERS], F.round("scale", 4).alias("scale"))


@query(f"WITH {EV}, late AS (SELECT event_id, row_number() OVER (ORDER BY event_date, event_id) AS r, count(*) OVER () AS n FROM ev WHERE event_date >= DATE '1997-01-01') SELECT event_id, CASE WHEN r IS NULL THEN 'train' WHEN r <= greatest(1, ceil(n / 2)) THEN 'validation' ELSE 'test' END AS split FROM ev LEFT JOIN late USING (event_id)")
def split_at_date(spark, sf):
    return ranks.split_at(order_events(spark, sf), "event_id", "event_date", "1997-01-01").select("event_id", "split")


@query(f"WITH {EV}, s AS (SELECT timing, floor(value / 100) AS score, (event_id % 3 = 0)::INT AS y FROM ev), r AS (SELECT *, rank() OVER (PARTITION BY timing ORDER BY score) + (count(*) OVER (PARTITION BY timing, score) - 1) / 2.0 AS rk FROM s) SELECT timing, count(*) AS n, round((sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y)))::DOUBLE, 6) AS auc FROM r GROUP BY 1")
def average_rank_auc(spark, sf):
    s = order_events(spark, sf).select("timing", F.floor(F.col("value") / 100).alias("score"), (F.col("event_id") % 3 == 0).cast("int").alias("y"))
    return rounded(ranks.auc(s, "score", "y", ["timing"]), 6)


BUCKET = "CASE WHEN n <= 1 THEN 0 ELSE greatest(0, ceil((r - 1) * 10.0::DOUBLE / (n - 1))::BIGINT - 1) END"


@query(f"WITH {EV}, q AS (SELECT *, row_number() OVER (PARTITION BY timing ORDER BY value, event_id) AS r, count(*) OVER (PARTITION BY timing) AS n FROM ev), b AS (SELECT *, {BUCKET} AS bucket FROM q) SELECT timing, bucket, count(*) AS n, round(avg(value), 7) AS mean_score, round(avg((event_id % 3 = 0)::INT), 6) AS outcome_rate FROM b GROUP BY 1, 2")
def qcut_deciles(spark, sf):
    b = ranks.buckets(order_events(spark, sf), "value", "event_id", ["timing"], 10, "bucket")
    return _deciles(b)


def _deciles(b: DataFrame) -> DataFrame:
    out = b.groupBy("timing", "bucket").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.avg((F.col("event_id") % 3 == 0).cast("int")).alias("o"))
    return out.select("timing", F.col("bucket").cast("long").alias("bucket"), "n", F.round("m", 7).alias("mean_score"), F.round("o", 6).alias("outcome_rate"))


@query("SELECT leakage_audit_reason, count(*) AS rows FROM (SELECT CASE WHEN l_shipdate IS NULL OR o_orderdate IS NULL THEN 'missing_time' WHEN l_shipdate > o_orderdate THEN 'after_entry' END AS leakage_audit_reason FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE leakage_audit_reason IS NOT NULL GROUP BY 1")
def leakage_rows(spark, sf):
    j = load(spark, sf, "lineitem").join(load(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return features.leakage_rows(j, "l_shipdate", "o_orderdate").groupBy("leakage_audit_reason").agg(F.count("*").alias("rows"))


@query("SELECT c AS \"column\", f AS filled, f / n::DOUBLE AS share FROM (SELECT count(*) AS n, count(text) AS a, count(lang) AS b, count(source) AS d FROM documents), LATERAL (VALUES ('text', a), ('lang', b), ('source', d)) v(c, f)")
def coverage_audit(spark, sf):
    return quality.coverage(load(spark, sf, "documents"), ["text", "lang", "source"])


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1 OR user_id IS NULL OR event_type IS NULL")
def key_uniqueness(spark, sf):
    return quality.key_violations(load(spark, sf, "events"), ["user_id", "event_type"])


@query("SELECT year(l_shipdate) AS year, count(DISTINCT l_shipdate::DATE) AS days, count(*) AS rows, count(DISTINCT l_partkey) AS tickers FROM lineitem GROUP BY 1")
def year_coverage(spark, sf):
    b = bars(spark, sf)
    return rounded(b.groupBy(F.year("date").alias("year")).agg(F.count_distinct("date").alias("days"), F.count("*").alias("rows"), F.count_distinct("ticker").alias("tickers")))


SYMBOL = "concat('O:', upper(regexp_replace(split_part(p_brand, '#', 1), '[^A-Za-z]', '')), '25', lpad((p_partkey % 12 + 1)::VARCHAR, 2, '0'), lpad((p_partkey % 28 + 1)::VARCHAR, 2, '0'), CASE WHEN p_size % 2 = 0 THEN 'C' ELSE 'P' END, lpad((p_size * 500)::VARCHAR, 8, '0'))"


@query("SELECT p_partkey, upper(regexp_replace(split_part(p_brand, '#', 1), '[^A-Za-z]', '')) AS underlying, make_date(2025, (p_partkey % 12 + 1)::BIGINT, (p_partkey % 28 + 1)::BIGINT) AS expiration, CASE WHEN p_size % 2 = 0 THEN 'call' ELSE 'put' END AS \"right\", p_size * 500 / 1000.0::DOUBLE AS strike FROM part")
def symbol_parse(spark, sf):
    p = load(spark, sf, "part").select("p_partkey", F.expr(SYMBOL.replace("::VARCHAR", "::STRING")).alias("symbol"))
    return tables.parse_option_symbol(p, "symbol").select("p_partkey", "underlying", "expiration", "right", "strike")


FILED = "CASE doc_id % 5 WHEN 0 THEN concat('ITEM  2.02 Results of the fiscal quarter. ', text) WHEN 1 THEN concat('Item 2.02 annual meeting; financial results ', text) WHEN 2 THEN concat('item\u00a02.02 ', CASE WHEN doc_id % 2 = 0 THEN 'quarter\u2009 ended ' ELSE '' END, text) WHEN 3 THEN '' ELSE text END"
# the statuses of a filing's text, from the same words
STATUS = f"""CASE WHEN coalesce(x, '') = '' THEN 'missing_text' WHEN NOT contains(f, 'item 2.02') THEN 'not_item_2_02_text' WHEN {' OR '.join(f"contains(f, '{w}')" for w in filings.OTHER)} THEN 'non_earnings_item_2_02'
 WHEN {' OR '.join(f"contains(f, '{w}')" for w in filings.EARNINGS)} THEN 'validated_earnings_release' ELSE 'ambiguous_item_2_02_text' END"""


@query(f"WITH t AS (SELECT doc_id, {FILED} AS x FROM documents), u AS (SELECT doc_id, x, lower(regexp_replace(x, '{WHITE}', ' ', 'g')) AS f FROM t) SELECT doc_id, {STATUS} AS status FROM u")
def filing_classifier(spark, sf):
    return filings.classify_filing(load(spark, sf, "documents").select("doc_id", F.expr(FILED).alias("text")), "text").select("doc_id", "status")


FIRST, SECOND = "CASE WHEN doc_id % 7 > 2 THEN concat('item 2.02 ', left(text, 40)) WHEN doc_id % 7 = 1 THEN 'item 2.02 quarter\u00a0ended' ELSE NULL END", "CASE WHEN doc_id % 3 = 0 THEN 'item 2.02 financial\u3000results' WHEN doc_id % 3 = 1 THEN 'item 2.02 weak' ELSE NULL END"


@query(f"""WITH a AS (SELECT doc_id, x, lower(regexp_replace(x, '{WHITE}', ' ', 'g')) AS f FROM (SELECT doc_id, {FIRST} AS x FROM documents)), b AS (SELECT doc_id, x, lower(regexp_replace(x, '{WHITE}', ' ', 'g')) AS f FROM (SELECT doc_id, {SECOND} AS x FROM documents)),
s AS (SELECT a.doc_id, s1, s2, s1 IN ('validated_earnings_release', 'non_earnings_item_2_02', 'not_item_2_02_text') AS settled, s2 IN ('validated_earnings_release', 'non_earnings_item_2_02', 'not_item_2_02_text') AS other FROM (SELECT doc_id, {STATUS} AS s1 FROM a) a JOIN (SELECT doc_id, {STATUS} AS s2 FROM b) b USING (doc_id))
SELECT doc_id, CASE WHEN NOT settled AND other THEN s2 ELSE s1 END AS text_validation_status, CASE WHEN NOT settled AND other THEN 'auxiliary_text_fallback' ELSE 'official_text' END AS text_validation_source, CASE WHEN settled THEN '' ELSE s2 END AS text_validation_aux_status FROM s""")
def official_then_aux(spark, sf):
    d = load(spark, sf, "documents")
    texts = lambda x: d.select(F.lit("t").alias("ticker"), F.col("doc_id").cast("string").alias("source_id"), F.expr(x).alias("text"))
    out = filings.validate_by_text(d.select("doc_id", F.lit("T").alias("ticker"), F.col("doc_id").cast("string").alias("source_id")), texts(FIRST), texts(SECOND))
    return out.select("doc_id", "text_validation_status", "text_validation_source", "text_validation_aux_status")


@query("SELECT o_custkey, count(*) AS n, max(o_orderkey) AS last_key, min(o_orderpriority) AS least FROM orders GROUP BY 1")
def json_parallel_arrays(spark, sf):
    packed = load(spark, sf, "orders").groupBy("o_custkey").agg(F.to_json(F.struct(F.collect_list("o_orderkey").alias("k"), F.collect_list("o_orderpriority").alias("p"))).alias("j"))
    rows = tables.explode_parallel(packed, "j", {"k": "bigint", "p": "string"}, ["o_custkey"])
    return rows.groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("k").alias("last_key"), F.min("p").alias("least"))


@query("SELECT user_id, event_id, event_type, round(value, 4) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def keyed_dedupe_keep_last(spark, sf):
    e = load(spark, sf, "events")
    return rounded(tables.keep_last(e, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type", "value"))


PLAN = f"{EV}, {DAYS}, av AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM bars WHERE isodow(date) < 6)), placed AS (SELECT ev.*, av.i AS e FROM ev ASOF JOIN av ON ev.event_date >= av.date), plan AS (SELECT p.event_id, p.ticker, av.date AS source_date, 19 - (p.e - av.i) AS seq_index FROM placed p JOIN av ON av.i BETWEEN p.e - 19 AND p.e)"
COVER = PLAN + ", cov AS (SELECT event_id, count(days.date) AS valid_days, count(days.date) FILTER (seq_index >= 15) AS latest5_days FROM plan LEFT JOIN days ON days.ticker = plan.ticker AND days.date = source_date GROUP BY 1)"


def plan_of(spark, sf):
    weekdays = bars(spark, sf).select("date").where(~F.dayofweek("date").isin(1, 7))
    return calendar.sequence_plan(order_events(spark, sf).select("event_id", "ticker", "event_date"), weekdays, "event_date", "date")


@query(f"WITH {PLAN} SELECT event_id, source_date, seq_index FROM plan")
def sequence_plan(spark, sf):
    return plan_of(spark, sf).select("event_id", "source_date", F.col("seq_index").cast("long").alias("seq_index"))


def covered(spark, sf):
    held = bars(spark, sf).select("ticker", F.col("date").alias("source_date")).distinct().withColumn("valid", F.lit(True))
    return calendar.sequence_coverage(plan_of(spark, sf).join(held, ["ticker", "source_date"], "left"), "event_id", "valid")


@query(f"WITH {COVER} SELECT *, valid_days >= 12 AND latest5_days >= 1 AS eligible FROM cov")
def sequence_coverage(spark, sf):
    return covered(spark, sf)


@query(f"WITH {COVER} SELECT count(*) AS events, count(*) FILTER (valid_days >= 8) AS at_least_8, count(*) FILTER (valid_days >= 12) AS at_least_12, count(*) FILTER (valid_days >= 16) AS at_least_16, count(*) FILTER (valid_days >= 20) AS at_least_20, round(avg((NOT (valid_days >= 12 AND latest5_days >= 1))::INT), 4) AS drop_rate, avg((NOT (valid_days >= 12 AND latest5_days >= 1))::INT) > 0.1 AS at_risk FROM cov")
def sequence_coverage_report(spark, sf):
    return rounded(calendar.coverage_report(covered(spark, sf)))
