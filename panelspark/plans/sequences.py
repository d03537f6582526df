"""Queries on event sequences: surfaces, steps of the last hour, coverage, aggregates, run-ups and tensors."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import calendar, covariates, panel, surface
from panelspark.operators.staging import materialise, parts_for
from panelspark.plans.common import BARS, DAYS, EV, bars, day_bars, load, order_events, query, rounded
from panelspark.plans.contracts import OPT, option_events, option_table
from panelspark.plans.panels import PLAN, plan_of

#: Contracts whose bars of an hour are made in one task.
PART_CONTRACTS = 100_000

# options of an event's day with a volatility of their own
SHAPE = OPT + ", sx AS (SELECT event_id, expiration, strike, side, expiration - entry_date AS dte, close, volume, spot, 0.2 + volume / 100 AS iv FROM oe JOIN op ON op.ticker = oe.ticker AND op.date = oe.entry_date WHERE close > 0)"


def shape_rows(spark, sf):
    e = option_events(spark, sf).select("event_id", "ticker", "entry_date", F.col("s_before").alias("spot"))
    o = option_table(spark, sf).withColumnRenamed("date", "entry_date").where("close > 0")
    return e.hint("merge").join(o, ["ticker", "entry_date"]).select("event_id", "entry_date", "expiration", "strike", "right", F.datediff("expiration", "entry_date").alias("dte"), F.col("close").alias("option_close"), F.col("volume").alias("option_volume"), F.lit(1).alias("option_transactions"), "spot", (0.2 + F.col("volume") / 100).alias("iv_proxy"))


@query(f"""WITH {SHAPE}, p AS (SELECT event_id, expiration, strike, avg(iv) FILTER (side = 'call') AS ci, avg(iv) FILTER (side = 'put') AS pi, avg(close) FILTER (side = 'call') AS cp, avg(close) FILTER (side = 'put') AS pp, avg(iv) AS iv, sum(iv) AS s, count(*) AS n, min(dte) AS dte, min(spot) AS spot FROM sx GROUP BY 1, 2, 3 HAVING ci IS NOT NULL AND pi IS NOT NULL),
a AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY abs(strike / spot - 1), abs(dte - 14), expiration, strike) = 1),
t AS (SELECT event_id, count(*) AS iv_pairs, sum(s) FILTER (dte BETWEEN 15 AND 45) / sum(n) FILTER (dte BETWEEN 15 AND 45) - sum(s) FILTER (dte BETWEEN 3 AND 14) / sum(n) FILTER (dte BETWEEN 3 AND 14) AS slope FROM p GROUP BY 1),
k AS (SELECT event_id, strike, sum(s) / sum(n) AS iv, min(spot) AS spot FROM p GROUP BY 1, 2), f AS (SELECT *, lag(iv) OVER w + lead(iv) OVER w - 2 * iv AS fly FROM k WINDOW w AS (PARTITION BY event_id ORDER BY strike)), g AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY abs(strike - spot), strike) = 1)
SELECT a.event_id, iv_pairs, round(a.iv, 6) AS atm_iv_proxy, round(pi - ci, 6) AS skew_proxy, round((cp + pp) / a.spot, 6) AS straddle_premium_to_spot, round(slope, 6) AS term_slope_proxy, round(fly, 6) AS butterfly_proxy FROM a JOIN t USING (event_id) JOIN g USING (event_id)""")
def surface_shape(spark, sf):
    out = surface.surface_shape(shape_rows(spark, sf), ["event_id"], "option_close", "spot")
    return rounded(out.select("event_id", "iv_pairs", "atm_iv_proxy", "skew_proxy", "straddle_premium_to_spot", "term_slope_proxy", "butterfly_proxy"), 6)


@query()
def daily_surface(spark, sf):
    out = surface.daily_surface(shape_rows(spark, sf).drop("iv_proxy"), ["event_id", "entry_date"], days_to_event=None)
    return rounded(out.select("event_id", "valid_pair_count", "surface_missing_rate", "atm_iv_proxy", "option_volume_sum", "call_put_volume_imbalance", "is_valid_sequence_day"), 6)


@query(f"WITH {SHAPE}, f AS (SELECT * FROM sx WHERE dte BETWEEN 3 AND 45), b AS (SELECT event_id, expiration, strike, count(DISTINCT side) >= 2 AS pair, sum(volume) AS v, coalesce(sum(volume) FILTER (side = 'call'), 0) AS c, coalesce(sum(volume) FILTER (side = 'put'), 0) AS p FROM f GROUP BY 1, 2, 3) SELECT event_id, count(*) FILTER (pair) AS valid_pair_count, sum(v) AS option_volume_sum, round((sum(c) - sum(p)) / (sum(c) + sum(p)), 6) AS call_put_volume_imbalance FROM b GROUP BY 1")
def daily_surface_volumes(spark, sf):
    out = surface.daily_surface(shape_rows(spark, sf).drop("iv_proxy"), ["event_id", "entry_date"])
    return rounded(out.select("event_id", "valid_pair_count", "option_volume_sum", "call_put_volume_imbalance"), 6)


@query(f"""WITH {SHAPE}, f AS (SELECT * FROM sx WHERE dte BETWEEN 3 AND 45), x AS (SELECT DISTINCT event_id, expiration, dte, t FROM f, (VALUES (7), (14), (30)) v(t)), w AS (SELECT DISTINCT event_id, expiration FROM (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY event_id, t ORDER BY abs(dte - t), dte, expiration) = 1)),
p AS (SELECT event_id, expiration, strike, min(spot) AS s FROM f JOIN w USING (event_id, expiration) GROUP BY 1, 2, 3 HAVING count(DISTINCT side) >= 2), k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY event_id, expiration ORDER BY abs(strike - s), strike) <= 4)
SELECT event_id, expiration, strike, side AS "right", dte, close AS option_close FROM f JOIN k USING (event_id, expiration, strike)""")
def index_candidates(spark, sf):
    return rounded(surface.index_candidates(shape_rows(spark, sf), ["event_id"]).select("event_id", "expiration", "strike", "right", "dte", "option_close"), 7)


@query()
def intraday_surface(spark, sf):
    """The events' contracts trade once a minute of the last hour; the price follows the close of the day."""
    e = option_events(spark, sf).withColumn("event_entry_timestamp", F.col("entry_date").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(20)))
    rows = materialise(shape_rows(spark, sf).withColumn("options_ticker", F.concat_ws("-", "event_id", "expiration", "strike", "right")), "shape-rows")
    # bars are made where their contract is dealt to, in parts whose bars a task can sort
    dealt = rows.select("options_ticker", "entry_date", "option_close").repartition(parts_for(spark, rows.count(), PART_CONTRACTS), "options_ticker")
    b = dealt.select("*", F.explode(F.sequence(F.lit(0), F.lit(60))).alias("m"))
    b = b.select("options_ticker", (F.col("entry_date").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(19), F.col("m"))).alias("ts"), (F.col("option_close") + F.col("m") / 100).alias("option_vwap"), F.lit(1).alias("volume"), F.lit(1).alias("transactions"))
    out = surface.intraday_surface(b, rows, e)
    return rounded(out.select("event_id", "bin", "valid_pair_count", "surface_missing_rate", "atm_iv_proxy", "latest_option_trade_bar_age_seconds", "hybrid_valid_step"), 6)


# steps of events: the plan joined with the days' bars; every fourth is a step of the last hour. Prices are moved off the
# fives that end many of them, on which engines round apart.
STEPS = PLAN + ", st AS (SELECT plan.event_id, seq_index, source_date, close + 1e-7 AS close, volume, CASE WHEN seq_index % 4 = 3 THEN 'intraday' ELSE 'daily' END AS step_type FROM plan LEFT JOIN days ON days.ticker = plan.ticker AND days.date = source_date)"


def steps(spark, sf):
    s = plan_of(spark, sf).join(day_bars(spark, sf).withColumnRenamed("date", "source_date"), ["ticker", "source_date"], "left")
    return s.withColumns({"close": F.col("close") + 1e-7, "step_type": F.when(F.col("seq_index") % 4 == 3, "intraday").otherwise("daily")})


@query(f"WITH {STEPS} SELECT event_id, count(*) AS sequence_days, count(close) AS valid_days, count(close) FILTER (seq_index >= 15) AS latest5_days, count(*) FILTER (volume IS NULL) AS missing_options_days, CASE WHEN count(close) >= 12 AND count(close) FILTER (seq_index >= 15) >= 1 THEN 'eligible' WHEN count(close) < 12 THEN 'insufficient_valid_sequence_days' ELSE 'insufficient_latest_5_call_put_pairs' END AS eligibility_reason FROM st GROUP BY 1")
def coverage_by_event(spark, sf):
    s = steps(spark, sf).withColumns({"is_valid_sequence_day": F.col("close").isNotNull(), "has_underlying_close": F.col("close").isNotNull(), "missing_options": F.col("volume").isNull()})
    return calendar.coverage_by_event(s, "event_id").select("event_id", "sequence_days", "valid_days", "latest5_days", "missing_options_days", "eligibility_reason")


@query(f"WITH {STEPS}, t AS (SELECT *, date_diff('minute', lag(source_date) OVER (PARTITION BY event_id ORDER BY seq_index)::TIMESTAMP, source_date::TIMESTAMP) AS d, date_diff('minute', event_date::TIMESTAMP, source_date::TIMESTAMP) / 28800.0::DOUBLE AS n FROM st JOIN ev USING (event_id)) SELECT event_id, seq_index, round(ln(1 + greatest(coalesce(d, 1440), 1)), 6) AS log_delta_minutes_from_prev_step, round(n, 6) AS normalized_time_to_entry FROM t")
def time_features(spark, sf):
    s = steps(spark, sf).withColumns({"source_timestamp": F.col("source_date").cast("timestamp"), "entry_ts": F.col("event_date").cast("timestamp")})
    return rounded(surface.time_features(s, "event_id", "entry_ts").select("event_id", "seq_index", "log_delta_minutes_from_prev_step", "normalized_time_to_entry"), 6)


HYBRID = STEPS + ", hy AS (SELECT event_id, count(*) AS hybrid_steps, count(close) FILTER (step_type = 'intraday') AS bins, coalesce(arg_max(close IS NOT NULL, seq_index) FILTER (step_type = 'intraday'), false) AS latest, (count(close) + count(volume)) / (2.0::DOUBLE * count(*)) AS density FROM st GROUP BY 1)"


@query(f"WITH {HYBRID} SELECT event_id, hybrid_steps, bins AS intraday_valid_bin_count, latest AS latest_5min_valid_surface, round(density, 6) AS hybrid_feature_mask_density, bins >= 8 AND density >= 0.5 AS hybrid_sequence_eligible FROM hy")
def hybrid_coverage(spark, sf):
    out = surface.hybrid_coverage(steps(spark, sf).withColumn("hybrid_valid_step", F.col("close").isNotNull()), ["close", "volume"])
    return rounded(out, 6)


@query(f"WITH {HYBRID} SELECT count(*) FILTER (bins >= 8) AS events_with_8_valid_bins, round(quantile_cont(density, 0.5), 6) AS median_density, 1000 AS total_events, count(*) FILTER (bins >= 8) < 700 OR quantile_cont(density, 0.5) < 0.5 AS too_sparse FROM hy")
def hybrid_report(spark, sf):
    cover = surface.hybrid_coverage(steps(spark, sf).withColumn("hybrid_valid_step", F.col("close").isNotNull()), ["close", "volume"])
    return rounded(surface.hybrid_report(cover, 1000), 6)


@query(f"WITH {STEPS}, l AS (SELECT step_type, 'close' AS metric, close AS v FROM st UNION ALL SELECT step_type, 'volume', volume FROM st) SELECT step_type, metric, count(v) AS n, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std, round(avg((v IS NULL)::INT), 6) AS missing_rate, round(quantile_cont(v, 0.01), 5) AS p01, round(quantile_cont(v, 0.5), 5) AS p50, round(quantile_cont(v, 0.99), 5) AS p99 FROM l GROUP BY 1, 2")
def distribution_audit(spark, sf):
    out = surface.distribution_audit(steps(spark, sf), "step_type", ["close", "volume"])
    return out.select("step_type", "metric", "n", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), F.round("missing_rate", 6).alias("missing_rate"), *[F.round(c, 5).alias(c) for c in ("p01", "p50", "p99")])


@query(f"WITH {STEPS}, x AS (SELECT *, row_number() OVER (PARTITION BY event_id, step_type ORDER BY seq_index)::DOUBLE AS x FROM st WHERE close IS NOT NULL) SELECT event_id, step_type, round(avg(close), 6) AS mean, round(stddev_pop(close) + 1e-7, 4) AS std, round(min(close), 4) AS min, round(max(close), 4) AS max, round(arg_max(close, x), 4) AS last_value, round(CASE WHEN count(*) > 1 THEN regr_slope(close, x) ELSE 0 END + 1e-7, 4) AS simple_slope FROM x GROUP BY 1, 2")
def flat_aggregates(spark, sf):
    out = surface.flat_aggregates(steps(spark, sf), "event_id", "step_type", "close")
    return out.select("event_id", "step_type", F.round("mean", 6).alias("mean"), *[F.round(c, 4).alias(c) for c in ("min", "max", "last_value")], *[F.round(F.col(c) + 1e-7, 4).alias(c) for c in ("std", "simple_slope")])


@query(f"""WITH {STEPS}, b AS (SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY seq_index DESC) AS back, close, volume FROM st), l AS (SELECT event_id, back, 'close' AS feature, close AS v FROM b WHERE close IS NOT NULL UNION ALL SELECT event_id, back, 'volume', volume FROM b WHERE volume IS NOT NULL),
e AS (SELECT l.*, w FROM l, (VALUES (1), (3), (5), (10)) x(w)), t AS (SELECT *, row_number() OVER (PARTITION BY event_id, feature, w ORDER BY back DESC)::DOUBLE AS x FROM e WHERE back <= w), p AS (SELECT event_id, feature, w, avg(v) AS prior FROM e WHERE back > w AND feature = 'volume' GROUP BY 1, 2, 3)
SELECT t.event_id, t.feature, t.w::BIGINT AS "window", round(avg(v), 4) AS mean, CASE WHEN count(*) > 1 THEN round(arg_max(v, x) - arg_min(v, x), 4) END AS delta, CASE WHEN count(*) > 1 THEN round(regr_slope(v, x), 4) END AS slope, round(avg(v) / any_value(prior) - 1, 4) AS abnormal FROM t LEFT JOIN p ON p.event_id = t.event_id AND p.feature = t.feature AND p.w = t.w GROUP BY 1, 2, 3""")
def runup_features(spark, sf):
    return rounded(surface.runup_features(steps(spark, sf), "event_id", ("close", "volume"), volumes=("volume",)))


@query(f"WITH {STEPS}, a AS (SELECT event_id, arg_max({{'c': close, 'v': volume}}, seq_index) AS s FROM st GROUP BY 1) SELECT event_id, round(1 - s.v / 100, 6) AS grid_coverage, round(s.c / 2, 5) AS left_right_slope, round(s.c / 2 / greatest(abs(s.c), 1e-6), 6) AS tail_asymmetry FROM a")
def latest_shape(spark, sf):
    s = steps(spark, sf).withColumns({"atm_iv_proxy": F.col("close"), "iv_skew_proxy": F.col("close") / 2, "iv_butterfly_proxy": F.col("close") / 3, "surface_missing_rate": F.col("volume") / 100})
    out = surface.latest_shape(s, "event_id")
    return out.select("event_id", F.round("grid_coverage", 6).alias("grid_coverage"), F.round("left_right_slope", 5).alias("left_right_slope"), F.round("tail_asymmetry", 6).alias("tail_asymmetry"))


@query(f"WITH {STEPS}, r AS (SELECT event_id, seq_index, volume / 100 - 0.2 AS r, close AS v FROM st), a AS (SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY seq_index DESC) AS b, r FROM r WHERE r IS NOT NULL), c AS (SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY seq_index DESC) AS b, v FROM r WHERE v IS NOT NULL), x AS (SELECT event_id, product(1 + r) FILTER (b <= 5) - 1 AS r5, product(1 + r) FILTER (b <= 10) - 1 AS r10 FROM a GROUP BY 1), y AS (SELECT event_id, arg_min(v, b) AS l, avg(v) FILTER (b <= 5) AS m FROM c GROUP BY 1) SELECT e.event_id, round(r5, 5) AS return_5d, round(r10, 5) AS return_10d, round(l, 6) AS rv5_last, round(m, 6) AS rv5_mean_5d FROM (SELECT DISTINCT event_id FROM st) e LEFT JOIN x USING (event_id) LEFT JOIN y USING (event_id)")
def underlying_runup(spark, sf):
    out = surface.underlying_runup(steps(spark, sf).withColumn("r", F.col("volume") / 100 - 0.2), "event_id", "r", "close")
    return out.select("event_id", F.round("return_5d", 5).alias("return_5d"), F.round("return_10d", 5).alias("return_10d"), F.round("rv5_last", 6).alias("rv5_last"), F.round("rv5_mean_5d", 6).alias("rv5_mean_5d"))


@query(f"WITH {STEPS} SELECT event_id, " + ", ".join(f"round(avg({f}) FILTER (seq_index = {i}), 5) AS seq_t{i:02d}_{f}" for f in ("close", "volume") for i in range(0, 20)) + " FROM st GROUP BY 1")
def sequence_pivot(spark, sf):
    return rounded(surface.sequence_matrix(steps(spark, sf), "event_id", ("close", "volume")), 5)


@query(f"""WITH {STEPS}, s AS (SELECT st.*, CASE WHEN volume IS NOT NULL THEN ln(1 + greatest(volume, 0)) END AS lv, CASE WHEN st.event_id % 3 > 0 THEN 'train' ELSE 'test' END AS split FROM st), q AS (SELECT step_type, quantile_cont(close, 0.5) AS m, quantile_cont(close, 0.75) - quantile_cont(close, 0.25) AS d, quantile_cont(lv, 0.5) AS mv, quantile_cont(lv, 0.75) - quantile_cont(lv, 0.25) AS dv FROM s WHERE split = 'train' GROUP BY 1)
SELECT event_id, seq_index, round(coalesce((close - m) / CASE WHEN d > 1e-12 THEN d ELSE 1 END, 0), 4) AS close, round(coalesce((lv - mv) / CASE WHEN dv > 1e-12 THEN dv ELSE 1 END, 0), 4) AS volume, close IS NOT NULL AS close_mask FROM s JOIN q USING (step_type)""")
def robust_scaled(spark, sf):
    s = steps(spark, sf).withColumn("split", F.when(F.col("event_id") % 3 > 0, "train").otherwise("test"))
    return rounded(surface.robust_scaled(s, ("close", "volume")).select("event_id", "seq_index", "close", "volume", "close_mask"))


@query(f"WITH {STEPS} SELECT event_id, count(*) FILTER (close IS NOT NULL OR volume IS NOT NULL) AS valid_len, count(*) FILTER ((close IS NOT NULL OR volume IS NOT NULL) AND step_type = 'daily') AS daily_valid_len, count(*) FILTER ((close IS NOT NULL OR volume IS NOT NULL) AND step_type = 'intraday') AS intraday_valid_len, round(1 - (count(close) + count(volume)) / 40.0::DOUBLE, 6) AS missing_rate FROM st GROUP BY 1")
def sequence_quality(spark, sf):
    s = steps(spark, sf).withColumn("split", F.lit("train"))
    tensor = surface.sequence_tensor(surface.robust_scaled(s, ("close", "volume")), "event_id", ("close", "volume"), 20)
    return rounded(surface.sequence_quality(tensor, "event_id").select("event_id", "valid_len", "daily_valid_len", "intraday_valid_len", "missing_rate"), 6)


@query(f"WITH {DAYS}, r AS (SELECT ticker, date, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM days), i AS (SELECT date, max(ret) FILTER (ticker = 1) AS a, max(ret) FILTER (ticker = 2) AS b FROM r WHERE ticker IN (1, 2) GROUP BY 1) SELECT ticker, date, round(ret, 6) AS ret, round(a, 6) AS \"1_return_1d\", round(b, 6) AS \"2_return_1d\" FROM r LEFT JOIN i USING (date)")
def same_day_returns(spark, sf):
    out = surface.same_day_returns(panel.rolling_variance(day_bars(spark, sf), "ticker", "date", "close"), "date", "ticker", "ret", ("1", "2"))
    return rounded(out.select("ticker", "date", "ret", "1_return_1d", "2_return_1d"), 6)


@query(f"WITH {BARS}, {EV}, h AS (SELECT event_id, price, date, orderkey, line, row_number() OVER (PARTITION BY event_id ORDER BY date DESC) AS n FROM ev JOIN bars USING (ticker) WHERE date < event_date) SELECT event_id, date AS source_date, 19 - row_number() OVER (PARTITION BY event_id ORDER BY date DESC) AS seq_index FROM (SELECT DISTINCT event_id, date FROM h) QUALIFY seq_index >= 0")
def hybrid_daily(spark, sf):
    e = order_events(spark, sf).select("event_id", "ticker", F.col("event_date").alias("entry_date"))
    d = e.join(bars(spark, sf).select("ticker", F.col("date").alias("source_date")).distinct(), "ticker").withColumn("is_valid_sequence_day", F.lit(True))
    return surface.hybrid_daily(d).select("event_id", "source_date", F.col("seq_index").cast("long").alias("seq_index"))


# lines as the options of two indices on their ship date, their trades a quarter of an hour before 20:00, and the indices' own bars
INDEX = """il AS (SELECT CASE l_suppkey % 2 WHEN 0 THEN 'SPY' ELSE 'QQQ' END AS symbol, l_shipdate::DATE AS date, concat(l_orderkey, '-', l_linenumber) AS tick, l_shipdate::DATE + (7 * (1 + l_linenumber % 2))::INT AS expiration, 98.0::DOUBLE + 4 * (l_partkey % 2) AS strike,
 l_orderkey % 2 AS side, 7 * (1 + l_linenumber % 2) AS dte, l_extendedprice / 10000 AS close, l_quantity AS q, l_linenumber AS line FROM lineitem),
sp AS (SELECT DISTINCT symbol, date, 100.0::DOUBLE AS spot FROM il WHERE day(date) % 13 > 0 OR symbol = 'QQQ'),
ob AS (SELECT il.*, spot FROM il JOIN sp USING (symbol, date) WHERE close > 0),
pk AS (SELECT symbol, date, expiration, strike FROM ob GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT side) >= 2 QUALIFY row_number() OVER (PARTITION BY symbol, date, expiration ORDER BY abs(strike - 100), strike) <= 4),
cd AS (SELECT ob.* FROM ob JOIN pk USING (symbol, date, expiration, strike)), pr AS (SELECT *, 0.2 + q / 100 AS iv FROM cd WHERE q > 10),
cc AS (SELECT symbol, date, count(*) AS candidates, count(*) FILTER (q > 10) AS priced, sum(q) FILTER (q > 10)::DOUBLE AS volume FROM cd GROUP BY 1, 2),
pa AS (SELECT symbol, date, expiration, strike, avg(iv) AS iv, avg(iv) FILTER (side = 1) AS ci, avg(iv) FILTER (side = 0) AS pi, any_value(dte) AS dte FROM pr GROUP BY ALL HAVING ci IS NOT NULL AND pi IS NOT NULL),
am AS (SELECT symbol, date, count(*) OVER (PARTITION BY symbol, date) AS pairs, iv, pi - ci AS skew FROM pa QUALIFY row_number() OVER (PARTITION BY symbol, date ORDER BY abs(strike / 100 - 1), abs(dte - 14), expiration, strike) = 1),
ub AS (SELECT symbol, date, 100 + close / 100 AS p, q, date + to_minutes((1080 + 17 * line)::INT) AS ts FROM il),
un AS (SELECT symbol, date, arg_max(p, {'t': ts, 'p': p}) AS last, arg_min(p, {'t': ts, 'p': p}) AS first, count(*) AS rows, sum(q) AS volume FROM ub WHERE ts BETWEEN date + INTERVAL 19 HOUR AND date + INTERVAL 20 HOUR GROUP BY 1, 2),
un2 AS (SELECT symbol, date, sum(p * q) / sum(q) AS vwap FROM ub WHERE ts BETWEEN date + INTERVAL 1185 MINUTE AND date + INTERVAL 20 HOUR GROUP BY 1, 2),
dy AS (SELECT sp.symbol, sp.date, CASE WHEN rows > 0 THEN 'ok' ELSE 'missing' END AS underlying_status, last, vwap, last / first - 1 AS ret, coalesce(rows, 0) AS rows, candidates, priced, CASE WHEN candidates IS NOT NULL THEN coalesce(pairs, 0) END AS pairs, iv, skew, cc.volume,
 CASE WHEN candidates IS NOT NULL THEN CASE WHEN coalesce(pairs, 0) > 0 THEN 'ok' ELSE 'no_prices' END END AS status
 FROM sp LEFT JOIN un USING (symbol, date) LEFT JOIN un2 USING (symbol, date) LEFT JOIN cc USING (symbol, date) LEFT JOIN am USING (symbol, date)),
ie AS (SELECT o_orderkey AS event_id, o_orderdate::DATE AS date, CASE WHEN o_orderkey % 11 = 0 THEN 'invalid_event_entry_timestamp' WHEN o_orderdate::DATE NOT IN (SELECT date FROM il) THEN 'missing_options_day_aggs' ELSE 'ok' END AS market_second_status FROM orders)"""
INDEX_COLUMNS = {
    "underlying_close": "round(last, 6)", "underlying_vwap": "round(vwap, 6)", "underlying_return_in_buffer": "round(ret, 6)", "underlying_rows": "rows", "candidate_contracts": "candidates",
    "priced_contracts": "priced", "valid_pair_count": "pairs", "atm_iv_proxy": "round(iv, 6)", "skew_proxy": "round(skew, 6)", "option_volume_sum": "volume", "status": "status",
}


def _index_columns(symbol: str) -> str:
    s = symbol.lower()
    known = f"CASE WHEN market_second_status = 'ok' THEN coalesce({s}.underlying_status, 'missing_underlying_day_aggs') END AS {s}_second_underlying_status"
    own = {n: x.replace("(", f"({s}.") if "(" in x else f"{s}.{x}" for n, x in INDEX_COLUMNS.items()}
    return ", ".join([known, *[f"CASE WHEN market_second_status = 'ok' THEN {x} END AS {s}_second_{n}" for n, x in own.items()]])


@query(f"WITH {INDEX} SELECT event_id, market_second_status, {_index_columns('SPY')}, {_index_columns('QQQ')} FROM ie LEFT JOIN dy spy ON spy.symbol = 'SPY' AND spy.date = ie.date LEFT JOIN dy qqq ON qqq.symbol = 'QQQ' AND qqq.date = ie.date")
def index_covariates(spark, sf):
    li, o = load(spark, sf, "lineitem"), load(spark, sf, "orders")
    day, q, n = F.to_date("l_shipdate"), F.col("l_quantity"), F.col("l_linenumber")
    at = lambda minutes: day.cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), minutes.cast("int"))
    symbol, dte = F.when(F.col("l_suppkey") % 2 == 0, "SPY").otherwise("QQQ"), (7 * (1 + n % 2)).cast("int")
    tick, close = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"), F.col("l_extendedprice") / 10000
    right = F.when(F.col("l_orderkey") % 2 == 1, "call").otherwise("put")
    opts = li.select(symbol.alias("symbol"), day.alias("date"), tick.alias("options_ticker"), F.date_add(day, dte).alias("expiration"), (98.0 + 4 * (F.col("l_partkey") % 2)).alias("strike"), right.alias("right"), dte.alias("dte"), close.alias("option_close"))
    spots = opts.select("symbol", "date", F.lit(100.0).alias("spot")).distinct().where((F.dayofmonth("date") % 13 > 0) | (F.col("symbol") == "QQQ"))
    trades = li.where("l_quantity > 10").select(tick.alias("options_ticker"), at(F.lit(1190)).alias("ts"), close.alias("option_vwap"), q.alias("volume"), F.lit(1).alias("transactions"))
    under = li.select(symbol.alias("symbol"), at(1080 + 17 * n).alias("ts"), (100 + close / 100).alias("close"), q.alias("volume"), F.lit(1).alias("transactions"))
    entry = F.when(F.col("o_orderkey") % 11 > 0, F.to_date("o_orderdate").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(20)))
    e = o.select(F.col("o_orderkey").alias("event_id"), F.to_date("o_orderdate").alias("entry_date"), entry.alias("event_entry_timestamp"))
    out = covariates.index_covariates(e, opts, spots, under, trades, volatility=0.2 + F.col("volume") / 100)
    names = [f"{s}_second_{c}" for s in ("spy", "qqq") for c in ("underlying_status", *INDEX_COLUMNS)]
    return rounded(out.select("event_id", "market_second_status", *names), 6)


# the plan's steps with the options of the ticker's own orders that day, whose volatility is given
LONG = f"""{PLAN}, {OPT}, so AS (SELECT ticker::BIGINT AS ticker, date, expiration, strike, side, expiration - date AS dte, 90.0::DOUBLE + day(date) % 20 AS spot, 0.2 + sum(volume) / 100 AS iv FROM op WHERE close > 0 AND expiration - date BETWEEN 3 AND 45 GROUP BY 1, 2, 3, 4, 5),
su AS (SELECT ticker, date, count(*) FILTER (pair) AS pairs FROM (SELECT ticker, date, count(DISTINCT side) >= 2 AS pair FROM so GROUP BY ticker, date, expiration, strike) GROUP BY 1, 2),
ch AS (SELECT * FROM so QUALIFY row_number() OVER (PARTITION BY ticker, date, expiration, side ORDER BY abs(strike / spot - 1), strike) <= 4),
ps AS (SELECT ticker, date, expiration, strike, avg(iv) AS iv, any_value(dte) AS dte, any_value(spot) AS spot FROM ch GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT side) = 2),
am AS (SELECT * FROM ps QUALIFY row_number() OVER (PARTITION BY ticker, date ORDER BY abs(strike / spot - 1), abs(dte - 14), expiration, strike) = 1),
re AS (SELECT ticker, date, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM days), rv AS (SELECT ticker, date, ret, CASE WHEN count(ret) OVER w >= 2 THEN var_samp(ret) OVER w END AS rv FROM re WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
lv AS (SELECT o_orderdate::DATE AS d, count(*) AS level FROM orders WHERE day(o_orderdate) % 9 > 0 GROUP BY 1), ld AS (SELECT source_date, CASE WHEN source_date - d <= 5 THEN level END AS level FROM (SELECT DISTINCT source_date FROM plan) ASOF LEFT JOIN lv ON source_date > d)"""


@query(f"WITH {LONG} SELECT event_id, seq_index::BIGINT AS seq_index, source_date, pairs AS valid_pair_count, round(iv, 6) AS atm_iv_proxy, coalesce(pairs > 0 AND iv IS NOT NULL, false) AS is_valid_sequence_day, round(ret + 1e-7, 5) AS ret, round(rv + 1e-7, 5) AS rv5, level FROM plan LEFT JOIN su ON su.ticker = plan.ticker AND su.date = source_date LEFT JOIN am ON am.ticker = plan.ticker AND am.date = source_date LEFT JOIN rv ON rv.ticker = plan.ticker AND rv.date = source_date LEFT JOIN ld USING (source_date)")
def surface_sequence_long(spark, sf):
    one = option_table(spark, sf).where("close > 0").groupBy("ticker", "date", "expiration", "strike", "right").agg(F.max("close").alias("close"), F.sum("volume").alias("volume"))
    opts = one.select(F.col("ticker").cast("bigint").alias("ticker"), "date", "expiration", "strike", "right", F.datediff("expiration", "date").alias("dte"), F.col("close").alias("option_close"), F.col("volume").alias("option_volume"), F.lit(1).alias("option_transactions"), (90.0 + F.dayofmonth("date") % 20).alias("spot"))
    levels = load(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date")).where(F.dayofmonth("date") % 9 > 0).groupBy("date").agg(F.count("*").alias("level"))
    out = surface.surface_sequence_long(plan_of(spark, sf), opts, day_bars(spark, sf), levels, volatility=0.2 + F.col("option_volume") / 100)
    lean = lambda c: F.round(F.col(c) + 1e-7, 5).alias(c)
    return out.select("event_id", F.col("seq_index").cast("long").alias("seq_index"), "source_date", "valid_pair_count", F.round("atm_iv_proxy", 6).alias("atm_iv_proxy"), "is_valid_sequence_day", lean("ret"), lean("rv5"), "level")
