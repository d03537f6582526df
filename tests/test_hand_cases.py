"""Cases whose results were worked out by hand, and ranks, quantiles and falls against pandas and numpy."""

import datetime as dt
import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.functions import black_scholes
from panelspark.operators import asof, comparison, features, filings, identity, metrics, models, options, panel, quality, quotes, ranks, strategy, surface, variance
from panelspark.sources import scans, tables
from panelspark.streaming import marks


def day(text):
    return dt.date.fromisoformat(text)


def ts(text):
    return dt.datetime.fromisoformat(text)


@pytest.mark.parametrize(("first", "second", "code"), [(0.8, 0.68, None), (1.0, 0.4, variance.NONMONOTONE), (0.3, 0.5, variance.NEGATIVE), (None, 0.5, variance.STALE), (0.0, 0.5, variance.NONPOSITIVE)])
def test_two_expiry_variance(spark, first, second, code):
    events = spark.createDataFrame([("e", day("2025-02-20"), day("2025-02-21"))], "event_id string, event_date date, exit_date date")
    points = spark.createDataFrame([("e", day("2025-02-20"), 1, 9.0), ("e", day("2025-03-02"), 10, first), ("e", day("2025-03-09"), 17, second)], "event_id string, expiration date, dte_days int, iv double")
    r = variance.two_expiry_variance(points, events).head()
    assert r.ivar_failure_reason == code
    if code is None:
        t1, t2 = 10 / 365, 17 / 365
        w1, w2 = first**2 * t1, second**2 * t2
        assert r.ivar_event == pytest.approx((t2 * w1 - t1 * w2) / (t2 - t1)) and r.expiry_gap_days == 7
    else:
        assert r.ivar_event is None
    assert variance.two_expiry_variance(points.limit(1), events).head().ivar_failure_reason == variance.TOO_FEW
    with pytest.raises(Exception, match="mixed"):
        variance.two_expiry_variance(points.withColumn("time_convention", F.lit("VENDOR")), events).collect()


def test_returns_ignore_prices_that_are_none(spark):
    windows = spark.createDataFrame([("a", day("2025-01-02"), day("2025-01-03"), None), ("b", day("2025-01-02"), day("2025-01-03"), None), ("a", day("2025-01-02"), day("2025-01-03"), "non_bmo_amc")], "ticker string, entry_date date, exit_date date, exclusion_reason string")
    bars = spark.createDataFrame([("a", day("2025-01-02"), 99.0, 100.0), ("a", day("2025-01-03"), 105.0, 110.0), ("b", day("2025-01-02"), 1.0, float("nan")), ("b", day("2025-01-03"), -1.0, float("inf"))], "ticker string, date date, open double, close double")
    out = {(r.ticker, r.exclusion_reason): r for r in panel.return_targets(windows, bars, "ticker").collect()}
    good = out["a", None]
    assert good.rvar_day == pytest.approx(math.log(1.1) ** 2) == pytest.approx(0.0090840304) and abs(good.residual) < 1e-12
    assert good.rvar_reconstructed == pytest.approx(good.rvar_day) and good.open_after_status == "vendor_regular_ohlc_assumed"
    for key in (("b", None), ("a", "non_bmo_amc")):
        assert out[key].rvar_day is None and out[key].open_after_status == "unavailable"


def test_liquidity_and_universe(spark):
    rows = [("AAA", "2025-01-10", 2.0, 5.0, 100), ("BBB", "2025-02-10", None, 3.0, 10_000), ("CCC", "2025-03-20", 4.0, 4.0, 7)]
    bars = spark.createDataFrame([(t, day(d), v, c, n) for t, d, v, c, n in rows], "ticker string, date date, vwap double, close double, volume long")
    month = panel.month_liquidity(bars, "ticker", "date", F.coalesce("vwap", "close"), F.col("volume"))
    assert {r.ticker: r.liquidity for r in month.collect()}["BBB"] == 3.0 * 10_000 * 100
    top = {(r.universe_month, r.ticker): r["rank"] for r in panel.trailing_universe(month, 2, 2).collect()}
    assert top[day("2025-03-01"), "BBB"] == 1 and top[day("2025-03-01"), "AAA"] == 2 and (day("2025-04-01"), "AAA") not in top
    events = spark.createDataFrame([(1, "AAA", day("2025-03-15")), (2, "CCC", day("2025-03-15")), (3, "AAA", None)], "event_id int, ticker string, date date")
    found = {r.event_id: (r.universe_rank, r.universe_filter_status) for r in panel.universe_membership(events, panel.trailing_universe(month, 2, 2), "ticker", "date").collect()}
    assert found == {1: (2, "in_universe"), 2: (None, "no_universe_membership"), 3: (None, "bad_event_month")}


def test_window_price(spark):
    bars = spark.createDataFrame([("o", ts("2025-01-03T14:34:00"), 5.0, 1), ("o", ts("2025-01-03T14:36:00"), 6.0, 2), ("o", ts("2025-01-03T14:45:00"), 7.0, 3), ("o", ts("2025-01-03T14:40:00"), float("nan"), 9)], "options_ticker string, ts timestamp, option_vwap double, volume long")
    asked = spark.createDataFrame([(1, "o", ts("2025-01-03T14:35:00"), ts("2025-01-03T14:45:00")), (2, "o", ts("2025-01-03T15:00:00"), ts("2025-01-03T15:05:00"))], "id int, options_ticker string, start_ts timestamp, end_ts timestamp")
    out = {r.id: r for r in asof.interval_vwap(bars, asked, ["options_ticker"], "ts", "option_vwap", "volume", ["id"]).collect()}
    assert out[1].vwap == pytest.approx(6.6) and out[1].age_seconds == 0 and out[2].status == "no_trade_in_cutoff_window"
    with pytest.raises(Exception, match="end after"):
        asof.interval_vwap(bars, asked.withColumn("end_ts", F.col("start_ts")), ["options_ticker"], "ts", "option_vwap", "volume", ["id"]).collect()


def test_straddle_falls_back_to_its_intrinsic_value(spark):
    events = spark.createDataFrame([("e", "T", day("2025-02-20"), day("2025-02-21"), 100.0, 108.0, None)], "event_id string, ticker string, entry_date date, exit_date date, s_before double, s_after double, open_after double")
    legs = [("e", day("2025-02-28"), 100.0, "call", "C", 6.0, "ok", 5, 1), ("e", day("2025-02-28"), 100.0, "put", "P", 5.8, "ok", 5, 1), ("e", day("2025-02-28"), 90.0, "put", "Q", 1.0, "ok", 5, 1)]
    prices = spark.createDataFrame(legs, "event_id string, expiration date, strike double, right string, options_ticker string, proxy_price double, proxy_status string, proxy_volume long, proxy_transactions long")
    r = options.straddle_diagnostics(prices, events).head()
    assert r.entry_premium_usd == pytest.approx(1180) and r.exit_option_value_usd == pytest.approx(800) and r.gross_proxy_pnl_usd == pytest.approx(-380)
    assert r.used_intrinsic_fallback and r.option_exit_price_status == options.NO_PRECLOSE and r.c2o_proxy_pnl_status == "missing_open_after"


def test_marks_confidence_fills_and_quoted_variance(spark):
    rq = [("e", "C", "call", quotes.ENTRY, 0), ("e", "P", "put", quotes.ENTRY, 0), ("e", "C", "call", quotes.EXIT, 1), ("e", "P", "put", quotes.EXIT, 1)]
    start = [ts("2025-02-20T20:45:00"), ts("2025-02-21T20:45:00")]
    end = [ts("2025-02-20T21:00:00"), ts("2025-02-21T21:00:00")]
    requests = spark.createDataFrame([(e, o, r, w, start[i].date(), start[i], end[i], day("2025-02-28"), 100.0, 100.0, "T", day("2025-02-20"), "AMC", day("2025-02-20"), day("2025-02-21")) for e, o, r, w, i in rq], "event_id string, options_ticker string, right string, window_label string, quote_date date, window_start timestamp, window_end timestamp, expiration date, strike double, spot double, ticker string, announcement_date date, announcement_timing string, entry_date date, exit_date date")
    q = [("C", end[0], 4.9, 5.1), ("C", start[0], 1.0, 1.1), ("P", end[0], 4.9, 5.1), ("P", end[0] + dt.timedelta(seconds=1), 9.0, 9.1), ("C", end[1], 4.5, 4.7), ("C", end[1], float("nan"), 1.0), ("P", end[1], 3.8, 5.2), ("P", end[1], 8.0, 7.0)]
    ticks = spark.createDataFrame(q, "options_ticker string, ts timestamp, bid double, ask double").withColumn("quote_date", F.to_date("ts"))
    m = quotes.window_marks(ticks, requests)
    assert sorted(r.quote_status for r in m.collect()) == ["ok", "ok", "ok", "wide_spread"]
    c = quotes.execution_confidence(m).head()
    assert c.execution_confidence_score == pytest.approx(0.875) and c.execution_confidence_band == "high" and c.max_quote_age_seconds == 0
    s = quotes.straddle_execution(m).head()
    assert s.entry_mid_cost_usd == pytest.approx(1000) and s.quote_mid_pnl_usd == pytest.approx(-90) and s.complete_mid_pair and not s.complete_bidask_pair
    assert {r.execution_side: round(r.long_fill_price, 6) for r in quotes.execution_legs(m).where("right = 'call'").collect()} == {"buy_to_open": 5.1, "sell_to_close": 4.5}
    two = spark.createDataFrame([("e", day("2025-02-28"), 0.01), ("e", day("2025-03-07"), 0.015)], "event_id string, expiration date, v double")
    pairs = two.select("event_id", "expiration", F.lit(100.0).alias("strike"), F.lit(100.0).alias("spot"), F.col("v").alias("quote_premium_var_mid"), F.col("v").alias("quote_premium_var_ask"), F.lit(True).alias("complete_mid_pair"), F.lit(False).alias("complete_bidask_pair"), F.lit("AMC").alias("announcement_timing"), F.lit(day("2025-02-20")).alias("announcement_date"), F.lit(day("2025-02-20")).alias("entry_date"), F.lit(None).cast("date").alias("exit_date"))
    r = quotes.quote_ivar(pairs).head()
    assert r.quote_mid_ivar_event == pytest.approx((15 * 0.01 - 8 * 0.015) / 7) and r.quote_ask_ivar_failure_reason == variance.STALE


def test_history_of_one_instant_is_not_seen(spark):
    rows = [("a", "T", ts("2025-01-01T10:00:00"), 0.01), ("b", "T", ts("2025-02-01T10:00:00"), 0.02), ("c", "T", ts("2025-02-01T10:00:00"), 0.03), ("d", "T", ts("2025-03-01T10:00:00"), None), ("x", "U", ts("2025-03-01T10:00:00"), 0.5)]
    e = spark.createDataFrame(rows, "event_id string, ticker string, at timestamp, rvar double").withColumn("ivar_event", F.lit(0.015))
    h = {r.event_id: r for r in features.earnings_history(e, "ticker", "at", "event_id", {"day": "rvar"}).collect()}
    assert h["b"].prior_earnings_count == h["c"].prior_earnings_count == 1 and h["b"].prior_day_rvar_median == h["c"].prior_day_rvar_median == 0.01
    w = np.exp(np.linspace(-1.5, 0, 3))
    assert h["d"].prior_day_rvar_ewm == pytest.approx(np.average([0.01, 0.02, 0.03], weights=w)) and h["d"].prior_day_rvar_gt_ivar_hit_rate == pytest.approx(2 / 3)
    last = {r.event_id: r.prior_last_mean for r in features.prior_last_mean(e, "ticker", "at", "event_id", "rvar", 2).collect()}
    assert last == {"a": None, "b": 0.01, "c": 0.01, "d": pytest.approx(0.025), "x": None}
    out = {r.event_id: r for r in features.benchmarks(e, "ticker", "at", "event_id", "rvar").collect()}
    assert out["a"].forecast_last_four_rvar == 0.015 and out["a"].fallback_spread_used and out["x"].forecast_last_four_rvar == pytest.approx(0.02)


def test_facts_are_known_from_acceptance_or_the_day_after_filing(spark):
    e = spark.createDataFrame([("e", "T", ts("2025-01-10T20:00:00"))], "event_id string, ticker string, at timestamp")
    rows = [("T", 100.0, ts("2025-01-02T12:00:00"), day("2025-01-02"), 1), ("T", 200.0, ts("2025-01-10T21:00:00"), day("2025-01-10"), 2), ("T", 300.0, None, day("2025-01-10"), 3), ("T", 90.0, None, day("2025-01-01"), 4), ("T", None, ts("2025-01-09T12:00:00"), day("2025-01-09"), 5)]
    f = spark.createDataFrame(rows, "ticker string, val double, accepted timestamp, filed date, n int")
    r = asof.gated_latest(e, f, ["ticker"], "at", "accepted", "filed", ["n"], "val").head()
    assert (r.latest, r.previous) == (100.0, 90.0)


def test_vix_changes_and_strictness(spark):
    days = [day("2025-01-01") + dt.timedelta(days=i) for i in range(60)]
    raw = spark.createDataFrame([(str(d), str(10.0 + i), i) for i, d in enumerate(days)] + [("2025-03-02", ".", 60), ("?", "3", 61)], "DATE string, VIXCLS string, line int")
    daily = features.vix_daily(raw)
    assert daily.count() == 61 and daily.where("is_holiday_or_missing").count() == 1
    e = spark.createDataFrame([(1, day("2025-02-20"), "AMC"), (2, day("2025-02-20"), "BMO"), (3, day("2025-03-06"), "BMO"), (4, day("2025-03-07"), "BMO"), (5, None, "AMC")], "id int, d date, timing string")
    out = {r.id: r for r in features.vix_features(daily, e, "d", "timing", same_day_amc=True).collect()}
    assert out[1].vix_date == day("2025-02-20") and out[2].vix_date == day("2025-02-19") and out[2].vix_change_1d == 1 and out[2].vix_change_5d == 5 and out[2].vix_regime_tercile == "high"
    assert out[3].vix_lag_days == 5 and not out[4].vix_available and not out[5].vix_available


def test_caps_scale_edges_along(spark):
    t = spark.createDataFrame([(1, "d", "A", 60.0, 10.0), (2, "d", "A", 10.0, 10.0), (3, "d", "B", 60.0, 10.0), (4, "x", None, 50.0, -1.0)], "id int, date string, sector string, loss double, edge double")
    got = {r.id: r.loss for r in strategy.portfolio_caps(t, 1000.0, "date", "sector", "edge", "loss", 1.0, 0.06, 0.02).collect()}
    assert got == {1: pytest.approx(5), 2: pytest.approx(10), 3: pytest.approx(20), 4: pytest.approx(20)}
    assert strategy.portfolio_caps(t, 1000.0, "date", "sector", "edge", "loss", 0.03, 1.0, 1.0).where("loss > 30.0001").count() == 0
    cost = strategy.half_spread_cost(spark.createDataFrame([("q", 4.0, 4.4)], "k string, bid double, ask double"), ["k"]).head()
    assert cost.transaction_cost == pytest.approx(20)


def test_payoff_nodes_are_a_normal_move(spark):
    nodes = strategy.hermite_nodes()
    assert sum(w for _, w in nodes) == pytest.approx(1) and sum(w * x * x for x, w in nodes) == pytest.approx(1) and sum(w * x for x, w in nodes) == pytest.approx(0, abs=1e-12)
    legs = spark.createDataFrame([("k", 100.0, 0.0, 90.0, "call", "long", 1.0, 3.0), ("k", 100.0, 0.0, 110.0, "call", "short", 1.0, 1.0)], "key string, spot double, v double, strike double, right string, side string, contracts double, price double")
    r = strategy.strategy_value(legs, ["key"], "spot", "v").head()
    assert r.expected_value == pytest.approx(1000) and r.entry_cost == pytest.approx(200)


def test_metrics_count_finite_rows_only(spark):
    nan = float("nan")
    rows = [(1, 1.0, 2.0, 4.0), (2, 3.0, 2.0, None), (3, nan, 2.0, 1.0), (4, 2.0, 2.0, nan), (5, 2.0, 3.0, 1.0)]
    df = spark.createDataFrame(rows, "id int, f double, y double, b double")
    r = metrics.forecast_metrics(df, [], "f", "y", "b").head()
    assert (r.n, r.n_forecast_target) == (2, 4) and r.mae == 1.0 and r.oos_r2 == pytest.approx(1 - 2 / 8)
    few = metrics.cluster_inference(df.withColumn("m", F.lit("x")), ["m"], "f", "y", "b", ["id"]).head()
    assert few.status == "insufficient_rows" and few.two_way_se is None
    gains = spark.createDataFrame([("a", 1, 0.0, 1.0, 3.0), ("a", 2, 0.0, 1.0, 2.0), ("b", 1, 0.0, 1.0, 1.0), ("b", 2, 1.0, 1.0, 4.0), ("c", 3, 1.0, 1.0, 2.0)], "t string, d int, f double, y double, b double")
    g = metrics.cluster_inference(gains, [], "f", "y", "b", ["t", "d"]).head()
    diff = np.array([3.0, 0.0, -1.0, 9.0, 1.0])
    by_t = np.array([diff[:2].mean(), diff[2:4].mean(), diff[4]])
    assert g.mean_gain == pytest.approx(diff.mean()) and g.plain_se == pytest.approx(diff.std(ddof=1) / math.sqrt(5)) and g.t_se == pytest.approx(by_t.std(ddof=1) / math.sqrt(3))
    assert g.two_way_se == pytest.approx((g.t_se + g.d_se) / 2)


def test_buckets_and_quantiles_agree_with_pandas(spark):
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 23, 100):
        data = pd.DataFrame({"id": range(n), "v": rng.integers(0, 12, n).astype(float), "w": rng.normal(size=n)})
        df = spark.createDataFrame(data)
        first = ranks.buckets(df, "w", "id", [], 10, "b").toPandas().set_index("id").b.sort_index()
        want = pd.qcut(data.w.rank(method="first"), q=min(10, n), labels=False, duplicates="drop")
        assert first.tolist() == want.tolist()
        tied = ranks.tied_buckets(df, "v", [], 10, "b").toPandas().set_index("id").b.sort_index()
        if data.v.nunique() > 1:
            assert tied.tolist() == pd.qcut(data.v.rank(method="average"), q=min(10, n), labels=False, duplicates="drop").tolist()
        else:
            assert set(tied) == {0}
        q = ranks.quantiles(df, "w", [], {"a": 0.05, "b": 0.5, "c": 0.97}).head()
        assert np.allclose(list(q), np.quantile(data.w, [0.05, 0.5, 0.97]))
        assert np.allclose(ranks.average_rank(df, "v", [], "r").toPandas().set_index("id").r.sort_index(), data.v.rank())
        curve = data.w.cumsum()
        assert metrics.max_drawdown(df, [], ["id"], "w").head().max_drawdown == pytest.approx((curve - curve.cummax()).min())
    assert ranks.quantiles(df.limit(0), "w", ["id"], {"a": 0.5}).count() == 0


def test_implied_volatility_reprices(spark):
    rows = [(s, k, t, v, c) for s in (50.0, 100.0) for k in (45.0, 100.0, 120.0) for t in (0.02, 0.5) for v in (0.1, 0.4, 2.0) for c in (True, False)]
    price = [float(black_scholes.price(np.array([s]), np.array([k]), np.array([t]), np.array([v]), np.array([c]))[0]) for s, k, t, v, c in rows]
    df = spark.createDataFrame([(*r, p) for r, p in zip(rows, price)], "s double, k double, t double, v double, c boolean, p double")
    out = df.withColumn("iv", black_scholes.implied_volatility(F.col("p"), F.col("s"), F.col("k"), F.col("t"), F.col("c"))).withColumn("again", black_scholes.option_price(F.col("s"), F.col("k"), F.col("t"), F.col("iv"), F.col("c"))).collect()
    for r in out:
        intrinsic = max(r.s - r.k, 0) if r.c else max(r.k - r.s, 0)
        if r.p - intrinsic > 1e-6:
            assert r.again == pytest.approx(r.p, abs=1e-9) and r.iv == pytest.approx(r.v, abs=1e-3)
    bad = spark.createDataFrame([(0.0, 50.0), (60.0, 50.0), (1e-12, 50.0)], "p double, s double").select(black_scholes.implied_volatility(F.col("p"), F.col("s"), F.lit(50.0), F.lit(0.1), F.lit(True)).alias("iv"))
    assert [r.iv for r in bad.collect()] == [None, None, None]


def test_streams_go_on_where_they_stopped(spark, tmp_path):
    requests = spark.createDataFrame([(1, "c", ts("2025-01-01T10:00:00"), ts("2025-01-01T11:30:00"))], "request_id long, contract string, start_ts timestamp, end_ts timestamp")
    schema = "contract string, ts timestamp, value double, volume long"
    source, folder = f"{tmp_path}/in", f"{tmp_path}/work"

    def land(*rows):
        spark.createDataFrame([("c", ts(t), v, n) for t, v, n in rows], schema).coalesce(1).write.mode("append").parquet(source)

    (tmp_path / "in").mkdir()
    assert marks.run_marks(spark, source, schema, requests, folder).count() == 0
    land(("2025-01-01T10:30:00", 5.0, 2), ("2025-01-01T12:00:00", 9.0, 2))
    assert [tuple(r) for r in marks.run_marks(spark, source, schema, requests, folder).select("request_id", "value").collect()] == [(1, 5.0)]
    assert marks.run_marks(spark, source, schema, requests, folder).head().value == 5.0  # nothing new
    land(("2025-01-01T10:10:00", 7.0, 4), ("2025-01-01T11:30:00", 6.0, 0))  # one late, one at the end
    assert marks.run_marks(spark, source, schema, requests, folder).head().value == 6.0
    r = marks.run_vwap(spark, source, schema, requests, f"{folder}-sums").head()
    assert r.vwap == pytest.approx((5 * 2 + 7 * 4) / 6) and r.rows == 2


def test_scans_count_what_they_read(spark):
    q = spark.createDataFrame([("c", day("2025-01-01"), ts("2025-01-01T10:00:00")), ("c", day("2025-01-01"), ts("2025-01-01T12:00:00")), ("d", day("2025-01-01"), ts("2025-01-01T10:00:00"))], "options_ticker string, quote_date date, ts timestamp")
    r = spark.createDataFrame([("c", day("2025-01-01"), ts("2025-01-01T09:00:00"), ts("2025-01-01T10:00:00"))] * 2, "options_ticker string, quote_date date, window_start timestamp, window_end timestamp")
    out, scanned, matched = scans.scan_quotes(q, r)
    assert len(out.collect()) == 1 and scanned.get["rows"] == 3 and matched.get["rows"] == 1
    with pytest.raises(Exception, match="no option symbol"):
        scans.option_days(spark.createDataFrame([("junk", day("2025-01-01"))], "ticker string, date date"), strict=True).collect()
    told = tables.normalise_quotes(spark.createDataFrame([("c", 1.0, 3.0, 1_735_725_600_123_456_789)], "ticker string, bid_price double, ask_price double, sip_timestamp long")).head()
    assert told.ts == ts("2025-01-01T10:00:00.123456") and told.mid == 2.0 and told.quote_date == day("2025-01-01")


def test_small_sources(spark, tmp_path):
    raw = spark.createDataFrame([("a", day("2025-01-02"), "1", "2", "?", "1.5", "7")], "ticker string, date date, open string, high string, low string, close string, volume string")
    r = scans.underlying_days(raw).head()
    assert (r.ticker, r.high, r.low, r.volume) == ("A", 2.0, None, 7)
    bars = spark.createDataFrame([("C", day("2025-01-02"), 1.0), ("C", day("2025-01-03"), 2.0)], "options_ticker string, date date, option_vwap double")
    c = spark.createDataFrame([("C", day("2025-01-03"), day("2025-02-01"), 9.0, "call")] * 2, "options_ticker string, date date, expiration date, strike double, right string")
    assert [(r.option_vwap, r.strike) for r in scans.contract_bars(bars, c).collect()] == [(2.0, 9.0)]
    spark.createDataFrame([("x", 1.5), ("y", float("nan"))], "k string, v double").coalesce(1).write.csv(f"{tmp_path}/t.csv", header=True)
    assert {r.k: r.v for r in tables.read_table(spark, f"{tmp_path}/t.csv", "k string, v double").collect()}["x"] == 1.5
    spark.createDataFrame([("x", float("nan"), float("inf"))], "k string, v double, w double").write.parquet(f"{tmp_path}/t.parquet")
    assert tuple(tables.read_table(spark, f"{tmp_path}/t.parquet").head()) == ("x", None, None)


def test_names_that_leak():
    blocked, vendor = features.leaking_names(["prior_day_rvar_median", "prior_guidance_flag", "rvar_event", "s_after", "spy_return", "predicted_iv", "future"], ["predicted_iv"])
    assert blocked == ["future", "prior_guidance_flag", "rvar_event", "s_after"] and vendor == []
    assert features.allowed("prior_day_rvar_median", "double")[0] and not features.allowed("rvar_event", "double")[0] and not features.allowed("name", "string")[0]


def test_matrix_refuses_two_diagnostics_for_one_event(spark):
    e = spark.createDataFrame([("a", "T", 0.1, 0.2)], "event_id string, ticker string, rvar_event double, ivar_event double")
    two = spark.createDataFrame([("a", 1.0, 1.0, 1.0)] * 2, "event_id string, entry_premium_usd double, gross_proxy_pnl_usd double, haircut_pnl_usd double")
    with pytest.raises(Exception, match="unique"):
        features.feature_matrix(e, two).collect()


def test_bar_on_an_edge_is_in_both_bins(spark):
    e = spark.createDataFrame([("e", ts("2025-01-02T21:00:00"), 100.0)], "event_id string, event_entry_timestamp timestamp, s_before double")
    c = spark.createDataFrame([("e", "C", day("2025-01-10"), 100.0, "call", 8), ("e", "P", day("2025-01-10"), 100.0, "put", 8)], "event_id string, options_ticker string, expiration date, strike double, right string, dte int")
    b = spark.createDataFrame([(o, ts("2025-01-02T20:05:00"), 2.0, 1, 1) for o in "CP"], "options_ticker string, ts timestamp, option_vwap double, volume long, transactions long")
    out = surface.intraday_surface(b, c, e).orderBy("bin").collect()
    assert [r.bin for r in out if r.hybrid_valid_step] == [0, 1] and len(out) == 12 and out[0].latest_option_trade_bar_age_seconds == 0 and out[1].latest_option_trade_bar_age_seconds == 300


def test_index_surfaces_side_by_side(spark):
    rows = [("SPY", day("2025-01-10"), 100.0, r, 8, 2.0, 3) for r in ("call", "put")] + [("SPY", day("2025-01-10"), 105.0, "call", 8, None, 0), ("QQQ", day("2025-01-10"), 100.0, "call", 8, 2.0, 1)]
    c = spark.createDataFrame(rows, "symbol string, expiration date, strike double, right string, dte int, vwap double, volume long").withColumns({"event_id": F.lit("e"), "spot": F.lit(100.0)})
    out = surface.index_surface(c, c, ["event_id", "symbol"])
    got = {r.symbol: r for r in out.collect()}
    assert got["SPY"].status == "ok" and got["SPY"].valid_pair_count == 1 and got["SPY"].surface_missing_rate == pytest.approx(1 - 1 / 1.5) and got["SPY"].straddle_premium_to_spot == pytest.approx(0.04)
    assert got["QQQ"].status == "no_prices" and got["QQQ"].priced_contracts == 1
    wide = surface.prefixed_by_symbol(out, "event_id", "symbol", ["SPY", "QQQ"], ["status"]).head()
    assert (wide.spy_second_status, wide.qqq_second_status) == ("ok", "no_prices")


def test_hybrid_sequence(spark):
    plan = spark.createDataFrame([("e", day("2025-01-02"), 18, day("2025-01-03"), ts("2025-01-03T21:00:00")), ("e", day("2025-01-03"), 19, day("2025-01-03"), ts("2025-01-03T21:00:00"))], "event_id string, source_date date, seq_index int, entry_date date, event_entry_timestamp timestamp")
    daily = spark.createDataFrame([("e", day("2025-01-02"), 0.5, True)], "event_id string, source_date date, atm_iv_proxy double, is_valid_sequence_day boolean")
    long = surface.sequence_long(plan, [daily], [["event_id", "source_date"]])
    assert [(r.seq_index, r.is_valid_sequence_day) for r in long.orderBy("seq_index").collect()] == [(18, True), (19, False)]
    bins = spark.createDataFrame([("e", 0, ts("2025-01-03T20:05:00"), 0.6, True, ts("2025-01-03T21:00:00"))], "event_id string, bin int, end_ts timestamp, atm_iv_proxy double, hybrid_valid_step boolean, event_entry_timestamp timestamp")
    out = surface.hybrid_sequence(surface.hybrid_daily(long), bins).orderBy("seq_index").collect()
    assert [(r.seq_index, r.step_type) for r in out] == [(18, "daily"), (19, "intraday")] and out[0].source_timestamp == ts("2025-01-02T21:00:00")
    assert out[1].log_delta_minutes_from_prev_step == pytest.approx(math.log1p(23 * 60 + 5)) and out[1].normalized_time_to_entry == pytest.approx(-55 / 28800)
    arrays = surface.sequence_arrays(surface.sequence_matrix(long, "event_id", ["atm_iv_proxy"]), "event_id", ["atm_iv_proxy"]).head()
    assert arrays.x[18] == [0.5] and arrays.mask[18:] == [[True], [False]] and len(arrays.x) == 20


def test_constraints_folds_and_availability(spark):
    q = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, 2.0), (3, None, 1.0)], "id int, bid double, ask double")
    assert [r.id for r in quality.violations(q, quality.quote_rules()).collect()] == [2]
    assert quality.enforced(q.where("id <> 2"), quality.quote_rules()).count() == 2
    with pytest.raises(Exception, match="row constraint"):
        quality.enforced(q, quality.quote_rules()).collect()
    rows = spark.range(12).select("id", F.when(F.col("id") < 8, "train").when(F.col("id") < 10, "validation").otherwise("test").alias("split"), F.when(F.col("id") != 9, 1.0).alias("f"))
    folds = {r.id: r.fold for r in models.time_folds(rows, ["id"], 3).collect()}
    assert [folds[i] for i in range(12)] == [0] * 3 + [1] * 3 + [2] * 3 + [3] * 3
    folds = {r.id: r.fold for r in models.time_folds(spark.range(14), ["id"], 3).collect()}
    assert [folds[i] for i in range(14)] == [0] * 5 + [1] * 3 + [2] * 3 + [3] * 3
    assert tuple(models_row for models_row in strategy.availability(rows, "f").head()) == (11, 1, 2)
    assert models.skip_reason(rows, "f") == "skipped_insufficient_train_rows"
    assert features.model_columns(spark.createDataFrame([(1, 2.0, "x", 3.0)], "cik int, vix double, name string, seqagg_v double"), False) == ["vix"]
    signal = spark.createDataFrame([(0.1, 0.3, 0.2, 5.0, 9.0, 4.0), (0.2, 0.3, 0.2, 5.0, 9.0, 4.0)], "edge_var double, forecast double, ivar double, expected_edge double, expected_value double, entry_cost double")
    assert quality.violations(signal, quality.signal_rules()).count() == 1


def test_bootstrap_interval_holds_the_lift(spark):
    rng = np.random.default_rng(1)
    rows = [(i, m, float(e * (m == "a") + rng.normal()), float(e)) for i in range(200) for e in [rng.normal()] for m in "ab"]
    long = spark.createDataFrame(rows, "event_id int, model string, score double, edge double")
    lift = comparison.pairwise_auc(long, [], "model", "event_id", "score", "edge").head().auc_lift
    r = comparison.bootstrap_auc(long, [], "model", "event_id", "score", "edge", 100).head()
    assert r.bootstrap_iter == 100 and r.auc_lift_ci_low < lift < r.auc_lift_ci_high and r.auc_lift_ci_low > 0


@pytest.mark.parametrize("white", [" ", "\u00a0", "\u2009", "\u3000", "\x1c", "\u00a0 \n"])
def test_white_space_of_filings(spark, white):
    """What counts as white space in a text isn't ASCII alone."""
    texts = [(1, f"Item{white}2.02 results for the quarter{white}ended May 3"), (2, f"Item{white}2.02 nothing else"), (3, white)]
    got = dict(filings.classify_filing(spark.createDataFrame(texts, "id int, text string"), "text").select("id", "status").collect())
    assert got == {1: "validated_earnings_release", 2: "ambiguous_item_2_02_text", 3: "not_item_2_02_text"}
    calendar = spark.createDataFrame([(f"{white}bmo{white}",)], "announcement_timing string")
    assert filings.validate_calendar(calendar).head().announcement_timing == "BMO"
    assert spark.createDataFrame([(f"{white}2024-05-01T10:00:00Z{white}",)], "t string").select(filings.aware_timestamp(F.col("t")).isNotNull()).head()[0]


def test_filters_on_doubles_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([(1, 2.0), (2, 5.0), (3, float("nan")), (4, None)], "id int, v double").write.parquet(f"{tmp_path}/t.parquet")
    out = tables.read_table(spark, f"{tmp_path}/t.parquet", where=F.col("v") > 3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(v,3.0)" in plan.split("PushedFilters: ")[1].split("]")[0]
    assert [r.id for r in out.collect()] == [2]


def test_event_ids_and_their_dates(spark):
    one = spark.createDataFrame([("aa", day("2025-01-02"), ts("2025-01-03T10:00:00"))], "ticker string, announcement_date date, event_entry_timestamp timestamp")
    assert identity.date_column(one) == "event_entry_timestamp" and identity.with_event_id(one).head().event_id == "AA_2025-01-03"
    assert identity.with_event_id(one.drop("event_entry_timestamp")).head().event_id == "AA_2025-01-02"
    with pytest.raises(ValueError, match="none of"):
        identity.with_event_id(one.select("ticker"))
    assert identity.checked_event_ids(one.withColumn("entry_date", F.lit("2025-01-03"))).head().event_id == "AA_2025-01-03"
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "event_id string")
    assert identity.checked_event_ids(ids("a", "b")).count() == 2
    for bad, why in ((("a", None), "not empty"), (("a", " "), "not empty"), (("a", "b", "a"), "unique: a")):
        with pytest.raises(Exception, match=why):
            identity.checked_event_ids(ids(*bad)).collect()


def test_digests_of_contents(spark, tmp_path):
    rows = [(1, "a", 2.0), (2, None, 1.0), (2, "", 1.0)]
    df = spark.createDataFrame(rows, "i int, s string, x double")
    digest = lambda d: tuple(identity.table_digest(d, ["i", "s", "x"]).head())
    assert digest(df) == digest(spark.createDataFrame(rows[::-1], df.schema).repartition(3)) != digest(df.unionByName(df.limit(1)))
    assert digest(spark.createDataFrame([rows[0], rows[1], rows[1]], df.schema)) != digest(df) and digest(df.limit(0))[0] == 0
    (tmp_path / "f.bin").write_bytes(b"\x00abc")
    got = identity.content_hashes(spark.read.format("binaryFile").load(str(tmp_path))).head()
    assert got.bytes == 4 and got.sha256 == hashlib.sha256(b"\x00abc").hexdigest()
    told = spark.createDataFrame([('{"a": 1, "b": {"c": [1, 2]}}', '{"b": {"c": [1, 2]}, "a": 1}'), ('{"a": 1}', '{"a": 2}'), ('{"a": 1}', None), ("x", "x")], "p string, q string")
    assert [r[0] for r in told.select(identity.same_parameters(F.col("p"), F.col("q"))).collect()] == [True, False, False, False]
    frame = spark.createDataFrame([("a,b", 1.5), ('say "x"', None), (None, 2.0), ("", 3.0)], "s string, v double")
    for name in ("t.csv", "t.csv.gz", "t.parquet"):
        tables.write_table(frame, f"{tmp_path}/{name}")
        want = frame if name == "t.parquet" else frame.withColumn("s", F.nullif("s", F.lit("")))
        assert sorted(map(str, tables.read_table(spark, f"{tmp_path}/{name}", "s string, v double").collect())) == sorted(map(str, want.collect())), name
