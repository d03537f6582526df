"""Queries on quotes: marks in windows, confidence, fills, straddles, quoted variances, and the streams of marks and prices."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from panelspark.operators import quotes
from panelspark.operators.staging import shared_folder
from panelspark.plans.common import TICKS, load, query, rounded, ticks
from panelspark.sources import tables
from panelspark.streaming import marks

# every purchase asks for a quarter's quotes before it and a day's after it; its contract's strike, right and expiry come from its id
WINDOW = """rq AS (SELECT event_id // 8 AS event_id, contract AS options_ticker, unnest([{'l': 'entry_preclose_15m', 'a': ts - INTERVAL 2 DAY, 'b': ts}, {'l': 'exit_preclose_15m', 'a': ts, 'b': ts + INTERVAL 3 DAY}]) AS w, event_id AS request, DATE '2024-06-01' + (event_id // 8 % 3 * 7 + event_id % 3 * 14)::INT AS expiration, 90 + event_id // 2 % 2 * 10 AS strike, CASE WHEN event_id % 2 = 0 THEN 'call' ELSE 'put' END AS side FROM ticks WHERE event_type = 'purchase'),
qs AS (SELECT contract, ts, event_id, value - 5 AS bid, value - 5 + (event_id % 7 - 1) AS ask FROM ticks),
hit AS (SELECT rq.request, w.l AS l, any_value(w.b) AS w_end, any_value(rq.event_id) AS event_id, any_value(rq.expiration) AS expiration, any_value(rq.strike) AS strike, any_value(rq.side) AS side, count(qs.ts) AS quote_count, arg_max({'b': bid, 'a': ask, 't': ts}, {'t': ts, 'e': qs.event_id}) FILTER (bid >= 0 AND ask > 0 AND ask >= bid) AS q FROM rq LEFT JOIN qs ON qs.contract = rq.options_ticker AND qs.ts BETWEEN w.a AND w.b GROUP BY 1, 2),
m1 AS (SELECT *, q.b AS bid, q.a AS ask, (q.b + q.a) / 2 AS mid, (q.a - q.b) / nullif((q.b + q.a) / 2, 0) AS sp, (epoch_us(w_end) - epoch_us(q.t)) / 1e6 AS age FROM hit),
mk AS (SELECT *, CASE WHEN quote_count = 0 THEN 'missing_quote' WHEN q IS NULL THEN 'invalid_bid_ask' WHEN age > 86400 THEN 'stale_quote' WHEN sp > 0.25 THEN 'wide_spread' ELSE 'ok' END AS status FROM m1), sc AS (SELECT *, CASE status WHEN 'ok' THEN 1.0 WHEN 'stale_quote' THEN 0.5 WHEN 'wide_spread' THEN 0.5 ELSE 0.0 END::DOUBLE AS score FROM mk)"""


def window_marks(spark, sf):
    n = lambda d: F.make_dt_interval(F.lit(d))
    i = F.col("event_id")
    t = ticks(spark, sf)
    window = lambda name, a, b: F.struct(F.lit(name).alias("window_label"), a.alias("window_start"), b.alias("window_end"))
    both = F.inline(F.array(window(quotes.ENTRY, F.col("ts") - n(2), F.col("ts")), window(quotes.EXIT, F.col("ts"), F.col("ts") + n(3))))
    expiration = F.date_add(F.lit("2024-06-01").cast("date"), (F.floor(i / 8) % 3 * 7 + i % 3 * 14).cast("int"))
    rq = t.where("event_type = 'purchase'").select(F.col("event_id").alias("request"), F.col("contract").alias("options_ticker"), F.floor(i / 8).alias("event_id"), expiration.alias("expiration"), (90 + F.floor(i / 2) % 2 * 10).cast("double").alias("strike"), F.when(i % 2 == 0, "call").otherwise("put").alias("right"), both)
    rq = rq.withColumns({"spot": F.lit(95.0), "entry_date": F.lit("2024-05-20").cast("date"), "exit_date": F.lit("2024-06-03").cast("date"), "announcement_date": F.lit("2024-06-01").cast("date"), "announcement_timing": F.lit("AMC")})
    q = t.select(F.col("contract").alias("options_ticker"), "ts", F.col("event_id").alias("tie"), (F.col("value") - 5).alias("bid"), (F.col("value") - 5 + (i % 7 - 1)).alias("ask"))
    return quotes.window_marks(q, rq, stale_seconds=86400, key=("request", "window_label"), tie=("tie",))


@query(f"WITH {TICKS}, {WINDOW} SELECT request, l AS window_label, quote_count, round(bid, 5) AS bid, round(ask, 5) AS ask, round(sp, 5) AS spread_over_mid, round(age, 6) AS quote_age_seconds, status AS quote_status, score AS quote_score FROM sc")
def quote_marks(spark, sf):
    out = window_marks(spark, sf)
    return out.select("request", "window_label", "quote_count", *[F.round(c, 5).alias(c) for c in ("bid", "ask", "spread_over_mid")], F.round("quote_age_seconds", 6).alias("quote_age_seconds"), "quote_status", "quote_score")


@query(f"WITH {TICKS}, {WINDOW}, c AS (SELECT event_id, count(*) AS required_quote_marks, count(*) FILTER (status = 'ok') AS ok_quote_marks, count(*) FILTER (status = 'stale_quote') AS stale_quote_marks, count(*) FILTER (status = 'wide_spread') AS wide_spread_marks, round(max(age), 6) AS max_quote_age_seconds, round(quantile_cont(sp, 0.5), 5) AS median_spread_over_mid, avg(score) AS s FROM sc GROUP BY 1) SELECT * EXCLUDE (s), round(s, 5) AS execution_confidence_score, CASE WHEN s >= 0.8 THEN 'high' WHEN s >= 0.5 THEN 'medium' WHEN s > 0 THEN 'low' ELSE 'missing' END AS execution_confidence_band FROM c")
def execution_confidence(spark, sf):
    out = quotes.execution_confidence(window_marks(spark, sf))
    five = lambda c: F.round(c, 5).alias(c)
    return out.select("event_id", "required_quote_marks", "ok_quote_marks", "stale_quote_marks", "wide_spread_marks", F.round("max_quote_age_seconds", 6).alias("max_quote_age_seconds"), five("median_spread_over_mid"), five("execution_confidence_score"), "execution_confidence_band")


@query(f"WITH {TICKS}, {WINDOW} SELECT request, l AS window_label, CASE WHEN l LIKE 'entry%' THEN 'buy_to_open' ELSE 'sell_to_close' END AS execution_side, round(CASE WHEN l LIKE 'entry%' THEN ask ELSE bid END * 100, 4) AS long_fill_value_usd, round(mid * 100, 4) AS mid_fill_value_usd FROM sc")
def execution_legs(spark, sf):
    return rounded(quotes.execution_legs(window_marks(spark, sf)).select("request", "window_label", "execution_side", "long_fill_value_usd", "mid_fill_value_usd"))


# the smallest ticker's mark counts in each place of a straddle
STRADDLE = """tk AS (SELECT sc.*, options_ticker AS t FROM sc JOIN (SELECT event_id AS request, contract AS options_ticker FROM ticks) USING (request)), lg AS (SELECT *, row_number() OVER (PARTITION BY event_id, expiration, strike, l, side ORDER BY t, bid, mid, ask, status) AS n FROM tk),
pv AS (SELECT event_id, expiration, strike, """ + ", ".join(f"{'max' if c != 'status' else 'any_value'}({c}) FILTER (l LIKE '{w}%' AND side = '{r}' AND n = 1) AS {w}_{r}_{c}" for w in ("entry", "exit") for r in ("call", "put") for c in ("bid", "mid", "ask", "status")) + """ FROM lg GROUP BY 1, 2, 3),
sd AS (SELECT *, (entry_call_mid + entry_put_mid) * 100 AS entry_mid, (entry_call_ask + entry_put_ask) * 100 AS entry_ask, (exit_call_mid + exit_put_mid) * 100 AS exit_mid, (exit_call_bid + exit_put_bid) * 100 AS exit_bid FROM pv),
s2 AS (SELECT *, pow(entry_mid / 100 / 95, 2) AS vm, pow(entry_ask / 100 / 95, 2) AS va, coalesce(entry_call_status = 'ok' AND entry_put_status = 'ok' AND exit_call_status = 'ok' AND exit_put_status = 'ok', false) AS full_, coalesce(entry_call_status <> 'missing_quote' AND entry_put_status <> 'missing_quote' AND exit_call_status <> 'missing_quote' AND exit_put_status <> 'missing_quote', false) AND entry_mid IS NOT NULL AND exit_mid IS NOT NULL AS mids FROM sd)"""


@query(f"WITH {TICKS}, {WINDOW}, {STRADDLE} SELECT event_id, expiration, strike::DOUBLE AS strike, round(entry_ask, 4) AS entry_ask_cost_usd, round(exit_bid - entry_ask, 4) AS quote_bidask_pnl_usd, round(exit_mid - entry_mid, 4) AS quote_mid_pnl_usd, round(vm, 4) AS quote_premium_var_mid, full_ AS complete_bidask_pair, mids AS complete_mid_pair FROM s2")
def straddle_execution(spark, sf):
    out = quotes.straddle_execution(window_marks(spark, sf))
    return rounded(out.select("event_id", "expiration", "strike", "entry_ask_cost_usd", "quote_bidask_pnl_usd", "quote_mid_pnl_usd", "quote_premium_var_mid", "complete_bidask_pair", "complete_mid_pair"))


@query(f"""WITH {TICKS}, {WINDOW}, {STRADDLE}, bs AS (SELECT * FROM s2 QUALIFY row_number() OVER (PARTITION BY event_id, expiration ORDER BY mids DESC, full_ DESC, abs(strike / 95.0::DOUBLE - 1), strike) = 1),
fs AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY expiration) AS n FROM bs WHERE expiration >= DATE '2024-06-03'),
tw AS (SELECT event_id, count(*) AS k, max(expiration) FILTER (n = 1) AS x1, max(expiration) FILTER (n = 2) AS x2, max(vm) FILTER (n = 1) AS w1, max(vm) FILTER (n = 2) AS w2, bool_and(mids) FILTER (n <= 2) AS ok FROM fs GROUP BY 1),
ev2 AS (SELECT DISTINCT event_id FROM s2), tt AS (SELECT event_id, coalesce(k, 0) AS k, w1, w2, ok, (x1 - DATE '2024-05-20') / 365.0::DOUBLE AS t1, (x2 - DATE '2024-05-20') / 365.0::DOUBLE AS t2 FROM ev2 LEFT JOIN tw USING (event_id)),
rs AS (SELECT *, CASE WHEN k < 2 THEN 'no_two_event_covering_expiries' WHEN NOT ok OR w1 IS NULL OR w2 IS NULL THEN 'stale_or_missing_iv' WHEN w1 <= 0 OR w2 <= 0 THEN 'nonpositive_total_variance' WHEN w2 < w1 THEN 'nonmonotone_total_variance' WHEN (t2 * w1 - t1 * w2) / (t2 - t1) < 0 THEN 'negative_extracted_ivar' END AS reason FROM tt)
SELECT event_id, k AS expiries, reason AS quote_mid_ivar_failure_reason, CASE WHEN reason IS NULL THEN round((t2 * w1 - t1 * w2) / (t2 - t1), 4) END AS quote_mid_ivar_event FROM rs""")
def quote_ivar(spark, sf):
    out = quotes.quote_ivar(quotes.straddle_execution(window_marks(spark, sf)))
    return rounded(out.select("event_id", "expiries", "quote_mid_ivar_failure_reason", "quote_mid_ivar_event"))


@query()
def quote_surface_ivar(spark, sf):
    out = quotes.quote_surface_ivar(quotes.iv_surface_pairs(quotes.iv_surface(window_marks(spark, sf))))
    return rounded(out.select("event_id", "expiries", "quote_surface_mid_ivar_failure_reason", "quote_surface_mid_ivar_event"))


@query("SELECT user_id AS options_ticker, event_id, round((value - 1 + value + 1) / 2, 5) AS mid, 2.0::DOUBLE AS spread, round(2 / nullif(value, 0), 5) AS spread_over_mid, epoch_us(date_trunc('second', ts)) AS us FROM events")
def normalised_quotes(spark, sf):
    """Raw quotes whose instants are whole numbers: nanoseconds, microseconds, milliseconds or seconds."""
    e = load(spark, sf, "events")
    s = F.unix_timestamp("ts")
    sip = F.when(F.col("event_id") % 4 == 0, s * 10**9).when(F.col("event_id") % 4 == 1, s * 10**6).when(F.col("event_id") % 4 == 2, s * 1000).otherwise(s)
    raw = e.select(F.col("user_id").alias("ticker"), "event_id", (F.col("value") - 1).alias("bid_price"), (F.col("value") + 1).alias("ask_price"), sip.alias("sip_timestamp"))
    out = tables.normalise_quotes(raw, ["event_id"])
    return rounded(out.select("options_ticker", "event_id", "mid", "spread", "spread_over_mid", F.unix_micros("ts").alias("us")), 5)


PURCHASES = "rq AS (SELECT event_id AS request_id, contract, ts - INTERVAL 900 MINUTE AS a, ts AS b FROM ticks WHERE event_type = 'purchase')"


def _stream(spark, sf):
    t = ticks(spark, sf)
    r = t.where("event_type = 'purchase'").select(F.col("event_id").alias("request_id"), "contract", (F.col("ts") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(900))).alias("start_ts"), F.col("ts").alias("end_ts"))
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    t.select("contract", "ts", "value", "volume").repartition(8).write.parquet(f"{folder}/in")
    return r, folder


@query(f"WITH {TICKS}, {PURCHASES} SELECT request_id, round(arg_max(value, {{'t': ts, 'v': value}}), 5) AS value, epoch_us(max(ts)) AS us FROM rq JOIN ticks USING (contract) WHERE value > 0 AND ts BETWEEN a AND b GROUP BY 1")
def quote_stream_marks(spark, sf):
    r, folder = _stream(spark, sf)
    out = marks.run_marks(spark, f"{folder}/in", "contract long, ts timestamp, value double, volume long", r, folder)
    return out.select("request_id", F.round("value", 5).alias("value"), F.unix_micros("ts").alias("us"))


@query(f"WITH {TICKS}, {PURCHASES} SELECT request_id, round(sum(value * volume) / sum(volume) + 1e-9, 5) AS vwap, sum(volume)::DOUBLE AS volume, count(*) AS rows FROM rq JOIN ticks USING (contract) WHERE value > 0 AND volume > 0 AND ts BETWEEN a AND b GROUP BY 1")
def quote_stream_vwap(spark, sf):
    r, folder = _stream(spark, sf)
    out = marks.run_vwap(spark, f"{folder}/in", "contract long, ts timestamp, value double, volume long", r, folder)
    return out.select("request_id", F.round(F.col("vwap") + 1e-9, 5).alias("vwap"), "volume", "rows")
