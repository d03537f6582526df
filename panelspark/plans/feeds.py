"""Queries on sources and audits: scans, day files, bars, quotes by window, sources in order, coverage and constraints."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from panelspark.operators import asof, filings, identity, panel, quality, quotes, strategy
from panelspark.operators.staging import shared_folder
from panelspark.plans.common import BARS, EV, TICKS, bars, load, order_events, query, rounded, ticks
from panelspark.plans.contracts import OPT, option_events
from panelspark.plans.panels import CALENDAR, span_calendar
from panelspark.sources import scans, tables

#: Most lines of one day file that a query writes.
FILE_LINES = 1_000_000


@query("SELECT l_returnflag AS flag, count(*) AS lines, round(sum(l_extendedprice), 2) AS total FROM lineitem WHERE l_quantity > 45 AND l_discount BETWEEN 0.02 AND 0.05 GROUP BY 1")
def filtered_scan(spark, sf):
    large = load(spark, sf, "lineitem", (F.col("l_quantity") > 45) & F.col("l_discount").between(0.02, 0.05))
    return rounded(large.groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("lines"), F.sum("l_extendedprice").alias("total")), 2)


@query("SELECT l_partkey, count(*) AS n, round(sum(l_quantity), 4) AS q FROM lineitem WHERE l_partkey IN (1, 5, 7, 11) GROUP BY 1")
def ticker_scan(spark, sf):
    df = scans.scan_tickers(spark, f"{sf}/lineitem.parquet", [1, 5, 7, 11], ["l_quantity"], "l_partkey")
    return rounded(df.groupBy("l_partkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q")))


@query("SELECT p_partkey, ['SPY', 'SPYG', 'QQQ', 'AB'][p_partkey % 4 + 1] AS root FROM part WHERE p_partkey % 4 IN (0, 2)")
def index_option_scan(spark, sf):
    root = F.element_at(F.array(*[F.lit(x) for x in ("SPY", "SPYG", "QQQ", "AB")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    p = load(spark, sf, "part").select("p_partkey", root.alias("root"), F.concat(F.lit("O:"), root, F.lit("250221C"), F.lpad(F.col("p_size").cast("string"), 8, "0")).alias("ticker"))
    return scans.scan_index_options(p, ["SPY", "QQQ"]).select("p_partkey", "root")


@query(f"WITH {BARS} SELECT DISTINCT date FROM bars WHERE date BETWEEN DATE '1995-01-01' AND DATE '1995-12-31'")
def date_listing(spark, sf):
    return scans.list_dates(scans.between_dates(bars(spark, sf), "1995-01-01", "1995-12-31"))


def day_files(spark, sf, folder):
    noon = (F.unix_timestamp(F.to_date("l_shipdate").cast("timestamp")) + 17 * 3600) * 10**9
    text = lambda c: F.col(c).cast("string")
    raw = load(spark, sf, "lineitem").select(text("l_partkey").alias("ticker"), F.when(F.col("l_linenumber") < 7, text("l_quantity")).otherwise("n/a").alias("volume"), text("l_extendedprice").alias("open"), text("l_extendedprice").alias("close"), text("l_extendedprice").alias("high"), text("l_extendedprice").alias("low"), text("l_discount").alias("vwap"), noon.alias("window_start"), F.lit("1").alias("transactions"))
    # a gzipped file is read by one task, so its lines are bounded
    raw.write.option("compression", "gzip").option("maxRecordsPerFile", FILE_LINES).csv(folder, header=True)


@query("SELECT l_partkey::VARCHAR AS ticker, l_shipdate::DATE AS date, count(*) AS n, round(sum(l_extendedprice), 3) AS close, count(*) FILTER (l_linenumber < 7) AS with_volume FROM lineitem GROUP BY 1, 2")
def day_file_ingest(spark, sf):
    """All lines as gzipped day files, taken in twice: the second time replaces the same dates."""
    folder = f"{shared_folder(spark)}/days-{uuid.uuid4().hex}"
    day_files(spark, sf, f"{folder}/raw")
    for _ in range(2):
        out = scans.ingest_day_files(spark, [f"{folder}/raw"], f"{folder}/bronze", "day_aggs")
    return rounded(out.groupBy("ticker", "date").agg(F.count("*").alias("n"), F.sum("close").alias("close"), F.count("volume").alias("with_volume")), 3)


@query(f"WITH {TICKS} SELECT contract, epoch_us(date_trunc('second', ts)) AS us, round(value, 5) AS option_vwap, coalesce(CASE WHEN event_id % 3 > 0 THEN volume END, 0)::BIGINT AS volume FROM ticks")
def second_bars(spark, sf):
    v = F.col("value").cast("string")
    raw = ticks(spark, sf).select("contract", (F.unix_timestamp("ts") * 1000).alias("t"), v.alias("o"), v.alias("h"), v.alias("l"), v.alias("c"), v.alias("vw"), F.when(F.col("event_id") % 3 > 0, F.col("volume").cast("string")).otherwise("?").alias("v"), F.lit(None).cast("string").alias("n"))
    return rounded(scans.second_bars(raw, "contract").select("contract", F.unix_micros("ts").alias("us"), "option_vwap", "volume"), 5)


SYMBOLS = "od AS (SELECT p_partkey, CASE WHEN p_partkey % 9 > 0 THEN concat('O:AB2502', lpad((p_partkey % 28 + 1)::VARCHAR, 2, '0'), 'P', lpad((p_size * 500)::VARCHAR, 8, '0')) ELSE 'junk' END AS s, p_retailprice AS c FROM part)"


@query(f"WITH {SYMBOLS} SELECT p_partkey, 'AB' AS ticker, 'put' AS \"right\", p_strike AS strike, dte FROM (SELECT p_partkey, substr(s, 12, 8)::BIGINT / 1000.0::DOUBLE AS p_strike, make_date(2025, 2, substr(s, 9, 2)::BIGINT) - DATE '2025-01-31' AS dte FROM od WHERE s <> 'junk' AND strlen(s) = 19)")
def option_days(spark, sf):
    k = F.col("p_partkey")
    symbol = F.when(k % 9 > 0, F.concat(F.lit("O:AB2502"), F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.lit("P"), F.lpad((F.col("p_size") * 500).cast("string"), 8, "0"))).otherwise("junk")
    raw = load(spark, sf, "part").select("p_partkey", symbol.alias("ticker"), F.lit("2025-01-31").cast("date").alias("date"))
    return rounded(scans.option_days(raw).select("p_partkey", "ticker", "right", "strike", "dte"))


@query(f"WITH {BARS}, a AS (SELECT DISTINCT o_custkey AS ticker, o_orderdate::DATE AS date FROM orders) SELECT bars.ticker, bars.date, count(*) AS n FROM bars SEMI JOIN a USING (ticker, date) GROUP BY 1, 2")
def event_bars(spark, sf):
    e = load(spark, sf, "orders").select(F.col("o_custkey").alias("ticker"), F.to_date("o_orderdate").alias("entry_date"), F.lit(None).cast("date").alias("exit_date"))
    return scans.event_bars(bars(spark, sf), e).groupBy("ticker", "date").agg(F.count("*").alias("n"))


@query(f"WITH {TICKS}, r AS (SELECT DISTINCT contract, ts::DATE AS d, ts - INTERVAL 1 HOUR AS a, ts + INTERVAL 1 HOUR AS b FROM ticks WHERE event_type = 'purchase') SELECT event_id, contract, round(value, 5) AS value FROM ticks SEMI JOIN r ON ticks.contract = r.contract AND ticks.ts::DATE = r.d AND ticks.ts BETWEEN a AND b")
def quote_scan(spark, sf):
    hour = F.make_dt_interval(F.lit(0), F.lit(1))
    t = ticks(spark, sf).withColumn("quote_date", F.to_date("ts"))
    r = t.where("event_type = 'purchase'").select("contract", "quote_date", (F.col("ts") - hour).alias("window_start"), (F.col("ts") + hour).alias("window_end"))
    return rounded(scans.scan_quotes(t, r, "contract")[0].select("event_id", "contract", "value"), 5)


@query("WITH u AS (SELECT user_id, event_type, value, event_id, NULL AS extra, 0 AS s FROM events WHERE event_id % 2 = 0 UNION ALL SELECT user_id, event_type, value + 1, event_id, event_id, 1 FROM events WHERE event_id % 3 = 0) SELECT user_id, event_type, round(value, 5) AS value, extra FROM u QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY s DESC, event_id DESC) = 1")
def union_sources(spark, sf):
    e = load(spark, sf, "events").select("user_id", "event_type", "value", "event_id")
    second = e.where("event_id % 3 = 0").withColumns({"value": F.col("value") + 1, "extra": F.col("event_id")})
    out = tables.union_sources([e.where("event_id % 2 = 0"), second], ["user_id", "event_type"], [F.desc("event_id")])
    return rounded(out.select("user_id", "event_type", "value", "extra"), 5)


@query(f"WITH {TICKS}, r AS (SELECT event_id AS request, contract, ts - INTERVAL 2 HOUR AS a, ts AS b FROM ticks WHERE event_type = 'purchase') SELECT request, round(arg_min(value, t.ts), 5) AS first_close, round(arg_max(value, t.ts), 5) AS last_close, coalesce(sum(volume), 0)::DOUBLE AS volume, count(t.ts) AS rows, CASE WHEN count(t.ts) > 0 THEN 'ok' ELSE 'missing' END AS status FROM r LEFT JOIN (SELECT * FROM ticks WHERE value > 0) t ON t.contract = r.contract AND t.ts BETWEEN a AND b GROUP BY 1")
def window_first_last(spark, sf):
    t = ticks(spark, sf)
    r = t.where("event_type = 'purchase'").select(F.col("event_id").alias("request"), "contract", (F.col("ts") - F.make_dt_interval(F.lit(0), F.lit(2))).alias("start_ts"), F.col("ts").alias("end_ts"))
    out = asof.first_last(t.drop("event_id"), r, ["contract"], "ts", "value", "volume", ["request"])
    return rounded(out.select("request", "first_close", "last_close", F.coalesce("volume", F.lit(0.0)).alias("volume"), F.coalesce("rows", F.lit(0)).alias("rows"), "status"), 5)


@query(f"WITH {TICKS} SELECT p.event_id AS request, t.event_id AS tick FROM ticks p JOIN ticks t ON t.contract = p.contract AND t.ts BETWEEN p.ts - INTERVAL 60 MINUTE AND p.ts WHERE p.event_type = 'purchase'")
def cutoff_buffer(spark, sf):
    t = ticks(spark, sf)
    c = t.where("event_type = 'purchase'").select(F.col("event_id").alias("request"), "contract", F.col("ts").alias("cutoff"))
    met = asof.before_cutoff(t.select(F.col("event_id").alias("tick"), "contract", "ts"), c.select("contract", "cutoff", "request"), ["contract"], "ts", "cutoff", 60)
    return met.join(c, ["contract", "cutoff"]).select("request", "tick")


@query("SELECT v.d AS dataset_id, v.f AS first_date, v.l AS last_date, v.n AS row_count, v.days, v.days / w::DOUBLE AS partition_coverage_share, CASE WHEN v.f <= DATE '1995-01-01' AND v.l >= DATE '2001-08-01' THEN CASE WHEN v.days / w::DOUBLE < 0.95 THEN 'span_ok_partition_gap' ELSE 'target_span_covered' END ELSE 'target_span_incomplete' END AS target_coverage_status FROM (SELECT min(o_orderdate)::DATE a, max(o_orderdate)::DATE b, count(*) c, count(DISTINCT o_orderdate::DATE) d FROM orders), (SELECT count(*) FILTER (isodow(x) < 6) AS w FROM (SELECT unnest(generate_series(DATE '1995-01-01', DATE '2001-08-01', INTERVAL 1 DAY)) AS x)), LATERAL (VALUES ('orders', a, b, c, d)) v(d, f, l, n, days)")
def date_coverage(spark, sf):
    out = quality.date_coverage(load(spark, sf, "orders"), "orders", "o_orderdate", "1995-01-01", "2001-08-01", partitioned=True)
    return rounded(out.select("dataset_id", "first_date", "last_date", "row_count", "days", "partition_coverage_share", "target_coverage_status"), 9)


@query("WITH s AS (SELECT unnest(generate_series(DATE '1993-01-01', DATE '1999-12-31', INTERVAL 1 DAY))::DATE AS d), w AS (SELECT year(d) AS year, count(*) FILTER (isodow(d) < 6) AS expected_weekdays FROM s GROUP BY 1), h AS (SELECT year(o_orderdate) AS year, count(DISTINCT o_orderdate::DATE) AS days FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1993-01-01' AND DATE '1999-12-31' GROUP BY 1) SELECT w.year, coalesce(days, 0) AS days, expected_weekdays, round(coalesce(days, 0) / expected_weekdays::DOUBLE, 6) AS coverage_share FROM w LEFT JOIN h USING (year)")
def calendar_year_coverage(spark, sf):
    return rounded(quality.year_coverage(load(spark, sf, "orders"), "o_orderdate", "1993-01-01", "1999-12-31").select("year", "days", "expected_weekdays", "coverage_share"), 6)


@query("SELECT event_id, CASE WHEN value < 3 AND event_id % 9 = 0 THEN 'bid_not_negative,ask_at_least_bid' WHEN value < 3 THEN 'bid_not_negative' ELSE 'ask_at_least_bid' END AS violations FROM events WHERE value < 3 OR event_id % 9 = 0")
def row_constraints(spark, sf):
    e = load(spark, sf, "events").select("event_id", (F.col("value") - 3).alias("bid"), (F.col("value") - 3 + F.when(F.col("event_id") % 9 == 0, -1).otherwise(1)).alias("ask"))
    return quality.violations(e, quality.quote_rules()).select("event_id", F.array_join("violations", ",").alias("violations"))


@query("SELECT CASE WHEN m <= 0.9 THEN 'deep_put_wing' WHEN m <= 0.97 THEN 'put_wing' WHEN m <= 1.03 THEN 'atm' WHEN m <= 1.1 THEN 'call_wing' ELSE 'deep_call_wing' END AS moneyness_bucket, CASE WHEN d <= 7 THEN '0_7' WHEN d <= 14 THEN '8_14' WHEN d <= 30 THEN '15_30' WHEN d <= 60 THEN '31_60' ELSE '61_plus' END AS dte_bucket, count(*) AS n, round(avg(abs(v - l)), 6) AS mean_abs_difference FROM (SELECT l_quantity / 25 AS m, l_suppkey % 70 AS d, l_tax AS v, l_discount AS l FROM lineitem) GROUP BY 1, 2")
def vendor_iv_difference(spark, sf):
    o = load(spark, sf, "lineitem").select((F.col("l_quantity") / 25).alias("moneyness"), (F.col("l_suppkey") % 70).alias("dte"), F.col("l_tax").alias("vendor_iv"), F.col("l_discount").alias("local_iv"))
    return rounded(quality.vendor_iv_difference(o), 6)


@query("SELECT coalesce(source, 'missing') AS source, count(*) AS rows, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS share FROM documents GROUP BY 1")
def source_shares(spark, sf):
    return rounded(quality.shares(load(spark, sf, "documents"), "source"), 6)


@query("SELECT 'o_orderstatus' AS \"column\", o_orderstatus AS value, count(*) AS rows FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2")
def shape_counts(spark, sf):
    return quality.shape(load(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("SELECT 'documents' AS dataset, v.f AS field, v.a AS available, round(CASE WHEN v.a THEN v.c / n::DOUBLE ELSE 0 END, 6) AS non_null_share, n AS row_count FROM (SELECT count(*) AS n, count(text) AS t, count(lang) AS l FROM documents), LATERAL (VALUES ('text', true, t), ('lang', true, l), ('vendor_iv', false, 0)) v(f, a, c)")
def field_audit(spark, sf):
    return rounded(quality.field_audit(load(spark, sf, "documents"), "documents", ["text", "lang", "vendor_iv"]), 6)


@query(f"WITH {EV}, r AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN ' bmo ' WHEN 1 THEN 'Amc' WHEN 2 THEN 'DMH' WHEN 3 THEN 'noon' END AS t FROM ev) SELECT event_id, CASE WHEN upper(trim(t)) IN ('BMO', 'AMC', 'DMH', 'UNKNOWN') THEN upper(trim(t)) ELSE 'UNKNOWN' END AS announcement_timing, coalesce(upper(trim(t)) IN ('BMO', 'AMC'), false) AS is_main_sample_timing FROM r")
def calendar_validation(spark, sf):
    told = F.expr("CASE event_id % 5 WHEN 0 THEN ' bmo ' WHEN 1 THEN 'Amc' WHEN 2 THEN 'DMH' WHEN 3 THEN 'noon' END")
    return filings.validate_calendar(order_events(spark, sf).select("event_id", told.alias("announcement_timing")))


@query(f"WITH {BARS}, d AS (SELECT ticker, date, min(price) AS low, max(price) AS high, arg_min(price, {{'o': orderkey, 'l': line}}) AS open, arg_max(price, {{'o': orderkey, 'l': line}}) AS close, CASE WHEN sum(volume) < 20 THEN 0 ELSE sum(volume) END AS volume FROM bars GROUP BY 1, 2) SELECT ticker, date, CASE WHEN ticker % 50 = 0 THEN 'vendor_halt_flag' WHEN volume = 0 AND low = high THEN 'proxy_zero_volume_unchanged_ohlc' END AS reason, CASE WHEN date BETWEEN DATE '2020-01-01' AND DATE '2020-09-30' THEN 'covid_shock' ELSE 'steady_proxy' END AS bucket FROM d")
def halted_days(spark, sf):
    o = F.struct("orderkey", "line")
    d = bars(spark, sf).groupBy("ticker", "date").agg(F.min("price").alias("low"), F.max("price").alias("high"), F.min_by("price", o).alias("open"), F.max_by("price", o).alias("close"), F.sum("volume").alias("volume"))
    d = d.withColumns({"volume": F.when(F.col("volume") < 20, 0.0).otherwise(F.col("volume")), "vendor": F.col("ticker") % 50 == 0})
    return d.select("ticker", "date", panel.halted(d, "vendor").alias("reason"), panel.telemetry_bucket(F.col("date")).alias("bucket"))


@query(f"WITH {OPT}, {CALENDAR}, s AS (SELECT event_id FROM oe ORDER BY 1 LIMIT 400 OFFSET 10), r AS (SELECT event_id, unnest([{{'l': 'entry_preclose_15m', 'd': entry_date}}, {{'l': 'exit_preclose_15m', 'd': exit_date}}]) AS w FROM oe SEMI JOIN s USING (event_id)) SELECT event_id, w.l AS window_label, w.d AS quote_date, epoch_us((w.d::TIMESTAMP + to_minutes(coalesce(close_minutes, 960)::BIGINT)) AT TIME ZONE 'America/New_York') AS end_us FROM r LEFT JOIN cal ON cal.date = w.d")
def quote_requests(spark, sf):
    e = option_events(spark, sf)
    c = e.select("event_id", "entry_date", "exit_date", F.concat("ticker", F.lit("C")).alias("options_ticker"), (F.col("event_id") >= 0).alias("eligible_for_quote_pool"))
    out = quotes.window_requests(c, e.select("event_id", "ticker"), span_calendar(spark, sf), max_events=400, event_offset=10)
    return out.select("event_id", "window_label", "quote_date", F.unix_micros("window_end").alias("end_us"))


@query(f"WITH {EV} SELECT event_id, round(coalesce(CASE WHEN event_id % 3 > 0 THEN value END, 0) * 0.005, 6) AS cost, round(ln(greatest(value / 1e6 - 0.1, 0) + 1e-6), 6) AS log_target, round(greatest(exp(ln(greatest(value / 1e6 - 0.1, 0) + 1e-6)) - 1e-6, 1e-6) + 1e-9, 6) AS back, CASE WHEN event_id % 3 > 0 THEN round(greatest((value + value / 2) / 2e6, 1e-6) + 1e-9, 6) END AS ensemble FROM ev")
def forecast_transforms(spark, sf):
    v = F.col("value")
    e = order_events(spark, sf).withColumns({"premium": F.when(F.col("event_id") % 3 > 0, v), "a": v / 1e6, "b": F.when(F.col("event_id") % 3 > 0, v / 2e6), "y": v / 1e6 - 0.1})
    log = strategy.log_target(F.col("y"))
    return rounded(e.select("event_id", strategy.proxy_cost("premium", 0.005).alias("cost"), log.alias("log_target"), (strategy.from_log(log) + 1e-9).alias("back"), (strategy.ensemble("a", "b") + 1e-9).alias("ensemble")), 6)


@query("SELECT o_custkey::VARCHAR AS ticker, (o_orderkey % 7)::VARCHAR AS source_id, concat('text ', max(o_orderkey)) AS text FROM orders GROUP BY 1, 2")
def filing_texts(spark, sf):
    """Texts as files of results: of one accession the last entry counts."""
    k = F.col("o_orderkey")
    entry = F.struct(k.alias("n"), (k % 7).cast("string").alias("accession_number"), F.concat(F.lit("text "), k).alias("items_text"))
    one = load(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(entry)).alias("results"))
    return filings.texts_by_accession(one.select(F.col("o_custkey").cast("string").alias("ticker"), F.to_json(F.struct("results")).alias("payload")))


@query("SELECT c_custkey::VARCHAR AS ticker, c_nationkey::BIGINT AS cik, c_mktsegment AS category, NULL::VARCHAR AS sic FROM customer")
def company_metadata(spark, sf):
    c = load(spark, sf, "customer")
    payload = F.to_json(F.struct(F.col("c_nationkey").alias("cik"), F.col("c_mktsegment").alias("category")))
    return filings.company_metadata(c.select(F.col("c_custkey").cast("string").alias("ticker"), payload.alias("payload"))).select("ticker", "cik", "category", "sic")


# part names with commas, quotes and nulls through a CSV and back
@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 5 = 1 THEN concat(p_name, ', \"', p_brand, '\"') ELSE p_name END AS name, round(p_retailprice, 2) AS price FROM part")
def csv_round_trip(spark, sf):
    name = F.when(F.col("p_partkey") % 5 == 0, None).when(F.col("p_partkey") % 5 == 1, F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"'))).otherwise(F.col("p_name"))
    path = f"{shared_folder(spark)}/parts-{uuid.uuid4().hex}.csv"
    tables.write_table(load(spark, sf, "part").select("p_partkey", name.alias("name"), F.round("p_retailprice", 2).alias("price")), path)
    return tables.read_table(spark, path, "p_partkey bigint, name string, price double")


@query("SELECT upper(concat('t', l_partkey)) AS ticker, l_shipdate::DATE AS date, max(l_extendedprice) AS close, sum(l_quantity)::BIGINT AS volume FROM lineitem WHERE l_partkey % 10 > 0 GROUP BY 1, 2")
def underlying_bars(spark, sf):
    raw = load(spark, sf, "lineitem").where("l_partkey % 10 > 0").select(F.concat(F.lit("t"), "l_partkey").alias("ticker"), F.to_date("l_shipdate").alias("date"), F.col("l_extendedprice").cast("string").alias("close"), F.col("l_quantity").cast("string").alias("volume"))
    raw = raw.withColumns({c: F.col("close") for c in ("open", "high", "low")})
    return scans.underlying_days(raw).groupBy("ticker", "date").agg(F.max("close").alias("close"), F.sum("volume").alias("volume"))


@query("SELECT o_orderkey, upper(concat('c', o_custkey)) || '_' || o_orderdate::DATE::VARCHAR AS event_id, concat('c', o_custkey, '_', o_orderdate::DATE, '_', o_orderpriority[1:1], '_', o_orderkey) AS source_event_id FROM orders")
def event_ids(spark, sf):
    o = load(spark, sf, "orders")
    e = o.select("o_orderkey", F.concat(F.lit("c"), "o_custkey").alias("ticker"), F.to_date("o_orderdate").alias("event_date"), F.to_date("o_orderdate").alias("announcement_date"), F.concat(F.left("o_orderpriority", F.lit(1)), F.lit("/"), "o_orderkey").alias("source_id"))
    return identity.with_event_id(e).select("o_orderkey", "event_id", identity.announced_id().alias("source_event_id"))


# an order's lines as its contracts: some aren't fit for quotes, some are of other days, many are the same contract
@query("SELECT DISTINCT l_orderkey AS event_id, l_partkey % 5 AS strike, l_linenumber % 2 AS \"right\" FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity > 10 AND l_linenumber < 6 AND o_orderkey % 3 > 0")
def sequence_contracts(spark, sf):
    events = load(spark, sf, "orders").where("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("event_id"))
    quantity = F.col("l_quantity")
    lines = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("event_id"), (F.col("l_partkey") % 5).alias("strike"), (F.col("l_linenumber") % 2).alias("right"), (quantity > 10).alias("eligible_for_quote_pool"), (F.col("l_linenumber") < 6).alias("is_robustness_dte_3_21"))
    return rounded(identity.sequence_contracts(lines, events))


@query("SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS bytes, sha256(coalesce(text, '')) AS sha256 FROM documents")
def content_hashes(spark, sf):
    files = load(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return identity.content_hashes(files).withColumnRenamed("path", "doc_id")


# filings of every customer with their acceptance: of one accession the archive's time counts, a time without a zone is none
@query("SELECT o_custkey::VARCHAR AS ticker, o_orderkey::VARCHAR AS accn, CASE WHEN o_orderkey % 4 > 0 THEN epoch(o_orderdate)::BIGINT + 3600 * (o_orderkey % 24) + CASE WHEN o_orderkey % 2 = 0 THEN 3600 ELSE 0 END END AS accepted FROM orders")
def acceptance_times(spark, sf):
    k = F.col("o_orderkey")
    at = lambda more: F.concat(F.date_format(F.timestamp_seconds(F.unix_timestamp(F.to_date("o_orderdate").cast("timestamp")) + 3600 * (k % 24 + more)), "yyyy-MM-dd'T'HH:mm:ss"), F.when(k % 4 > 0, "Z").otherwise(""))
    block = lambda c, when: F.collect_list(F.when(when, c))
    key, even = k.cast("string"), k % 2 == 0
    made = load(spark, sf, "orders").groupBy(F.col("o_custkey").cast("string").alias("ticker")).agg(block(key, k > 0).alias("a"), block(at(0), k > 0).alias("b"), block(key, even).alias("c"), block(at(1), even).alias("d"))
    pair = lambda x, y: F.struct(F.col(x).alias("accessionNumber"), F.col(y).alias("acceptanceDateTime"))
    payload = made.select("ticker", F.to_json(F.struct(F.struct(pair("a", "b").alias("recent")).alias("filings"), F.array(pair("c", "d")).alias("archive_payloads"))).alias("payload"))
    return filings.acceptance_times(payload).select("ticker", "accn", F.unix_timestamp("acceptance_datetime").alias("accepted"))
