"""Queries on events and their contracts: tickers, filings, facts, market covariates, contract picks, forwards, straddles, features."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions.black_scholes import implied_volatility, option_price
from panelspark.operators import features, filings, options, panel
from panelspark.plans.common import BARS, DAYS, EV, bars, load, order_events, query, rounded
from panelspark.plans.panels import CALENDAR, span_calendar


@query("""SELECT upper(trim(concat(' s', s_suppkey, ' '))) AS ticker, CASE s_nationkey % 5 WHEN 0 THEN NULL ELSE upper(['Nasdaq', 'NYSE', 'OTC', 'NYSE Arca'][s_nationkey % 5]) END AS exchange, CASE WHEN s_nationkey % 5 = 3 THEN 'unsupported_exchange' WHEN s_suppkey % 7 = 0 THEN 'fund_or_index_like_name' ELSE 'eligible_common_equity' END AS filter_reason, NOT (s_nationkey % 5 = 3 OR s_suppkey % 7 = 0) AS eligible FROM supplier""")
def eligible_equities(spark, sf):
    exchange = F.expr("CASE s_nationkey % 5 WHEN 0 THEN NULL ELSE element_at(array('Nasdaq', 'NYSE', 'OTC', 'NYSE Arca'), cast(s_nationkey % 5 AS int)) END")
    s = load(spark, sf, "supplier").select(F.concat(F.lit(" s"), "s_suppkey", F.lit(" ")).alias("ticker"), exchange.alias("exchange"), F.when(F.col("s_suppkey") % 7 == 0, "Alpha ETF Trust").otherwise("Acme Corp").alias("name"))
    return panel.eligible_equities(s).select("ticker", "exchange", "filter_reason", "eligible")


@query("""WITH a AS (SELECT DISTINCT o_custkey::VARCHAR AS t FROM orders WHERE o_custkey % 3 = 0), r AS (SELECT c_custkey::VARCHAR AS ticker, unnest(CASE WHEN c_custkey % 2 = 0 THEN [c_custkey, c_custkey + 1, c_custkey + 3] ELSE [c_custkey] END)::VARCHAR AS cand FROM customer),
m AS (SELECT ticker, count(a.t) AS n, min(a.t) AS one, string_agg(cand, ',' ORDER BY cand) AS candidate_tickers FROM r LEFT JOIN a ON a.t = cand GROUP BY 1) SELECT ticker, CASE n WHEN 1 THEN one END AS mapped_ticker, CASE WHEN n = 1 THEN 'ok' WHEN n > 1 THEN 'ticker_mapping_ambiguous' ELSE 'ticker_not_found' END AS mapping_status, candidate_tickers FROM m""")
def ticker_mapping(spark, sf):
    c = load(spark, sf, "customer").select("c_custkey")
    even = c.where("c_custkey % 2 = 0")
    alias = lambda n: even.select(F.col("c_custkey").cast("string").alias("ticker"), (F.col("c_custkey") + n).cast("string").alias("alias"))
    have = load(spark, sf, "orders").where("o_custkey % 3 = 0").select(F.col("o_custkey").cast("string").alias("ticker"))
    return panel.ticker_mapping(c.select(F.col("c_custkey").cast("string").alias("ticker")), have, alias(1).unionByName(alias(3)))


@query(f"WITH {BARS}, m AS (SELECT ticker, avg(volume) AS v FROM bars GROUP BY 1) SELECT ticker, round(v, 6) AS mean_volume, row_number() OVER (ORDER BY v DESC, ticker DESC) AS rank FROM m QUALIFY rank <= 50")
def mean_volume_universe(spark, sf):
    return rounded(panel.mean_volume_universe(bars(spark, sf), "ticker", "volume", 50), 6)


# each customer's orders as a submission file: recent filings, and an archive that repeats one of them
FORM, ITEMS = "['8-K', '8-K', '10-Q'][o_orderkey % 3 + 1]", "['2.02,9.01', '5.02', '2.02'][o_orderkey % 4 % 3 + 1]"


@query(f"""WITH f AS (SELECT o_custkey, o_orderkey, {FORM} AS form, {ITEMS} AS items, o_orderdate::DATE AS d, o_orderkey % 24 AS h, o_orderkey % 5 > 0 AS zoned FROM orders),
k AS (SELECT *, CASE WHEN zoned THEN (d + to_hours(h::INT)) AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' END AS lt FROM f WHERE form = '8-K' AND contains(items, '2.02')), l AS (SELECT *, coalesce(lt::DATE, d) AS a FROM k)
SELECT o_custkey::VARCHAR AS ticker, o_orderkey::VARCHAR AS source_id, a AS announcement_date, CASE WHEN hour(lt) * 60 + minute(lt) < 570 THEN 'BMO' WHEN hour(lt) >= 16 THEN 'AMC' ELSE 'UNKNOWN' END AS announcement_timing, coalesce(lt::DATE <> d, false) AS filing_acceptance_date_mismatch FROM l WHERE a BETWEEN DATE '1994-01-01' AND DATE '1996-12-31'""")
def filing_candidates(spark, sf):
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (n + 1).cast("int"))
    k = F.col("o_orderkey")
    at = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T"), F.lpad((k % 24).cast("string"), 2, "0"), F.lit(":00:00"), F.when(k % 5 > 0, "Z").otherwise(""))
    filed = load(spark, sf, "orders").select("o_custkey", F.struct(pick(["8-K", "8-K", "10-Q"], k % 3).alias("form"), pick(["2.02,9.01", "5.02", "2.02"], k % 4 % 3).alias("items"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("filingDate"), at.alias("acceptanceDateTime"), k.cast("string").alias("accessionNumber")).alias("f"))
    parts = ("form", "items", "filingDate", "acceptanceDateTime", "accessionNumber")
    block = lambda c: F.struct(*[F.col(f"{c}.{p}").alias(p) for p in parts])
    one = filed.groupBy("o_custkey").agg(F.collect_list("f").alias("f"), F.collect_list(F.when(F.col("f.accessionNumber").cast("long") % 2 == 0, F.col("f"))).alias("g"))
    payload = one.select(F.col("o_custkey").cast("string").alias("ticker"), F.to_json(F.struct(F.struct(block("f").alias("recent")).alias("filings"), F.array(block("g")).alias("archive_payloads"))).alias("payload"))
    return filings.submission_candidates(payload, "1994-01-01", "1996-12-31").select("ticker", "source_id", "announcement_date", "announcement_timing", "filing_acceptance_date_mismatch")


# orders as company facts: the concept by the key, accepted on their day (even keys) or only filed on it
CONCEPTS = ("Assets", "Revenues", "SalesRevenueNet", "Goodwill")


def facts(spark, sf):
    k = F.col("o_orderkey")
    entry = lambda i: F.collect_list(F.when(k % 4 == i, F.struct(F.col("o_totalprice").alias("val"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("filed"), F.date_format(F.date_sub(F.to_date("o_orderdate"), 30), "yyyy-MM-dd").alias("end"), k.cast("string").alias("accn"))))
    o = load(spark, sf, "orders")
    one = o.groupBy("o_custkey").agg(*[entry(i).alias(c) for i, c in enumerate(CONCEPTS)])
    gaap = F.struct(*[F.struct(F.struct(F.col(c).alias("USD")).alias("units")).alias(c) for c in CONCEPTS])
    payload = one.select(F.col("o_custkey").cast("string").alias("ticker"), F.to_json(F.struct(F.struct(gaap.alias("us-gaap")).alias("facts"))).alias("payload"))
    accepted = o.where("o_orderkey % 2 = 0").select(F.col("o_custkey").cast("string").alias("ticker"), k.cast("string").alias("accn"), F.to_date("o_orderdate").cast("timestamp").alias("acceptance_datetime"))
    return filings.company_facts(payload, accepted)


@query("SELECT o_custkey::VARCHAR AS ticker, ['assets', 'revenue', 'revenue'][o_orderkey % 4 + 1] AS feature_concept, count(*) AS n, round(sum(o_totalprice), 2) AS total, count(*) FILTER (o_orderkey % 2 = 0) AS accepted FROM orders WHERE o_orderkey % 4 < 3 GROUP BY 1, 2")
def company_facts(spark, sf):
    return rounded(facts(spark, sf).groupBy("ticker", "feature_concept").agg(F.count("*").alias("n"), F.sum("val").alias("total"), F.count("acceptance_datetime").alias("accepted")), 2)


FACTS = f"""{EV}, ft AS (SELECT o_custkey AS ticker, ['assets', 'revenue', 'revenue'][o_orderkey % 4 + 1] AS concept, o_totalprice AS val, o_orderdate::DATE AS d, o_orderkey::VARCHAR AS accn, o_orderkey % 2 = 0 AS acc FROM orders WHERE o_orderkey % 4 < 3),
mt AS (SELECT event_id, concept, val, d, acc, row_number() OVER (PARTITION BY event_id, concept ORDER BY d DESC, val DESC) AS n FROM ev JOIN ft ON ft.ticker = ev.ticker AND ((acc AND d <= event_date) OR (NOT acc AND d < event_date))),
pv AS (SELECT event_id, max(val) FILTER (concept = 'assets' AND n = 1) AS a, max(val) FILTER (concept = 'revenue' AND n = 1) AS r, max(val) FILTER (concept = 'revenue' AND n = 2) AS r2, count(DISTINCT concept) AS coverage, count(*) FILTER (acc) AS mapped, count(*) FILTER (NOT acc) AS filed, max(d) AS last FROM mt GROUP BY 1),
sd AS (SELECT event_id, count(*) AS dropped FROM ev JOIN ft ON ft.ticker = ev.ticker AND NOT acc AND d = event_date GROUP BY 1)"""


@query(f"WITH {FACTS} SELECT ev.event_id, coalesce(mapped + filed, 0) > 0 AS available, coalesce(coverage, 0) AS coverage, coalesce(mapped, 0)::BIGINT AS mapped_acceptance_rows, coalesce(filed, 0)::BIGINT AS fallback_filed_rows, coalesce(dropped, 0) AS dropped_same_day_rows, round(ln(1 + a), 6) AS log_assets, round(r / r2 - 1, 6) AS revenue_growth, date_diff('day', last, event_date)::DOUBLE AS freshness_days FROM ev LEFT JOIN pv USING (event_id) LEFT JOIN sd USING (event_id)")
def facts_at_events(spark, sf):
    e = order_events(spark, sf).select("event_id", F.col("ticker").cast("string").alias("ticker"), F.col("event_date").cast("timestamp").alias("asof"))
    out = filings.facts_at_events(e, facts(spark, sf), concepts=("assets", "liabilities", "cash", "current_assets", "current_liabilities", "revenue", "net_income", "operating_income"))
    return rounded(out.select("event_id", "available", "coverage", "mapped_acceptance_rows", "fallback_filed_rows", "dropped_same_day_rows", "log_assets", "revenue_growth", "freshness_days"), 6)


# a raw index file made of the orders' days, with missing numbers, bad dates and repeated days
@query(f"""WITH {EV}, ob AS (SELECT o_orderdate::DATE AS d, avg(o_totalprice) / 5000 AS x FROM orders GROUP BY 1), va AS (SELECT d, x FROM ob WHERE day(d) % 9 > 0 AND NOT (dayofweek(d) IN (0, 6))), w AS (SELECT *, x - lag(x) OVER o AS c1, x - lag(x, 5) OVER o AS c5, list(x) OVER (ORDER BY d ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING) AS past FROM va WINDOW o AS (ORDER BY d)),
p AS (SELECT d, x, c1, c5, CASE WHEN len(past) >= 40 THEN (SELECT avg((u <= x)::INT) FROM (SELECT unnest(past) AS u)) END AS pct FROM w),
j AS (SELECT event_id, event_date, p.* FROM ev ASOF LEFT JOIN p ON CASE WHEN timing = 'AMC' THEN event_date ELSE event_date - 1 END >= p.d)
SELECT event_id, CASE WHEN event_date - d <= 5 THEN d END AS vix_date, CASE WHEN event_date - d <= 5 THEN round(x + 1e-9, 6) END AS vix_level, CASE WHEN event_date - d <= 5 THEN round(c1 + 1e-9, 6) END AS vix_change_1d, CASE WHEN event_date - d <= 5 THEN round(c5 + 1e-9, 6) END AS vix_change_5d, CASE WHEN event_date - d <= 5 THEN round(pct, 6) END AS vix_percentile_252d,
CASE WHEN event_date - d <= 5 THEN CASE WHEN pct <= 1 / 3.0 THEN 'low' WHEN pct <= 2 / 3.0 THEN 'mid' WHEN pct IS NOT NULL THEN 'high' END END AS vix_regime_tercile, coalesce(event_date - d <= 5, false) AS vix_available FROM j""")
def vix_features(spark, sf):
    d = F.col("d")
    days = order_events(spark, sf).groupBy(F.col("event_date").alias("d")).agg((F.avg("value") / 5000).alias("x"))
    missing = (F.dayofmonth(d) % 9 == 0) | F.dayofweek(d).isin(1, 7)
    raw = days.select(d.cast("string").alias("observation_date"), F.when(missing, ".").otherwise(F.col("x").cast("string")).alias("VIXCLS"), F.unix_date(d).alias("line"))
    raw = raw.unionByName(raw.select("observation_date", F.lit("999").alias("VIXCLS"), (F.col("line") - 100_000).alias("line"))).unionByName(raw.limit(1).select(F.lit("no date").alias("observation_date"), "VIXCLS", "line"))
    out = features.vix_features(features.vix_daily(raw), order_events(spark, sf), "event_date", "timing", same_day_amc=True)
    out = out.withColumns({c: F.col(c) + 1e-9 for c in ("vix_level", "vix_change_1d", "vix_change_5d")})
    return rounded(out.select("event_id", "vix_date", "vix_level", "vix_change_1d", "vix_change_5d", "vix_percentile_252d", "vix_regime_tercile", "vix_available"), 6)


# lineitem as the option day table: the customer of the order is the underlying, an order's lines are calls and puts in pairs
OPT = "op AS (SELECT o_custkey::VARCHAR AS ticker, o_orderdate::DATE AS date, concat(l_orderkey, '-', l_linenumber) AS options_ticker, (o_orderdate::DATE + (7 * (1 + (l_linenumber - 1) // 4))::INT) AS expiration, 84.0::DOUBLE + 4 * ((l_linenumber - 1) // 2 % 2) + 4 * (l_orderkey % 3) AS strike, CASE WHEN l_linenumber % 2 = 0 THEN 'call' ELSE 'put' END AS side, CASE WHEN l_linenumber < 7 THEN l_extendedprice / 10000 ELSE 0 END AS close, l_quantity AS volume FROM lineitem JOIN orders ON l_orderkey = o_orderkey), oe AS (SELECT o_orderkey AS event_id, o_custkey::VARCHAR AS ticker, o_orderdate::DATE AS entry_date, o_orderdate::DATE + 3 AS exit_date, 90 + o_orderkey % 20 AS spot FROM orders)"


def option_table(spark, sf):
    li, o, n = load(spark, sf, "lineitem"), load(spark, sf, "orders"), F.col("l_linenumber")
    j = li.join(o.hint("merge"), li["l_orderkey"] == o["o_orderkey"])  # both grow; a small file of orders is still too much for a driver
    return j.select(F.col("o_custkey").cast("string").alias("ticker"), F.to_date("o_orderdate").alias("date"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("options_ticker"), F.date_add(F.to_date("o_orderdate"), (7 * (1 + F.floor((n - 1) / 4))).cast("int")).alias("expiration"), (84.0 + 4 * (F.floor((n - 1) / 2) % 2) + 4 * (F.col("l_orderkey") % 3)).cast("double").alias("strike"), F.when(F.col("l_linenumber") % 2 == 0, "call").otherwise("put").alias("right"), F.when(F.col("l_linenumber") < 7, F.col("l_extendedprice") / 10000).otherwise(0.0).alias("close"), F.col("l_quantity").alias("volume"), F.lit(1).alias("transactions"))


def option_events(spark, sf):
    o = load(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").cast("string").alias("ticker"), F.to_date("o_orderdate").alias("entry_date"), F.date_add(F.to_date("o_orderdate"), 3).alias("exit_date"), (90 + F.col("o_orderkey") % 20).cast("double").alias("s_before"))


DC = OPT + ", dc AS (SELECT event_id, options_ticker, op.expiration, strike, side, expiration - entry_date AS dte, abs(strike / spot - 1) AS far, close, volume, spot FROM oe JOIN op ON op.ticker = oe.ticker AND op.date = oe.entry_date WHERE close > 0 AND expiration - entry_date BETWEEN 0 AND 45 AND expiration >= exit_date)"


@query(f"WITH {DC} SELECT event_id, options_ticker, dte, round(far, 6) AS moneyness_abs, CASE WHEN dte BETWEEN 5 AND 14 THEN 'ok' ELSE 'ivar_support_only' END AS contract_discovery_status, dte BETWEEN 5 AND 14 AS is_robustness_dte_3_21 FROM dc")
def day_contracts(spark, sf):
    out = options.day_contracts(option_events(spark, sf), option_table(spark, sf))
    return rounded(out.select("event_id", "options_ticker", "dte", "moneyness_abs", "contract_discovery_status", "is_robustness_dte_3_21"), 6)


@query(f"WITH {DC}, s AS (SELECT event_id, expiration, strike, count(DISTINCT side) >= 2 AS pair, min(far) AS far FROM dc GROUP BY 1, 2, 3), p AS (SELECT *, max(pair) OVER (PARTITION BY event_id, expiration) AS any_ FROM s), k AS (SELECT * FROM p WHERE pair OR NOT any_ QUALIFY row_number() OVER (PARTITION BY event_id, expiration ORDER BY far, strike) <= 2) SELECT dc.event_id, options_ticker FROM dc JOIN k USING (event_id, expiration, strike)")
def near_atm_topk(spark, sf):
    return options.near_the_money(options.day_contracts(option_events(spark, sf), option_table(spark, sf)), 2).select("event_id", "options_ticker")


@query(f"""WITH {DC}, v AS (SELECT *, dte NOT BETWEEN 5 AND 14 AS support, ['validated', 'missing_reference', 'fetch_failed', 'validated', 'not_requested'][event_id % 5 + 1] AS status, CASE event_id % 3 WHEN 0 THEN 100.0 WHEN 1 THEN 10.0 END AS shares, event_id % 4 = 0 AS adjusted FROM dc),
u AS (SELECT *, status = 'validated' AS ok, status IN ('missing_reference', 'not_requested') AND NOT support AND NOT adjusted AS fall, status = 'validated' AND (coalesce(shares <> 100, true) OR adjusted) AS odd FROM v)
SELECT event_id, options_ticker, status AS reference_status, CASE WHEN odd THEN 'non_standard_excluded' WHEN NOT (ok OR fall) AND NOT support THEN 'contract_reference_unvalidated_excluded' WHEN support THEN 'ivar_support_only' ELSE 'ok' END AS contract_discovery_status, CASE WHEN ok THEN 'validated_reference' WHEN fall THEN 'missing_reference_standard_contract_fallback' ELSE 'excluded' END AS reference_proxy_source, NOT support AND (ok OR fall) AND NOT odd AS eligible_for_quote_pool FROM u""")
def reference_validation(spark, sf):
    c = options.day_contracts(option_events(spark, sf), option_table(spark, sf)).withColumns({"option_multiplier": F.lit(100.0), "contract_size": F.lit(100.0)})
    # each event asks about its own contracts: their reports carry the event's number, and an earlier report is outdone
    named = c.withColumn("options_ticker", F.concat_ws("/", "event_id", "options_ticker"))
    k = F.col("event_id")
    status = F.element_at(F.array(*[F.lit(x) for x in ("validated", "missing_reference", "fetch_failed", "validated", "not_requested")]), (k % 5 + 1).cast("int"))
    more = F.when(k % 4 == 0, F.array(F.lit("X"))).otherwise(F.array().cast("array<string>"))
    payload = F.to_json(F.struct(F.struct(F.col("options_ticker").alias("ticker"), F.when(k % 3 == 0, 100).when(k % 3 == 1, 10).alias("shares_per_contract"), more.alias("additional_underlyings")).alias("results")))
    report = named.select("options_ticker", status.alias("reference_status"), payload.alias("payload"), F.lit(2).alias("checked_at"))
    report = report.unionByName(report.select("options_ticker", F.lit("fetch_failed").alias("reference_status"), F.lit(None).cast("string").alias("payload"), F.lit(1).alias("checked_at")))
    out = options.validate_reference(named, options.reference_fields(report)).withColumn("options_ticker", F.substring_index("options_ticker", "/", -1))
    return out.select("event_id", "options_ticker", "reference_status", "contract_discovery_status", "reference_proxy_source", "eligible_for_quote_pool")


QT = OPT + ", qt AS (SELECT event_id, expiration, strike, side, close AS bid, close * (1 + (volume::INT % 5) / 10.0::DOUBLE) AS ask, spot, entry_date FROM oe JOIN op ON op.ticker = oe.ticker AND op.date = oe.entry_date), dv AS (SELECT c_custkey::VARCHAR AS ticker, DATE '1995-06-15' AS x FROM customer WHERE c_custkey % 4 = 0)"


@query(f"""WITH {QT}, se AS (SELECT event_id, max(expiration) AS second FROM (SELECT DISTINCT event_id, expiration FROM qt QUALIFY dense_rank() OVER (PARTITION BY event_id ORDER BY expiration) <= 2) GROUP BY 1),
st AS (SELECT *, (bid + ask) / 2 AS mid, (ask - bid) / ((bid + ask) / 2) AS sp, abs(strike / spot - 1) AS far FROM qt WHERE expiration - entry_date BETWEEN 2 AND 60 AND bid > 0 AND ask > bid AND (ask - bid) / ((bid + ask) / 2) <= 0.3 AND abs(strike / spot - 1) <= 0.1),
pr AS (SELECT event_id, expiration, strike, min({{'s': sp, 'm': mid}}) FILTER (side = 'call') AS c, min({{'s': sp, 'm': mid}}) FILTER (side = 'put') AS p, min(far) AS far FROM st GROUP BY 1, 2, 3),
bs AS (SELECT event_id, strike + c.m - p.m AS f FROM pr WHERE c IS NOT NULL AND p IS NOT NULL QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY far, c.s, p.s, expiration, strike) = 1),
py AS (SELECT DISTINCT event_id FROM oe JOIN dv USING (ticker) LEFT JOIN se USING (event_id) WHERE x BETWEEN entry_date AND coalesce(second, entry_date))
SELECT oe.event_id, CASE WHEN f > 0 AND py.event_id IS NULL THEN 'put_call_parity' ELSE 'spot_fallback' END AS forward_source, round(CASE WHEN f > 0 AND py.event_id IS NULL THEN f ELSE spot END + 1e-8, 6) AS forward_price FROM oe LEFT JOIN bs USING (event_id) LEFT JOIN py USING (event_id)""")
def parity_forward(spark, sf):
    e = option_events(spark, sf).withColumn("spot", F.col("s_before"))
    ask = F.col("close") * (1 + (F.col("volume").cast("int") % 5) / F.lit(10.0))
    q = e.select("event_id", "ticker", "entry_date", "spot").join(option_table(spark, sf).withColumnRenamed("date", "entry_date"), ["ticker", "entry_date"]).select("event_id", "entry_date", "spot", "expiration", "strike", "right", F.col("close").alias("bid"), ask.alias("ask"))
    d = load(spark, sf, "customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").cast("string").alias("ticker"), F.lit("1995-06-15").cast("date").alias("ex_dividend_date"))
    out = options.parity_forward(e, q, d, dte_min=2, dte_max=60)
    return out.select("event_id", "forward_source", F.round(F.col("forward_price") + 1e-8, 6).alias("forward_price"))


@query(f"WITH {QT} SELECT DISTINCT event_id FROM oe JOIN dv USING (ticker) WHERE x BETWEEN entry_date AND entry_date + 60")
def exdiv_semi(spark, sf):
    e = option_events(spark, sf).withColumn("until", F.date_add("entry_date", 60))
    d = load(spark, sf, "customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").cast("string").alias("ticker"), F.lit("1995-06-15").cast("date").alias("ex_dividend_date"))
    return options.ex_dividend_events(e, d, "entry_date", "until")


@query(f"WITH {EV}, p AS (SELECT event_id, (event_id * 31 % 101) / 1000.0::DOUBLE AS r, (event_id * 17 % 89) / 1000.0::DOUBLE AS i FROM ev), c AS (SELECT quantile_cont(i, 0.75) AS cut FROM p WHERE i > 0) SELECT event_id, i > 0 AND i >= cut AND r <= i * 0.25 AND r < i AS possible_preannouncement_or_prior_guidance FROM p, c")
def small_moves(spark, sf):
    i = F.col("event_id")
    e = order_events(spark, sf).select("event_id", ((i * 31 % 101) / F.lit(1000.0)).alias("rvar_event"), ((i * 17 % 89) / F.lit(1000.0)).alias("ivar_event"))
    return options.flag_small_moves(e).select("event_id", "possible_preannouncement_or_prior_guidance")


# entry prices of the events' contracts, their exits and what the straddles made
PRICED = DC + f""", pp AS (SELECT event_id, expiration, strike, side, options_ticker, close AS price, volume::BIGINT AS v, spot FROM dc WHERE volume::INT % 10 > 0),
sk AS (SELECT event_id, expiration, strike, min({{'t': options_ticker, 'p': price}}) FILTER (side = 'call') AS c, min({{'t': options_ticker, 'p': price}}) FILTER (side = 'put') AS p, sum(v) AS v, any_value(spot) AS spot FROM pp GROUP BY 1, 2, 3),
ch AS (SELECT * FROM sk WHERE c IS NOT NULL AND p IS NOT NULL QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY expiration, abs(strike / spot - 1), v DESC, strike) = 1)"""


def priced(spark, sf):
    c = options.day_contracts(option_events(spark, sf), option_table(spark, sf))
    return c.withColumns({"proxy_price": F.col("option_close"), "proxy_status": F.when(F.col("volume") % 10 > 0, "ok").otherwise("no_trade_in_cutoff_window"), "proxy_volume": F.col("volume"), "proxy_transactions": F.col("transactions")})


def straddle_events(spark, sf):
    k = F.col("event_id")
    return option_events(spark, sf).withColumns({"s_after": F.col("s_before") + k % 7 - 3, "open_after": F.when(k % 6 > 0, F.col("s_before") + k % 5 - 2), "announcement_date": F.col("entry_date")})


@query(f"WITH {PRICED} SELECT event_id, strike, c.t AS call_options_ticker, p.t AS put_options_ticker, round((c.p + p.p) * 100, 4) AS entry_premium_usd FROM ch")
def chosen_straddles(spark, sf):
    return rounded(options.choose_straddles(priced(spark, sf), straddle_events(spark, sf)).select("event_id", "strike", "call_options_ticker", "put_options_ticker", "entry_premium_usd"))


# bars on the exit day of a leg: three after the open, one before the close (some legs lack them)
def exit_bars(spark, sf):
    s = options.choose_straddles(priced(spark, sf), straddle_events(spark, sf))
    leg = F.explode(F.array("call_options_ticker", "put_options_ticker")).alias("options_ticker")
    n = lambda m: F.make_dt_interval(F.lit(0), F.lit(0), F.lit(m))
    local = F.col("exit_date").cast("timestamp")
    each = s.select("exit_date", leg).distinct().withColumn("x", F.conv(F.substring(F.md5("options_ticker"), 1, 4), 16, 10).cast("int"))
    made = F.inline(F.array(*[F.struct(F.to_utc_timestamp(local + n(m), "America/New_York").alias("ts"), (F.col("x") % 50 + 1 + i).cast("double").alias("option_vwap"), (F.col("x") % 3 + 1).cast("long").alias("volume"), F.lit(1).alias("transactions")) for i, m in enumerate((570, 574, 575, 950))]))
    return each.where("x % 8 > 0").select("options_ticker", made)


EXITS = PRICED + f""", {CALENDAR}, lg AS (SELECT event_id, unnest([c.t, p.t]) AS t FROM ch), xx AS (SELECT event_id, t, ('0x' || left(md5(t), 4))::INT AS x FROM lg), pc AS (SELECT event_id, t, x, CASE WHEN x % 8 > 0 THEN x % 50 + 1 + 0.5 END AS early, CASE WHEN x % 8 > 0 THEN x % 50 + 3 END AS later, CASE WHEN x % 8 > 0 AND coalesce(cal.close_minutes, 960) = 960 THEN x % 50 + 4 END AS late FROM xx JOIN oe USING (event_id) LEFT JOIN cal ON cal.date = oe.exit_date)"""


@query(f"""WITH {EXITS}, z AS (SELECT ch.event_id, (c.p + p.p) * 100 AS paid, ch.strike, ch.expiration, oe.exit_date, oe.spot + oe.event_id % 7 - 3 AS s_after, CASE WHEN oe.event_id % 6 > 0 THEN oe.spot + oe.event_id % 5 - 2 END AS opened,
 (SELECT sum(late) * 100 FROM pc WHERE pc.event_id = ch.event_id HAVING count(late) = 2) AS pre FROM ch JOIN oe USING (event_id)),
w AS (SELECT *, CASE WHEN expiration <= exit_date OR pre IS NULL THEN abs(s_after - strike) * 100 ELSE pre END AS value FROM z)
SELECT event_id, round(paid, 6) AS entry_premium_usd, round(value, 6) AS exit_option_value_usd, CASE WHEN expiration <= exit_date THEN 'expiration_at_exit_intrinsic' WHEN pre IS NOT NULL THEN 'ok' ELSE 'missing_exit_preclose_vwap_intrinsic_fallback' END AS option_exit_price_status, round(value - paid, 6) AS gross_proxy_pnl_usd, round(value - paid - 0.1 * paid, 6) AS haircut_pnl_usd, round(abs(opened - strike) * 100 - paid, 6) AS gross_c2o_intrinsic_proxy_pnl_usd FROM w""")
def straddle_diagnostics(spark, sf):
    e, p = straddle_events(spark, sf), priced(spark, sf)
    exits = options.exit_prices(exit_bars(spark, sf), options.choose_straddles(p, e), span_calendar(spark, sf))
    out = options.straddle_diagnostics(p, e, exits)
    return rounded(out.select("event_id", "entry_premium_usd", "exit_option_value_usd", "option_exit_price_status", "gross_proxy_pnl_usd", "haircut_pnl_usd", "gross_c2o_intrinsic_proxy_pnl_usd"), 6)


@query(f"WITH {EXITS} SELECT DISTINCT pc.event_id, t AS options_ticker, w AS window_label, round(CASE w WHEN '0_5' THEN (2 * early + later + 0.0) / 3 + 0.0 WHEN '5_15' THEN later + 0.0 ELSE late + 0.0 END, 6) AS vwap, CASE WHEN CASE w WHEN 'preclose_15m' THEN late ELSE later END IS NULL THEN 'no_trade_in_cutoff_window' ELSE 'ok' END AS status FROM pc, (VALUES ('0_5'), ('5_15'), ('preclose_15m')) v(w)")
def post_open_windows(spark, sf):
    """Bars at 9:30, 9:34 and 9:35: the last one lies in both windows, whose ends count."""
    e = straddle_events(spark, sf)
    out = options.exit_prices(exit_bars(spark, sf), options.choose_straddles(priced(spark, sf), e), span_calendar(spark, sf))
    return rounded(out.select("event_id", "options_ticker", "window_label", "vwap", "status").distinct(), 6)


@query()
def local_iv(spark, sf):
    out = options.attach_iv(priced(spark, sf), straddle_events(spark, sf))
    return rounded(out.select("event_id", "options_ticker", "local_iv", "local_iv_status"), 6)


@query(f"WITH {DC}, q AS (SELECT event_id, expiration, strike, side, 0.2 + volume / 100 AS iv, volume::BIGINT AS v, spot, dte FROM dc), p AS (SELECT event_id, expiration, strike, avg(iv) AS iv, sum(v) AS v, any_value(spot) AS spot, any_value(dte) AS dte FROM q GROUP BY 1, 2, 3 HAVING count(*) FILTER (side = 'call') > 0 AND count(*) FILTER (side = 'put') > 0) SELECT event_id, expiration, round(iv, 6) AS iv, dte AS dte_days, strike, round(1 + abs(strike / spot - 1), 6) AS moneyness, v::BIGINT AS volume FROM p QUALIFY row_number() OVER (PARTITION BY event_id, expiration ORDER BY abs(strike / spot - 1), v DESC, strike) = 1")
def iv_inputs(spark, sf):
    p = priced(spark, sf).withColumn("local_iv", 0.2 + F.col("volume") / 100)
    return rounded(options.iv_inputs(p, straddle_events(spark, sf)).select("event_id", "expiration", "iv", "dte_days", "strike", "moneyness", "volume"), 6)


# a premium has a volatility if it isn't below what the option is worth at once; the volatility prices it back
@query("""WITH v AS (SELECT p_partkey, p_retailprice AS s, p_retailprice * (0.9::DOUBLE + (p_partkey % 20) / 100.0::DOUBLE) AS k, p_retailprice * (0.0205::DOUBLE + p_size / 1000.0::DOUBLE) AS p, p_size % 2 = 1 AS c FROM part WHERE p_size > 0),
f AS (SELECT p_partkey, p >= greatest(CASE WHEN c THEN s - k ELSE k - s END, 0) AS priced FROM v) SELECT p_partkey, priced, CASE WHEN priced THEN true END AS reprices FROM f""")
def implied_vol_reprices(spark, sf):
    p = load(spark, sf, "part").where("p_size > 0")
    spot, t, call = F.col("p_retailprice"), F.lit(30 / 365), F.col("p_size") % 2
    strike, premium = spot * (F.lit(0.9) + (F.col("p_partkey") % 20) / 100), spot * (F.lit(0.0205) + F.col("p_size") / 1000)
    out = p.select("p_partkey", spot.alias("s"), strike.alias("k"), premium.alias("p"), call.alias("c"), implied_volatility(premium, spot, strike, t, call).alias("iv"))
    back = option_price(F.col("s"), F.col("k"), t, F.col("iv"), F.col("c"))
    return out.select("p_partkey", F.col("iv").isNotNull().alias("priced"), F.when(F.col("iv").isNotNull(), F.abs(back - F.col("p")) < 1e-9 * F.col("s")).alias("reprices"))


@query()
def implied_vol(spark, sf):
    p = load(spark, sf, "part").where("p_size > 0")
    spot = F.col("p_retailprice")
    return p.select("p_partkey", implied_volatility(spot * (F.lit(0.02) + F.col("p_size") / 1000), spot, spot * (F.lit(0.9) + (F.col("p_partkey") % 20) / 100), F.lit(30 / 365), F.col("p_size") % 2).alias("iv"))


@query(f"WITH {EV} SELECT t.target_id, count(*) AS n, round(avg(t.v - 5), 6) AS mean_edge FROM ev, LATERAL (VALUES ('day_c2c', value / 1e4), ('jump_c2o', value / 2e4), ('reaction_o2c', CASE WHEN event_id % 3 > 0 THEN value / 3e4 END)) t(target_id, v) GROUP BY 1")
def target_frames(spark, sf):
    v = F.col("value")
    e = order_events(spark, sf).withColumns({"rvar_day": v / 1e4, "rvar_jump": v / 2e4, "rvar_reaction": F.when(F.col("event_id") % 3 > 0, v / 3e4), "ivar_event": F.lit(5.0)})
    return rounded(panel.target_frames(e).groupBy("target_id").agg(F.count("*").alias("n"), F.avg("edge_var_realized").alias("mean_edge")), 6)


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'technology_communication' WHEN p_size % 4 = 1 THEN CASE WHEN p_partkey % 3 = 0 THEN 'financials_real_estate' WHEN p_partkey % 3 = 1 THEN 'energy_materials_industrials' ELSE 'technology_communication' END WHEN p_size % 4 = 2 THEN 'healthcare' END AS sector FROM part")
def coarse_sectors(spark, sf):
    """A sector's name, an industry code, a category's words, or nothing."""
    n, k = F.col("p_size") % 4, F.col("p_partkey") % 3
    p = load(spark, sf, "part").select("p_partkey", F.when(n == 0, "Application Software").alias("sector"), F.when(n == 1, F.when(k == 0, "6021").when(k == 1, "2911").otherwise("3571")).alias("sic"), F.when(n == 2, "Biotech research").alias("category"))
    out = features.coarse_sectors(p)
    name = F.coalesce(*[F.when(F.col(f"sector_sic_{g}"), g) for g in features.SECTORS])
    return out.select("p_partkey", name.alias("sector"))


@query("SELECT p_partkey, ['high', 'mid', 'low'][greatest(0, ceil((row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1) * 3.0::DOUBLE / (count(*) OVER () - 1))::BIGINT - 1) + 1] AS liquidity_bucket FROM part")
def liquidity_bucket(spark, sf):
    return features.liquidity_bucket(load(spark, sf, "part"), "p_retailprice", "p_partkey").select("p_partkey", "liquidity_bucket")


@query(f"""WITH {EV}, m AS (SELECT event_id, event_date, (event_id % 40)::DOUBLE AS dte, (event_id * 31 % 101) / 1000.0::DOUBLE AS r, 0.05::DOUBLE AS i, timing, 1 + event_id % 9 AS rk FROM ev), s AS (SELECT event_id, value / 100 AS premium, value / 1000 AS gross FROM ev WHERE event_id % 2 = 0)
SELECT m.event_id, round(r - i, 6) AS edge_var_realized, coalesce(dte BETWEEN 5 AND 14, false) AS is_main_dte_5_14, CASE WHEN dte <= 4 THEN 'lt_5' WHEN dte <= 14 THEN 'main_5_14' WHEN dte <= 21 THEN 'robust_15_21' ELSE 'ivar_support_gt_21' END AS dte_bucket, timing = 'AMC' AS is_amc, round(1 / rk::DOUBLE, 6) AS liquidity_rank_score, round(sin(2 * pi() * (month(event_date) - 1) / 12), 6) AS event_month_sin, round(CASE WHEN gross IS NOT NULL THEN greatest(gross - gross * 0.9, 0) END, 6) AS estimated_transaction_cost_usd, round(gross * 0.9 / premium, 6) AS return_on_premium_realized FROM m LEFT JOIN s USING (event_id)""")
def feature_matrix(spark, sf):
    i = F.col("event_id")
    e = order_events(spark, sf).select("event_id", F.col("ticker").cast("string").alias("ticker"), F.col("event_date").alias("entry_date"), (i % 40).cast("double").alias("dte_1"), ((i * 31 % 101) / F.lit(1000.0)).alias("rvar_event"), F.lit(0.05).alias("ivar_event"), F.col("timing").alias("announcement_timing"), (1 + i % 9).alias("universe_rank"))
    s = order_events(spark, sf).where("event_id % 2 = 0").select("event_id", (F.col("value") / 100).alias("entry_premium_usd"), (F.col("value") / 1000).alias("gross_proxy_pnl_usd"), (F.col("value") / 1000 * 0.9).alias("haircut_pnl_usd"))
    out = features.feature_matrix(features.eligible_events(e), s)
    return rounded(out.select("event_id", "edge_var_realized", "is_main_dte_5_14", "dte_bucket", "is_amc", "liquidity_rank_score", "event_month_sin", "estimated_transaction_cost_usd", "return_on_premium_realized"), 6)


@query("SELECT v.feature_name, v.model_feature, v.reason, v.c / (SELECT count(*) FROM documents)::DOUBLE AS coverage FROM (SELECT count(doc_id) AS a, count(text) AS b, count(lang) AS c, count(source) AS d, count(n_chars) AS e FROM documents), LATERAL (VALUES ('doc_id', true, 'allowlisted_numeric_or_bool', a), ('text', false, 'non_numeric', b), ('lang', false, 'non_numeric', c), ('source', false, 'non_numeric', d), ('prior_n_chars', true, 'point_in_time_prior_history', e), ('rvar_event_chars', false, 'leakage_or_identifier_exclusion', e), ('split', false, 'exact_exclusion', d)) v(feature_name, model_feature, reason, c)")
def schema_report(spark, sf):
    d = load(spark, sf, "documents").withColumns({"prior_n_chars": F.col("n_chars"), "rvar_event_chars": F.col("n_chars"), "split": F.col("source")}).drop("n_chars")
    return features.schema_report(d).select("feature_name", "model_feature", "reason", "coverage")


@query(f"WITH {EV}, {DAYS}, n AS (SELECT event_id, count(date) AS history_days FROM ev LEFT JOIN days ON days.ticker = ev.ticker AND date < event_date GROUP BY 1) SELECT event_id, history_days, CASE WHEN history_days < 20 THEN 'insufficient_20_day_sequence' END AS sequence_reason FROM n")
def sequence_history(spark, sf):
    e = order_events(spark, sf).select("event_id", "ticker", "event_date")
    return rounded(features.sequence_history(e, bars(spark, sf), "event_id", "ticker", "event_date", "date").select("event_id", "history_days", "sequence_reason"))


@query(f"WITH {EV}, q AS (SELECT event_id, coalesce(CASE WHEN event_id % 4 > 0 THEN CASE WHEN value > 150000 THEN 'high' ELSE 'low' END END, 'missing') AS execution_confidence_band FROM ev) SELECT * FROM q")
def quote_diagnostics(spark, sf):
    e = order_events(spark, sf).select("event_id", "ticker")
    c = order_events(spark, sf).where("event_id % 4 > 0").select("event_id", "ticker", F.when(F.col("value") > 150000, "high").otherwise("low").alias("execution_confidence_band"))
    return features.with_quote_diagnostics(e, c).select("event_id", "execution_confidence_band")
