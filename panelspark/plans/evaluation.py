"""Queries on evaluation: forecast, ranking and strategy metrics, policies, defeats, comparisons of models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators import comparison, metrics, models, strategy
from panelspark.plans.common import EV, load, order_events, query, rounded
from panelspark.plans.panels import SPLIT, split_events

FC = "fc AS (SELECT l_returnflag AS model, l_orderkey * 10 + l_linenumber AS key, l_extendedprice / 1000 AS y, l_quantity * 1.5 AS f, CASE WHEN l_orderkey % 50 > 0 THEN 38.0::DOUBLE END AS b, l_suppkey, l_shipdate::DATE AS d, l_linestatus FROM lineitem)"


def forecasts(spark, sf):
    return load(spark, sf, "lineitem").select(F.col("l_returnflag").alias("model"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_quantity") * 1.5).alias("f"), F.when(F.col("l_orderkey") % 50 > 0, 38.0).alias("b"), "l_suppkey", F.to_date("l_shipdate").alias("d"), "l_linestatus").withColumn("edge", F.col("y") - F.col("b"))


@query(f"WITH {FC}, g AS (SELECT *, greatest(y, 1e-6) / greatest(f, 1e-6) AS q FROM fc) SELECT model, count(b) AS n, count(*) AS n_forecast_target, round(avg(abs(f - y)) FILTER (b IS NOT NULL), 4) AS mae, round(sqrt(avg((f - y) ** 2) FILTER (b IS NOT NULL)), 4) AS rmse, round(avg(q - ln(q) - 1) FILTER (b IS NOT NULL), 4) AS qlike, round(1 - sum((f - y) ** 2) FILTER (b IS NOT NULL) / sum((b - y) ** 2), 4) AS oos_r2 FROM g GROUP BY 1")
def forecast_metrics(spark, sf):
    return rounded(metrics.forecast_metrics(forecasts(spark, sf), ["model"], "f", "y", "b"))


@query(f"""WITH {FC}, l AS (SELECT model, l_suppkey, d, (b - y) ** 2 - (f - y) ** 2 AS gain FROM fc WHERE b IS NOT NULL), o AS (SELECT model, count(*) AS n, avg(gain) AS m, stddev_samp(gain) / sqrt(count(*)) AS se FROM l GROUP BY 1),
a AS (SELECT model, count(*) AS k, stddev_samp(m) / sqrt(count(*)) AS se FROM (SELECT model, l_suppkey, avg(gain) AS m FROM l GROUP BY 1, 2) GROUP BY 1), c AS (SELECT model, count(*) AS k, stddev_samp(m) / sqrt(count(*)) AS se FROM (SELECT model, d, avg(gain) AS m FROM l GROUP BY 1, 2) GROUP BY 1)
SELECT model, 'ok' AS status, n, round(m, 3) AS mean_gain, round(o.se, 3) AS plain_se, a.k AS l_suppkey_clusters, round(a.se, 3) AS l_suppkey_se, c.k AS d_clusters, round(c.se, 3) AS d_se, 'ok' AS two_way_status, round((a.se + c.se) / 2, 3) AS two_way_se FROM o JOIN a USING (model) JOIN c USING (model)""")
def cluster_inference(spark, sf):
    return rounded(metrics.cluster_inference(forecasts(spark, sf), ["model"], "f", "y", "b", ["l_suppkey", "d"]), 3)


# average ranks, their distinct quantile edges, and how many inner edges lie below a rank
SCORED = FC + """, sc AS (SELECT model, key, f AS score, y - b AS edge, (y > b)::INT AS hit FROM fc WHERE b IS NOT NULL), rk AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY score) + (count(*) OVER (PARTITION BY model, score) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY model) AS n FROM sc),
cuts AS (SELECT model, list_sort(list_distinct(quantile_cont(r, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS c FROM rk GROUP BY 1),
dc AS (SELECT rk.*, """ + " + ".join(f"CASE WHEN {i} < len(c) AND c[{i}] < r THEN 1 ELSE 0 END" for i in range(2, 11)) + """ AS edge_decile FROM rk JOIN cuts USING (model)),
ed AS (SELECT model, edge_decile, count(*) AS n, avg(score) AS mean_score, avg(edge) AS mean_realized_edge FROM dc GROUP BY 1, 2)"""


@query(f"WITH {SCORED} SELECT model, edge_decile::BIGINT AS edge_decile, n, round(mean_score, 6) AS mean_score, round(mean_realized_edge, 6) AS mean_realized_edge FROM ed")
def edge_deciles(spark, sf):
    return rounded(metrics.edge_deciles(forecasts(spark, sf), ["model"], "f", "edge"), 6)


@query(f"""WITH {SCORED}, o AS (SELECT model, count(*) AS n, (sum(r) FILTER (hit = 1) - sum(hit) * (sum(hit) + 1) / 2.0) / (sum(hit) * (count(*) - sum(hit)))::DOUBLE AS auc, avg((least(greatest(r / n, 1e-12), 1 - 1e-12) - hit) ** 2) AS brier FROM rk GROUP BY 1),
t AS (SELECT model, avg(hit) AS top FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY score DESC, key) AS p FROM rk) WHERE p <= ceil(n / 10) GROUP BY 1),
s AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY mean_realized_edge) + (count(*) OVER (PARTITION BY model, mean_realized_edge) - 1) / 2.0 AS mr, mean_realized_edge >= lag(mean_realized_edge) OVER (PARTITION BY model ORDER BY edge_decile) AS up FROM ed),
u AS (SELECT model, corr(edge_decile, mr) AS sp, avg(up::INT) AS adj FROM s GROUP BY 1)
SELECT model, n, round(auc, 6) AS auc, round(brier, 6) AS rank_probability_brier, round(top, 6) AS top_decile_precision, round(sp, 6) AS edge_decile_spearman, round(adj, 6) AS edge_decile_adjacent_up_share FROM o JOIN t USING (model) JOIN u USING (model)""")
def ranking_metrics(spark, sf):
    return rounded(metrics.ranking_metrics(forecasts(spark, sf), ["model"], "f", "edge", "key"), 6)


@query(f"WITH {SCORED}, q AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY score, key) AS p FROM sc JOIN (SELECT model, count(*) AS n FROM sc GROUP BY 1) USING (model)), z AS (SELECT *, greatest(0, ceil((p - 1) * 10.0::DOUBLE / (n - 1))::BIGINT - 1) AS bucket FROM q) SELECT model, bucket, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(edge), 6) AS event_rate FROM z GROUP BY 1, 2")
def calibration(spark, sf):
    return rounded(metrics.calibration(forecasts(spark, sf), ["model"], "f", "edge", "key"), 6)


@query(f"""WITH {FC}, g AS (SELECT model, greatest(y, 1e-6) AS a, greatest(f, 1e-6) AS f FROM fc), c AS (SELECT *, a / f - ln(a / f) - 1 AS k FROM g), w AS (SELECT model, quantile_cont(f, 0.01) AS lo, quantile_cont(f, 0.99) AS hi, count(*) AS n FROM c GROUP BY 1),
p AS (SELECT c.*, n, a / least(greatest(f, lo), hi) AS q, row_number() OVER (PARTITION BY model ORDER BY k DESC, f) AS r FROM c JOIN w USING (model))
SELECT model, count(*) AS n, round(avg(k), 6) AS qlike, round(avg(q - ln(q) - 1), 6) AS winsorized_qlike, round(sum(k) FILTER (r <= greatest(1, ceil(n * 0.01))) / greatest(sum(k), 1e-6), 6) AS top_1pct_share FROM p GROUP BY 1""")
def qlike_sanity(spark, sf):
    return rounded(metrics.qlike_sanity(forecasts(spark, sf), ["model"], "f", "y"), 6)


@query(f"WITH {FC}, g AS (SELECT model, key, greatest(y, 1e-6) AS a, greatest(f, 1e-6) AS f FROM fc), c AS (SELECT *, a / f - ln(a / f) - 1 AS k FROM g), r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY round(k, 9) DESC, key) AS place, (rank() OVER (PARTITION BY model ORDER BY k) + (count(*) OVER (PARTITION BY model, k) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY model) AS pct FROM c) SELECT model, key, place, round(k, 5) AS contribution FROM r WHERE place <= 25")
def qlike_extremes(spark, sf):
    out = metrics.qlike_extremes(forecasts(spark, sf).withColumn("f", F.col("f")), ["model"], "f", "y", "key")
    return rounded(out.select("model", "key", "place", "contribution"), 5)


TR = EV + ", tr AS (SELECT *, value / 1000 - (event_id % 97) * 3 AS net, 10 + event_id % 11 AS cost, value / 100 AS premium, (event_id * 31 % 101) / 10.0::DOUBLE AS edge FROM ev)"


def trades(spark, sf):
    e = order_events(spark, sf)
    return e.withColumns({"net": F.col("value") / 1000 - (F.col("event_id") % 97) * 3, "cost": (10 + F.col("event_id") % 11).cast("double"), "premium": F.col("value") / 100, "edge": (F.col("event_id") * 31 % 101) / F.lit(10.0)})


# cumulative result, its running peak and the deepest fall below it
FALL = "cu AS (SELECT {k}, net, sum(net) OVER (PARTITION BY {k} ORDER BY event_date, event_id ROWS UNBOUNDED PRECEDING) AS cum, event_date, event_id FROM {t}), pk AS (SELECT *, max(cum) OVER (PARTITION BY {k} ORDER BY event_date, event_id ROWS UNBOUNDED PRECEDING) AS peak FROM cu), dd AS (SELECT {k}, min(cum - peak) AS max_drawdown, count(*) AS n FROM pk GROUP BY ALL)"
MONEY = "count(*) AS n, round(sum(gross), 4) AS gross, round(sum(net), 4) AS net, round(sum(net) / sum(abs(premium)), 6) AS return_on_premium, round(avg(net) / stddev_samp(net) * sqrt(count(*)), 4) AS sharpe, round(avg(net) / stddev_samp(net) FILTER (net < 0) * sqrt(count(*)), 4) AS sortino, round(avg((net > 0)::INT), 6) AS hit_rate, round(avg(net) FILTER (net > 0), 5) AS avg_win, round(avg(net) FILTER (net < 0), 5) AS avg_loss, round(quantile_cont(net, 0.05), 4) AS tail_5pct"


@query(f"WITH {TR}, g AS (SELECT *, net + cost AS gross FROM tr), {FALL.format(k='timing', t='g')}, m AS (SELECT timing, {MONEY} FROM g GROUP BY 1) SELECT m.*, round(max_drawdown, 4) AS max_drawdown FROM m JOIN dd USING (timing)")
def strategy_metrics(spark, sf):
    out = metrics.strategy_metrics(trades(spark, sf).withColumn("gross", F.col("net") + F.col("cost")), ["timing"], ["event_date", "event_id"], "net", "gross", "premium")
    return _money(out, ["timing"])


def _money(out: DataFrame, keys: list[str]) -> DataFrame:
    places = {"gross": 4, "net": 4, "return_on_premium": 6, "sharpe": 4, "sortino": 4, "hit_rate": 6, "avg_win": 5, "avg_loss": 5, "tail_5pct": 4, "max_drawdown": 4}
    return out.select(*keys, "n", *[F.round(c, k).alias(c) for c, k in places.items()])


@query(f"WITH {TR}, {FALL.format(k='ticker', t='tr')} SELECT ticker, round(max_drawdown, 6) AS max_drawdown, n FROM dd")
def drawdown(spark, sf):
    return rounded(metrics.max_drawdown(trades(spark, sf), ["ticker"], ["event_date", "event_id"], "net"), 6)


@query(f"WITH {TR}, g AS (SELECT m::DOUBLE AS multiplier, event_date, event_id, net - m * cost AS net FROM tr, (VALUES (0.0), (0.5), (1.0), (1.5), (2.0)) v(m)), {FALL.format(k='multiplier', t='g')}, s AS (SELECT multiplier, count(*) AS n, round(sum(net), 4) AS net, round(avg((net > 0)::INT), 6) AS hit_rate FROM g GROUP BY 1) SELECT s.*, round(max_drawdown, 4) AS max_drawdown FROM s JOIN dd USING (multiplier)")
def cost_sensitivity(spark, sf):
    out = metrics.cost_sensitivity(trades(spark, sf), [], ["event_date", "event_id"], "net", "cost")
    return out.select("multiplier", "n", F.round("net", 4).alias("net"), F.round("hit_rate", 6).alias("hit_rate"), F.round("max_drawdown", 4).alias("max_drawdown"))


@query(f"""WITH {TR}, b AS (SELECT unnest([{{'d': 'timing', 'v': timing}}, {{'d': 'o_orderstatus', 'v': o_orderstatus}}]) AS x, event_date, event_id, net, net + cost AS gross, premium, edge, cost FROM tr), g AS (SELECT x.d AS dimension, x.v AS value, * FROM b), {FALL.format(k='dimension, value', t='g')},
m AS (SELECT dimension, value, count(*) AS strategy_n, round(sum(net), 4) AS strategy_net, round(avg((net > 0)::INT), 6) AS strategy_hit_rate, count(*) AS n, round(avg(abs(edge - cost)), 5) AS mae, round(1 - sum((edge - cost) ** 2) / sum((9.0 - cost) ** 2), 5) AS oos_r2 FROM g GROUP BY 1, 2) SELECT m.*, round(max_drawdown, 4) AS strategy_max_drawdown FROM m JOIN dd USING (dimension, value)""")
def breakdowns(spark, sf):
    t = trades(spark, sf).withColumns({"gross": F.col("net") + F.col("cost"), "nine": F.lit(9.0)})
    out = metrics.breakdown_metrics(t, ["timing", "o_orderstatus"], ["event_date", "event_id"], "net", "gross", "premium", "edge", "cost", "nine")
    return out.select("dimension", "value", "strategy_n", F.round("strategy_net", 4).alias("strategy_net"), F.round("strategy_hit_rate", 6).alias("strategy_hit_rate"), F.round("strategy_max_drawdown", 4).alias("strategy_max_drawdown"), "n", F.round("mae", 5).alias("mae"), F.round("oos_r2", 5).alias("oos_r2"))


@query(f"""WITH {TR}, p AS (SELECT timing, o_orderstatus, event_date, event_id, edge AS forecast, cost::DOUBLE AS rvar, 9.0::DOUBLE AS ivar, cost - 9.0 AS e, net, net + cost AS gross, premium, cost FROM tr)
SELECT 'forecast' AS "table", timing, o_orderstatus, 'rmse' AS metric, round(sqrt(avg((forecast - rvar) ** 2)), 5) AS value FROM p GROUP BY 2, 3
UNION ALL SELECT 'strategy', timing, o_orderstatus, 'net', round(sum(net), 4) FROM p GROUP BY 2, 3
UNION ALL SELECT 'cost', timing, o_orderstatus, 'net_at_1.5', round(sum(gross - 1.5 * cost), 4) FROM p GROUP BY 2, 3
UNION ALL SELECT 'ranking', timing, o_orderstatus, 'n', count(*) FROM p GROUP BY 2, 3""")
def metric_tables(spark, sf):
    t = trades(spark, sf).withColumns({"gross": F.col("net") + F.col("cost"), "forecast": F.col("edge"), "rvar": F.col("cost"), "ivar": F.lit(9.0)}).withColumn("edge", F.col("rvar") - F.col("ivar"))
    out = metrics.metric_tables(t, ["timing", "o_orderstatus"], "event_id", ["event_date", "event_id"])
    asked = F.concat_ws("/", "table", "metric").isin("forecast/rmse", "strategy/net", "cost/net_at_1.5", "ranking/n")
    return out.where(asked).withColumn("value", F.when(F.col("table") == "forecast", F.round("value", 5)).otherwise(F.round("value", 4)))


@query(f"WITH {TR} SELECT t::DOUBLE AS threshold, e::DOUBLE AS min_edge, count(*) FILTER (edge > t * cost AND edge >= e) AS trades, round(coalesce(sum(net) FILTER (edge > t * cost AND edge >= e), 0), 7) AS net FROM tr, (VALUES (0.0), (0.25), (0.5), (0.75)) a(t), (VALUES (0.0), (2.5), (5.0)) b(e) GROUP BY 1, 2")
def policy_grid(spark, sf):
    return rounded(strategy.policy_grid(trades(spark, sf), (0.0, 0.25, 0.5, 0.75), (0.0, 2.5, 5.0), "edge", "cost", "net"), 7)


@query(f"WITH {TR} SELECT timing, event_id, row_number() OVER (PARTITION BY timing ORDER BY edge DESC, event_id) AS rank FROM tr QUALIFY rank <= 25")
def topk_in_split(spark, sf):
    return rounded(strategy.top_k(trades(spark, sf), ["timing"], [F.desc("edge"), "event_id"], 25).select("timing", "event_id", "rank"))


# NAV 100,000: an event may lose 1,000, a date 5,000, a timing of a date 1,500
CAPPED = TR + """, c0 AS (SELECT event_id, event_date, timing, least(1.0, 1000 / premium) AS s0, premium * least(1.0, 1000 / premium) AS l0, (edge - 3) * least(1.0, 1000 / premium) AS e0 FROM tr),
c1 AS (SELECT *, sum(l0) OVER d AS tl, sum(greatest(e0, 0)) OVER d AS te FROM c0 WINDOW d AS (PARTITION BY event_date)), c2 AS (SELECT *, CASE WHEN tl <= 5000 THEN 1.0 WHEN te <= 0 THEN 5000 / tl ELSE least(1.0, 5000 * greatest(e0, 0) / te / l0) END AS s1 FROM c1),
c3 AS (SELECT event_id, event_date, timing, s0 * s1 AS s, l0 * s1 AS l1, e0 * s1 AS e1 FROM c2), c4 AS (SELECT *, sum(l1) OVER d AS tl, sum(greatest(e1, 0)) OVER d AS te FROM c3 WINDOW d AS (PARTITION BY event_date, timing)),
c5 AS (SELECT *, CASE WHEN tl <= 1500 OR tl <= 0 THEN 1.0 WHEN te <= 0 THEN 1500 / tl WHEN l1 <= 0 THEN 1.0 ELSE least(1.0, 1500 * greatest(e1, 0) / te / l1) END AS s2 FROM c4)"""


@query(f"WITH {CAPPED} SELECT event_id, round(l1 * s2, 5) AS premium, round(e1 * s2, 5) AS edge, round(s * s2, 6) AS scale FROM c5")
def portfolio_caps(spark, sf):
    t = trades(spark, sf).withColumn("edge", F.col("edge") - 3)
    out = strategy.portfolio_caps(t, 100_000.0, "event_date", "timing", "edge", "premium", 0.01, 0.05, 0.015)
    return out.select("event_id", F.round("premium", 5).alias("premium"), F.round("edge", 5).alias("edge"), F.round("scale", 6).alias("scale"))


NODES = ", ".join(f"({x!r}::DOUBLE, {w!r}::DOUBLE)" for x, w in strategy.hermite_nodes())


@query(f"""WITH l AS (SELECT p_partkey, p_retailprice AS spot, p_size / 500.0::DOUBLE AS v, unnest([{{'r': 1, 's': 1.0, 'k': 1000.0}}, {{'r': -1, 's': 1.0, 'k': 1000.0}}, {{'r': 1, 's': -1.0, 'k': 1200.0}}]) AS leg FROM part)
SELECT p_partkey, round(sum(w * leg.s * 2 * 100 * greatest(leg.r * (spot * exp(sqrt(v) * x) - leg.k), 0)), 2) AS expected_value, round(sum(DISTINCT leg.s * 2 * 100 * (10 + leg.k / 100 + leg.r)), 4) AS entry_cost FROM l, (VALUES {NODES}) n(x, w) GROUP BY 1""")
def expected_payoff_quadrature(spark, sf):
    """A straddle at 1,000 against a sold call at 1,200, two contracts each."""
    leg = lambda r, side, k: F.struct(F.lit(r).alias("right"), F.lit(side).alias("side"), F.lit(k).alias("strike"), F.lit(2.0).alias("contracts"), F.lit(10 + k / 100 + (1 if r == "call" else -1)).alias("price"))
    p = load(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("spot"), (F.col("p_size") / 500.0).alias("variance"), F.inline(F.array(leg("call", "long", 1000.0), leg("put", "long", 1000.0), leg("call", "short", 1200.0))))
    out = strategy.strategy_value(p, ["p_partkey"], "spot", "variance")
    return out.select("p_partkey", F.round("expected_value", 2).alias("expected_value"), F.round("entry_cost", 4).alias("entry_cost"))


PX = SPLIT + ", px AS (SELECT sp.*, (event_id * 31 % 101) / 1000.0::DOUBLE AS forecast, (event_id * 17 % 89) / 1000.0::DOUBLE AS ivar, value / 100 AS premium, CASE WHEN event_id % 40 > 0 THEN value / 1000 - (event_id % 97) * 3 END AS pnl, 10.0::DOUBLE + event_id % 11 AS fee, ['high', 'mid', 'low'][event_id % 3 + 1] AS liquidity_bucket, event_id % 2 = 0 AS is_main_dte_5_14, ['high', 'medium', 'low', NULL][event_id % 4 + 1] AS execution_confidence_band, (event_id % 10) / 10.0::DOUBLE AS execution_confidence_score FROM sp)"


def proxies(spark, sf):
    e = split_events(spark, sf)
    i = F.col("event_id")
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (i % n + 1).cast("int"))
    return e.withColumns({
        "forecast": (i * 31 % 101) / F.lit(1000.0), "ivar": (i * 17 % 89) / F.lit(1000.0), "premium": F.col("value") / 100, "pnl": F.when(i % 40 > 0, F.col("value") / 1000 - (i % 97) * 3), "fee": (10 + i % 11).cast("double"),
        "liquidity_bucket": pick(["high", "mid", "low"], 3), "is_main_dte_5_14": i % 2 == 0, "execution_confidence_band": pick(["high", "medium", "low", None], 4), "execution_confidence_score": (i % 10) / F.lit(10.0),
    })


TAKEN = PX + ", tk AS (SELECT *, coalesce(ivar > 0 AND premium > 0 AND forecast - ivar > 0.001 AND (forecast - ivar) / nullif(ivar, 0) * premium > 1.5 * fee, false) AS go, (forecast - ivar) / nullif(ivar, 0) * premium AS expected FROM px)"


@query(f"WITH {TAKEN} SELECT event_id, go AS should_trade, round(expected + 1e-8, 5) AS expected_edge, pnl IS NOT NULL AS pnl_available, round(go::INT * pnl, 6) AS gross, round(go::INT * pnl - go::INT * fee, 6) AS net FROM tk")
def proxy_trades(spark, sf):
    out = strategy.proxy_trades(proxies(spark, sf), "forecast", "ivar", "pnl", "premium", "fee", 0.001)
    return out.select("event_id", "should_trade", F.round(F.col("expected_edge") + 1e-8, 5).alias("expected_edge"), "pnl_available", F.round("gross", 6).alias("gross"), F.round("net", 6).alias("net"))


@query(f"""WITH {TAKEN}, c AS (SELECT *, go AND is_main_dte_5_14 AND coalesce(execution_confidence_band, 'missing') IN ('high', 'medium') AND execution_confidence_score >= 0.2 AS cand FROM tk),
r AS (SELECT *, CASE WHEN cand THEN row_number() OVER (PARTITION BY split, cand ORDER BY expected DESC, event_id) END AS place FROM c)
SELECT event_id, place::BIGINT AS policy_rank, coalesce(cand AND place <= 20, false) AS should_trade, round(CASE WHEN coalesce(cand AND place <= 20, false) THEN pnl ELSE 0 END, 6) AS gross FROM r""")
def policy_applied(spark, sf):
    t = strategy.proxy_trades(proxies(spark, sf), "forecast", "ivar", "pnl", "premium", "fee", 0.001)
    out = strategy.apply_policy(t, strategy.Policy(top_k=20, main_dte=True, bands=("high", "medium"), least_score=0.2), "event_id")
    return rounded(out.select("event_id", "policy_rank", "should_trade", "gross"), 6)


TUNED = PX + """, va AS (SELECT * FROM px WHERE split = 'validation'), md AS (SELECT (l * 2 + d) * 2 + q AS m, l, d, q FROM range(3) a(l), range(2) b(d), range(2) c(q)),
gr AS (SELECT t, e, ti, ei FROM (VALUES (0, 0.5), (1, 1.0), (2, 1.5), (3, 2.0), (4, 3.0)) a(ti, t), (VALUES (0, 0.0), (1, 0.0005), (2, 0.001)) b(ei, e)), ks AS (SELECT * FROM (VALUES (0, 1000000000), (1, 5), (2, 10), (3, 20)) k(ki, k)),
ok AS (SELECT va.*, ti, ei, m, (forecast - ivar) / ivar * premium AS expected FROM va, gr, md WHERE ivar > 0 AND premium > 0 AND forecast - ivar > e AND (forecast - ivar) / ivar * premium > t * fee
 AND (l = 0 OR liquidity_bucket = 'high' OR (l = 1 AND liquidity_bucket = 'mid')) AND (d = 0 OR is_main_dte_5_14) AND (execution_confidence_band = 'high' OR (q = 0 AND execution_confidence_band = 'medium')) AND execution_confidence_score >= CASE q WHEN 0 THEN 0.5 ELSE 0.8 END),
rk AS (SELECT *, row_number() OVER (PARTITION BY ti, ei, m ORDER BY expected DESC, event_id) AS best_first FROM ok), tr AS (SELECT ((ti * 3 + ei) * 4 + ki) * 12 + m AS candidate_id, event_date, event_id, pnl - fee AS net FROM rk, ks WHERE best_first <= k AND pnl IS NOT NULL)"""


@query(f"""WITH {TUNED}, {FALL.format(k='candidate_id', t='tr')}, s AS (SELECT candidate_id, count(*) AS n, sum(net) AS net FROM tr GROUP BY 1), every AS (SELECT i AS candidate_id FROM range(720) x(i)),
o AS (SELECT every.candidate_id, coalesce(s.n, 0) AS n, net, CASE WHEN s.n > 0 THEN net - 0.1 * abs(least(max_drawdown, 0)) ELSE -1e18 END AS objective FROM every LEFT JOIN s USING (candidate_id) LEFT JOIN dd USING (candidate_id)),
b AS (SELECT *, row_number() OVER (ORDER BY n >= 3 DESC, objective DESC, net DESC NULLS LAST, n DESC, candidate_id) AS p FROM o) SELECT candidate_id::BIGINT AS candidate_id, n, round(net, 6) AS net, CASE WHEN n > 0 THEN round(objective, 5) END AS objective, n >= 3 AS enough_trades, p = 1 AS selected FROM b""")
def policy_tuning(spark, sf):
    out = strategy.tune_policy(proxies(spark, sf), "event_id", "event_date", "forecast", "ivar", "pnl", "premium", "fee")
    return out.select(F.col("candidate_id").cast("long").alias("candidate_id"), "n", F.round("net", 6).alias("net"), F.when(F.col("n") > 0, F.round("objective", 5)).alias("objective"), "enough_trades", "selected")


@query(f"WITH {TR} SELECT event_id, edge - 5 AS edge_var, round(premium - 900, 6) AS expected_edge, premium - 900 > 1.5 * cost AS should_trade, CASE WHEN premium > 0 THEN floor(5000 / premium)::BIGINT END AS contracts FROM tr")
def premium_signal(spark, sf):
    t = trades(spark, sf).withColumns({"implied": F.lit(5.0), "entry": F.lit(900.0)})
    out = strategy.premium_signal(t, "edge", "implied", "premium", "entry", "cost")
    return out.select("event_id", "edge_var", F.round("expected_edge", 6).alias("expected_edge"), "should_trade", strategy.contract_count(F.lit(5000.0), F.col("premium")).alias("contracts"))


DEFEAT = """raw AS (SELECT l_returnflag AS model, l_linestatus, l_orderkey AS orderkey, l_linenumber AS line, l_extendedprice / 1000 AS y, l_quantity * 1.5 AS f, 38.0::DOUBLE AS b FROM lineitem),
er AS (SELECT *, f - b AS forecast_edge, y - b AS realised_edge, abs(f - y) AS model_error, abs(b - y) AS market_error FROM raw),
df AS (SELECT *, model_error < market_error AS near, forecast_edge > 0 AS up, realised_edge > 0 AS paid FROM er),
dt AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY forecast_edge DESC, orderkey * 10 + line) <= ceil(count(*) OVER (PARTITION BY model) / 10) AS top FROM df)"""
VERDICT = "count(*) AS n, round(avg(near::INT), 4) AS model_nearer_share, round(avg((up = paid)::INT), 4) AS sign_correct_share, round(avg((up AND NOT paid)::INT), 4) AS false_positive_share, round(avg((paid AND NOT up)::INT), 4) AS false_negative_share, round(avg((near AND up = paid AND realised_edge <> 0)::INT), 4) AS model_corrected_market_share, round(avg((NOT near AND up <> paid)::INT), 4) AS market_right_model_wrong_share, round(avg(model_error), 4) AS mean_model_error, round(avg(market_error), 4) AS mean_market_error, round(avg(market_error) - avg(model_error), 4) AS mae_lift, round(sqrt(avg(market_error ** 2)) - sqrt(avg(model_error ** 2)), 4) AS rmse_lift, round(avg((model_error ** 2 < market_error ** 2)::INT), 4) AS model_nearer_squared_share, round(avg(near::INT) FILTER (top), 4) AS top_decile_model_nearer_share, round(avg(paid::INT) FILTER (top), 4) AS top_decile_realised_positive_share"


def defeats(spark, sf, key="key"):
    raw = load(spark, sf, "lineitem").select(F.col("l_returnflag").alias("model"), "l_linestatus", F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("line"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_quantity") * 1.5).alias("f"), F.lit(38.0).alias("b"))
    return comparison.defeat_events(raw, "f", "y", "b", ["model"], key)


@query(f"WITH {DEFEAT} SELECT model, {VERDICT} FROM dt GROUP BY 1")
def defeat_summary(spark, sf):
    return rounded(comparison.defeat_summary(defeats(spark, sf), ["model"]))


@query(f"WITH {DEFEAT} SELECT model, 'l_linestatus' AS dimension, l_linestatus AS value, {VERDICT} FROM dt GROUP BY 1, 3 UNION ALL SELECT model, 'line', line::VARCHAR, {VERDICT} FROM dt GROUP BY 1, 3")
def defeat_breakdowns(spark, sf):
    return rounded(comparison.defeat_breakdowns(defeats(spark, sf), ["model"], ["l_linestatus", "line"]))


CASES = DEFEAT + """, cases AS (SELECT 'false_positive' AS case_type, abs(forecast_edge) AS severity, * FROM df WHERE up AND NOT paid
UNION ALL SELECT 'false_negative', abs(realised_edge), * FROM df WHERE paid AND NOT up
UNION ALL SELECT 'model_corrected_market', abs(market_error - model_error), * FROM df WHERE near AND up = paid AND realised_edge <> 0
UNION ALL SELECT 'market_right_model_wrong', abs(market_error - model_error), * FROM df WHERE NOT near AND up <> paid
UNION ALL SELECT 'execution_fragile', abs(forecast_edge), * FROM df WHERE line = 7), cb AS (SELECT *, row_number() OVER (PARTITION BY case_type, model ORDER BY severity DESC, orderkey, line) AS rank FROM cases QUALIFY rank <= 25)"""


def cases(spark, sf):
    return comparison.casebook(defeats(spark, sf, None), ["model"], ["orderkey", "line"], F.col("line") == 7)  # no case asks for the top decile


@query(f"WITH {CASES} SELECT case_type, model, orderkey, line::BIGINT AS line, round(severity, 7) AS severity, rank FROM cb")
def casebook(spark, sf):
    return rounded(cases(spark, sf).select("case_type", "model", "orderkey", "line", "severity", "rank"), 7)


BANDED = "CASE orderkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'missing' END"


@query(f"WITH {CASES} SELECT {BANDED} AS execution_confidence_band, case_type, model, count(*) AS n, round(avg(severity), 7) AS mean_severity, round(avg(model_error), 7) AS mean_model_error, round(avg(market_error), 7) AS mean_market_error FROM cb GROUP BY 1, 2, 3")
def band_cases(spark, sf):
    banded = cases(spark, sf).withColumn("execution_confidence_band", F.expr("CASE orderkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' END"))
    return rounded(comparison.band_cases(banded, ["model"]), 7)


@query(f"WITH {PX} SELECT split, timing AS target_id, coalesce(execution_confidence_band, 'missing') AS execution_confidence_band, count(*) AS n_target_rows, count(DISTINCT event_id) AS n_events FROM px GROUP BY 1, 2, 3")
def band_coverage(spark, sf):
    return comparison.band_coverage(proxies(spark, sf).withColumn("target_id", F.col("timing")))


@query(f"WITH {PX} SELECT coalesce(execution_confidence_band, 'missing') AS execution_confidence_band, count(*) AS n_events, count(pnl) AS quote_mid_ivar_event_events, count(*) AS execution_confidence_score_events, round(quantile_cont(pnl, 0.5), 5) AS median_quote_mid_ivar_event, round(quantile_cont(execution_confidence_score, 0.5), 5) AS median_execution_confidence_score FROM px GROUP BY 1")
def band_ivar(spark, sf):
    return rounded(comparison.band_ivar(proxies(spark, sf).withColumn("quote_mid_ivar_event", F.col("pnl"))), 5)


@query(f"""WITH {DEFEAT}, bk AS (SELECT model, 'l_linestatus' AS dimension, l_linestatus AS value, count(*) AS n, avg(market_error) - avg(model_error) AS lift FROM df GROUP BY 1, 3 UNION ALL SELECT model, 'line', line::VARCHAR, count(*), avg(market_error) - avg(model_error) FROM df GROUP BY 1, 3)
SELECT 'ivar_defeat' AS source, dimension, count(*) AS row_count, count(DISTINCT model) AS model_count, count(DISTINCT value) AS subgroup_count, min(n)::DOUBLE AS min_cell_n, quantile_cont(n, 0.5) AS median_cell_n, max(n)::DOUBLE AS max_cell_n, count(*) FILTER (lift > 0) AS positive_metric_rows, round(avg((lift > 0)::INT), 6) AS positive_metric_share, round(max(lift), 6) AS best_metric_value, CASE WHEN count(DISTINCT value) < 2 THEN 'single_bucket_no_robustness_claim' WHEN min(n) < 5 THEN 'exploratory_small_cells' ELSE 'available_multi_bucket' END AS claim_gate_status FROM bk GROUP BY 2""")
def robustness_summary(spark, sf):
    cells = comparison.defeat_breakdowns(defeats(spark, sf), ["model"], ["l_linestatus", "line"])
    out = comparison.robustness(cells, "ivar_defeat", "n", "mae_lift", ["model"])
    return rounded(out.select("source", "dimension", "row_count", "model_count", "subgroup_count", "min_cell_n", "median_cell_n", "max_cell_n", "positive_metric_rows", "positive_metric_share", "best_metric_value", "claim_gate_status"), 6)


LONG = TR + ", lg AS (SELECT timing, event_id, edge - 5 AS e, unnest([{'m': 'a', 's': (event_id * 7 % 50)::DOUBLE}, {'m': 'b', 's': CASE WHEN event_id % 5 > 0 THEN edge + event_id % 13 END}, {'m': 'c', 's': -edge}]) AS x FROM tr), ml AS (SELECT timing, event_id, e, x.m AS model, x.s AS score FROM lg)"


def scored(spark, sf):
    i = F.col("event_id")
    made = F.inline(F.array(F.struct(F.lit("a").alias("model"), (i * 7 % 50).cast("double").alias("score")), F.struct(F.lit("b").alias("model"), F.when(i % 5 > 0, F.col("edge") + i % 13).alias("score")), F.struct(F.lit("c").alias("model"), (-F.col("edge")).alias("score"))))
    return trades(spark, sf).select("timing", "event_id", (F.col("edge") - 5).alias("e"), made)


@query(f"""WITH {LONG}, pr AS (SELECT a.timing, a.event_id, a.model AS model_a, b.model AS model_b, a.score AS sa, b.score AS sb, (a.e > 0)::INT AS y FROM ml a JOIN ml b ON a.timing = b.timing AND a.event_id = b.event_id AND a.model < b.model WHERE a.score IS NOT NULL AND b.score IS NOT NULL),
r AS (SELECT *, rank() OVER (PARTITION BY timing, model_a, model_b ORDER BY sa) + (count(*) OVER (PARTITION BY timing, model_a, model_b, sa) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY timing, model_a, model_b ORDER BY sb) + (count(*) OVER (PARTITION BY timing, model_a, model_b, sb) - 1) / 2.0 AS rb FROM pr),
u AS (SELECT timing, model_a, model_b, count(*) AS common_rows, (sum(ra) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y)))::DOUBLE AS auc_a, (sum(rb) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y)))::DOUBLE AS auc_b FROM r GROUP BY 1, 2, 3)
SELECT timing, model_a, model_b, common_rows, round(auc_a, 6) AS auc_a, round(auc_b, 6) AS auc_b, round(auc_a - auc_b, 6) AS auc_lift FROM u""")
def pairwise_auc(spark, sf):
    return rounded(comparison.pairwise_auc(scored(spark, sf), ["timing"], "model", "event_id", "score", "e"), 6)


@query()
def bootstrap_auc(spark, sf):
    return rounded(comparison.bootstrap_auc(scored(spark, sf), ["timing"], "model", "event_id", "score", "e"), 6)


PAIRS = LONG + ", pr AS (SELECT a.timing, a.event_id, a.model AS model_a, b.model AS model_b, a.score AS sa, b.score AS sb, (a.e > 0)::INT AS y FROM ml a JOIN ml b ON a.timing = b.timing AND a.event_id = b.event_id AND a.model < b.model WHERE a.score IS NOT NULL AND b.score IS NOT NULL)"


@query(f"""WITH {PAIRS}, wp AS (SELECT timing, model_a, model_b, d, y, unnest([sa, sb]) AS s, unnest(['a', 'b']) AS side, CASE d WHEN 0 THEN 1 ELSE event_id % 4 END AS w FROM pr, unnest([0, 1]) t(d)),
r AS (SELECT *, sum(w * (1 - y)) OVER (PARTITION BY timing, model_a, model_b, d, side ORDER BY s) - sum(w * (1 - y)) OVER (PARTITION BY timing, model_a, model_b, d, side, s) / 2.0 AS below FROM wp),
u AS (SELECT timing, model_a, model_b, d, side, (sum(w * y * below) / (sum(w * y) * sum(w * (1 - y))))::DOUBLE AS auc FROM r GROUP BY ALL)
SELECT timing, model_a, model_b, round(max(auc) FILTER (d = 0 AND side = 'a') - max(auc) FILTER (d = 0 AND side = 'b'), 6) AS plain_lift, round(max(auc) FILTER (d = 1 AND side = 'a') - max(auc) FILTER (d = 1 AND side = 'b'), 6) AS weighted_lift FROM u GROUP BY 1, 2, 3""")
def weighted_lifts(spark, sf):
    """Two given draws: every event once, and every event as often as its number modulo 4."""
    rows = scored(spark, sf)
    weights = rows.select("event_id").distinct().withColumn("w", F.concat(F.unhex(F.lit("01")), F.unhex(F.lpad((F.col("event_id") % 4).cast("string"), 2, "0"))))
    out = comparison.bootstrap_lifts(rows, ["timing"], "model", "event_id", "score", "e", 2, weights=weights)
    return rounded(out.select("timing", "model_a", "model_b", F.get("lifts", F.lit(0)).alias("plain_lift"), F.get("lifts", F.lit(1)).alias("weighted_lift")), 6)


@query(f"""WITH {LONG}, hm AS (SELECT *, (e > 0)::INT AS y FROM ml WHERE score IS NOT NULL), sz AS (SELECT timing, model, count(*) AS n FROM ml GROUP BY 1, 2),
r AS (SELECT *, rank() OVER (PARTITION BY timing, model ORDER BY score) + (count(*) OVER (PARTITION BY timing, model, score) - 1) / 2.0 AS r FROM hm),
u AS (SELECT timing, model, count(*) AS coverage, ((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))))::DOUBLE AS auc FROM r GROUP BY 1, 2),
t AS (SELECT timing, max(auc) FILTER (model = 'a') AS m, max(auc) FILTER (model = 'c') AS s, max(auc) FILTER (model = 'b') AS b FROM u GROUP BY 1)
SELECT timing, model AS model_id, coverage, round(1 - coverage / n::DOUBLE, 6) AS drop_rate, round(auc - m, 6) AS mask_only_lift, round(auc - s, 6) AS time_shuffle_lift, round(auc - b, 6) AS best_real_sequence_lift FROM u JOIN sz USING (timing, model) JOIN t USING (timing)""")
def sequence_controls(spark, sf):
    out = comparison.sequence_controls(scored(spark, sf), ["timing"], "model", "event_id", "score", "e", ["b"], "a", "c")
    return rounded(out.select("timing", "model_id", "coverage", "drop_rate", "mask_only_lift", "time_shuffle_lift", "best_real_sequence_lift"), 6)


@query(f"""WITH {SPLIT}, d AS (SELECT timing, event_id, split, (event_id * 31 % 101)::DOUBLE AS x, (event_id * 17 % 89)::DOUBLE AS z, value / 1000 AS y, 150.0::DOUBLE AS i FROM sp),
f AS (SELECT timing, count(*) AS validation_rows, var_pop(x) AS vx, var_pop(z) AS vz, covar_pop(x, z) AS xz, covar_pop(x, y) AS xy, covar_pop(z, y) AS zy, avg(x) AS mx, avg(z) AS mz, avg(y) AS my FROM d WHERE split = 'validation' GROUP BY 1),
s AS (SELECT d.*, validation_rows, x - i AS base, my + (xy * vz - zy * xz) / (vx * vz - xz * xz) * (x - mx) + (zy * vx - xy * xz) / (vx * vz - xz * xz) * (z - mz) - i AS stack, (y > i)::INT AS h FROM d JOIN f USING (timing) WHERE split = 'test'),
r AS (SELECT *, rank() OVER (PARTITION BY timing ORDER BY base) + (count(*) OVER (PARTITION BY timing, base) - 1) / 2.0 AS rb, rank() OVER (PARTITION BY timing ORDER BY round(stack, 9)) + (count(*) OVER (PARTITION BY timing, round(stack, 9)) - 1) / 2.0 AS rs FROM s)
SELECT timing, any_value(validation_rows) AS validation_rows, count(*) AS test_rows, round((sum(rb) FILTER (h = 1) - sum(h) * (sum(h) + 1) / 2.0) / (sum(h) * (count(*) - sum(h)))::DOUBLE, 4) AS auc_base, round((sum(rs) FILTER (h = 1) - sum(h) * (sum(h) + 1) / 2.0) / (sum(h) * (count(*) - sum(h)))::DOUBLE, 4) AS auc_stacked FROM r GROUP BY 1""")
def stacked_increment(spark, sf):
    i = F.col("event_id")
    d = split_events(spark, sf).withColumns({"x": (i * 31 % 101).cast("double"), "z": (i * 17 % 89).cast("double"), "y": F.col("value") / 1000, "implied": F.lit(150.0)})
    out = comparison.stacked_increment(d, ["timing"], "x", "z", "y", "implied", "event_id")
    return rounded(out.select("timing", "validation_rows", "test_rows", "auc_base", "auc_stacked"))


TARGETED = "SELECT event_id, ['day_c2c', 'jump_c2o', 'reaction_o2c'][t + 1] AS target_id, CASE WHEN event_id % 7 <> t THEN value * (t + 1) END AS forecast FROM ev, range(3) r(t)"


@query(f"WITH {EV}, l AS ({TARGETED}), s AS (SELECT event_id, max(forecast) FILTER (target_id = 'jump_c2o') + max(forecast) FILTER (target_id = 'reaction_o2c') AS a FROM l GROUP BY 1) SELECT event_id, target_id, CASE WHEN target_id = 'day_c2c' THEN round(a, 4) END AS forecast_additive FROM l JOIN s USING (event_id)")
def additive_forecast(spark, sf):
    t = F.posexplode(F.array(*[F.lit(x) for x in ("day_c2c", "jump_c2o", "reaction_o2c")])).alias("t", "target_id")
    long = order_events(spark, sf).select("event_id", "value", t).withColumn("forecast", F.when(F.col("event_id") % 7 != F.col("t"), F.col("value") * (F.col("t") + 1)))
    return rounded(comparison.additive_forecast(long, ["event_id"], "target_id", "forecast").select("event_id", "target_id", "forecast_additive"))


@query(f"WITH {FC}, p AS (SELECT y, b + y / 10 AS i FROM fc WHERE b IS NOT NULL) SELECT count(*) AS paired_rows, round(stddev_samp(y), 5) AS sd_rvar, round(stddev_samp(i), 5) AS sd_ivar, round(stddev_samp(y) / stddev_samp(i), 5) AS sd_ratio, round(avg(y) / avg(i), 5) AS mean_ratio FROM p")
def scale_diagnostic(spark, sf):
    return rounded(comparison.scale_diagnostic(forecasts(spark, sf).withColumn("i", F.col("b") + F.col("y") / 10), "y", "i"), 5)


@query(f"WITH {PX}, e AS (SELECT event_id, split, forecast - ivar AS a, execution_confidence_score - ivar AS b FROM px), r AS (SELECT event_id, (rank() OVER (PARTITION BY split ORDER BY a) + (count(*) OVER (PARTITION BY split, a) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY split) AS ra, (rank() OVER (PARTITION BY split ORDER BY b) + (count(*) OVER (PARTITION BY split, b) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY split) AS rb FROM e) SELECT event_id, round((ra + rb) / 2, 6) AS rank_signal FROM r")
def rank_signal(spark, sf):
    return rounded(models.rank_signal(proxies(spark, sf), ["forecast", "execution_confidence_score"], "ivar", "event_id").select("event_id", "rank_signal"), 6)


def _learnable(spark, sf) -> DataFrame:
    return proxies(spark, sf).withColumns({"target": F.abs(F.col("premium") / 10000 + F.col("forecast")), "implied": F.lit(0.15)})


FEATURES = ("forecast", "premium", "execution_confidence_score")
ORDER = ("event_date", "event_id")


@query()
def elastic_net(spark, sf):
    out, _ = models.elastic_net(_learnable(spark, sf), FEATURES, "target", ORDER)
    return rounded(out.select("event_id", "split", "forecast_elastic_net"), 6)


@query()
def boosted_trees(spark, sf):
    out, _ = models.boosted_trees(_learnable(spark, sf), FEATURES, "target", "implied", "event_id")
    return rounded(out.select("event_id", "split", "forecast_gbt"), 6)


# three standardised features and a penalty of 0.01: the weights by Cramer's rule
RIDGE = f"""WITH {PX}, lr AS (SELECT event_id, split, coalesce(forecast, 0)::DOUBLE AS x1, coalesce(premium, 0)::DOUBLE AS x2, coalesce(execution_confidence_score, 0)::DOUBLE AS x3, abs(premium / 10000 + forecast)::DOUBLE AS y FROM px),
tr AS (SELECT * FROM lr WHERE split = 'train' AND y IS NOT NULL),
mo AS (SELECT avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3, avg(y) AS my, stddev_pop(x1) AS s1, stddev_pop(x2) AS s2, stddev_pop(x3) AS s3, covar_pop(x1, x2) AS c12, covar_pop(x1, x3) AS c13, covar_pop(x2, x3) AS c23, covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2, covar_pop(x3, y) AS c3 FROM tr),
gr AS (SELECT *, 1.01::DOUBLE AS d, c12 / (s1 * s2) AS a, c13 / (s1 * s3) AS b, c23 / (s2 * s3) AS c, c1 / s1 AS q1, c2 / s2 AS q2, c3 / s3 AS q3 FROM mo),
de AS (SELECT *, d * (d * d - c * c) - a * (a * d - c * b) + b * (a * c - d * b) AS det FROM gr),
we AS (SELECT *, (q1 * (d * d - c * c) - a * (q2 * d - c * q3) + b * (q2 * c - d * q3)) / det / s1 AS w1, (d * (q2 * d - c * q3) - q1 * (a * d - c * b) + b * (a * q3 - q2 * b)) / det / s2 AS w2,
 (d * (d * q3 - q2 * c) - a * (a * q3 - q2 * b) + q1 * (a * c - d * b)) / det / s3 AS w3 FROM de)"""


@query(RIDGE + " SELECT event_id, split, CASE WHEN split <> 'train' THEN round(greatest(1e-6, my + w1 * (x1 - m1) + w2 * (x2 - m2) + w3 * (x3 - m3)), 6) END AS forecast_ridge FROM lr, we")
def ridge_regression(spark, sf):
    return rounded(models.ridge(_learnable(spark, sf), FEATURES, "target")[0].select("event_id", "split", "forecast_ridge"), 6)


# three targets: one with every number, one without numbers in validation rows, one without test rows
@query(f"""WITH {PX}, lo AS (SELECT event_id, split, t AS target_id, abs(premium / 10000 + forecast) AS y FROM px, unnest(['day_c2c', 'jump_c2o', 'reaction_o2c']) u(t) WHERE NOT (t = 'reaction_o2c' AND split = 'test')),
co AS (SELECT target_id, count(*) FILTER (split = 'train') AS train_rows, count(*) FILTER (split = 'validation') AS validation_rows, count(*) FILTER (split = 'test') AS test_rows FROM lo GROUP BY 1)
SELECT target_id, model_id, train_rows, validation_rows, test_rows, CASE target_id WHEN 'day_c2c' THEN validation_rows ELSE 0 END AS validation_prediction_rows, CASE target_id WHEN 'day_c2c' THEN test_rows ELSE 0 END AS test_prediction_rows,
CASE target_id WHEN 'day_c2c' THEN 'trained' WHEN 'jump_c2o' THEN 'skipped_insufficient_finite_targets' ELSE 'skipped_insufficient_test_rows' END AS status, 3::BIGINT AS feature_count FROM co, unnest(['elastic_net', 'gbt', 'ridge']) v(model_id)""")
def model_suite(spark, sf):
    value = F.when(F.col("target_id") == "day_c2c", F.col("target")).when(F.col("target_id") == "jump_c2o", F.when(F.col("split") != "validation", F.col("target") / 2)).otherwise(F.col("target") / 3)
    names = ("day_c2c", "jump_c2o", "reaction_o2c")
    long = _learnable(spark, sf).select("*", F.explode(F.array(*map(F.lit, names))).alias("target_id")).where("NOT (target_id = 'reaction_o2c' AND split = 'test')")
    return models.model_suite(long.withColumn("target", value), FEATURES, ORDER, "target", "implied", "event_id", names)[1]


@query(f"""WITH {FC}, so AS (SELECT model, key, f - b AS score, y - b AS edge FROM fc WHERE b IS NOT NULL), rk AS (SELECT *, (edge > 0)::INT AS hit, count(*) OVER (PARTITION BY model) AS n, rank() OVER (PARTITION BY model ORDER BY score) + (count(*) OVER (PARTITION BY model, score) - 1) / 2.0 AS r, row_number() OVER (PARTITION BY model ORDER BY score DESC, key) AS p FROM so),
o AS (SELECT model, (sum(r) FILTER (hit = 1) - sum(hit) * (sum(hit) + 1) / 2.0) / (sum(hit) * (count(*) - sum(hit)))::DOUBLE AS auc, avg(hit) FILTER (p <= ceil(n / 10)) AS top FROM rk GROUP BY 1), e AS (SELECT model, sqrt(avg((f - y) ** 2)) AS rmse FROM fc WHERE b IS NOT NULL GROUP BY 1)
SELECT model, round(auc + 0.001 * greatest(top, 0) - 0.000001 * rmse, 6) AS objective FROM o JOIN e USING (model) ORDER BY 1""")
def tuning_objective(spark, sf):
    """The number that trees are chosen by, for three models' forecasts."""
    rows = forecasts(spark, sf)
    found = [(m, models.tuning_objective(rows.where(F.col("model") == m), "f", "y", "b", "key")) for m in ("A", "N", "R")]
    return rounded(spark.createDataFrame(found, "model string, objective double"), 6)
