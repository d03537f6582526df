"""Proxy trades from forecasts, trade policies and their choice on validation rows, option payoffs and portfolio caps."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, fields

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.numbers import number
from panelspark.operators import metrics

# The grid of policies and the bounds of quote filters.
THRESHOLDS, EDGES, TOP_K = (0.5, 1.0, 1.5, 2.0, 3.0), (0.0, 0.0005, 0.001), (None, 5, 10, 20)
LEAST_TRADES, DRAWDOWN_PENALTY, MOST_AGE, MOST_SPREAD, COST_SHARE = 3, 0.10, 60.0, 0.25, 0.10
MULTIPLIER = 100.0


def hermite_nodes(n: int = 21) -> list[tuple[float, float]]:
    """(x, weight) for the mean of a function of a standard normal number: Gauss-Hermite nodes times sqrt 2, weights over sqrt pi."""
    x, w = np.polynomial.hermite.hermgauss(n)
    return list(zip((x * np.sqrt(2)).tolist(), (w / np.sqrt(np.pi)).tolist()))


TWO_POINT = [(-1.0, 0.5), (1.0, 0.5)]


def strategy_value(legs: DataFrame, key: Sequence[str], spot: str, variance: str, nodes: Sequence[tuple[float, float]] | None = None) -> DataFrame:
    """Per key the expected payoff of its legs and what entering them costs.

    ``legs``: strike, right (call or put), side (long or short), contracts, price. The move's log is normal around 0
    (or at the given nodes) with the given variance; zero variance is one node.
    """
    points = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(w).alias("w")) for x, w in nodes or hermite_nodes()])
    deviation = F.sqrt(F.col(variance))
    after = lambda p: F.col(spot) * F.exp(deviation * p["x"])
    pay = lambda s: F.greatest(F.when(F.col("right") == "call", s - F.col("strike")).otherwise(F.col("strike") - s), F.lit(0.0))
    expected = F.when(F.col(variance) == 0, pay(F.col(spot))).when(F.col(variance) > 0, F.aggregate(points, F.lit(0.0), lambda a, p: a + p["w"] * pay(after(p))))
    units = F.when(F.col("side") == "long", 1.0).otherwise(-1.0) * F.col("contracts") * MULTIPLIER
    return legs.groupBy(*key).agg(F.sum(units * expected).alias("expected_value"), F.sum(units * F.col("price")).alias("entry_cost"))


def half_spread_cost(quotes: DataFrame, key: Sequence[str], contracts: float = 1.0) -> DataFrame:
    """Per key half the spread of all its quotes, in money."""
    return quotes.groupBy(*key).agg(F.sum((F.col("ask") - F.col("bid")) / 2 * contracts * MULTIPLIER).alias("transaction_cost"))


def premium_signal(df: DataFrame, forecast: str, ivar: str, value: str, entry: str, cost: str, threshold: float = 1.5) -> DataFrame:
    """Adds edge_var, expected_edge (value less entry cost) and should_trade (that beats ``threshold`` times the cost)."""
    out = df.withColumns({"edge_var": F.col(forecast) - F.col(ivar), "expected_edge": F.col(value) - F.col(entry)})
    return out.withColumn("should_trade", F.col("expected_edge") > threshold * F.col(cost))


def contract_count(target: Column, loss: Column) -> Column:
    """Whole contracts within a loss; null where a contract can't lose."""
    return F.when(loss > 0, F.floor(target / loss))


def proxy_cost(premium: str, share: float) -> Column:
    return F.coalesce(number(premium), F.lit(0.0)) * share


def log_target(value: Column, floor: float = metrics.FLOOR) -> Column:
    return F.ln(F.greatest(value, F.lit(0.0)) + floor)


def from_log(value: Column, floor: float = metrics.FLOOR) -> Column:
    return F.when(value.isNotNull(), F.greatest(F.exp(value) - floor, F.lit(floor)))


def ensemble(a: str, b: str, floor: float = metrics.FLOOR) -> Column:
    """The mean of two forecasts, floored; null where one is missing."""
    mean = (number(a) + number(b)) / 2
    return F.when(mean.isNotNull(), F.greatest(mean, F.lit(floor)))


def availability(df: DataFrame, forecast: str, split: str = "split") -> DataFrame:
    """One row: usable forecasts in all, among validation and among test rows."""
    ok = number(forecast).isNotNull()
    return df.agg(F.count_if(ok).alias("finite"), F.count_if(ok & (F.col(split) == "validation")).alias("validation_finite"), F.count_if(ok & (F.col(split) == "test")).alias("test_finite"))


def proxy_trades(df: DataFrame, forecast: str, ivar: str, pnl: str, premium: str, cost: str | None = None, min_edge: float | Column = 0.0, threshold: float | Column = 1.5) -> DataFrame:
    """Adds the trade that a forecast suggests: buy where its edge over the implied variance, in money, beats the cost.

    forecast_edge, expected_edge, threshold_usd, should_trade, cost, gross, net, return_on_premium, pnl_available. Without
    a cost column the cost is a tenth of the premium. A row whose result is missing has none, traded or not.
    """
    f, i, p = number(forecast), number(ivar), number(premium)
    c = number(cost) if cost in df.columns else F.coalesce(p * COST_SHARE, F.lit(0.0))
    edge, expected = f - i, (f - i) / F.nullif(i, F.lit(0.0)) * p
    go = F.coalesce((i > 0) & (p > 0) & (edge > min_edge) & (expected > threshold * c), F.lit(False))
    out = df.withColumns({"forecast_edge": edge, "expected_edge": expected, "threshold_usd": threshold * c, "pnl_available": number(pnl).isNotNull(), "should_trade": go, "cost": c})
    out = out.withColumn("gross", F.col("should_trade").cast("double") * number(pnl)).withColumn("net", F.col("gross") - F.col("should_trade").cast("double") * F.col("cost"))
    return out.withColumn("return_on_premium", F.col("net") / F.nullif(F.abs(p), F.lit(0.0)))


@dataclass(frozen=True)
class Policy:
    """A trade filter. Empty lists and None ask for nothing."""

    threshold: float = 1.5
    min_edge: float = 0.0
    top_k: int | None = None
    liquidity_buckets: tuple[str, ...] = ()
    main_dte: bool | None = None
    dte_buckets: tuple[str, ...] = ()
    bands: tuple[str, ...] = ()
    least_score: float | None = None
    most_spread: float | None = None
    most_age: float | None = None


#: The column that each filter reads.
FILTERED = {"liquidity_buckets": "liquidity_bucket", "main_dte": "is_main_dte_5_14", "dte_buckets": "dte_bucket", "bands": "execution_confidence_band", "least_score": "execution_confidence_score", "most_spread": "median_spread_over_mid", "most_age": "max_quote_age_seconds"}


def passes(df: DataFrame, policy: Policy) -> Column:
    """Whether a row passes the policy's filters; a filter whose column is absent lets nothing pass."""
    out = F.lit(True)
    for name, column in FILTERED.items():
        asked = getattr(policy, name)
        if asked is None or asked == ():
            continue
        if column not in df.columns:
            return F.lit(False)
        c = F.col(column)
        if name == "main_dte":
            test = F.coalesce(c.cast("boolean"), F.lit(False)) == asked
        elif name in ("most_spread", "most_age"):
            test = number(column) <= asked
        elif name == "least_score":
            test = number(column) >= asked
        else:
            test = (F.coalesce(c, F.lit("missing")) if name == "bands" else c).isin(*asked)
        out = out & F.coalesce(test, F.lit(False))
    return out


def policy_columns(policy: Policy) -> dict[str, Column]:
    """The policy's fields as literal columns."""
    text = lambda v: F.lit(",".join(v)) if isinstance(v, tuple) else F.lit(v)
    return {f"policy_{f.name}": text(getattr(policy, f.name)) for f in fields(policy)}


def apply_policy(trades: DataFrame, policy: Policy, key: str, split: str = "split", score: str = "expected_edge") -> DataFrame:
    """The trades of ``proxy_trades`` under a policy: those that pass and, of each split, its ``top_k`` best scores (ties by key).

    Rows that aren't traded have gross and net 0. policy_rank is the place among the split's candidates.
    """
    out = trades.withColumn("passes", passes(trades, policy)).withColumns(policy_columns(policy))
    candidate = F.col("should_trade") & F.col("passes")
    if policy.top_k is not None:
        ranked = F.when(candidate, number(score))
        place = F.row_number().over(Window.partitionBy(F.coalesce(split, F.lit("_all"))).orderBy(ranked.desc_nulls_last(), key))
        out = out.withColumn("policy_rank", F.when(ranked.isNotNull(), place))
        candidate = candidate & (F.col("policy_rank") <= policy.top_k)
    else:
        out = out.withColumn("policy_rank", F.lit(None).cast("int"))
    out = out.withColumn("should_trade", F.coalesce(candidate, F.lit(False)))
    gross = F.when(F.col("should_trade"), F.col("gross")).otherwise(0.0)
    return out.withColumn("gross", gross).withColumn("net", F.col("gross") - F.col("should_trade").cast("double") * F.coalesce("cost", F.lit(0.0)))


def filter_modes(validation: DataFrame) -> list[Policy]:
    """The filters worth trying on these rows: by liquidity, by days to expiry and by quote quality, each alone or not at all."""
    has = lambda c: c in validation.columns
    asked = [F.collect_set("liquidity_bucket").alias("liquidity") if has("liquidity_bucket") else F.array().alias("liquidity")]
    asked.append(F.count_if(F.col("dte_bucket") == "main_5_14").alias("main") if has("dte_bucket") else F.lit(0).alias("main"))
    asked.append(F.count_if(F.col("execution_confidence_band").isin("high", "medium")).alias("usable") if has("execution_confidence_band") else F.lit(0).alias("usable"))
    found = validation.agg(F.count("*").alias("rows"), *asked).head()
    near = tuple(b for b in ("high", "mid") if b in found["liquidity"])
    liquidity = dict.fromkeys([(), *([near] if near else []), *([("high",)] if "high" in near else [])])
    dte = [{}]
    if has("is_main_dte_5_14"):
        dte.append({"main_dte": True})
    elif found["main"]:
        dte.append({"dte_buckets": ("main_5_14",)})
    quotes = [{}]
    if found["usable"]:
        bound = lambda name, value: {name: value if has(FILTERED[name]) else None}
        age = bound("most_age", MOST_AGE)
        quotes = [{"bands": ("high", "medium")} | bound("least_score", 0.5) | bound("most_spread", MOST_SPREAD) | age, {"bands": ("high",)} | bound("least_score", 0.8) | bound("most_spread", 0.15) | age]
    return [Policy(liquidity_buckets=x, **y, **z) for x in liquidity for y in dte for z in quotes]


def tune_policy(df: DataFrame, key: str, date: str, forecast: str, ivar: str, pnl: str, premium: str, cost: str | None = None, split: str = "split", thresholds: Sequence[float] = THRESHOLDS, edges: Sequence[float] = EDGES, top_ks: Sequence[int | None] = TOP_K, least_trades: int = LEAST_TRADES, penalty: float = DRAWDOWN_PENALTY) -> DataFrame:
    """Every policy of the grid with its result on validation rows and whether it is the one selected.

    The objective is the net result less ``penalty`` times the drawdown. Policies with ``least_trades`` are preferred; ties
    go to the larger net result, then more trades, then the first of the grid. Validation rows meet the grid's signals
    once (an explode over a constant), and only rows that a policy trades go on. Sums are exact, so that policies of the same trades tie.
    """
    validation = df.where(F.col(split) == "validation")
    modes = filter_modes(validation)
    signals = [(float(t), float(e), m) for t in thresholds if t > 0 for e in edges for m in range(len(modes))]
    # in the grid's order: thresholds, edges, top k, filters
    number_of = lambda i, k: (i // len(modes) * len(top_ks) + k) * len(modes) + i % len(modes)
    policies = [(number_of(i, k), t, e, n, m) for i, (t, e, m) in enumerate(signals) for k, n in enumerate(top_ks)]
    tried = [f.name for f in fields(Policy) if f.name not in ("threshold", "min_edge", "top_k")]
    text = lambda v: ",".join(v) if isinstance(v, tuple) else None if v is None else str(v)
    grid = df.sparkSession.createDataFrame([(i, t, e, n, *[text(asdict(modes[m])[c]) for c in tried]) for i, t, e, n, m in policies], f"candidate_id int, threshold double, min_edge double, top_k int, {', '.join(f'{c} string' for c in tried)}")

    base = proxy_trades(validation, forecast, ivar, pnl, premium, cost, -float("inf"), -float("inf"))
    met = base.select(key, date, "forecast_edge", "expected_edge", F.col("cost"), number(pnl).alias("pnl"), F.abs(number(premium)).alias("premium"), number(ivar).alias("i"), number(premium).alias("p"), F.array(*[passes(validation, m) for m in modes]).alias("modes"))
    signal = F.inline(F.array(*[F.struct(F.lit(i).alias("signal"), F.lit(t).alias("t"), F.lit(e).alias("e"), F.lit(m).alias("mode")) for i, (t, e, m) in enumerate(signals)]))
    taken = met.where("i > 0 AND p > 0").select("*", signal).where((F.col("forecast_edge") > F.col("e")) & (F.col("expected_edge") > F.col("t") * F.col("cost")) & F.element_at("modes", F.col("mode") + 1))
    taken = taken.select(key, date, "signal", "expected_edge", "premium", F.col("pnl").alias("gross"), (F.col("pnl") - F.col("cost")).alias("net"))
    parts = []
    for k, n in enumerate(top_ks):
        part = taken
        if n is not None:
            part = taken.withColumn("_n", F.row_number().over(Window.partitionBy("signal").orderBy(F.col("expected_edge").desc(), key))).where(F.col("_n") <= n).drop("_n")
        parts.append(part.withColumn("candidate_id", ((F.floor(F.col("signal") / len(modes)) * len(top_ks) + k) * len(modes) + F.col("signal") % len(modes)).cast("int")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    results = metrics.strategy_metrics(every, ["candidate_id"], [date, key], "net", "gross", "premium", exactly=True)
    out = grid.join(results, "candidate_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    out = out.withColumn("objective", F.when(F.col("n") > 0, F.col("net") - penalty * F.abs(F.least("max_drawdown", F.lit(0.0)))).otherwise(-1e18))
    out = out.withColumn("enough_trades", (F.col("n") > 0) & (F.col("n") >= least_trades))
    # as many rows as the grid has policies
    best = F.row_number().over(Window.orderBy(F.col("enough_trades").desc(), F.col("objective").desc(), F.col("net").desc_nulls_last(), F.col("n").desc(), "candidate_id"))
    return out.withColumn("selected", best == 1)


def top_k(df: DataFrame, by: Sequence[str], order: Sequence, k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group in ``order`` with their place; Spark keeps k rows a group before it shuffles."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def policy_grid(trades: DataFrame, thresholds: Sequence[float], edges: Sequence[float], edge: str, cost: str, net: str) -> DataFrame:
    """Every (threshold, least edge) pair's trades and net result. The grid is a constant, the trades are read once."""
    grid = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.lit(float(e)).alias("min_edge")) for t in thresholds for e in edges]))
    each = trades.select(edge, cost, net, grid.alias("_g")).select("*", "_g.*")
    taken = (F.col(edge) > F.col("threshold") * F.col(cost)) & (F.col(edge) >= F.col("min_edge"))
    return each.groupBy("threshold", "min_edge").agg(F.count_if(taken).alias("trades"), F.coalesce(F.sum(F.when(taken, F.col(net))), F.lit(0.0)).alias("net"))


def selected_policy(search: DataFrame) -> Policy:
    """The one selected row as a policy (one row comes to the driver)."""
    r = search.where("selected").head()
    words = lambda v: tuple(v.split(",")) if v else ()
    real = lambda v: None if v is None else float(v)
    return Policy(r["threshold"], r["min_edge"], r["top_k"], words(r["liquidity_buckets"]), None if r["main_dte"] is None else r["main_dte"] == "True", words(r["dte_buckets"]), words(r["bands"]), real(r["least_score"]), real(r["most_spread"]), real(r["most_age"]))


def portfolio_caps(trades: DataFrame, nav: float, date: str, sector: str, edge: str, loss: str, per_event: float = 0.01, per_date: float = 0.10, per_sector: float = 0.03) -> DataFrame:
    """Adds scale (at most 1) and scales loss and edge by it, so that no event, then no date, then no sector of a date may lose
    more than its share of ``nav``.

    Within a date or sector over its cap the cap is dealt out by positive expected edge, as it stands after the passes
    before; without any positive edge all shrink alike.
    """
    part = F.when(F.col(loss) > 0, F.least(F.lit(1.0), nav * per_event / F.col(loss))).otherwise(1.0)
    out = trades.withColumns({"scale": part, "_sector": F.coalesce(sector, F.lit("UNKNOWN"))})
    out = out.withColumns({loss: F.col(loss) * F.col("scale"), edge: F.col(edge) * F.col("scale")})
    for keys, cap in (([date], nav * per_date), ([date, "_sector"], nav * per_sector)):
        w, good = Window.partitionBy(*keys), F.greatest(F.col(edge), F.lit(0.0))
        out = out.withColumns({"_loss": F.sum(loss).over(w), "_edge": F.sum(good).over(w)})
        dealt = F.when(F.col("_edge") <= 0, cap / F.col("_loss")).when(F.col(loss) > 0, F.least(F.lit(1.0), cap * good / F.col("_edge") / F.col(loss))).otherwise(1.0)
        now = F.when((F.col("_loss") <= cap) | (F.col("_loss") <= 0), 1.0).otherwise(dealt)
        out = out.withColumn("_now", now).withColumns({loss: F.col(loss) * F.col("_now"), edge: F.col(edge) * F.col("_now"), "scale": F.col("scale") * F.col("_now")})
    return out.drop("_loss", "_edge", "_now", "_sector")
