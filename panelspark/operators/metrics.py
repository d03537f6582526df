"""Forecast, ranking and strategy metrics by group: one row per group, nulls where a metric is not defined.

A row counts where the numbers that a metric needs are finite; NaN and infinities are missing values. Everything that
needs an order (ranks, quantiles, drawdown) goes over range partitions, so a group may be of any size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.numbers import EPSILON, clip, number
from panelspark.operators import ranks
from panelspark.operators.intervals import exact
from panelspark.operators.selection import column_quantiles
from panelspark.operators.staging import running_sum, spread_in_order

FLOOR = 1e-6


def qlike(actual: Column, forecast: Column, floor: float = FLOOR) -> Column:
    """The QLIKE loss of one row: q - ln q - 1 of the ratio q of both, floored."""
    q = F.greatest(actual, F.lit(floor)) / F.greatest(forecast, F.lit(floor))
    return q - F.ln(q) - 1


def _joined(parts: Sequence[DataFrame], by: Sequence[str]) -> DataFrame:
    """Tables of one row per group side by side."""
    out = parts[0]
    for more in parts[1:]:
        if not by:
            out = out.crossJoin(more)  # one row each
            continue
        met = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by]
        out = out.alias("l").join(more.alias("r"), met, "left").select("l.*", *[f"r.{c}" for c in more.columns if c not in by])
    return out


def forecast_metrics(df: DataFrame, by: Sequence[str], forecast: str, target: str, baseline: str) -> DataFrame:
    """n, n_forecast_target, MAE, RMSE, QLIKE and out-of-sample R^2 against the baseline, in one pass.

    All but n_forecast_target are of the rows where forecast, target and baseline are finite.
    """
    pair = df.select(*by, number(forecast).alias("f"), number(target).alias("y"), number(baseline).alias("b")).where("f IS NOT NULL AND y IS NOT NULL")
    full = lambda c: F.when(F.col("b").isNotNull(), c)
    square = lambda a, b: (F.col(a) - F.col(b)) * (F.col(a) - F.col(b))
    of_baseline = F.sum(full(square("y", "b")))
    return pair.groupBy(*by).agg(
        F.count("b").alias("n"), F.count("*").alias("n_forecast_target"), F.avg(full(F.abs(F.col("f") - F.col("y")))).alias("mae"), F.sqrt(F.avg(full(square("f", "y")))).alias("rmse"),
        F.avg(full(qlike(F.col("y"), F.col("f")))).alias("qlike"), F.when(of_baseline > EPSILON, 1 - F.sum(full(square("f", "y"))) / of_baseline).alias("oos_r2"),
    )


def _scored(df: DataFrame, by: Sequence[str], score: str, edge: str, *keep: str) -> DataFrame:
    out = df.select(*by, *keep, number(score).alias("score"), number(edge).alias("edge"))
    return out.where("score IS NOT NULL AND edge IS NOT NULL")


def edge_deciles(df: DataFrame, by: Sequence[str], score: str, edge: str, bins: int = 10) -> DataFrame:
    """Per group and bucket of average ranks of the score: n, mean score and mean edge; a constant score is one bucket."""
    placed = ranks.tied_buckets(_scored(df, by, score, edge), "score", by, bins, "edge_decile")
    return placed.groupBy(*by, "edge_decile").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.avg("edge").alias("mean_realized_edge"))


def calibration(df: DataFrame, by: Sequence[str], score: str, outcome: str, key: str, bins: int = 10) -> DataFrame:
    """Per group and bucket of first ranks of the score (ties by ``key``): n, mean score and rate of the outcome."""
    placed = ranks.buckets(_scored(df, by, score, outcome, key), "score", key, by, bins, "bucket")
    return placed.groupBy(*by, "bucket").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.avg("edge").alias("event_rate"))


def ranking_metrics(df: DataFrame, by: Sequence[str], score: str, edge: str, key: str, bins: int = 10) -> DataFrame:
    """n, AUC, Brier score of the percentile rank, precision of the top share, and how edge deciles rise.

    The outcome is a positive edge. The top ceil(n / bins) rows by score (ties by ``key``) are the top share; with a
    constant score all rows are.
    """
    rows = _scored(df, by, score, edge, key).withColumn("hit", (F.col("edge") > 0).cast("long"))
    counts = rows.groupBy(*by, "score").agg(F.count("*").alias("c"), F.sum("hit").alias("h"))
    total = counts.groupBy(*by).agg(F.sum("c").alias("n"), F.sum("h").cast("double").alias("p"), F.count("*").alias("values"))
    met = lambda left, right: _joined([left, right], by) if by else left.crossJoin(F.broadcast(right))
    at = met(running_sum(counts, by, [F.col("score")], F.col("c"), "below"), total)
    rank = F.col("below") + (F.col("c") + 1) / 2
    share = clip(rank / F.col("n"), EPSILON, 1 - EPSILON)
    brier = F.sum(F.col("h") * (share - 1) * (share - 1) + (F.col("c") - F.col("h")) * share * share) / F.first("n")
    p, q = F.first("p"), F.first("n") - F.first("p")
    auc = F.when((p > 0) & (q > 0), (F.sum(F.col("h") * rank) - p * (p + 1) / 2) / (p * q))
    one = at.groupBy(*by).agg(F.first("n").alias("n"), auc.alias("auc"), brier.alias("rank_probability_brier"))
    top = met(running_sum(rows, by, [F.col("score").desc(), F.col(key)], F.lit(1), "above"), total)
    top = top.where((F.col("values") == 1) | (F.col("above") < F.ceil(F.col("n") / bins))).groupBy(*by).agg(F.avg("hit").alias("top_decile_precision"))
    # at most ``bins`` rows a group
    deciles, w = edge_deciles(df, by, score, edge, bins), Window.partitionBy(*by)
    mean = F.col("mean_realized_edge")
    tied = F.rank().over(w.orderBy(mean)) + (F.count("*").over(w.partitionBy(*by, mean)) - 1) / 2
    steps = deciles.select(*by, "edge_decile", mean, tied.alias("rank"), (mean >= F.lag(mean).over(w.orderBy("edge_decile"))).cast("int").alias("up"))
    rising = F.when((F.count("*") > 1) & (F.stddev_pop("mean_realized_edge") > EPSILON), F.corr(F.col("edge_decile").cast("double"), "rank"))
    rises = steps.groupBy(*by).agg(rising.alias("edge_decile_spearman"), F.avg("up").alias("edge_decile_adjacent_up_share"))
    return _joined([one, top, rises], by)


def max_drawdown(df: DataFrame, by: Sequence[str], order: Sequence[str], net: str, exactly: bool = False) -> DataFrame:
    """Per group n and the deepest fall of the cumulative sum below its running peak (which starts at the first value).

    Range partitions are summed up each (total, highest, lowest and deepest fall inside); what falls across partitions
    follows from these few rows. ``exactly``: numbers (below 10^18) count to ten digits after the point, and groups of the same rows fall alike.
    """
    kept = exact if exactly else lambda c: c
    # only what the sums need is dealt out
    rows = spread_in_order(df.select(*dict.fromkeys([*by, *order]), F.coalesce(kept(number(net)), F.lit(0)).alias("_net")), by, [F.col(c) for c in order])
    inside = Window.partitionBy("_group", "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumn("_cum", kept(F.sum("_net").over(inside))).withColumn("_peak", F.max("_cum").over(inside))
    parts = run.groupBy("_group", "_part", *by).agg(F.count("*").alias("n"), kept(F.sum("_net")).alias("total"), F.max("_cum").alias("high"), F.min("_cum").alias("low"), F.min(F.col("_cum") - F.col("_peak")).alias("fall"))
    earlier = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("start", F.coalesce(kept(F.sum("total").over(earlier)), F.lit(0)))
    peak = F.max(F.col("start") + F.col("high")).over(earlier)
    parts = parts.withColumn("fall", F.least("fall", F.col("start") + F.col("low") - peak))
    return parts.groupBy("_group", *by).agg(F.min("fall").cast("double").alias("max_drawdown"), F.sum("n").alias("n")).drop("_group")


def strategy_metrics(df: DataFrame, by: Sequence[str], order: Sequence[str], net: str, gross: str, premium: str, capital: str | None = None, exactly: bool = False) -> DataFrame:
    """Sums, returns, Sharpe and Sortino ratios, drawdown (in ``order``), hits, wins, losses and 5 % tail per group.

    Rows without a finite net result don't count. ``exactly``: net and drawdown come from sums of ten digits after the point, which
    don't hang on the order of rows.
    """
    rows = df.select(*by, *order, number(net).alias("net"), number(gross).alias("gross"), F.abs(number(premium)).alias("premium"), F.abs(number(capital or premium)).alias("capital")).where("net IS NOT NULL")
    n, total = F.count("*"), F.sum(exact(F.col("net"))).cast("double") if exactly else F.sum("net")
    sign = lambda up: F.when((F.col("net") > 0) if up else (F.col("net") < 0), F.col("net"))
    per = lambda d: F.when(d > EPSILON, F.avg("net") / d * F.sqrt(n))
    share = lambda c: F.when(F.sum(c) > EPSILON, total / F.sum(c))
    one = rows.groupBy(*by).agg(
        n.alias("n"), F.sum("gross").alias("gross"), total.alias("net"), share("premium").alias("return_on_premium"), share("capital").alias("return_on_capital"), per(F.stddev_samp("net")).alias("sharpe"),
        per(F.stddev_samp(sign(False))).alias("sortino"), F.avg((F.col("net") > 0).cast("double")).alias("hit_rate"), F.avg(sign(True)).alias("avg_win"), F.avg(sign(False)).alias("avg_loss"), n.alias("turnover"),
    )
    return _joined([one, max_drawdown(rows, by, order, "net", exactly).drop("n"), column_quantiles(rows, ["net"], by, {"tail_5pct": 0.05}).drop("feature", "n")], by)


def cost_sensitivity(df: DataFrame, by: Sequence[str], order: Sequence[str], gross: str, cost: str, multipliers: Sequence[float] = (0.0, 0.5, 1.0, 1.5, 2.0)) -> DataFrame:
    """Per group and cost multiplier: trades, net result, hit rate and drawdown; rows are read once."""
    rows = df.select(*by, *order, number(gross).alias("_gross"), number(cost).alias("_cost")).where("_gross IS NOT NULL AND _cost IS NOT NULL")
    each = rows.withColumn("multiplier", F.explode(F.array(*[F.lit(float(m)) for m in multipliers]))).withColumn("net", F.col("_gross") - F.col("multiplier") * F.col("_cost"))
    keys = [*by, "multiplier"]
    one = each.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("net").alias("net"), F.avg((F.col("net") > 0).cast("double")).alias("hit_rate"))
    return _joined([one, max_drawdown(each, keys, order, "net").drop("n")], keys)


def by_dimension(df: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Each row once for each of these columns, as dimension and value: what follows groups by both at once."""
    pair = F.inline(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in dimensions]))
    return df.select("*", pair)


def breakdown_metrics(df: DataFrame, dimensions: Sequence[str], order: Sequence[str], net: str, gross: str, premium: str, forecast: str, target: str, baseline: str) -> DataFrame:
    """Strategy metrics (prefixed) and forecast metrics by each single dimension's values."""
    each = by_dimension(df.select(*dict.fromkeys([*dimensions, *order, net, gross, premium, forecast, target, baseline])), dimensions)
    keys = ["dimension", "value"]
    money = strategy_metrics(each, keys, order, net, gross, premium)
    money = money.select(*keys, *[F.col(c).alias(f"strategy_{c}") for c in money.columns if c not in keys])
    return _joined([money, forecast_metrics(each, keys, forecast, target, baseline)], keys)


def long_metrics(table: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """A metric table as table, by, metric, value."""
    numbers = [c for c in table.columns if c not in by]
    return table.select(*by, *[F.col(c).cast("double").alias(c) for c in numbers]).unpivot(list(by), numbers, "metric", "value").select(F.lit(name).alias("table"), *by, "metric", "value")


def metric_tables(predictions: DataFrame, by: Sequence[str], key: str, order: Sequence[str], forecast: str = "forecast", target: str = "rvar", baseline: str = "ivar", edge: str = "edge", net: str = "net", gross: str = "gross", premium: str = "premium", cost: str = "cost") -> DataFrame:
    """Forecast, ranking, strategy and cost tables of predictions in long form (a row per target, model and event), stacked."""
    tables = {
        "forecast": forecast_metrics(predictions, by, forecast, target, baseline), "ranking": ranking_metrics(predictions, by, forecast, edge, key),
        "strategy": strategy_metrics(predictions, by, order, net, gross, premium),
    }
    out = [long_metrics(t, by, name) for name, t in tables.items()]
    costs = cost_sensitivity(predictions, by, order, gross, cost)
    named = F.concat(F.col("metric"), F.lit("_at_"), F.col("multiplier").cast("string"))
    out.append(long_metrics(costs, [*by, "multiplier"], "cost").withColumn("metric", named).drop("multiplier"))
    whole = out[0]
    for t in out[1:]:
        whole = whole.unionByName(t)
    return whole


def qlike_sanity(df: DataFrame, by: Sequence[str], forecast: str, target: str, floor: float = FLOOR) -> DataFrame:
    """QLIKE per group as it is, with forecasts clipped to their 1st and 99th percentiles, and the share of the worst 1 % of rows."""
    rows = qlike_rows(df, by, forecast, target, floor)
    cuts = ranks.quantiles(rows, "floored", by, {"low": 0.01, "high": 0.99})
    size = rows.groupBy(*by).agg(F.count("*").alias("n"))
    met = _joined([rows, _joined([cuts, size], by)], by)
    worst = running_sum(met, by, [F.col("contribution").desc(), F.col("floored")], F.lit(1), "above")
    clipped = F.least(F.greatest("floored", "low"), F.col("high"))
    top = F.sum(F.when(F.col("above") < F.greatest(F.lit(1), F.ceil(F.col("n") * 0.01)), F.col("contribution")))
    return worst.groupBy(*by).agg(F.count("*").alias("n"), F.avg("contribution").alias("qlike"), F.avg(qlike(F.col("actual"), clipped, floor)).alias("winsorized_qlike"), (top / F.greatest(F.sum("contribution"), F.lit(floor))).alias("top_1pct_share"))


def qlike_rows(df: DataFrame, by: Sequence[str], forecast: str, target: str, floor: float = FLOOR, keep: Sequence[str] = ()) -> DataFrame:
    """by, keep, actual and forecast floored, and the row's contribution to QLIKE."""
    rows = df.select(*by, *keep, number(target).alias("actual"), number(forecast).alias("floored")).where("actual IS NOT NULL AND floored IS NOT NULL")
    rows = rows.withColumns({"actual": F.greatest("actual", F.lit(floor)), "floored": F.greatest("floored", F.lit(floor))})
    return rows.withColumn("contribution", qlike(F.col("actual"), F.col("floored"), floor))


def qlike_extremes(df: DataFrame, by: Sequence[str], forecast: str, target: str, key: str, most: int = 25, floor: float = FLOOR) -> DataFrame:
    """The worst rows of each group by their contribution to QLIKE (five times the worst 1 %, at most ``most``), with their percentile."""
    rows = qlike_rows(df, by, forecast, target, floor, [key])
    placed = ranks.value_counts(rows, "contribution", by).select(*by, "contribution", "total", ((F.col("below") + (F.col("n") + 1) / 2) / F.col("total")).alias("percentile"))
    n = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("contribution").desc(), key))
    top = rows.withColumn("place", n).where(F.col("place") <= most)
    met = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*by, "contribution"]]
    out = top.alias("l").join(placed.alias("r"), met).select("l.*", "r.total", "r.percentile")
    return out.where(F.col("place") <= F.greatest(F.lit(1), F.least(F.lit(most), F.greatest(F.lit(1), F.ceil(F.col("total") * 0.01)) * 5))).drop("total")


def cluster_inference(df: DataFrame, by: Sequence[str], forecast: str, target: str, baseline: str, clusters: Sequence[str], least: int = 5) -> DataFrame:
    """Per group the mean of baseline loss minus model loss (squared errors), its plain error and its error by each clustering.

    The error of a clustering is the sample deviation of cluster means over the root of their number; two_way_se is the
    mean of the clusterings' errors, as the panel reports it (no estimator of two-way clustering). A group with fewer
    than ``least`` usable rows has its status only.
    """
    rows = df.select(*by, *[F.col(c).cast("string").alias(c) for c in clusters], number(forecast).alias("_f"), number(target).alias("_y"), number(baseline).alias("_b"))
    square = lambda c: (F.col(c) - F.col("_y")) * (F.col(c) - F.col("_y"))
    rows = rows.withColumn("_gain", square("_b") - square("_f"))
    n, enough = F.count("_gain"), F.count("_gain") >= least
    some = lambda c, name: F.when(enough, c).alias(name)
    one = rows.groupBy(*by).agg(F.when(enough, "ok").otherwise("insufficient_rows").alias("status"), some(n, "n"), some(F.avg("_gain"), "mean_gain"), some(F.stddev_samp("_gain") / F.sqrt(n), "plain_se"))
    parts = [one]
    for c in clusters:
        means = rows.where("_gain IS NOT NULL").groupBy(*by, c).agg(F.avg("_gain").alias("_mean"))
        parts.append(means.groupBy(*by).agg(F.count("*").alias(f"{c}_clusters"), F.when(F.count("*") >= 2, F.stddev_samp("_mean") / F.sqrt(F.count("*"))).alias(f"{c}_se")))
    out = _joined(parts, by)
    ok = F.col("status") == "ok"
    for c in clusters:
        out = out.withColumns({f"{c}_clusters": F.when(ok, F.col(f"{c}_clusters")), f"{c}_se": F.when(ok, F.col(f"{c}_se"))})
    both = F.lit(True)
    for c in clusters:
        both = both & (F.col(f"{c}_clusters") >= 2)
    status = F.when(ok, F.when(both, "ok").otherwise("insufficient_clusters"))
    mean = sum((F.col(f"{c}_se") for c in clusters[1:]), F.col(f"{clusters[0]}_se")) / len(clusters)
    return out.withColumns({"two_way_status": status, "two_way_se": F.when(ok & both, mean)})
