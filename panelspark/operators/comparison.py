"""Models against the market and against each other: defeat tables, casebooks, summaries by group, pairwise lifts and stacked increments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.numbers import number
from panelspark.operators import metrics, ranks
from panelspark.operators.bootstrap import cluster_weights, weighted_auc
from panelspark.operators.selection import same
from panelspark.operators.staging import materialise, running_sum

FLAGS = ("model_nearer", "sign_correct", "false_positive", "false_negative", "model_corrected_market", "market_right_model_wrong")
CASES = 25
#: Slices of a case and group whose severest rows tell what is too mild for the casebook.
SLICES = 1000
BAND = "execution_confidence_band"


def defeat_events(df: DataFrame, forecast: str, realised: str, implied: str, by: Sequence[str] = (), key: str | None = None) -> DataFrame:
    """Rows with all three numbers, each with both edges, errors and squared errors, and who was nearer: forecast or market.

    With ``key`` also top_decile: whether the row is among the group's ceil(n / 10) largest forecast edges (ties by key; with
    a constant edge all are).
    """
    f, y, b = number(forecast), number(realised), number(implied)
    out = df.where(f.isNotNull() & y.isNotNull() & b.isNotNull())
    out = out.withColumns({"forecast_edge": f - b, "realised_edge": y - b, "model_error": F.abs(f - y), "market_error": F.abs(b - y)})
    out = out.withColumns({"model_squared_error": F.col("model_error") * F.col("model_error"), "market_squared_error": F.col("market_error") * F.col("market_error")})
    long, paid = F.col("forecast_edge") > 0, F.col("realised_edge") > 0
    nearer = F.col("model_error") < F.col("market_error")
    flags = {"model_nearer": nearer, "model_nearer_squared": F.col("model_squared_error") < F.col("market_squared_error"), "sign_correct": long == paid, "false_positive": long & ~paid, "false_negative": ~long & paid, "model_corrected_market": nearer & (long == paid) & (F.col("realised_edge") != 0), "market_right_model_wrong": ~nearer & (long != paid)}
    out = out.withColumns(flags)
    if key is None:
        return out
    edge = F.col("forecast_edge")
    whole = {"_n": (F.sum, F.lit(1)), "_low": (F.min, edge), "_high": (F.max, edge)}
    joined = running_sum(out, by, [edge.desc(), F.col(key)], F.lit(1), "_above", whole)
    return joined.withColumn("top_decile", (F.col("_low") == F.col("_high")) | (F.col("_above") < F.ceil(F.col("_n") / 10))).drop("_n", "_low", "_high", "_above")


def defeat_summary(defeats: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per group: rows, shares of each verdict, mean errors of both, how much smaller the model's are, and the verdicts among top edges."""
    share = lambda c: F.avg(F.col(c).cast("int"))
    lift = {"mae_lift": F.avg("market_error") - F.avg("model_error"), "rmse_lift": F.sqrt(F.avg("market_squared_error")) - F.sqrt(F.avg("model_squared_error")), "model_nearer_squared_share": share("model_nearer_squared")}
    top = {}
    if "top_decile" in defeats.columns:
        top = {"top_decile_model_nearer_share": F.avg(F.when(F.col("top_decile"), F.col("model_nearer").cast("int"))), "top_decile_realised_positive_share": F.avg(F.when(F.col("top_decile"), (F.col("realised_edge") > 0).cast("int")))}
    return defeats.groupBy(*by).agg(F.count("*").alias("n"), *[share(c).alias(f"{c}_share") for c in FLAGS], F.avg("model_error").alias("mean_model_error"), F.avg("market_error").alias("mean_market_error"), *[c.alias(n) for n, c in (lift | top).items()])


def defeat_breakdowns(defeats: DataFrame, by: Sequence[str], dimensions: Sequence[str]) -> DataFrame:
    """The summary by each single dimension's values."""
    return defeat_summary(metrics.by_dimension(defeats, dimensions), [*by, "dimension", "value"])


def casebook(defeats: DataFrame, by: Sequence[str], key: Sequence[str], fragile: Column | None = None, n: int = CASES) -> DataFrame:
    """The ``n`` severest rows of each case and group, ties to the smaller key; a row may illustrate several cases.

    Rows that can't be among them go before any is sorted (``_severe``), so groups may be of any size.
    """
    gain = F.col("market_error") - F.col("model_error")
    # fixed values: the names of the cases
    cases = [("false_positive", F.col("false_positive"), F.col("forecast_edge")), ("false_negative", F.col("false_negative"), F.col("realised_edge")), ("model_corrected_market", F.col("model_corrected_market"), gain), ("market_right_model_wrong", F.col("market_right_model_wrong"), gain)]
    if fragile is not None:
        cases.append(("execution_fragile", F.coalesce(fragile, F.lit(False)), F.col("forecast_edge")))
    case = F.array(*[F.struct(F.lit(name).alias("case_type"), holds.alias("holds"), F.abs(severity).alias("severity")) for name, holds, severity in cases])
    met = defeats.select("*", F.inline(F.filter(case, lambda c: c["holds"]))).drop("holds")
    place = F.row_number().over(Window.partitionBy("case_type", *by).orderBy(F.col("severity").desc(), *key))
    return _severe(met, ["case_type", *by], key, n).withColumn("rank", place).where(F.col("rank") <= n)


def _severe(rows: DataFrame, by: Sequence[str], key: Sequence[str], n: int) -> DataFrame:
    """``rows`` without those that ``n`` others of their group exceed for certain.

    The n-th largest of the slices' severest rows is a bound that n rows reach; the n-th severest row isn't below it. Slices are
    counted, not sorted. Groups with fewer slices have no bound and keep all rows.
    """
    most = rows.groupBy(*by, F.pmod(F.xxhash64(*key), F.lit(SLICES)).alias("_slice")).agg(F.max("severity").alias("_most"))
    w = Window.partitionBy(*by).orderBy(F.col("_most").desc(), "_slice")
    bounds = most.withColumn("_place", F.row_number().over(w)).where(F.col("_place") == n).select(*by, F.col("_most").alias("_bound"))
    met = rows.alias("l").join(F.broadcast(bounds.alias("r")), same("l", "r", by), "left")  # a row for each case and group
    return met.where("r._bound IS NULL OR l.severity >= r._bound").select("l.*")


def band_coverage(predictions: DataFrame, by: Sequence[str] = ("split", "target_id")) -> DataFrame:
    """Rows and events by split, target and confidence band."""
    named = predictions.withColumn(BAND, F.coalesce(BAND, F.lit("missing")))
    return named.groupBy(*by, BAND).agg(F.count("*").alias("n_target_rows"), F.count_distinct("event_id").alias("n_events"))


def band_ivar(predictions: DataFrame) -> DataFrame:
    """By confidence band of distinct events: how many have a quoted variance, and medians of it, of the score and of the spread."""
    numbers = ("quote_mid_ivar_event", "quote_ask_ivar_event", "execution_confidence_score", "median_spread_over_mid")
    have = [c for c in numbers if c in predictions.columns]
    events = predictions.groupBy("event_id").agg(F.min(F.coalesce(BAND, F.lit("missing"))).alias(BAND), *[F.min(number(c)).alias(c) for c in have])
    one = events.groupBy(BAND).agg(F.count("*").alias("n_events"), *[F.count(c).alias(f"{c}_events") for c in have])
    for c in have:
        one = one.join(ranks.quantiles(events, c, [BAND], {f"median_{c}": 0.5}), BAND, "left")
    return one


def band_cases(cases: DataFrame, by: Sequence[str]) -> DataFrame:
    """By confidence band and case: how many, and mean severity and errors."""
    named = cases.withColumn(BAND, F.coalesce(BAND, F.lit("missing")))
    return named.groupBy(BAND, "case_type", *by).agg(F.count("*").alias("n"), F.avg("severity").alias("mean_severity"), F.avg("model_error").alias("mean_model_error"), F.avg("market_error").alias("mean_market_error"))


def robustness(breakdowns: DataFrame, source: str, n: str, metric: str, by: Sequence[str] = ("target_id", "model_id")) -> DataFrame:
    """By dimension of a breakdown table: cells, their least, median and largest counts, how many are positive, and what may be claimed."""
    m, c = number(metric), number(n)
    out = breakdowns.groupBy("dimension").agg(
        F.count("*").alias("row_count"), *[F.count_distinct(b).alias(f"{b}_count") for b in by if b in breakdowns.columns], F.count_distinct("value").alias("subgroup_count"), F.min(c).alias("min_cell_n"), F.percentile(c, F.lit(0.5)).alias("median_cell_n"), F.max(c).alias("max_cell_n"),
        F.count_if(m > 0).alias("positive_metric_rows"), F.count_if(m <= 0).alias("negative_metric_rows"), F.avg((m > 0).cast("int")).alias("positive_metric_share"), F.max(m).alias("best_metric_value"), F.min(m).alias("worst_metric_value"),
    )
    gate = F.when(F.col("subgroup_count") < 2, "single_bucket_no_robustness_claim").when(F.col("min_cell_n").isNull(), "missing_cell_counts").when(F.col("min_cell_n") < 5, "exploratory_small_cells").otherwise("available_multi_bucket")
    return out.select(F.lit(source).alias("source"), "*", gate.alias("claim_gate_status"))


def scale_diagnostic(df: DataFrame, rvar: str, ivar: str) -> DataFrame:
    """One row: rows with both, both sample deviations, and the ratios of deviations and means."""
    both = df.select(number(rvar).alias("r"), number(ivar).alias("i")).where("r IS NOT NULL AND i IS NOT NULL")
    per = lambda a, b: a / F.nullif(b, F.lit(0.0))
    one = both.agg(F.count("*").alias("paired_rows"), F.stddev_samp("r").alias("sd_rvar"), F.stddev_samp("i").alias("sd_ivar"), F.avg("r").alias("_mr"), F.avg("i").alias("_mi"))
    return one.select("paired_rows", "sd_rvar", "sd_ivar", per(F.col("sd_rvar"), F.col("sd_ivar")).alias("sd_ratio"), per(F.col("_mr"), F.col("_mi")).alias("mean_ratio"))


def _pair_rows(long: DataFrame, by: Sequence[str], model: str, key: str, score: str, edge: str) -> DataFrame:
    """Rows that two models share: by, model_a, model_b, key, hit, a, b. Each event's models are few, so pairs are made inside the event."""
    packed = long.where(number(score).isNotNull() & number(edge).isNotNull()).groupBy(*by, key).agg(F.array_sort(F.collect_list(F.struct(F.col(model).alias("m"), number(score).alias("s")))).alias("ms"), F.max(number(edge)).alias("_e"))
    each = packed.select(*by, key, "ms", (F.col("_e") > 0).cast("long").alias("hit"), F.posexplode("ms").alias("at", "x"))
    return each.select(*by, key, "hit", "x", F.explode(F.slice("ms", F.col("at") + 2, F.size("ms"))).alias("y")).select(*by, key, "hit", F.col("x.m").alias("model_a"), F.col("y.m").alias("model_b"), F.col("x.s").alias("a"), F.col("y.s").alias("b"))


def pairwise_auc(long: DataFrame, by: Sequence[str], model: str, key: str, score: str, edge: str) -> DataFrame:
    """Per pair of models on the rows that both have: common rows, both AUCs and the lift of the first over the second."""
    pairs, keys = _pair_rows(long, by, model, key, score, edge), [*by, "model_a", "model_b"]
    pairs = materialise(pairs, "model-pairs")
    a = ranks.auc(pairs, "a", "hit", keys).withColumnsRenamed({"auc": "auc_a", "n": "common_rows"})
    b = ranks.auc(pairs, "b", "hit", keys).select(*keys, F.col("auc").alias("auc_b"))
    return a.join(b, keys).withColumn("auc_lift", F.col("auc_a") - F.col("auc_b"))


def bootstrap_lifts(long: DataFrame, by: Sequence[str], model: str, key: str, score: str, edge: str, draws: int = 200, seed: int = 17, weights: DataFrame | None = None) -> DataFrame:
    """by, model_a, model_b and lifts: an array with the AUC lift of each draw of clusters (``key``), on the rows that both models have.

    ``weights``: key and w (``bootstrap.cluster_weights``), if they aren't to be drawn here.
    """
    pairs, keys = materialise(_pair_rows(long, by, model, key, score, edge), "bootstrap-pairs"), [*by, "model_a", "model_b"]
    own = weights if weights is not None else cluster_weights(pairs, key, draws, seed)
    rows = materialise(pairs.join(own, key), "bootstrap-rows")
    a, b = (weighted_auc(rows, keys, c, "hit", "w", draws).alias(c) for c in "ab")
    met = a.join(b, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in keys])
    return met.select(*[f"a.{c}" for c in keys], F.zip_with("a.auc", "b.auc", lambda x, y: x - y).alias("lifts"))


def bootstrap_auc(long: DataFrame, by: Sequence[str], model: str, key: str, score: str, edge: str, draws: int = 200, seed: int = 17) -> DataFrame:
    """Per pair of models the 95 % interval of the AUC lift over draws of clusters with replacement (clusters are events)."""
    lifts = bootstrap_lifts(long, by, model, key, score, edge, draws, seed)
    keys = [*by, "model_a", "model_b"]
    known = lifts.withColumn("lifts", F.array_sort(F.filter("lifts", lambda x: x.isNotNull()))).where(F.size("lifts") > 0)
    return known.select(*keys, F.size("lifts").cast("long").alias("bootstrap_iter"), *[_sorted_share(F.col("lifts"), q).alias(c) for c, q in INTERVAL.items()])


INTERVAL = {"auc_lift_ci_low": 0.025, "auc_lift_ci_high": 0.975}
# Fixed value: the lift over both controls from which a sequence model is called an indication.
LEAST_LIFT = 0.05


def _sorted_share(values: Column, share: float) -> Column:
    """The quantile of a sorted array by linear interpolation."""
    at = F.lit(share) * (F.size(values) - 1)
    low = F.get(values, F.floor(at).cast("int"))
    return low + (F.get(values, F.ceil(at).cast("int")) - low) * (at - F.floor(at))


def sequence_controls(long: DataFrame, by: Sequence[str], model: str, key: str, score: str, edge: str, real: Sequence[str], mask: str, shuffle: str, draws: int = 200, seed: int = 17) -> DataFrame:
    """Per group and sequence model (``real`` ones and the two controls): coverage, the share of rows without a score, AUC lifts over
    the control that sees masks only, over the one with shuffled time and over the best real model, and the lower ends of the
    control lifts' bootstrap intervals (0 of a control over itself).

    A real model that lifts both by LEAST_LIFT, with intervals above 0, is a signal indication; all others are diagnostic.
    """
    asked = [*real, mask, shuffle]
    rows = long.where(F.col(model).isin(*asked)).select(*by, model, key, number(score).alias("_s"), number(edge).alias("_e"))
    rows = materialise(rows, "control-rows")
    scored = rows.withColumn("_hit", F.when(F.col("_e").isNotNull(), (F.col("_e") > 0).cast("long")))
    auc = ranks.auc(scored.where("_s IS NOT NULL"), "_s", "_hit", [*by, model])
    sizes = rows.groupBy(*by, model).agg(F.count("*").alias("_all"))
    of = lambda m: F.max(F.when(F.col(model) == m, F.col("auc")))
    tops = auc.groupBy(*by).agg(of(mask).alias("_mask"), of(shuffle).alias("_shuffle"), F.max(F.when(F.col(model).isin(*real), F.col("auc"))).alias("_best"))
    both = lambda l_, r, keys: [F.col(f"{l_}.{c}").eqNullSafe(F.col(f"{r}.{c}")) for c in keys]
    out = sizes.alias("l").join(auc.alias("r"), both("l", "r", [*by, model]), "left").select("l.*", F.coalesce("r.n", F.lit(0)).alias("coverage"), "r.auc")
    out = out.alias("l").join(tops.alias("r"), both("l", "r", by) or F.lit(True), "left").select("l.*", "r._mask", "r._shuffle", "r._best")
    # intervals of every model over each control; a pair's order is the names', so its lift may have to be turned
    lifts = bootstrap_lifts(rows, by, model, key, "_s", "_e", draws, seed)
    sides = []
    for control in (mask, shuffle):
        for a, b, sign in (("model_a", "model_b", 1.0), ("model_b", "model_a", -1.0)):
            sides.append(lifts.where(F.col(b) == control).select(*by, F.col(a).alias(model), F.lit(control).alias("_control"), F.array_sort(F.transform(F.filter("lifts", lambda x: x.isNotNull()), lambda x: x * sign)).alias("_l")))  # noqa: B023
    each = sides[0]
    for side in sides[1:]:
        each = each.unionByName(side)
    ends = each.where(F.size("_l") > 0).select(*by, model, "_control", *[_sorted_share(F.col("_l"), q).alias(c) for c, q in INTERVAL.items()])
    end = lambda c, m: F.max(F.when(F.col("_control") == m, F.col(c)))
    wide = ends.groupBy(*by, model).agg(*[end(c, m).alias(f"_{n}_{c}") for n, m in (("mask", mask), ("shuffle", shuffle)) for c in INTERVAL])
    out = out.alias("l").join(wide.alias("r"), both("l", "r", [*by, model]), "left").select("l.*", *[f"r._{n}_{c}" for n in ("mask", "shuffle") for c in INTERVAL])
    own = {(n, c): F.when(F.col(model) == m, 0.0).otherwise(F.col(f"_{n}_{c}")) for n, m in (("mask", mask), ("shuffle", shuffle)) for c in INTERVAL}
    lift = {"mask_only_lift": F.col("auc") - F.col("_mask"), "time_shuffle_lift": F.col("auc") - F.col("_shuffle"), "best_real_sequence_lift": F.col("auc") - F.col("_best")}
    low, high = (F.least(own["mask", c], own["shuffle", c]) for c in INTERVAL)
    out = out.select(*by, F.col(model).alias("model_id"), "coverage", (1 - F.col("coverage") / F.col("_all")).alias("drop_rate"), "auc", *[v.alias(n) for n, v in lift.items()], low.alias("auc_lift_ci_low"), high.alias("auc_lift_ci_high"))
    both_lifts = (F.col("mask_only_lift") >= LEAST_LIFT) & (F.col("time_shuffle_lift") >= LEAST_LIFT) & (F.col("auc_lift_ci_low") > 0)
    signal = F.coalesce(F.col("model_id").isin(*real) & both_lifts, F.lit(False))
    return out.withColumns({"auc_lift": F.least("mask_only_lift", "time_shuffle_lift"), "claim_scope": F.when(signal, "diagnostic_grade_signal_indication").otherwise("diagnostic"), "fail_reason": F.when(~signal, "gate_not_passed_or_control_missing")})


def stacked_increment(df: DataFrame, by: Sequence[str], baseline: str, candidate: str, target: str, implied: str, key: str, split: str = "split", least: int = 5) -> DataFrame:
    """Per group: target regressed on both forecasts over validation rows, applied to test rows; AUC of the baseline and of the stack.

    The regression is nine sums a group, solved in one expression (Cramer's rule); singular groups have no stack.
    """
    x, z, y, i = number(baseline), number(candidate), number(target), number(implied)
    rows = df.select(*by, key, split, x.alias("x"), z.alias("z"), y.alias("y"), i.alias("i")).where("x IS NOT NULL AND z IS NOT NULL AND y IS NOT NULL")
    fit = rows.where(F.col(split) == "validation").groupBy(*by).agg(F.count("*").alias("validation_rows"), F.var_pop("x").alias("vx"), F.var_pop("z").alias("vz"), F.covar_pop("x", "z").alias("xz"), F.covar_pop("x", "y").alias("xy"), F.covar_pop("z", "y").alias("zy"), F.avg("x").alias("mx"), F.avg("z").alias("mz"), F.avg("y").alias("my"))
    d = F.col("vx") * F.col("vz") - F.col("xz") * F.col("xz")
    fit = fit.where(F.col("validation_rows") >= least).withColumns({"bx": F.when(F.abs(d) > 1e-18, (F.col("xy") * F.col("vz") - F.col("zy") * F.col("xz")) / d), "bz": F.when(F.abs(d) > 1e-18, (F.col("zy") * F.col("vx") - F.col("xy") * F.col("xz")) / d)})
    test = rows.where((F.col(split) == "test") & F.col("i").isNotNull())
    met = test.alias("l").join(fit.alias("r"), [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by]).select("l.*", "r.validation_rows", "r.bx", "r.bz", "r.mx", "r.mz", "r.my") if by else test.crossJoin(F.broadcast(fit))  # one row
    stacked = F.col("my") + F.col("bx") * (F.col("x") - F.col("mx")) + F.col("bz") * (F.col("z") - F.col("mz"))
    scored = met.withColumns({"base": F.col("x") - F.col("i"), "stack": stacked - F.col("i"), "hit": (F.col("y") - F.col("i") > 0).cast("long")})
    base = ranks.auc(scored, "base", "hit", by).withColumnsRenamed({"n": "test_rows", "auc": "auc_base"}).where(F.col("test_rows") >= least)
    stack = ranks.auc(scored, "stack", "hit", by).select(*by, F.col("auc").alias("auc_stacked"))
    out = base.join(stack, list(by), "left") if by else base.crossJoin(stack)
    sizes = fit.select(*by, "validation_rows")
    out = out.join(sizes, list(by)) if by else out.crossJoin(sizes)
    return out.withColumn("auc_lift", F.col("auc_stacked") - F.col("auc_base"))


def additive_forecast(long: DataFrame, keys: Sequence[str], target: str, forecast: str, whole: str = "day_c2c", parts: tuple[str, str] = ("jump_c2o", "reaction_o2c")) -> DataFrame:
    """Adds forecast_additive: on rows of the whole move the sum of the forecasts of its two parts, where both are; one group-by, no self-join."""
    part = lambda p: F.max(F.when(F.col(target) == p, number(forecast)))
    sums = long.groupBy(*keys).agg((part(parts[0]) + part(parts[1])).alias("forecast_additive"))
    out = long.join(sums, list(keys), "left")
    return out.withColumn("forecast_additive", F.when(F.col(target) == whole, F.col("forecast_additive")))
