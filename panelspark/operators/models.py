"""Forecast models over the feature matrix: elastic net and ridge from moments, boosted trees from Spark's library, chosen on train folds and validation rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.numbers import number
from panelspark.operators import linear, metrics, ranks
from panelspark.operators.staging import materialise, running_sum
from panelspark.operators.strategy import from_log, log_target

# How strong and of what kind the penalty may be, the bins of a feature for trees, the fewest rows a model is fitted on, and the tree variants.
ALPHAS, L1_RATIOS = (0.0025, 0.005, 0.01, 0.02, 0.05, 0.1), (0.05, 0.1, 0.25, 0.5, 0.7, 0.9, 0.95, 0.99, 1.0)
BINS = 32
LEAST = {"train": 20, "validation": 5, "test": 5}
TREES = ({"maxDepth": 3, "maxIter": 30, "stepSize": 0.1}, {"maxDepth": 4, "maxIter": 20, "stepSize": 0.2})


def skip_reason(df: DataFrame, target: str, split: str = "split") -> str | None:
    """Why no model can be fitted on these rows, or None (three counts come to the driver)."""
    found = {r["s"]: r for r in df.groupBy(F.col(split).alias("s")).agg(F.count("*").alias("n"), F.count(number(target)).alias("known")).collect()}
    for name, least in LEAST.items():
        if (found[name]["n"] if name in found else 0) < least:
            return f"skipped_insufficient_{name}_rows"
    if found["train"]["known"] < LEAST["train"] or found["validation"]["known"] < LEAST["validation"]:
        return "skipped_insufficient_finite_targets"
    return None


def time_folds(train: DataFrame, order: Sequence[str], folds: int = 5) -> DataFrame:
    """Adds fold: the last rows in time order are cut into ``folds`` equal parts 1, 2, ..., and what comes before them is part 0.

    Each part is tested by what came before it.
    """
    placed = running_sum(train, [], [F.col(c) for c in order], F.lit(1), "_at")
    n = F.broadcast(train.agg(F.count("*").alias("_n")))  # one row
    size = F.floor(F.col("_n") / (folds + 1))
    first = F.col("_n") - folds * size
    fold = F.when(F.col("_at") < first, 0).otherwise(1 + F.floor((F.col("_at") - first) / size))
    return placed.crossJoin(n).withColumn("fold", fold.cast("int")).drop("_at", "_n")


def bin_starts(df: DataFrame, features: Sequence[str], most: int = BINS) -> list[list[float]]:
    """Per feature the least value of each bin but the first: bins are its values, where there are at most ``most``, otherwise equal shares of the rows.

    Missing numbers are 0. What comes to the driver is ``most`` numbers a feature.
    """
    cells = df.select(*[F.coalesce(number(f), F.lit(0.0)).alias(f) for f in features]).unpivot([], list(features), "feature", "v")
    placed = ranks.value_counts(cells, "v", ["feature"])
    share = F.floor(F.col("below") * most / F.col("total"))
    shares, values, kinds = {}, {}, {}
    for r in placed.groupBy("feature", share.alias("share")).agg(F.min("v").alias("v"), F.count("*").alias("n")).collect():
        shares.setdefault(r.feature, []).append(r.v)
        kinds[r.feature] = kinds.get(r.feature, 0) + r.n
    few = [f for f in features if kinds.get(f, 0) <= most]
    for r in placed.where(F.col("feature").isin(few)).select("feature", "v").collect() if few else []:
        values.setdefault(r.feature, []).append(r.v)
    return [sorted(values.get(f) or shares.get(f, []))[1:] for f in features]


def binned(df: DataFrame, features: Sequence[str], starts: Sequence[Sequence[float]]) -> DataFrame:
    """Adds x, a vector of the features' bins, numbered from 0. A missing number is 0; a feature of one bin is left out."""
    cut = [(f"_v{i}", f"_x{i}", f, [-float("inf"), *s, float("inf")]) for i, (f, s) in enumerate(zip(features, starts, strict=True)) if s]
    if not cut:
        return VectorAssembler(inputCols=["_x"], outputCol="x").transform(df.withColumn("_x", F.lit(0.0))).drop("_x")
    values, names, _, edges = map(list, zip(*cut))
    out = df.withColumns({v: F.coalesce(number(f), F.lit(0.0)) for v, _, f, _ in cut})
    out = Bucketizer(inputCols=values, outputCols=names, splitsArray=edges).transform(out)
    out = out.withColumns({n: F.col(n) + 0.0 for n in names})  # plain numbers: a bucket's own metadata would make trees take bins for categories without an order
    return VectorAssembler(inputCols=names, outputCol="x").transform(out).drop(*values, *names)


def weighted_cells(df: DataFrame, parts: Sequence[str]) -> DataFrame:
    """parts, x, y and _weight: rows of equal ``x`` as two rows at most, with the number, sum and sum of squares of their ``y``.

    Trees are cut between bins and their loss is the squared error, so nothing else of the rows counts.
    """
    cells = df.groupBy(*parts, "x").agg(F.count("*").cast("double").alias("_n"), F.avg("y").alias("_m"), F.stddev_pop("y").alias("_s"))
    two = F.array(*[F.struct((F.col("_m") + F.lit(d) * F.col("_s")).alias("y"), (F.col("_n") / 2).alias("_weight")) for d in (-1, 1)])
    one = F.array(F.struct(F.col("_m").alias("y"), F.col("_n").alias("_weight")))
    return cells.select(*parts, "x", F.inline(F.when(F.col("_s") > 0, two).otherwise(one)))


def _predicted(model, df: DataFrame, name: str) -> DataFrame:
    return model.transform(df).withColumn(name, from_log(F.col("p"))).drop("p")


def _forecast(df: DataFrame, name: str, value: Column, split: str) -> DataFrame:
    """Adds a forecast, never below the floor, to the rows of validation and test."""
    return df.withColumn(name, F.when(F.col(split) != "train", F.greatest(value, F.lit(metrics.FLOOR))))


def _none(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.lit(None).cast("double"))


def elastic_net(df: DataFrame, features: Sequence[str], target: str, order: Sequence[str], name: str = "forecast_elastic_net", alphas: Sequence[float] = ALPHAS, ratios: Sequence[float] = L1_RATIOS, folds: int = 5, split: str = "split") -> tuple[DataFrame, dict]:
    """Adds the forecast of an elastic net whose penalty is chosen by time-ordered folds of train rows and that is fitted again on train and validation.

    Returns (rows with the forecast, what was done). All penalties and folds come from one pass over the rows (``linear``).
    """
    reason = skip_reason(df, target, split)
    if reason:
        return _none(df, name), {"status": reason}
    known = df.withColumn("_y", log_target(number(target))).where("_y IS NOT NULL").select(split, "_y", *dict.fromkeys([*order, *features]))
    train = time_folds(known.where(F.col(split) == "train"), order, folds)
    rows = train.unionByName(known.where(F.col(split) == "validation").withColumn("fold", F.lit(folds + 1)))
    parts = linear.moments(rows, features, "_y", "fold")
    losses = linear.cross_validated({k: m for k, m in parts.items() if k <= folds}, alphas, ratios)
    alpha, ratio = min(losses, key=losses.get)
    model = linear.fit_elastic_net(linear.total(parts.values()), features, alpha, ratio)
    done = {"status": "trained", "alpha": alpha, "l1_ratio": ratio, "cv_mse": losses[alpha, ratio], "grid_points": len(losses), "weights": model.weights.tolist(), "intercept": model.intercept}
    return _forecast(df, name, from_log(model.predicted()), split), done


def tuning_objective(scored: DataFrame, forecast: str, target: str, implied: str, key: str) -> float:
    """AUC of the forecast edge, then a thousandth of the top decile's precision, less a millionth of the RMSE; -1e6 without an AUC."""
    rows = scored.withColumns({"_score": number(forecast) - number(implied), "_edge": number(target) - number(implied)})
    rows = materialise(rows.select("_score", "_edge", *dict.fromkeys([key, forecast, target, implied])), "scored")  # read by several passes, so a model predicts once
    rank = metrics.ranking_metrics(rows, [], "_score", "_edge", key).head()
    if rank is None or rank["auc"] is None:
        return -1e6
    error = metrics.forecast_metrics(rows, [], forecast, target, implied).head()["rmse"]
    return rank["auc"] + 1e-3 * max(rank["top_decile_precision"] or 0.0, 0.0) - 1e-6 * (error if error is not None else float("inf"))


def boosted_trees(df: DataFrame, features: Sequence[str], target: str, implied: str, key: str, name: str = "forecast_gbt", variants: Sequence[dict] = TREES, split: str = "split", seed: int = 17) -> tuple[DataFrame, dict]:
    """Adds the forecast of boosted trees; of the variants the one that ranks validation rows best counts.

    Features are cut into bins by train rows once, and boosting's many passes are over the bins' weighted cells: with few
    features these are far fewer than the rows.
    """
    df = materialise(df, "tree-rows")  # read by every pass below
    reason = skip_reason(df, target, split)
    if reason:
        return _none(df, name), {"status": reason}
    known = df.withColumn("y", log_target(number(target))).where(F.col(split).isin("train", "validation") & F.col("y").isNotNull())
    starts = bin_starts(known.where(F.col(split) == "train"), features)
    held = F.col(split) == "validation"
    cells = materialise(weighted_cells(binned(known.withColumn("_held", held), features, starts), ["_held"]), "tree-cells").persist()
    bins = max(BINS, math.ceil(math.sqrt(cells.count())))  # so that Spark looks for a bin's edges in all cells, not in a sample
    best = None
    for variant in variants:
        # rows of the validation split stop the boosting early
        model = GBTRegressor(featuresCol="x", labelCol="y", predictionCol="p", weightCol="_weight", validationIndicatorCol="_held", maxBins=bins, seed=seed, **variant).fit(cells)
        value = tuning_objective(_predicted(model, binned(known.where(held), features, starts), name), name, target, implied, key)
        if best is None or value > best[0]:
            best = (value, model, variant)
    cells.unpersist()
    out = _predicted(best[1], binned(df, features, starts), name).drop("x")
    return _forecast(out, name, F.col(name), split), {"status": "trained", "objective": best[0], **best[2]}


def ridge(df: DataFrame, features: Sequence[str], target: str, name: str = "forecast_ridge", alpha: float = 0.01, split: str = "split") -> tuple[DataFrame, dict]:
    """Adds the forecast of a ridge regression of the plain target on train rows; train rows have none, and none is below the floor."""
    reason = skip_reason(df, target, split)
    if reason:
        return _none(df, name), {"status": reason}
    rows = df.where(F.col(split) == "train").select(number(target).alias("_y"), F.lit(0).alias("_part"), *features)
    model = linear.fit_ridge(linear.moments(rows, features, "_y", "_part")[0], features, alpha)
    return _forecast(df, name, model.predicted(), split), {"status": "trained", "alpha": alpha, "weights": model.weights.tolist(), "intercept": model.intercept}


def rank_signal(df: DataFrame, forecasts: Sequence[str], implied: str, key: str, split: str = "split") -> DataFrame:
    """Adds rank_signal: the mean of the forecasts' percentile ranks of edge within the split; null where one is missing."""
    out = df
    for i, f in enumerate(forecasts):
        edged = out.withColumn(f"_edge{i}", number(f) - number(implied))
        out = ranks.average_rank(edged, f"_edge{i}", [split], f"_rank{i}")
    sizes = out.groupBy(split).agg(*[F.count(f"_edge{i}").alias(f"_n{i}") for i in range(len(forecasts))])
    out = out.join(F.broadcast(sizes), split, "left")  # a row for each split
    parts = [F.col(f"_rank{i}") / F.col(f"_n{i}") for i in range(len(forecasts))]
    mean = sum(parts[1:], parts[0]) / len(parts)
    return out.withColumn("rank_signal", mean).drop(*[f"_{w}{i}" for w in ("edge", "rank", "n") for i in range(len(forecasts))])


SUITE = ("elastic_net", "gbt", "ridge")


def model_suite(long: DataFrame, features: Sequence[str], order: Sequence[str], target: str, implied: str, key: str, targets: Sequence[str], target_id: str = "target_id", split: str = "split", trees: Sequence[dict] = TREES) -> tuple[DataFrame, DataFrame]:
    """Every model for each of the named targets (three, say): rows with all forecasts, and what was done for each (target, model).

    The second frame has status, the rows of each split, the number of features, and how many rows of validation and test
    have a forecast. A model that was trained but has no usable forecast there is marked invalid.
    """
    done, frames = [], []
    long = materialise(long, "suite-rows")  # read by every model's passes, so what made them runs once
    for t in targets:
        rows, said = long.where(F.col(target_id) == t), {}
        rows, said["elastic_net"] = elastic_net(rows, features, target, order, split=split)
        rows, said["gbt"] = boosted_trees(rows, features, target, implied, key, variants=trees, split=split)
        rows, said["ridge"] = ridge(rows, features, target, split=split)
        frames.append(rows)
        done += [(t, m, said[m]["status"]) for m in SUITE]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    of = lambda s: F.col(split) == s
    usable = lambda m, s: F.count_if(of(s) & number(f"forecast_{m}").isNotNull()).alias(f"{s}_prediction_rows")
    each = F.array(*[F.struct(F.lit(m).alias("model_id"), usable(m, "validation"), usable(m, "test")) for m in SUITE])
    sizes = [F.count_if(of(s)).alias(f"{s}_rows") for s in LEAST]
    counts = out.groupBy(target_id).agg(*sizes, each.alias("m")).select(target_id, *[f"{s}_rows" for s in LEAST], F.inline("m"))
    told = long.sparkSession.createDataFrame(done, f"{target_id} string, model_id string, raw_status string")
    held = F.col("validation_prediction_rows") + F.col("test_prediction_rows")
    status = F.when((F.col("raw_status") == "trained") & (held == 0), "invalid_no_usable_predictions").otherwise(F.col("raw_status"))
    report = counts.join(F.broadcast(told), [target_id, "model_id"])  # a row for each target and model
    return out, report.withColumns({"status": status, "feature_count": F.lit(len(features)).cast("long")}).drop("raw_status")
