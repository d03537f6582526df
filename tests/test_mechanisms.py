"""Intervals by prefix states, quantiles without a sort, ranks inside range partitions and linear models from moments, against brute force."""

import datetime as dt
import math
import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.functions import black_scholes
from panelspark.operators import asof, bootstrap, comparison, covariates, intervals, linear, models, ranks, selection, staging, surface
from panelspark.sources import scans
from panelspark.streaming import marks

T0 = dt.datetime(2024, 3, 1, 9, 30)


def shuffled_rows(df):
    """Rows written by all exchanges of the plan that ran."""
    found = []

    def walk(node):
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return walk(node.finalPhysicalPlan())
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            return walk(node.plan())
        if node.nodeName() == "Exchange":
            found.append(node.metrics().apply("shuffleRecordsWritten").value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    df.collect()
    walk(df._jdf.queryExecution().executedPlan())
    return sum(found)


def at(seconds):
    return None if seconds is None else T0 + dt.timedelta(seconds=seconds)


# intervals ----------------------------------------------------------------------------------------------------------

def random_intervals(seed, contracts, n_ticks, n_windows, span):
    rng = random.Random(seed)
    ticks = [(rng.choice(contracts), rng.choice([None, *[rng.randrange(span) for _ in range(9)]]), rng.choice([1.5, 2.25, 3.0, None, 7.125]), rng.randrange(1, 5)) for _ in range(n_ticks)]
    asked = [(i, rng.choice(contracts), rng.randrange(span), 0) for i in range(n_windows)]
    asked = [(i, c, s, rng.choice([s + rng.randrange(span), s, s - 5, None])) for i, c, s, _ in asked]
    return ticks, asked


@pytest.mark.parametrize("closed", [True, False])
@pytest.mark.parametrize("bucket", [7, 60, 100_000])
def test_intervals_against_brute_force(spark, closed, bucket):
    """Ticks at one instant, null keys, times and prices, windows of no length, backward ones, windows over many buckets."""
    ticks, asked = random_intervals(bucket, ["a", "b", None, "only ticks"], 400, 150, 300)
    t = spark.createDataFrame([(c, at(s), p, v) for c, s, p, v in ticks], "contract string, ts timestamp, price double, volume int")
    r = spark.createDataFrame([(i, c, at(s), at(e)) for i, c, s, e in [*asked, (1000, "only windows", 1, 50)]], "id int, contract string, start_ts timestamp, end_ts timestamp")
    one = F.when(F.col("price").isNotNull(), F.struct("ts", "volume", "price"))
    sums = {"n": F.lit(1).cast("long"), "pv": intervals.exact(F.col("price") * F.col("volume"))}
    got = {x.id: x for x in intervals.inside_intervals(t, r, ["contract"], "ts", ["id"], sums, one, one, closed, bucket).collect()}
    for i, c, s, e in asked:
        inside = [] if c is None or e is None else [(x, v, p) for k, x, p, v in ticks if k == c and x is not None and s <= x and (x <= e if closed else x < e)]
        priced = sorted(x for x in inside if x[2] is not None)
        x = got.get(i)
        if x is None:
            assert not inside  # a window without a key has no row
            continue
        assert x.n == len(inside) and float(x.pv) == pytest.approx(sum(v * p for _, v, p in priced), abs=1e-12)
        assert (x._last and (x._last.ts, x._last.volume, x._last.price)) == (priced and (at(priced[-1][0]), *priced[-1][1:]) or None)
        assert (x._first and (x._first.ts, x._first.volume, x._first.price)) == (priced and (at(priced[0][0]), *priced[0][1:]) or None)
    assert got[1000].n == 0 and got[1000]._last is None


def test_overlapping_windows_cost_no_pairs(spark):
    """A thousand windows over all of a contract's ticks: shuffled rows stay near ticks plus windows."""
    ticks = spark.range(3000).select(F.lit("c").alias("contract"), F.timestamp_seconds(F.col("id") * 5 + 1_700_000_000).alias("ts"), F.lit(2.0).alias("price"), F.lit(3).alias("volume"))
    asked = spark.range(1000).select("id", F.lit("c").alias("contract"), F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("start_ts"), F.timestamp_seconds(F.lit(1_700_014_000)).alias("end_ts"))
    out = asof.interval_vwap(ticks, asked, ["contract"], "ts", "price", "volume", ["id"])
    assert shuffled_rows(out) < 3 * (3000 + 2 * 1000)  # pairs would be 2.7 million
    assert {(r.vwap, r.status) for r in out.collect()} == {(2.0, "ok")}


def test_quote_scan_meets_one_row_a_contract_and_day(spark):
    """Windows that overlap, touch, nest or end before they start."""
    rng = random.Random(4)
    day = T0.date()
    ticks = [(i, rng.choice("ab"), day, at(rng.randrange(500))) for i in range(300)]
    asked = [(rng.choice("ab"), day, at(s), at(s + rng.choice([-3, 0, 10, 40]))) for s in [rng.randrange(500) for _ in range(40)]]
    q = spark.createDataFrame(ticks, "id int, options_ticker string, quote_date date, ts timestamp")
    r = spark.createDataFrame(asked, "options_ticker string, quote_date date, window_start timestamp, window_end timestamp")
    out, scanned, matched = scans.scan_quotes(q, r)
    got = sorted(x.id for x in out.collect())
    assert got == [i for i, c, _, t in ticks if any(c == k and a <= t <= b for k, _, a, b in asked)]
    assert scanned.get == {"rows": 300} and matched.get == {"rows": len(got)}


@pytest.mark.parametrize("bucket_days", [1, 90])
def test_asof_against_brute_force(spark, bucket_days):
    rng = random.Random(bucket_days)
    day = lambda n: T0 + dt.timedelta(hours=n)
    left = [(i, rng.choice(["a", "b", "c"]), day(rng.randrange(2000)), rng.random() < 0.5) for i in range(200)]
    right = [(rng.choice(["a", "b"]), day(rng.randrange(2000)) if rng.random() < 0.9 else None, rng.randrange(50)) for _ in range(120)]
    right += [(k, t, v + 1) for k, t, v in right[:10]]
    out = asof.asof_backward(spark.createDataFrame(left, "id int, k string, t timestamp, strict boolean"), spark.createDataFrame(right, "k string, at timestamp, v int"), ["k"], "t", "at", ["v"], F.col("strict"), 30, bucket_days)
    got = {r.id: (r.v, r.matched_at) for r in out.collect()}
    for i, k, t, strict in left:
        known = [(a, v) for c, a, v in right if c == k and a is not None and (a < t if strict else a <= t)]
        want = max(known) if known and (t.date() - max(known)[0].date()).days <= 30 else None
        assert got[i] == ((want[1], want[0]) if want else (None, None))


# quantiles and ranks ------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("accuracy", [10, 1000])
def test_quantiles_of_many_columns(spark, accuracy):
    """Groups with null and with few rows, ties, a third of one value, missing columns; a coarse sketch is exact, too."""
    rng = np.random.default_rng(accuracy)
    n = 3000
    data = pd.DataFrame({"g": rng.choice(["x", "y", None], n, p=[0.6, 0.39, 0.01]), "a": rng.normal(size=n), "b": np.where(rng.random(n) < 0.33, 1.0, rng.lognormal(3, 4, n)), "c": rng.integers(0, 5, n).astype(float), "e": np.nan, "f": np.where(rng.random(n) < 0.999, np.nan, 1.0)})
    df = spark.createDataFrame(data.replace({np.nan: None}), "g string, a double, b double, c double, e double, f double").repartition(5)
    shares = {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = {(r.g, r.feature): r for r in selection.column_quantiles(df, list("abcef"), ["g"], shares, accuracy).collect()}
    for g, own in data.groupby(data.g.fillna("null")):
        for c in "abcef":
            known, r = own[c].dropna(), got.get((None if g == "null" else g, c))
            assert (r is None) == (len(known) == 0)
            if r:
                assert r.n == len(known) and [r[k] for k in shares] == pytest.approx([known.quantile(s) for s in shares.values()], rel=1e-12)


def test_a_sketch_that_misses_is_mended(spark, monkeypatch):
    df = spark.range(5000).select(F.lit(1).alias("g"), (F.col("id") % 977).cast("double").alias("v"))
    real = selection._enclosed
    wrong = F.array(F.lit(1e6))
    monkeypatch.setattr(selection, "_enclosed", lambda *a: real(*a).withColumns({"lo": wrong, "hi": wrong}))
    r = selection.column_quantiles(df, ["v"], ["g"], {"q": 0.3}).head()
    assert r.q == df.agg(F.percentile("v", F.lit(0.3))).head()[0]


def test_parameters_need_no_sort_of_rows(spark):
    df = spark.range(100).select((F.col("id") * 1.0).alias("v"))
    plan = selection._enclosed(df, ["v"], [], [0.5], 1000)._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "percentile_approx" in plan


def test_places_with_ties_over_partitions(spark):
    """A value that a third of the rows share lies in many range partitions; nulls, null groups and uncounted rows."""
    rng = np.random.default_rng(2)
    n = 4000
    data = pd.DataFrame({"id": range(n), "g": rng.choice(["x", None, "z"], n), "v": np.where(rng.random(n) < 0.4, 5.0, rng.integers(0, 30, n).astype(float)), "w": rng.random(n) < 0.5})
    data.loc[rng.random(n) < 0.1, "v"] = np.nan
    df = spark.createDataFrame(data.replace({np.nan: None}), "id int, g string, v double, w boolean")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ranks.places(df, "v", ["g"], F.col("w")).toPandas().set_index("id").sort_index()
        rank = ranks.average_rank(df, "v", ["g"], "r").toPandas().set_index("id").r.sort_index()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for _, own in data.groupby(data.g.fillna("null")):
        counted = np.sort(own.v[own.w].dropna())
        for i, v in zip(own.id, own.v, strict=True):
            if np.isnan(v):
                assert np.isnan(got.below[i]) and np.isnan(got.upto[i])
            else:
                assert (got.below[i], got.upto[i]) == (np.searchsorted(counted, v), np.searchsorted(counted, v, side="right"))
        assert np.allclose(rank[own.id], own.v.rank(), equal_nan=True)


# linear models ------------------------------------------------------------------------------------------------------

def slow_elastic_net(x, y, alpha, ratio):
    """Coordinate descent on the rows themselves, features as given."""
    mean, my = x.mean(0), y.mean()
    x, y = x - mean, y - my
    w = np.zeros(x.shape[1])
    for _ in range(20_000):
        before = w.copy()
        for j in range(len(w)):
            rho = x[:, j] @ (y - x @ w + x[:, j] * w[j]) / len(y)
            bend = x[:, j] @ x[:, j] / len(y) + alpha * (1 - ratio)
            w[j] = np.sign(rho) * max(abs(rho) - alpha * ratio, 0) / bend if bend > 1e-12 else 0.0
        if abs(w - before).max() < 1e-13:
            break
    return w, my - mean @ w


@pytest.fixture(scope="module")
def regression(spark):
    rng = np.random.default_rng(8)
    n = 247
    x = rng.normal(size=(n, 4)) * [1, 1000, 1e-3, 1] + [1e4, 5, 0, 3]
    x[:, 3] += x[:, 0] - 1e4
    y = np.exp(0.3 * (x[:, 0] - 1e4) - 0.002 * x[:, 1] + 0.2 * rng.normal(size=n) - 3)
    data = pd.DataFrame(x, columns=list("abcd")).assign(flat=2.0, y=y, t=rng.permutation(n), split=np.where(np.arange(n) < 180, "train", np.where(np.arange(n) < 215, "validation", "test")))
    data.loc[::17, "b"] = np.nan
    return data, spark.createDataFrame(data.replace({np.nan: None}), "a double, b double, c double, d double, flat double, y double, t int, split string")


NAMES = ["a", "b", "c", "d", "flat"]


def test_elastic_net_grid_against_rows(regression):
    """Every grid point and fold by descent on the rows; the chosen model's weights and forecasts."""
    data, df = regression
    alphas, ratios = (0.005, 0.05, 0.3), (0.1, 0.5, 1.0)
    out, done = models.elastic_net(df, NAMES, "y", ["t"], alphas=alphas, ratios=ratios)
    train = data[data.split == "train"].sort_values("t")
    x, y = train[NAMES].fillna(0).to_numpy(), np.log(train.y.to_numpy() + models.metrics.FLOOR)
    sd = np.where(x.std(0) <= 1e-12, 1, x.std(0))
    z, size = (x - x.mean(0)) / sd, len(y) // 6
    losses = {}
    for alpha in alphas:
        for ratio in ratios:
            errors = []
            for k in range(5):
                lo = len(y) - (5 - k) * size
                w, b = slow_elastic_net(z[:lo], y[:lo], alpha, ratio)
                errors.append(((y[lo : lo + size] - z[lo : lo + size] @ w - b) ** 2).mean())
            losses[alpha, ratio] = np.mean(errors)
    best = min(losses, key=losses.get)
    assert (done["alpha"], done["l1_ratio"], done["grid_points"]) == (*best, 9) and done["cv_mse"] == pytest.approx(losses[best], rel=1e-8)
    both = data[data.split != "test"]
    x, y = both[NAMES].fillna(0).to_numpy(), np.log(both.y.to_numpy() + models.metrics.FLOOR)
    mean, sd = x.mean(0), np.where(x.std(0) <= 1e-12, 1, x.std(0))
    w, b = slow_elastic_net((x - mean) / sd, y, *best)
    assert np.allclose(np.array(done["weights"]) * sd, w, atol=1e-8)
    got = out.toPandas().set_index("t").forecast_elastic_net
    want = np.exp((data[NAMES].fillna(0).to_numpy() - mean) / sd @ w + b) - models.metrics.FLOOR
    for i, split in enumerate(data.split):
        v = got[data.t[i]]
        assert np.isnan(v) if split == "train" else v == pytest.approx(max(want[i], models.metrics.FLOOR), rel=1e-7)


def test_full_grid_is_one_pass_and_ridge_meets_numpy(spark, regression):
    data, df = regression
    _, done = models.elastic_net(df, NAMES, "y", ["t"])
    assert done["grid_points"] == 54
    train = data[data.split == "train"]
    x, y = train[NAMES].fillna(0).to_numpy(), train.y.to_numpy()
    mean, sd = x.mean(0), np.where(x.std(0) <= 1e-12, 1, x.std(0))
    z = (x - mean) / sd
    w = np.linalg.solve(z.T @ z / len(y) + 0.01 * np.eye(5), z.T @ (y - y.mean()) / len(y))
    out, done = models.ridge(df, NAMES, "y")
    assert np.allclose(np.array(done["weights"]) * sd, w, atol=1e-8)
    got = out.toPandas().set_index("t").forecast_ridge
    want = y.mean() + (data[NAMES].fillna(0).to_numpy() - mean) / sd @ w
    assert all(np.isnan(got[t]) if s == "train" else got[t] == pytest.approx(max(v, models.metrics.FLOOR), rel=1e-8) for t, s, v in zip(data.t, data.split, want, strict=True))
    few = df.where("split <> 'test'")
    assert models.ridge(few, NAMES, "y")[1] == {"status": "skipped_insufficient_test_rows"}
    assert linear.moments(df.limit(0).withColumn("p", F.lit(0)), NAMES, "y", "p") == {}


# volatilities -------------------------------------------------------------------------------------------------------

def test_erfc_meets_the_library():
    x = np.concatenate([np.linspace(-8, 30, 20_001), [0.0, 0.46875, -0.46875, 4.0, -4.0, 26.9, 40, -40, np.inf, -np.inf]])
    want = np.array([math.erfc(v) for v in x])
    got = black_scholes.erfc(x)
    some = want > 1e-300
    assert np.abs(got[some] / want[some] - 1).max() < 2e-15 * 10 and np.abs(got - want).max() < 1e-15
    assert np.isnan(black_scholes.erfc(np.array([np.nan]))).all()


def test_newton_meets_bisection():
    rng = np.random.default_rng(0)
    n = 20_000
    s, k, y, v = rng.uniform(20, 500, n), rng.uniform(0.5, 1.8, n), rng.uniform(0.005, 2, n), rng.uniform(0.02, 3, n)
    k, c = s * k, rng.random(n) < 0.5
    p = black_scholes.price(s, k, y, v, c)
    low, high = np.full(n, black_scholes.LOW), np.full(n, black_scholes.HIGH)
    for _ in range(60):
        mid = (low + high) / 2
        below = black_scholes.price(s, k, y, mid, c) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    got = black_scholes.solve(p, s, k, y, c)
    told = black_scholes.slope(s, k, y, v) > 1e-2  # elsewhere many volatilities have the price
    assert np.abs(got - mid)[told].max() < 1e-10 and np.abs(got - v)[told].max() < 1e-9
    again = black_scholes.price(s, k, y, got, c)
    there = ~np.isnan(got)
    assert there[told].all() and np.abs(again - p)[there].max() < 1e-9
    none = black_scholes.solve(np.array([1e-9, 99.99999]), np.array([100.0] * 2), np.array([100.0] * 2), np.array([1.0, 0.01]), np.array([True] * 2))
    assert np.isnan(none).all()


# bootstrap ----------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("bucket", [16, 4096])
def test_draws_are_multinomial(spark, bucket):
    """Every draw takes as many clusters as there are; a cluster's weight has mean 1 and the variance of a draw with replacement."""
    keys = spark.range(500).select((F.col("id") * 3).cast("string").alias("k"))
    got = {r.k: list(r.w) for r in bootstrap.cluster_weights(keys.union(keys), "k", 300, 5, bucket).collect()}
    w = np.array(list(got.values()))
    assert w.shape == (500, 300) and (w.sum(0) == 500).all()
    assert abs(w.var() - (1 - 1 / 500)) < 0.03 and abs(np.corrcoef(w[:2])[0, 1]) < 0.2
    again = {r.k: list(r.w) for r in bootstrap.cluster_weights(keys.repartition(7), "k", 300, 5, bucket).collect()}
    assert got == again


def test_weighted_auc_over_many_ranges(spark):
    """Ties that lie in several ranges, batches of few rows, groups with one class; against all pairs."""
    rng = np.random.default_rng(3)
    n, draws = 900, 7
    data = pd.DataFrame({"g": rng.choice(["x", "y", None], n), "v": np.where(rng.random(n) < 0.4, 2.0, rng.integers(0, 25, n) / 4), "hit": rng.integers(0, 2, n)})
    data.loc[data.g == "y", "hit"] = 1
    w = rng.integers(0, 4, (n, draws)).astype("u1")
    df = spark.createDataFrame([(*r, x.tobytes()) for r, x in zip(data.replace({np.nan: None}).itertuples(index=False), w, strict=True)], "g string, v double, hit int, w binary")
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    spark.conf.set("spark.sql.shuffle.partitions", "23"), spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13"), spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.g: r.auc for r in bootstrap.weighted_auc(df.repartition(5), ["g"], "v", "hit", "w", draws).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for g, own in data.groupby(data.g.fillna("null")):
        v, hit, ww = own.v.to_numpy(), own.hit.to_numpy() == 1, w[own.index].astype(float)
        win = (v[hit][:, None] > v[~hit][None, :]) + 0.5 * (v[hit][:, None] == v[~hit][None, :])
        for d in range(draws):
            a, b = ww[hit, d], ww[~hit, d]
            auc = got[None if g == "null" else g][d]
            assert auc is None if not b.sum() else auc == pytest.approx(a @ win @ b / (a.sum() * b.sum()), abs=1e-12)


def test_controls_tell_a_signal(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        e = rng.normal()
        rows += [(i, "real", e + 0.3 * rng.normal(), e), (i, "weak", rng.normal(), e), (i, "mask", 0.0 if i % 2 else rng.normal(), e), (i, "shuffle", rng.normal(), e if i % 9 else None)]
    long = spark.createDataFrame([(i, m, float(s), None if e is None else float(e)) for i, m, s, e in rows], "event_id int, model string, score double, edge double")
    got = {r.model_id: r for r in comparison.sequence_controls(long, [], "model", "event_id", "score", "edge", ["real", "weak"], "mask", "shuffle", 100).collect()}
    assert got["real"].claim_scope == "diagnostic_grade_signal_indication" and got["real"].fail_reason is None and got["real"].best_real_sequence_lift == 0
    assert {m for m in got if got[m].claim_scope == "diagnostic"} == {"weak", "mask", "shuffle"}
    assert got["mask"].mask_only_lift == 0 and got["mask"].auc_lift_ci_low <= 0 and got["shuffle"].coverage == 355


# state of streams ---------------------------------------------------------------------------------------------------

def data_files(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(f"{folder}/data") for f in names if f.endswith(".parquet")}


def test_a_batch_rewrites_the_buckets_it_touches(spark, tmp_path):
    """One contract, one bucket; a batch that is killed before its manifest is run again to the same table; old versions go."""
    state = marks.State(spark, f"{tmp_path}/state", "contract string, " + marks.SUMS, 8)
    requests = spark.createDataFrame([(i, f"c{i % 20}", at(0), at(1000 + i)) for i in range(200)], "request_id long, contract string, start_ts timestamp, end_ts timestamp")
    frame = lambda rows: spark.createDataFrame([(c, at(s), v, n) for c, s, v, n in rows], "contract string, ts timestamp, value double, volume long")
    table = lambda: sorted(map(tuple, state.latest().collect()))
    first = [(f"c{k}", 10 * j, 1.0 + j / 7, 1 + j) for k in range(20) for j in range(5)]
    state.merge(marks.batch_sums(frame(first), requests), 0, marks.merged_sums)
    before = data_files(state.folder)
    assert 1 < len(state.manifest(0)) <= 8
    second = [("c3", 55, 2.0, 10), ("c3", 999_999, 5.0, 10)]
    state.merge(marks.batch_sums(frame(second), requests), 1, marks.merged_sums)
    after = data_files(state.folder)
    new = set(after) - set(before)
    assert len({os.path.dirname(f) for f in new}) == 1 and all(before[f] == after[f] for f in set(before) & set(after))
    assert sorted(state.manifest(1).values()).count(1) == 1
    want = table()
    by = {r[1]: r for r in want}
    assert by[3][5] == 6 and float(by[3][2]) == pytest.approx(sum(v * n for c, _, v, n in first if c == "c3") + 20) and by[4][5] == 5
    # the batch again, after its manifest is lost: from the state before it, to the same rows
    os.rename(f"{state.folder}/manifest/version-1", f"{tmp_path}/lost")
    state.merge(marks.batch_sums(frame(second), requests), 1, marks.merged_sums)
    assert table() == want
    state.merge(marks.batch_sums(frame(second), requests), 1, marks.merged_sums)
    assert table() == want
    # versions that no manifest of the last two names are gone
    for n in range(2, 5):
        state.merge(marks.batch_sums(frame([("c3", 60 + n, 1.0, 1)]), requests), n, marks.merged_sums)
    assert state.manifests() == [3, 4]
    versions = {f.split("version-")[1].split("/")[0] for f in data_files(state.folder)}
    assert versions == {str(v) for m in (3, 4) for v in state.manifest(m).values()}
    assert {r[1]: r[5] for r in table()}[3] == 9


def test_index_features_are_made_once_an_instant(spark):
    """Hundreds of events at one instant of a day with 80 contracts: no row for each event and contract, and all events have the same features."""
    day, entry = dt.date(2024, 3, 1), dt.datetime(2024, 3, 1, 20)
    contracts = [("SPY", day, f"{k}{r}", day + dt.timedelta(7), 80.0 + k, r, 7, 2.0) for k in range(40) for r in ("call", "put")]
    options = spark.createDataFrame(contracts, "symbol string, date date, options_ticker string, expiration date, strike double, right string, dte int, option_close double")
    trades = spark.createDataFrame([(c[2], entry - dt.timedelta(minutes=5), 2.0, 10.0, 1) for c in contracts], "options_ticker string, ts timestamp, option_vwap double, volume double, transactions int")
    under = spark.createDataFrame([("SPY", entry - dt.timedelta(minutes=m), 100.0 + m, 1.0, 1) for m in (5, 50)], "symbol string, ts timestamp, close double, volume double, transactions int")
    spots = spark.createDataFrame([("SPY", day, 100.0)], "symbol string, date date, spot double")
    events = spark.createDataFrame([(i, day, entry if i % 10 else None) for i in range(500)], "event_id long, entry_date date, event_entry_timestamp timestamp")
    out = covariates.index_covariates(events, options, spots, under, trades, volatility=F.lit(0.3))
    assert shuffled_rows(out) < 4 * 500 + 2000
    rows = out.collect()
    assert len(rows) == 500 and {r.market_second_status for r in rows} == {"ok", "invalid_event_entry_timestamp"}
    assert {(r.spy_second_candidate_contracts, r.spy_second_valid_pair_count, r.spy_second_underlying_close, r.qqq_second_underlying_status) for r in rows if r.event_id % 10} == {(8, 4, 105.0, "missing_underlying_day_aggs")}
    assert all(r.spy_second_underlying_status is None for r in rows if r.event_id % 10 == 0)


def option_rows(spark, days=3):
    rows = [(e, "SPY", f"{e}/{d}/{k}{r}", T0.date() + dt.timedelta(d), 80.0 + k, r, d, 2.0 + k / 10, 100.0) for e in range(days) for d in (1, 5, 7, 9, 14, 28, 30, 33) for k in range(0, 40, 3) for r in ("call", "put") if (e + d + k) % 4 or r == "call"]
    return spark.createDataFrame(rows, "event_id int, symbol string, options_ticker string, expiration date, strike double, right string, dte int, option_close double, spot double")


def test_bins_of_events_are_not_broadcast(spark):
    """An explode of events looks small to Spark, however much it makes."""
    contracts = option_rows(spark)
    events = spark.createDataFrame([(e, T0, 100.0) for e in range(3)], "event_id int, event_entry_timestamp timestamp, s_before double")
    bars = contracts.select("options_ticker", F.lit(T0 - dt.timedelta(minutes=7)).alias("ts"), F.col("option_close").alias("option_vwap"), F.lit(1).alias("volume"), F.lit(1).alias("transactions"))
    out = surface.intraday_surface(bars, contracts, events)
    rows = out.collect()
    assert len(rows) == 36 and {r.bin for r in rows if r.valid_pair_count} == {10}
    assert "BroadcastExchange" not in out._jdf.queryExecution().toString()


def test_candidates_need_one_shuffle(spark):
    """The strikes of the wanted expiries against plain Python; rows are shuffled once."""
    rows = option_rows(spark)
    out = surface.index_candidates(rows, ["event_id"])
    want = set()
    held = [r for r in rows.collect() if 3 <= r.dte <= 45]
    for e in range(3):
        mine = [r for r in held if r.event_id == e]
        for d in {min({r.dte for r in mine}, key=lambda x: (abs(x - t), x)) for t in (7, 14, 30)}:
            of = [r for r in mine if r.dte == d]
            both = {r.strike for r in of if r.right == "put"} & {r.strike for r in of if r.right == "call"}
            best = sorted(both, key=lambda k: (abs(k - 100), k))[:4]
            want |= {r.options_ticker for r in of if r.strike in best}
    assert {r.options_ticker for r in out.collect()} == want and out.count() == len(want)
    assert out._jdf.queryExecution().sparkPlan().toString().count("Join") == 0 and shuffled_rows(out) <= len(held)


def test_ordered_rows_are_not_broadcast(spark):
    """Rows in order make small files; what is merged into them is a row for each partition."""
    rows = spark.range(20000).select((F.col("id") % 3).alias("g"), (F.col("id") % 7).cast("double").alias("v"), "id")
    for out in (staging.running_sum(rows, ["g"], [F.col("v"), F.col("id")], F.lit(1), "below"), ranks.places(rows, "v", ["g"])):
        assert out.count() == 20000 and out.agg(F.max("below")).head()[0] < 6667
        out.collect()
        assert "BroadcastExchange" not in out._jdf.queryExecution().toString()


def test_the_suite_makes_its_rows_once(spark):
    """What the rows are made of runs once, however many models and targets read them."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = spark.range(10).select("id", F.lit("a").alias("target_id"), F.lit("train").alias("split"), F.lit(1.0).alias("x"), F.lit(2.0).alias("y"), F.lit(1.0).alias("i"))
    long = rows.mapInArrow(counted, rows.schema)
    report = models.model_suite(long, ["x"], ["id"], "y", "i", "id", ["a"])[1].collect()
    assert {(r.model_id, r.status, r.train_rows) for r in report} == {(m, "skipped_insufficient_train_rows", 10) for m in models.SUITE}
    assert made.value == 10


def test_a_group_of_defeats_is_not_gathered(spark):
    """Sizes and ends of groups come with the partitions' sums: rows meet no join on their group, null ones and constant edges included."""
    rows = spark.range(5000).select(F.when(F.col("id") % 5 > 0, F.col("id") % 2).alias("g"), "id", F.when(F.col("id") % 2 == 0, (F.col("id") * 7 % 113).cast("double")).otherwise(1.0).alias("f"), F.lit(50.0).alias("y"), F.lit(20.0).alias("b"))
    out = comparison.defeat_events(rows, "f", "y", "b", ["g"], "id")
    got = out.collect()
    want = set()
    for g in (None, 0, 1):
        mine = sorted((r for r in rows.collect() if r.g == g), key=lambda r: (-r.f, r.id))
        want |= {r.id for r in (mine if mine[0].f == mine[-1].f else mine[: math.ceil(len(mine) / 10)])}
    assert len(got) == 5000 and {r.id for r in got if r.top_decile} == want
    assert out._jdf.queryExecution().sparkPlan().toString().count("Join") == 1
