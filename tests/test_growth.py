"""What keeps a task's memory and the work from growing faster than the rows."""

import datetime as dt
import glob
import math
import random

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from panelspark.operators import comparison, covariates, filings, models, strategy, surface
from panelspark.plans import feeds, sequences


def test_casebook_sorts_few_rows_and_keeps_the_severest(spark):
    rng = random.Random(3)
    rows = [(m, i, float(rng.randrange(10_000)), rng.random() < 0.5) for m in ("a", None) for i in range(20_000)] + [("few", i, float(i % 3), True) for i in range(40)]
    d = spark.createDataFrame(rows, "model string, id long, forecast_edge double, false_positive boolean")
    d = d.withColumns({"realised_edge": F.lit(0.0), "model_error": F.lit(1.0), "market_error": F.lit(2.0), "false_negative": F.lit(False), "model_corrected_market": F.lit(False), "market_right_model_wrong": F.lit(False)})
    got = [(r.model, r.id, r.rank) for r in comparison.casebook(d, ["model"], ["id"], n=10).collect()]
    want = []
    for m in ("a", None, "few"):
        best = sorted((-v, i) for g, i, v, hit in rows if g == m and hit)[:10]
        want += [(m, i, k + 1) for k, (_, i) in enumerate(best)]
    assert sorted(got, key=str) == sorted(want, key=str)
    met = d.where("false_positive").withColumn("severity", F.col("forecast_edge"))
    assert comparison._severe(met, ["model"], ["id"], 10).where("model IS DISTINCT FROM 'few'").count() < 400


def test_day_files_are_bounded(spark, sf, monkeypatch, tmp_path):
    monkeypatch.setattr(feeds, "FILE_LINES", 500)
    feeds.day_files(spark, sf, f"{tmp_path}/raw")
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert spark.read.csv(f"{tmp_path}/raw", header=True).count() == lines and len(glob.glob(f"{tmp_path}/raw/*.csv.gz")) >= lines / 500


def test_filing_text_is_made_once(spark):
    d = spark.createDataFrame([("Item\u00a02.02  quarter\tended",), ("item 2.02 annual meeting financial results",), ("",), (None,), ("other",), ("item 2.02",)], "text string")
    out = filings.classify_filing(d, "text")
    assert [r.status for r in out.collect()] == [filings.VALIDATED, filings.UNRELATED, filings.NO_TEXT, filings.NO_TEXT, filings.NOT_ITEM, filings.AMBIGUOUS]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") <= 1


def steps(spark):
    return spark.createDataFrame([(e, i, float(e * i), float(i), "daily" if i % 2 else "intraday", "train") for e in range(30) for i in range(20)], "event_id long, seq_index int, close double, volume double, step_type string, split string")


def test_steps_are_made_once_for_all_passes(spark):
    assert "scaled-steps" in surface.robust_scaled(steps(spark), ("close", "volume")).inputFiles()[0]
    assert any("audited" in f for f in surface.distribution_audit(steps(spark), "step_type", ["close", "volume"]).inputFiles())


def test_sequence_matrix_shuffles_narrow_rows(spark):
    out = surface.sequence_matrix(steps(spark), "event_id", ("close", "volume"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan[plan.index("Exchange") :]
    assert out.where("event_id = 3").head()["seq_t05_close"] == 15.0


def test_trees_are_fitted_on_cells(spark, monkeypatch):
    """Boosting passes over the features' bins, not over the rows, and forecasts as Spark's trees on the rows do."""
    rng, sizes = random.Random(5), []
    rows = [(i, float(rng.randrange(20)), float(rng.randrange(12)), ("train", "validation", "test")[i % 3]) for i in range(6000)]
    rows = [(i, a, None if b == 3 else b, math.exp((a - 9) * (b - 4) / 30 + rng.random()), 1.0, s) for i, a, b, s in rows]
    d = spark.createDataFrame(rows, "id long, a double, b double, y double, implied double, split string")

    class Counted(GBTRegressor):
        def fit(self, df):
            sizes.append(df.count())
            return super().fit(df)

    monkeypatch.setattr(models, "GBTRegressor", Counted)
    variant = {"maxDepth": 3, "maxIter": 8, "stepSize": 0.2}
    got = {r.id: r.forecast_gbt for r in models.boosted_trees(d, ["a", "b"], "y", "implied", "id", variants=[variant])[0].collect()}
    assert sizes[0] <= 20 * 12 * 4
    plain = VectorAssembler(inputCols=["a", "b"], outputCol="x").transform(d.fillna(0.0)).withColumns({"y": models.log_target(F.col("y")), "held": F.col("split") == "validation"})
    model = GBTRegressor(featuresCol="x", labelCol="y", validationIndicatorCol="held", seed=17, **variant).fit(plain.where("split <> 'test'"))
    want = {r.id: None if r.split == "train" else r.p for r in model.transform(plain).select("id", "split", models.from_log(F.col("prediction")).alias("p")).collect()}
    assert all((w is None and got[i] is None) or abs(got[i] - w) < 1e-9 for i, w in want.items()) and len(got) == 6000


def test_bins_of_many_values_hold_equal_shares(spark):
    d = spark.range(6400).select((F.col("id") * 7919 % 6400).cast("double").alias("a"), F.lit(None).cast("double").alias("b"))
    assert models.bin_starts(d, ["a", "b"]) == [[float(200 * i) for i in range(1, 32)], []]


def test_facts_are_read_once(spark):
    """Facts are made once for all that is told of them, and a fact without any day is known to nobody."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = [("a", "revenue", 100.0, "2024-03-01", None), ("A", "revenue", 120.0, "2024-03-05", "2024-03-05 12:00:00"), ("a", "revenue", 7.0, None, None), ("a", None, 1.0, "2024-03-09", None), ("a", "assets", None, "2024-03-02", None)]
    facts = spark.createDataFrame(rows, "ticker string, feature_concept string, val double, f string, t string").select("ticker", "feature_concept", "val", F.lit("2023-12-31").cast("date").alias("end"), F.to_date("f").alias("filed"), F.col("t").cast("timestamp").alias("acceptance_datetime"))
    events = spark.createDataFrame([(1, "a", "2024-03-01 20:00:00"), (2, "a", "2024-03-02 00:00:00"), (3, "A", "2024-03-05 12:00:00"), (4, "a", "2024-03-09 23:00:00"), (5, "b", "2024-03-09 23:00:00"), (6, "a", None)], "event_id long, ticker string, t string").select("event_id", "ticker", F.col("t").cast("timestamp").alias("asof"))
    out = filings.facts_at_events(events, facts.mapInArrow(counted, facts.schema)).collect()
    got = {r.event_id: (r.mapped_acceptance_rows, r.fallback_filed_rows, r.dropped_same_day_rows, r.coverage, r.revenue, r.revenue_growth and round(r.revenue_growth, 6), r.freshness_days and round(r.freshness_days, 4)) for r in out}
    assert got == {1: (0, 0, 1, 0, None, None, None), 2: (0, 1, 1, 1, 100.0, None, 1.0), 3: (1, 2, 0, 2, 120.0, 0.2, 0.0), 4: (1, 2, 1, 2, 120.0, 0.2, 4.4583), 5: (0, 0, 0, 0, None, None, None), 6: (0, 0, 0, 0, None, None, None)}
    assert made.value == len(rows)


def test_options_of_a_day_are_read_once(spark):
    """Volumes, pairs and shape of a surface come from one reading of its options; strikes are written down."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = [(e, "2024-03-15", 90.0 + 5 * k, r, 10, 2.0 + k, 3.0, 1, 100.0 + e) for e in range(20) for k in range(6) for r in (("call", "put") if e else ("call",))]
    opts = spark.createDataFrame(rows, "event_id long, expiration string, strike double, right string, dte int, option_close double, option_volume double, option_transactions int, spot double")
    out = surface.daily_surface(opts.mapInArrow(counted, opts.schema), ["event_id"], volatility=F.col("strike") / 100).orderBy("event_id").collect()
    assert made.value == len(rows) and len(out) == 20
    assert [r.valid_pair_count for r in out] == [0] + [6] * 19 and [r.option_volume_sum for r in out] == [18.0] + [36.0] * 19
    assert out[0].atm_iv_proxy is None and out[0].surface_missing_rate == 1.0 and not out[0].is_valid_sequence_day
    assert abs(out[1].atm_iv_proxy - 1.0) < 1e-12 and abs(out[1].surface_missing_rate - 0.4) < 1e-12 and out[1].is_valid_sequence_day


def test_last_bars_are_dealt_out_once(spark):
    """Bars that lie by contract already stay where they are, last bars go to their event once; against plain Python, shared contracts and edges included."""
    rng, t0 = random.Random(11), dt.datetime(2024, 3, 1, 20)
    cuts = {1: t0, 2: t0 + dt.timedelta(minutes=7), 3: t0, 4: t0, 5: None}
    plan = [(e, f"{'s' if e < 3 else e}/{k}{r}", t0.date() + dt.timedelta(8), 94.0 + 3 * k, r, 8) for e in (1, 2, 3, 5) for k in range(5) for r in ("call", "put")]
    bars = [(c, cuts[1] - dt.timedelta(seconds=15 * rng.randrange(-40, 260)), 8.0 + rng.random(), i + 1, 1) for i, c in enumerate(c for c in sorted({p[1] for p in plan}) for _ in range(60))]
    contracts = spark.createDataFrame(plan, "event_id long, options_ticker string, expiration date, strike double, right string, dte int")
    events = spark.createDataFrame([(e, c, 100.0) for e, c in cuts.items()], "event_id long, event_entry_timestamp timestamp, s_before double")
    dealt = spark.createDataFrame(bars, "options_ticker string, ts timestamp, option_vwap double, volume long, transactions long").repartition(4, "options_ticker")
    out = surface.intraday_surface(dealt, contracts, events)
    text = out._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning(event_id") == 1 and text.count("Exchange hashpartitioning(options_ticker") == 4 and "BroadcastExchange" not in text
    want = {}
    for e in (1, 2, 3, 4):
        for b in range(12):
            end = cuts[e] - dt.timedelta(minutes=5 * (11 - b))
            last = [max((x[1], x[2], x[3]) for x in mine) for p in plan if p[0] == e and abs(p[3] / 100 - 1) <= 0.05 for mine in [[x for x in bars if x[0] == p[1] and end - dt.timedelta(minutes=5) <= x[1] <= end]] if mine]
            want[e, b] = (float(sum(x[2] for x in last)) or None, end)
    assert {(r.event_id, r.bin): (r.option_volume_sum, r.end_ts) for r in out.collect()} == want


def test_contracts_trade_every_minute(spark, sf):
    """Each bin ends on a minute, and so on a bar."""
    out = sequences.intraday_surface(spark, sf).where("hybrid_valid_step")
    assert [r[0] for r in out.select("latest_option_trade_bar_age_seconds").distinct().collect()] == [0.0]


def test_bars_of_an_index_are_read_once(spark, monkeypatch):
    """An index's bars are summed up by instant before they are dealt out; a contract goes to its hour once, and windows over a full hour lose nothing."""
    asked, t0 = [], dt.datetime(2024, 3, 1, 20)
    inside = covariates.inside_intervals

    def counted(ticks, *more, **named):
        asked.append(ticks.count())
        return inside(ticks, *more, **named)

    monkeypatch.setattr(covariates, "inside_intervals", counted)
    entries = {1: t0, 2: t0 + dt.timedelta(minutes=5), 3: t0 + dt.timedelta(minutes=5)}
    events = spark.createDataFrame([(e, t0.date(), at) for e, at in entries.items()], "event_id long, entry_date date, event_entry_timestamp timestamp")
    chain = [("SPY", t0.date(), f"{k}{r}", t0.date() + dt.timedelta(7), 96.0 + 4 * k, r, 7, 2.0) for k in range(3) for r in ("call", "put")]
    options = spark.createDataFrame(chain, "symbol string, date date, options_ticker string, expiration date, strike double, right string, dte int, option_close double")
    bars = [(c[2], t0 + dt.timedelta(minutes=m), 4.0 + m / 10, 30.0 + m, 1) for c in chain for m in (-16, -15, -10, -2, 0, 3, 5, 6)]
    trades = spark.createDataFrame(bars, "options_ticker string, ts timestamp, option_vwap double, volume double, transactions int")
    seconds = [("SPY", t0 + dt.timedelta(minutes=m), 100.0 + i, None if i == 5 else 1.0 + i, 1) for m in (-61, -50, -10, 0, 5) for i in range(40)]
    under = spark.createDataFrame(seconds, "symbol string, ts timestamp, close double, volume double, transactions int")
    spots = spark.createDataFrame([("SPY", t0.date(), 100.0)], "symbol string, date date, spot double")
    out = {r.event_id: r for r in covariates.index_covariates(events, options, spots, under, trades, volatility=F.col("volume") / 1000).collect()}
    assert asked == [5]
    for e, at in entries.items():
        mine = lambda s, far: [x for x in s if at - dt.timedelta(minutes=far) <= x[1] <= at]  # noqa: B023, E731
        wide, near = mine(seconds, 60), [x for x in mine(seconds, 15) if x[3]]
        volume = sum(x[3] for x in mine(bars, 15)) / len(chain)
        assert (out[e].spy_second_underlying_close, out[e].spy_second_underlying_rows, out[e].spy_second_underlying_volume_sum) == (139.0, len(wide), sum(x[3] or 0.0 for x in wide))
        assert abs(out[e].spy_second_underlying_vwap - sum(x[2] * x[3] for x in near) / sum(x[3] for x in near)) < 1e-9 and abs(out[e].spy_second_underlying_return_in_buffer - 0.39) < 1e-12
        assert (out[e].spy_second_candidate_contracts, out[e].spy_second_priced_contracts, out[e].spy_second_valid_pair_count, out[e].spy_second_option_volume_sum) == (6, 6, 3, 6 * volume)
        assert abs(out[e].spy_second_atm_iv_proxy - volume / 1000) < 1e-12


def test_policies_of_the_same_trades_tie(spark):
    """Net results and drawdowns are exact in any order of the rows, and of equal policies the first of the grid is selected."""
    pnl = [0.3] * 3 + [-0.1] * 30 + [0.2] * 7 + [1e6, -0.1, 0.7] + [0.1] * 57
    rows = [(i, dt.date(2024, 1, 1) + dt.timedelta(i), 0.5, 0.25, v, 100.0, 0.0, "validation") for i, v in enumerate(pnl)]
    d = spark.createDataFrame(rows, "id long, d date, f double, i double, pnl double, premium double, fee double, split string").repartition(7)
    out = strategy.tune_policy(d, "id", "d", "f", "i", "pnl", "premium", "fee", top_ks=(None,)).collect()
    assert {(r.n, r.net, r.max_drawdown) for r in out} == {(100, 1000005.6, -3.0)}
    assert [r.candidate_id for r in out if r.selected] == [0]
