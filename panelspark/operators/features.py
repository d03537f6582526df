"""Features of events as of their entry: earnings history, market covariates, sectors, the feature matrix, and which columns may be used."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.numbers import finite, number
from panelspark.operators import ranks
from panelspark.operators.asof import asof_backward
from panelspark.operators.staging import running_sum

LAST = 4


def prior_last_mean(events: DataFrame, ticker: str, ts: str, key: str, value: str, k: int = LAST) -> DataFrame:
    """Adds prior_last_mean: the mean of the ticker's last ``k`` values before this instant (inside one instant by key).

    An instant keeps its last ``k`` values, and its state is at most ``k`` instants' values cut to ``k``; events take the state
    of the latest earlier instant by an as-of join, so the work is linear however long a ticker's history is.
    """
    known = events.where(number(value).isNotNull() & F.col(ts).isNotNull())
    newest = lambda c, n: F.slice(c, F.greatest(F.size(c) - n + 1, F.lit(1)), F.lit(n))
    place = F.row_number().over(Window.partitionBy(ticker, ts).orderBy(F.desc(key)))
    few = known.select(ticker, ts, key, number(value).alias("_v")).withColumn("_n", place).where(F.col("_n") <= k)
    at = few.groupBy(ticker, ts).agg(F.array_sort(F.collect_list(F.struct(key, "_v")))["_v"].alias("_vs"))
    w = Window.partitionBy(ticker).orderBy(ts).rowsBetween(-(k - 1), 0)
    states = at.select(ticker, F.col(ts).alias("_at"), newest(F.flatten(F.collect_list("_vs").over(w)), k).alias("_state"))
    out = asof_backward(events, states, [ticker], ts, "_at", ["_state"], strict=True)
    mean = F.aggregate("_state", F.lit(0.0), lambda a, x: a + x) / F.size("_state")
    return out.withColumn("prior_last_mean", F.when(F.size("_state") > 0, mean)).drop("_state", "matched__at")


def prior_global_mean(events: DataFrame, ts: str, value: str) -> DataFrame:
    """Adds prior_global_mean: the mean of all values before this instant, from running sums over instants."""
    at = events.where(F.col(ts).isNotNull()).groupBy(ts).agg(F.sum(F.coalesce(number(value), F.lit(0.0))).alias("_s"), F.count(number(value)).alias("_c"))
    sums = running_sum(running_sum(at, [], [F.col(ts)], F.col("_s"), "_before_s"), [], [F.col(ts)], F.col("_c"), "_before_c")
    known = sums.select(F.col(ts).alias("_t"), (F.col("_before_s") / F.nullif(F.col("_before_c"), F.lit(0))).alias("prior_global_mean"))
    return events.join(known, F.col(ts) == F.col("_t"), "left").drop("_t")


def prior_mean(events: DataFrame, ticker: str, ts: str, key: str, value: str, name: str, fallback: Column | None = None) -> DataFrame:
    """Adds ``name``: the ticker's mean of its last four values, else the mean of all values before, else ``fallback``."""
    out = prior_global_mean(prior_last_mean(events, ticker, ts, key, value), ts, value)
    rest = [fallback] if fallback is not None else []
    return out.withColumn(name, F.coalesce("prior_last_mean", "prior_global_mean", *rest)).drop("prior_last_mean", "prior_global_mean")


def benchmarks(events: DataFrame, ticker: str, ts: str, key: str, rvar: str = "rvar_event", ivar: str = "ivar_event") -> DataFrame:
    """Adds naive forecasts: the market's, the last four realised and implied variances, and the market plus the trailing spread."""
    out = events.withColumns({"_market": number(ivar), "_spread": number(rvar) - number(ivar)})
    above = lambda c: F.when(c.isNotNull(), F.greatest(c, F.lit(0.0)))
    out = prior_mean(out, ticker, ts, key, rvar, "_r4", F.col("_market"))
    out = prior_mean(out, ticker, ts, key, ivar, "_i4", F.col("_market"))
    out = prior_mean(out, ticker, ts, key, "_spread", "_s4")
    out = out.withColumns({"forecast_market": F.col("_market"), "forecast_last_four_rvar": above(F.col("_r4")), "forecast_last_four_ivar": above(F.col("_i4")), "trailing_spread": F.coalesce("_s4", F.lit(0.0)), "fallback_spread_used": F.col("_s4").isNull()})
    out = out.withColumns({"forecast_trailing_spread": above(F.col("_market") + F.col("trailing_spread")), "prior_rv_iv_spread": F.col("forecast_last_four_rvar") - F.col("forecast_last_four_ivar"), "iv_runup": F.col("_market") / F.nullif(F.col("forecast_last_four_ivar"), F.lit(0.0)) - 1})
    return out.drop("_market", "_spread", "_r4", "_i4", "_s4")


def earnings_history(events: DataFrame, ticker: str, ts: str, key: str, targets: dict[str, str], ivar: str = "ivar_event") -> DataFrame:
    """Adds the ticker's history before each event's instant: count, days since the last, and for each target's variance and its
    spread over the implied one: median, population deviation, two quantiles, maximum and a mean weighted towards the latest;
    for the spread also how often it was positive.

    Events at one instant never see each other (a RANGE frame). A company has a few dozen earnings, so a frame is short.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(ticker).orderBy(at).rangeBetween(Window.unboundedPreceding, -1)
    values = {f"prior_{n}_rvar": number(c) for n, c in targets.items()} | {f"prior_{n}_rv_iv_spread": number(c) - number(ivar) for n, c in targets.items()}
    out = events.withColumns({f"_{n}": v for n, v in values.items()})
    since = (at - F.max(at).over(w)) / 86400e6
    made = {"prior_earnings_count": F.count("*").over(w), "prior_days_since_earnings": since}
    for n in values:
        v = F.col(f"_{n}")
        made |= {f"{n}_median": F.percentile(v, F.lit(0.5)).over(w), f"{n}_std": F.stddev_pop(v).over(w), f"{n}_p75": F.percentile(v, F.lit(0.75)).over(w), f"{n}_p90": F.percentile(v, F.lit(0.9)).over(w), f"{n}_max": F.max(v).over(w)}
        # collect_list leaves out nulls only of whole entries
        made[f"_{n}_seen"] = F.array_sort(F.collect_list(F.when(v.isNotNull(), F.struct(at.alias("t"), F.col(key).alias("k"), v.alias("v")))).over(w))
        if n.endswith("spread"):
            made[f"{n.replace('_rv_iv_spread', '')}_rvar_gt_ivar_hit_rate"] = F.avg((v > 0).cast("double")).over(w)
    out = out.withColumns(made)
    for n in values:
        seen = F.col(f"_{n}_seen")
        weight = lambda i: F.when(F.size(seen) == 1, F.exp(F.lit(-1.5))).otherwise(F.exp(-1.5 + 1.5 * i / (F.size(seen) - 1)))  # noqa: B023, E731
        placed = F.transform(seen, lambda s, i: F.struct((weight(i) * s["v"]).alias("a"), weight(i).alias("b")))  # noqa: B023
        total = F.aggregate(placed, F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b")), lambda acc, x: F.struct((acc["a"] + x["a"]).alias("a"), (acc["b"] + x["b"]).alias("b")), lambda acc: acc["a"] / acc["b"])
        out = out.withColumn(f"{n}_ewm", F.when(F.size(seen) > 0, total))
    return out.drop(*[f"_{n}" for n in values], *[f"_{n}_seen" for n in values])


def vix_daily(raw: DataFrame) -> DataFrame:
    """date, vix_close, is_holiday_or_missing from a raw table of texts: '.' is missing, rows without a date go, of one date the last counts.

    ``raw`` has its line number in ``line``.
    """
    date = next(c for c in ("DATE", "observation_date", "date") if c in raw.columns)
    value = next(c for c in ("VIXCLS", "vix_close") if c in raw.columns)
    rows = raw.select(F.col(date).try_cast("date").alias("date"), finite(F.col(value).try_cast("double")).alias("vix_close"), "line").where("date IS NOT NULL")
    one = rows.groupBy("date").agg(F.max_by(F.struct("vix_close"), "line").alias("v"))
    return one.select("date", "v.vix_close", F.col("v.vix_close").isNull().alias("is_holiday_or_missing"))


def regime(percentile: Column) -> Column:
    return F.when(percentile <= 1 / 3, "low").when(percentile <= 2 / 3, "mid").when(percentile.isNotNull(), "high")


def vix_features(observations: DataFrame, events: DataFrame, asof: str, timing: str, same_day_amc: bool = False, max_lag_days: int = 5, window: int = 252, least: int = 40) -> DataFrame:
    """``events`` with the VIX of the latest observation before ``asof`` (on it for events after the close, if ``same_day_amc``).

    An observation older than ``max_lag_days`` counts as none. Changes are over observations, not days. The percentile and its
    tercile compare with the ``window`` observations before, if there are ``least``. Observations are one row a day.
    """
    valid = observations.where("vix_close IS NOT NULL").groupBy(F.col("date").alias("vix_date")).agg(F.max("vix_close").alias("vix_level"))
    w = Window.orderBy("vix_date")
    past = F.collect_list("vix_level").over(w.rowsBetween(-window, -1))
    made = valid.select("vix_date", "vix_level", (F.col("vix_level") - F.lag("vix_level", 1).over(w)).alias("vix_change_1d"), (F.col("vix_level") - F.lag("vix_level", 5).over(w)).alias("vix_change_5d"), past.alias("_past"), F.lead("vix_date").over(w).alias("_next"))
    share = F.size(F.filter("_past", lambda x: x <= F.col("vix_level"))) / F.size("_past")
    made = made.withColumn("vix_percentile_252d", F.when(F.size("_past") >= least, share))
    # the days on which an observation is the latest: at most max_lag_days + 1 rows for each
    until = F.least(F.coalesce(F.date_sub("_next", 1), F.date_add("vix_date", max_lag_days)), F.date_add("vix_date", max_lag_days))
    days = made.withColumn("_day", F.explode(F.sequence("vix_date", until))).drop("_past", "_next")
    same = F.lit(same_day_amc) & (F.upper(timing) == "AMC")
    day = F.when(F.coalesce(same, F.lit(False)), F.col(asof).cast("date")).otherwise(F.date_sub(F.col(asof).cast("date"), 1))
    out = events.withColumn("_day", day).join(F.broadcast(days), "_day", "left").drop("_day")
    out = out.withColumn("vix_lag_days", F.datediff(F.col(asof).cast("date"), "vix_date"))
    kept = F.col("vix_lag_days") <= max_lag_days
    names = ("vix_date", "vix_level", "vix_change_1d", "vix_change_5d", "vix_percentile_252d")
    out = out.withColumns({c: F.when(kept, F.col(c)) for c in names}).withColumn("vix_lag_days", F.when(kept, F.col("vix_lag_days")))
    return out.withColumns({"vix_regime_tercile": regime(F.col("vix_percentile_252d")), "vix_above_30": F.col("vix_level") > 30, "vix_available": F.col("vix_level").isNotNull()})


# Coarse sectors, and the words that name them (the first sector with a word in the text counts).
SECTOR_WORDS = {
    "technology_communication": ("technology", "software", "semiconductor", "computer", "internet", "communication", "telecom"),
    "financials_real_estate": ("bank", "financial", "insurance", "real estate", "reit"),
    "healthcare": ("health", "pharma", "biotech", "medical", "therapeutics", "drug"),
    "consumer": ("retail", "consumer", "restaurant", "apparel", "media", "entertainment"),
    "energy_materials_industrials": ("energy", "oil", "gas", "mining", "industrial", "manufactur", "utility"),
}
SECTORS = (*SECTOR_WORDS, "other")


def sector_of_text(text: Column) -> Column:
    low, out = F.lower(F.trim(text)), None
    for group, words in SECTOR_WORDS.items():
        has = F.greatest(*[F.contains(low, F.lit(w)) for w in words])
        out = F.when(has, group) if out is None else out.when(has, group)
    return out


def sector_of_sic(sic: Column) -> Column:
    """The coarse sector of an industry code; a code outside the ranges is other, none is none."""
    code = sic.try_cast("double").cast("int")
    within = lambda *spans: F.greatest(*[code.between(a, b) for a, b in spans], F.lit(False))
    return (
        F.when(within((6000, 6799)), "financials_real_estate").when(within((8000, 8099), (2830, 2839)), "healthcare").when(within((5200, 5999), (7000, 7999)), "consumer")
        .when(within((3570, 3579), (3660, 3679)), "technology_communication").when(within((1000, 1799), (2000, 4999)), "energy_materials_industrials").when(code.isNotNull(), "other")
    )


def coarse_sectors(events: DataFrame) -> DataFrame:
    """Adds sector_sic_available and a flag for each coarse sector: from sector, industry text, code, category, then entity type."""
    text = lambda c: [sector_of_text(F.col(c))] if c in events.columns else []
    code = [sector_of_sic(F.col("sic"))] if "sic" in events.columns else []
    group = F.coalesce(*text("sector"), *text("sic_description"), *code, *text("category"), *text("entity_type"), F.lit(None).cast("string"))
    out = events.withColumn("_group", group)
    return out.withColumns({"sector_sic_available": F.col("_group").isNotNull()} | {f"sector_sic_{g}": F.coalesce(F.col("_group") == g, F.lit(False)) for g in SECTORS}).drop("_group")


def dte_bucket(dte: Column) -> Column:
    return F.when(dte <= 4, "lt_5").when(dte <= 14, "main_5_14").when(dte <= 21, "robust_15_21").when(dte.isNotNull(), "ivar_support_gt_21").otherwise("nan")


def eligible_events(panel: DataFrame) -> DataFrame:
    """Events with an entry: its instant, or its date."""
    return panel.where(F.coalesce(*[F.col(c).cast("timestamp") for c in ("event_entry_timestamp", "entry_date") if c in panel.columns], F.lit(None).cast("timestamp")).isNotNull())


def one_row_each(df: DataFrame, key: str) -> DataFrame:
    """``df``, or an error when it runs if a key repeats (counted in a window over the key, in the join's own shuffle)."""
    n = F.count("*").over(Window.partitionBy(key))
    sound = F.when(n == 1, F.col(key)).otherwise(F.raise_error(F.concat(F.lit(f"{key} must be unique: "), F.col(key).cast("string"))).cast(df.schema[key].dataType))
    return df.withColumn(key, sound)


def feature_matrix(panel: DataFrame, straddles: DataFrame | None = None) -> DataFrame:
    """The model table: realised edges (labels), days to expiry, timing, liquidity, season, and what the straddle cost and made."""
    c = panel.columns
    out = panel.withColumns({"ticker": F.upper("ticker"), "rvar_event": number("rvar_day") if "rvar_day" in c else number("rvar_event"), "ivar_event": number("ivar_event")})
    out = out.withColumn("edge_var_realized", F.col("rvar_event") - F.col("ivar_event"))
    out = out.withColumns({f"edge_var_realized_{n}": number(f"rvar_{n}") - F.col("ivar_event") for n in ("day", "jump", "reaction") if f"rvar_{n}" in c})
    dte = number(next((x for x in ("dte_1", "dte") if x in c), "ivar_event")) if {"dte_1", "dte"} & set(c) else F.lit(None).cast("double")
    flag = lambda a, b: F.coalesce(dte.between(a, b), F.lit(False))
    out = out.withColumns({"is_main_dte_5_14": flag(5, 14), "is_robustness_dte_3_21": flag(3, 21), "dte_bucket": dte_bucket(dte)})
    if "announcement_timing" in c:
        out = out.withColumns({"is_bmo": F.col("announcement_timing") == "BMO", "is_amc": F.col("announcement_timing") == "AMC"})
    if "universe_rank" in c:
        out = out.withColumn("liquidity_rank_score", 1 / F.greatest(number("universe_rank"), F.lit(1.0)))
    if "entry_date" in c:
        angle = 2 * math.pi * (F.month("entry_date") - 1) / 12
        out = out.withColumns({"event_year": F.year("entry_date"), "event_month": F.month("entry_date"), "event_month_sin": F.sin(angle), "event_month_cos": F.cos(angle), "regime": F.when(F.year("entry_date") == 2020, "covid_shock").otherwise("steady_proxy")})
    if straddles is not None:
        more = [x for x in straddles.columns if x == "event_id" or x not in out.columns]
        out = one_row_each(out, "event_id").join(one_row_each(straddles.select(*more), "event_id"), "event_id", "left")
        cost = number("gross_proxy_pnl_usd") - number("haircut_pnl_usd")
        out = out.withColumns({"net_proxy_pnl_usd": number("haircut_pnl_usd"), "estimated_transaction_cost_usd": F.when(cost.isNotNull(), F.greatest(cost, F.lit(0.0))), "return_on_premium_realized": number("haircut_pnl_usd") / F.nullif(number("entry_premium_usd"), F.lit(0.0))})
    return out


def liquidity_bucket(events: DataFrame, rank: str, key: str) -> DataFrame:
    """Adds liquidity_bucket: high, mid or low by thirds of the rank (ties by key); without a rank there is none."""
    third = ranks.buckets(events.select(key, number(rank).alias("_rank")), "_rank", key, [], 3, "_third")
    named = third.select(key, F.element_at(F.array(F.lit("high"), F.lit("mid"), F.lit("low")), F.col("_third") + 1).alias("liquidity_bucket"))
    return events.join(named, key, "left")


def with_quote_diagnostics(events: DataFrame, confidence: DataFrame, quote_ivar: DataFrame | None = None) -> DataFrame:
    """Events with quote confidence and quoted variances, for analysis only; no confidence is the band missing."""
    out = events
    for extra in (confidence, quote_ivar):
        if extra is not None:
            # what the events know themselves stays theirs
            own = extra.drop("ticker", "announcement_date", "announcement_timing", "entry_date", "exit_date").dropDuplicates(["event_id"])
            out = out.drop(*[c for c in own.columns if c != "event_id"]).join(own, "event_id", "left")
    return out.withColumn("execution_confidence_band", F.coalesce("execution_confidence_band", F.lit("missing")))


def butterfly(put: Column, middle: Column, call: Column) -> Column:
    return put - 2 * middle + call


def sequence_history(events: DataFrame, history: DataFrame, event: str, ticker: str, entry: str, date: str, needed: int = 20) -> DataFrame:
    """``events`` with how many distinct dates their ticker has before the entry and why a sequence can't be made (or null).

    Counts come from a running count per ticker and an as-of join.
    """
    days = history.select(ticker, F.col(date).alias("_d")).distinct()
    counted = days.select(ticker, "_d", F.row_number().over(Window.partitionBy(ticker).orderBy("_d")).alias("history_days"))
    out = asof_backward(events, counted, [ticker], entry, "_d", ["history_days"], strict=True).drop("matched__d")
    out = out.withColumn("history_days", F.coalesce("history_days", F.lit(0)))
    return out.withColumn("sequence_reason", F.when(F.col("history_days") < needed, f"insufficient_{needed}_day_sequence"))


# Names that no model may read (they tell of the outcome, the quotes or an identity), and how names tell their family.
EXCLUDED = frozenset(
    "cik event_year event_month sic source_id source_timestamp feature_asof_timestamp event_entry_timestamp signal_timestamp split target_id target_label_column feature_schema_version paper_grade "
    "execution_confidence_band execution_confidence_score quote_execution_paper_grade required_quote_marks ok_quote_marks missing_quote_marks invalid_quote_marks stale_quote_marks wide_spread_marks "
    "max_quote_age_seconds median_spread_over_mid expiry_candidate_count surface_pair_count paper_grade_quote_ivar_mid paper_grade_quote_ivar_ask paper_grade_quote_iv_mid paper_grade_quote_iv_bidask "
    "paper_grade_quote_iv_surface_pair paper_grade_quote_surface_ivar_mid paper_grade_quote_surface_ivar_bid paper_grade_quote_surface_ivar_ask used_intrinsic_fallback xbrl_dropped_same_day_filed_rows".split()
)
TELLING = tuple(
    "accession primary_document sec_items source_id rvar_event rvar_ r_event_ edge_var_realized mispricing_realized preannouncement prior_guidance s_after close_after open_after return_decomposition cross_term "
    "gross_proxy_pnl_usd gross_exit_option_vwap gross_c2o gross_post_open gross_reaction_o2c exit_option_value exit_intrinsic exit_option_vwap post_open_option_vwap open_option_vwap option_proxy_decomposition "
    "reaction_o2c_option_vwap c2o_exit_intrinsic c2o_haircut c2o_proxy_pnl haircut_pnl_usd net_proxy_pnl_usd quote_execution quote_iv quote_ivar quote_bid_iv quote_mid_iv quote_ask_iv quote_mid_ivar quote_ask_ivar "
    "quote_surface quote_status quote_score surface_pair spread_over_mid return_on_premium_realized realized post_event future".split()
)
FAMILIES = (
    (r"^seqagg_", "sequence_aggregate"), (r"^prior_", "rolling_earnings_history"), (r"_train_(z|rank)$", "train_fit_normalization"), (r"^xbrl_", "sec_xbrl_companyfacts"), (r"^sector_sic_", "sector_sic_coarse_control"),
    (r"delta_grid_proxy|rnd_proxy", "single_name_surface_proxy"), (r"runup|underlying_pre_event_|delta_", "single_name_runup_proxy"), (r"^(vix_|spy_|qqq_|market_second_)", "market_covariate"), (r"premium|cost|volume|transactions", "liquidity_execution_proxy"),
)
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")


def allowed(name: str, kind: str) -> tuple[bool, str]:
    """Whether a column may be a model's input, and why. History of earlier events may, whatever its name holds."""
    low, numeric = name.lower(), kind in NUMERIC or kind.startswith("decimal")
    tests = (
        (name in EXCLUDED or low in EXCLUDED, False, "exact_exclusion"), (low.endswith("_cik") or low.startswith(("cik_", "sec_raw_")), False, "raw_identifier_exclusion"), (low.startswith("forecast_"), False, "prediction_column"),
        (low.startswith("prior_"), numeric, "point_in_time_prior_history" if numeric else "non_numeric"), (any(p in low for p in TELLING), False, "leakage_or_identifier_exclusion"), (low.startswith("seq_t"), False, "raw_pivot_sequence_column"),
    )
    return next(((ok, why) for test, ok, why in tests if test), (numeric, "allowlisted_numeric_or_bool" if numeric else "non_numeric"))


def schema_report(df: DataFrame) -> DataFrame:
    """A row per column: feature_name, family, model_feature, reason and coverage (the share of rows that have it), in one pass over the rows."""
    family = lambda name: next((f for p, f in FAMILIES if re.search(p, name)), "event_level")
    told = [(n, family(n), *allowed(n, k)) for n, k in df.dtypes]
    rows = F.array(*[F.struct(F.lit(n).alias("feature_name"), F.lit(f).alias("family"), F.lit(ok).alias("model_feature"), F.lit(why).alias("reason"), F.col(f"_{i}").alias("coverage")) for i, (n, f, ok, why) in enumerate(told)])
    share = lambda n: F.coalesce(F.avg(F.col(f"`{n}`").isNotNull().cast("int")), F.lit(0.0))
    return df.agg(*[share(n).alias(f"_{i}") for i, (n, *_) in enumerate(told)]).select(F.inline(rows))


def model_columns(df: DataFrame, sequence_aggregates: bool = True) -> list[str]:
    """The columns that may be a model's inputs, in their order."""
    return [n for n, k in df.dtypes if allowed(n, k)[0] and (sequence_aggregates or not n.startswith("seqagg_"))]


# Patterns of names that tell of the outcome, and of a vendor's own forecasts.
BLOCKED = (
    r"(^|_)s_after($|_)", r"(^|_)close_after($|_)", r"(^|_)open_after($|_)", r"(^|_)rvar_event($|_)", r"rvar_", r"(^|_)r_event_", r"gross_.*proxy_pnl", r"haircut_pnl", r"net_proxy_pnl", r"exit_option_value", r"exit_intrinsic", r"exit_option_vwap",
    r"post_open_option_vwap", r"c2o_", r"reaction_o2c", r"(^|_)realized(_|$)", r"(^|_)post_event(_|$)", r"(^|_)future(_|$)", r"same_event_return", r"preannouncement", r"prior_guidance",
)
VENDOR = (r"vendor_.*forecast", r"forecasted_iv", r"predicted_")


def leaking_names(columns: Sequence[str], whitelist: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """(names that tell of the outcome, vendors' forecasts that aren't allowed). History of earlier events may be named after outcomes."""
    hit = lambda name, patterns: any(re.search(p, name.lower()) for p in patterns)
    history = lambda n: n.lower().startswith("prior_") and "guidance" not in n.lower() and "preannouncement" not in n.lower()
    return sorted({c for c in columns if hit(c, BLOCKED) and not history(c)}), sorted({c for c in columns if hit(c, VENDOR)} - set(whitelist))


def leakage_rows(df: DataFrame, asof: str, entry: str) -> DataFrame:
    """Rows whose features are later than their entry or have no time. Text columns count as instants only if all name a zone or none does."""
    kinds = dict(df.dtypes)
    if kinds[asof] == kinds[entry] == "string":
        zoned = lambda c: F.col(c).rlike(r"(Z|[+-]\d{2}:?\d{2})$")
        mixed = df.agg((F.count_if(zoned(asof) | zoned(entry)) > 0).alias("a"), (F.count_if(~zoned(asof) | ~zoned(entry)) > 0).alias("b"))
        out = df.crossJoin(F.broadcast(mixed))  # one row
        time = lambda c: F.try_to_timestamp(F.col(c))
        return out.withColumn("leakage_audit_reason", F.when(F.col("a") & F.col("b"), "timezone_mismatch").when(time(asof).isNull() | time(entry).isNull(), "missing_time").when(time(asof) > time(entry), "after_entry")).where("leakage_audit_reason IS NOT NULL").drop("a", "b")
    late = F.when(F.col(asof).isNull() | F.col(entry).isNull(), "missing_time").when(F.col(asof) > F.col(entry), "after_entry")
    return df.withColumn("leakage_audit_reason", late).where("leakage_audit_reason IS NOT NULL")
