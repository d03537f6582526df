"""Audits of tables: coverage of columns and dates, keys, constraints on rows, and shares by group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.numbers import number


def coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, non-null rows and their share, in one pass."""
    one = df.agg(F.count("*").alias("_n"), *[F.count(c).alias(c) for c in columns])
    long = one.unpivot(["_n"], list(columns), "column", "filled")
    return long.select("column", "filled", (F.col("filled") / F.col("_n")).alias("share"))


def key_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once or hold a null."""
    bad = F.greatest(*[F.col(k).isNull().cast("int") for k in keys], F.lit(0))
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where((F.col("n") > 1) | (bad > 0))


def field_audit(df: DataFrame, dataset: str, required: Sequence[str]) -> DataFrame:
    """A row per required field: whether the table has it, its share of rows with a value, and the rows."""
    have = [c for c in required if c in df.columns]
    one = df.agg(F.count("*").alias("_n"), *[F.count(F.col(f"`{c}`")).alias(f"_{i}") for i, c in enumerate(have)])
    share = {c: F.coalesce(F.col(f"_{i}") / F.nullif(F.col("_n"), F.lit(0)), F.lit(0.0)) for i, c in enumerate(have)}
    rows = F.array(*[F.struct(F.lit(dataset).alias("dataset"), F.lit(c).alias("field"), F.lit(c in have).alias("available"), share.get(c, F.lit(0.0)).alias("non_null_share"), F.col("_n").alias("row_count")) for c in required])
    return one.select(F.inline(rows))


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break a rule, with the names of the rules they break; a rule that can't be told counts as kept."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(True)), F.lit(name)) for name, rule in rules.items()]))
    return df.withColumn("violations", broken).where(F.size("violations") > 0)


def enforced(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``df``, whose rows raise an error when they are read if they break a rule."""
    kept = F.lit(True)
    for name, rule in rules.items():
        kept = kept & F.when(F.coalesce(rule, F.lit(True)), F.lit(True)).otherwise(F.raise_error(F.lit(f"row constraint broken: {name}")).cast("boolean"))
    return df.where(kept)


#: Rules of quotes, bars, features and signals.
def quote_rules() -> dict[str, Column]:
    return {"bid_not_negative": F.col("bid") >= 0, "ask_at_least_bid": F.col("ask") >= F.col("bid")}


def bar_rules() -> dict[str, Column]:
    return {f"{c}_positive": F.col(c) > 0 for c in ("open", "high", "low", "close")} | {"high_at_least_low": F.col("high") >= F.col("low")}


def signal_rules(tolerance: float = 1e-9) -> dict[str, Column]:
    c = F.col
    return {"edge_is_forecast_less_implied": F.abs(c("edge_var") - (c("forecast") - c("ivar"))) <= tolerance, "edge_is_value_less_cost": F.abs(c("expected_edge") - (c("expected_value") - c("entry_cost"))) <= tolerance}


def date_coverage(df: DataFrame, dataset: str, date: str, start: str, end: str, entities: Sequence[str] = (), partitioned: bool = False) -> DataFrame:
    """One row: first and last date, rows, distinct entities, weekdays expected and days present, and how the target span is covered.

    A table is the span's if it starts and ends with it; one partitioned by date must also hold 95 % of the weekdays.
    """
    a, b = F.lit(start).cast("date"), F.lit(end).cast("date")
    d = F.col(date).cast("date")
    one = df.agg(F.count("*").alias("row_count"), F.count(d).alias("date_non_null_rows"), F.min(d).alias("first_date"), F.max(d).alias("last_date"), F.count_distinct(d).alias("days"), *[F.count_distinct(e).alias(f"{e}_count") for e in entities])
    weekdays = F.size(F.filter(F.sequence(a, b), lambda x: ~F.dayofweek(x).isin(1, 7)))
    out = one.select(F.lit(dataset).alias("dataset_id"), "*", weekdays.alias("expected_weekdays"))
    share = F.col("days") / F.col("expected_weekdays") if partitioned else F.lit(None).cast("double")
    inside = (F.col("first_date") <= a) & (F.col("last_date") >= b)
    status = F.when(F.col("first_date").isNull(), "exists_no_date_bounds").when(~inside, "target_span_incomplete").when(share < 0.95, "span_ok_partition_gap").otherwise("target_span_covered")
    reason = F.when(F.col("first_date").isNull(), "no_auditable_date_column").when(~inside, F.concat_ws(",", F.when(F.col("first_date") > a, "history_starts_after_target"), F.when(F.col("last_date") < b, "history_ends_before_target"))).when(share < 0.95, "date_span_covers_target_but_partitions_incomplete")
    return out.withColumns({"partition_coverage_share": share, "target_coverage_status": status, "gap_reason": reason})


def year_coverage(df: DataFrame, date: str, start: str, end: str) -> DataFrame:
    """Per year of the span: days present, weekdays expected and their ratio; years without a row have one."""
    day = df.select(F.col(date).cast("date").alias("d")).where(F.col("d").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).groupBy(F.year("d").alias("year")).agg(F.count_distinct("d").alias("days"))
    # a row for each day of the span
    span = df.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("d")).groupBy(F.year("d").alias("year")).agg(F.count_if(~F.dayofweek("d").isin(1, 7)).alias("expected_weekdays"))
    out = span.join(day, "year", "left").withColumn("days", F.coalesce("days", F.lit(0)))
    return out.withColumn("coverage_share", F.col("days") / F.nullif(F.col("expected_weekdays"), F.lit(0)))


# Buckets of days to expiry and of moneyness, right-closed.
DTE_EDGES, DTE_NAMES = (7, 14, 30, 60), ("0_7", "8_14", "15_30", "31_60", "61_plus")
MONEYNESS_EDGES, MONEYNESS_NAMES = (0.9, 0.97, 1.03, 1.1), ("deep_put_wing", "put_wing", "atm", "call_wing", "deep_call_wing")


def cut(value: Column, edges: Sequence[float], names: Sequence[str]) -> Column:
    """The name of the right-closed bucket that a value falls in."""
    out = F.when(value <= edges[0], names[0])
    for e, n in zip(edges[1:], names[1:]):
        out = out.when(value <= e, n)
    return out.when(value.isNotNull(), names[-1])


def vendor_iv_difference(options: DataFrame) -> DataFrame:
    """By moneyness and days to expiry: rows with both volatilities and their mean distance."""
    rows = options.select(number("vendor_iv").alias("v"), number("local_iv").alias("l"), number("moneyness").alias("m"), number("dte").alias("d")).dropna()
    return rows.groupBy(cut(F.col("m"), MONEYNESS_EDGES, MONEYNESS_NAMES).alias("moneyness_bucket"), cut(F.col("d"), DTE_EDGES, DTE_NAMES).alias("dte_bucket")).agg(F.count("*").alias("n"), F.avg(F.abs(F.col("v") - F.col("l"))).alias("mean_abs_difference"))


def shares(df: DataFrame, column: str) -> DataFrame:
    """Each value's rows and share of all rows; null is the value missing."""
    counts = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("missing")).alias(column)).agg(F.count("*").alias("rows"))
    total = counts.agg(F.sum("rows").alias("_n"))
    return counts.crossJoin(F.broadcast(total)).select(column, "rows", (F.col("rows") / F.col("_n")).alias("share"))  # one row


def shape(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, value, rows: how often each value of each column occurs, in one group-by."""
    pair = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(pair).groupBy("column", "value").agg(F.count("*").alias("rows"))
