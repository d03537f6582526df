"""Ranks, quantiles, quantile buckets, chronological splits and train-only normalisation.

``ntile`` is not the quantile bucket of ranks, and Spark has no average rank; both are built from ranks and counts.
Ranks are counts inside range partitions of the rows plus those of the partitions before (``places``), quantiles come from
counts by distinct value or without any order of the rows (``selection``); so neither one group nor one value with a third
of the rows gathers in a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.selection import column_quantiles, same as _same
from panelspark.operators.staging import materialise, running_sum


def value_counts(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """by, value, n and below (rows of the group with a smaller value) and total: one row for each distinct value.

    Rows are counted before they are ordered, so ties cost one row; nulls are left out.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    placed = running_sum(counts, by, [F.col(value)], F.col("n"), "below")
    total = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    return placed.alias("l").join(total.alias("r"), _same("l", "r", by), "left").select(*[F.col(f"l.{c}") for c in (*by, value, "n", "below")], "r.total")


def places(df: DataFrame, value: str, by: Sequence[str], counted: Column | None = None) -> DataFrame:
    """Adds below and upto: how many counted rows (default: all with a value) of the group have a smaller value, and at most this one.

    Rows are dealt out by range of group, value and their own number, so that equal values spread over tasks, and stay where
    they are: counts inside a range partition are windows, and only counts of partitions and of the values at their
    ends go through windows over partitions. Nothing is joined back on a value.
    """
    there = F.col(value).isNotNull()
    rows = df.withColumns({"_own": F.monotonically_increasing_id(), "_c": F.when(there & (counted if counted is not None else F.lit(True)), 1).otherwise(0).cast("long"), "_g": F.struct(F.lit(0).alias("all"), *by)})
    spread = rows.repartitionByRange(*by, F.col(value), F.col("_own")).withColumn("_part", F.spark_partition_id())
    ordered = Window.partitionBy("_g", "_part").orderBy(value)  # up to a row's peers
    peers = Window.partitionBy("_g", "_part", value)
    held = materialise(spread.withColumns({"_upto": F.sum("_c").over(ordered), "_peers": F.sum("_c").over(peers)}).drop("_own", "_c"), "places")
    parts = held.groupBy("_g", "_part").agg(F.max("_upto").alias("c"), F.min_by("_peers", value).alias("c_lo"), F.max_by("_peers", value).alias("c_hi"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    before = Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_start", F.coalesce(F.sum("c").over(before), F.lit(0)))
    # a value at a partition's end may go on in others: its counts in the partitions before and after
    ends = F.array(F.struct(F.col("lo").alias("v"), F.col("c_lo").alias("n")), F.struct(F.col("hi").alias("v"), F.when(F.col("hi") != F.col("lo"), F.col("c_hi")).otherwise(0).alias("n")))
    each = parts.select("_g", "_part", F.inline(ends)).where("v IS NOT NULL").groupBy("_g", "v", "_part").agg(F.max("n").alias("n"))
    same = Window.partitionBy("_g", "v").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumns({"_e": F.coalesce(F.sum("n").over(same), F.lit(0)), "_all": F.sum("n").over(Window.partitionBy("_g", "v"))})
    each = each.select("_g", "_part", "v", "_e", (F.col("_all") - F.col("_e") - F.col("n")).alias("_l"))
    shift = parts.join(each.hint("merge"), ["_g", "_part"], "left").groupBy("_g", "_part").agg(
        F.max("_start").alias("_start"), F.max("lo").alias("_lo"), F.max("hi").alias("_hi"), F.max(F.when(F.col("v") == F.col("lo"), F.col("_e"))).alias("_e"), F.max(F.when(F.col("v") == F.col("hi"), F.col("_l"))).alias("_l")
    )
    # the small side by name: ordered rows make small files, and Spark would broadcast them
    out = held.join(shift.hint("merge") if by else F.broadcast(shift), ["_g", "_part"])
    below = F.col("_start") + F.col("_upto") - F.col("_peers") - F.when(F.col(value) == F.col("_lo"), F.col("_e")).otherwise(0)
    upto = F.col("_start") + F.col("_upto") + F.when(F.col(value) == F.col("_hi"), F.col("_l")).otherwise(0)
    known = lambda c: F.when(F.col(value).isNotNull(), c)
    return out.select(*df.columns, known(below).alias("below"), known(upto).alias("upto"))


def average_rank(df: DataFrame, value: str, by: Sequence[str], name: str) -> DataFrame:
    """Adds the 1-based rank of ``value`` in its group, ties sharing their mean rank; a null value has a null rank."""
    return places(df, value, by).withColumn(name, (F.col("below") + F.col("upto") + 1) / 2).drop("below", "upto")


def _at_share(share: float, value: str) -> Column:
    """The quantile of a group of distinct values with n, below and total, by linear interpolation."""
    place = F.lit(float(share)) * (F.col("total") - 1)
    holds = lambda k: (F.col("below") <= k) & (k < F.col("below") + F.col("n"))
    low, high = F.max(F.when(holds(F.floor(place)), F.col(value))), F.max(F.when(holds(F.ceil(place)), F.col(value)))
    return low + (high - low) * F.max(place - F.floor(place))


def quantiles(df: DataFrame, value: str, by: Sequence[str], shares: dict[str, float]) -> DataFrame:
    """by and one column for each named share: the exact quantile by linear interpolation, as ``percentile`` gives it.

    Only counts of distinct values are ordered, over all partitions; no buffer holds a group's values.
    """
    return value_counts(df, value, by).groupBy(*by).agg(*[_at_share(share, value).alias(name) for name, share in shares.items()])


def quantile_bucket(rank: Column, n: Column, q: int | Column) -> Column:
    """The bucket 0..q-1 of a first rank 1..n by linear quantile edges, right-closed; fewer rows than buckets: one each."""
    q = F.least(F.lit(q) if isinstance(q, int) else q, n)
    return F.when(n <= 1, F.lit(0)).otherwise(F.greatest(F.lit(0), F.ceil((rank - 1) * q / (n - 1)).cast("int") - 1))


def buckets(df: DataFrame, value: str, tie: str, by: Sequence[str], q: int, name: str) -> DataFrame:
    """Adds the quantile bucket of first ranks (by value, then ``tie``) of the rows of each group; rows without a value have none."""
    kept = df.where(F.col(value).isNotNull())
    ranked = running_sum(kept, by, [F.col(value), F.col(tie)], F.lit(1), "_below")
    total = kept.groupBy(*by).agg(F.count("*").alias("_total"))
    met = ranked.alias("l").join(F.broadcast(total.alias("r")) if not by else total.alias("r"), _same("l", "r", by), "left")  # never the rows are broadcast
    return met.select(*[f"l.{c}" for c in df.columns], quantile_bucket(F.col("_below") + 1, F.col("_total"), q).alias(name))


def tied_buckets(df: DataFrame, value: str, by: Sequence[str], q: int, name: str) -> DataFrame:
    """Adds the quantile bucket of average ranks: equal values share a bucket, and edges that coincide count once.

    Edges are quantiles of the ranks. A bucket's number is how many distinct edges above the least lie below the rank.
    """
    at = value_counts(df, value, by).withColumn("_rank", F.col("below") + (F.col("n") + 1) / 2)
    edges = []
    for i in range(q + 1):
        # the i-th edge lies between the ranks at two places of the sorted rows
        place = F.lit(float(i)) * (F.col("total") - 1) / F.least(F.lit(q), F.col("total"))
        holds = lambda k: (F.col("below") <= k) & (k < F.col("below") + F.col("n"))
        low, high = F.max(F.when(holds(F.floor(place)), F.col("_rank"))), F.max(F.when(holds(F.ceil(place)), F.col("_rank")))
        edges.append(F.when(F.max(F.lit(i) <= F.least(F.lit(q), F.col("total"))), low + (high - low) * F.max(place - F.floor(place))))
    cuts = at.groupBy(*by).agg(F.array_sort(F.array_distinct(F.array_compact(F.array(*edges)))).alias("_cuts"))
    ranked = average_rank(df, value, by, "_rank").alias("l")
    met = ranked.join(F.broadcast(cuts.alias("r")) if not by else cuts.alias("r"), _same("l", "r", by), "left")
    # right-closed, the least edge included
    inner = F.slice("r._cuts", F.lit(2), F.greatest(F.size("r._cuts") - 2, F.lit(0)))
    bucket = F.when(F.col("l._rank").isNotNull(), F.size(F.filter(inner, lambda c: c < F.col("l._rank"))))
    return met.select(*[f"l.{c}" for c in df.columns], bucket.alias(name))


def auc(df: DataFrame, score: str, outcome: str, by: Sequence[str]) -> DataFrame:
    """Per group the area under the ROC curve by average ranks; null with one class only."""
    known = df.where(F.col(score).isNotNull() & F.col(outcome).isNotNull()).withColumn("_hit", (F.col(outcome) > 0).cast("long"))
    at = running_sum(known.groupBy(*by, score).agg(F.count("*").alias("_c"), F.sum("_hit").alias("_h")), by, [F.col(score)], F.col("_c"), "_below")
    got = at.groupBy(*by).agg(F.sum(F.col("_h") * (F.col("_below") + (F.col("_c") + 1) / 2)).alias("_s"), F.sum("_h").cast("double").alias("_p"), F.sum("_c").cast("double").alias("_n"))
    neg = F.col("_n") - F.col("_p")
    return got.select(*by, F.col("_n").cast("long").alias("n"), F.when((F.col("_p") > 0) & (neg > 0), (F.col("_s") - F.col("_p") * (F.col("_p") + 1) / 2) / (F.col("_p") * neg)).alias("auc"))


def chronological_split(df: DataFrame, key: str, ts: str, train: float = 0.7, validation: float = 0.85) -> DataFrame:
    """Adds split by the order of each key's first time: the earliest 70 % train, then validation, then test.

    Ranks come from counts per day plus a rank inside the day. Fewer than three keys can't be split: an error.
    """
    first = df.groupBy(key).agg(F.min(ts).alias("_t")).withColumn("_d", F.to_date("_t"))
    per_day = first.groupBy("_d").agg(F.count("*").alias("_c"))
    before = Window.orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_day.select("_d", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"), F.sum("_c").over(Window.partitionBy()).alias("_n"))
    ranked = first.alias("f").join(F.broadcast(starts.alias("s")), F.col("f._d").eqNullSafe(F.col("s._d"))).select("f.*", "_start", "_n")
    ranked = ranked.withColumn("_r", F.col("_start") + F.row_number().over(Window.partitionBy("_d").orderBy("_t", key)))
    n = F.when(F.col("_n") >= 3, F.col("_n")).otherwise(F.raise_error(F.lit("a chronological split needs three keys")).cast("long"))
    cut1 = F.greatest(F.lit(1), F.floor(F.lit(train) * n))
    cut2 = F.least(F.greatest(cut1 + 1, F.floor(F.lit(validation) * n)), n - 1)
    split = F.when(F.col("_r") <= cut1, "train").when(F.col("_r") <= cut2, "validation").otherwise("test")
    return df.join(ranked.select(key, split.alias("split")), key)


def split_at(df: DataFrame, key: str, ts: str, split_date: str) -> DataFrame:
    """Adds split by date: keys first seen before ``split_date`` train; the later ones halve into validation and test by their order."""
    first = df.groupBy(key).agg(F.min(ts).alias("_t"))
    late = running_sum(first.where(F.col("_t") >= F.lit(split_date).cast("timestamp")), [], [F.col("_t"), F.col(key)], F.lit(1), "_below")
    n = late.agg(F.count("*").alias("_n"))
    half = late.crossJoin(F.broadcast(n)).select(key, F.when(F.col("_below") < F.greatest(F.lit(1), F.ceil(F.col("_n") / 2)), "validation").otherwise("test").alias("split"))  # one row
    return df.join(half, key, "left").withColumn("split", F.coalesce("split", F.lit("train")))


PARAMS = {"p10": 0.1, "p25": 0.25, "center": 0.5, "p75": 0.75, "p90": 0.9}


def train_params(df: DataFrame, values: str | Sequence[str], split: str = "split", fit: Sequence[str] = ("train",)) -> DataFrame:
    """What the fitted splits say of each value: feature, n_fit, center (median), scale (population deviation, 1 if none) and five quantiles.

    Two aggregations for all columns at once, and no sort of rows.
    """
    columns = [values] if isinstance(values, str) else list(values)
    fitted = df.where(F.col(split).isin(*fit)).select(*[F.col(c).cast("double").alias(c) for c in columns])
    spreads = fitted.agg(F.array(*[F.struct(F.lit(c).alias("feature"), F.stddev_pop(c).alias("_s")) for c in columns]).alias("_a")).select(F.inline("_a"))
    cuts = column_quantiles(fitted, columns, [], PARAMS).withColumnRenamed("n", "n_fit")
    scale = F.when(F.col("_s") > 1e-12, F.col("_s")).otherwise(1.0)
    return cuts.join(spreads, "feature").select("feature", *PARAMS, "n_fit", scale.alias("scale"))


def train_fit(df: DataFrame, values: str | Sequence[str], split: str = "split", fit: Sequence[str] = ("train",), key: str | None = None) -> DataFrame:
    """Adds, for one column, z (distance to the fitted median in fitted deviations) and rank (share of fitted rows at or below).

    For a list of columns adds <column>_train_z and <column>_train_rank; ``key`` must then name a column that tells rows
    apart. Ranks of all columns come from one order of (column, value) cells and return to their rows by the key.
    A column without a fitted value gives nulls.
    """
    inside = F.col(split).isin(*fit)
    columns = [values] if isinstance(values, str) else list(values)
    params = train_params(df, columns, split, fit)
    held = params.agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("center", "scale", "n_fit")))).alias("_p"))  # a row, an entry for each column
    of = lambda c, what: F.col("_p")[c][what]
    z = lambda c: (F.col(c) - of(c, "center")) / of(c, "scale")
    if isinstance(values, str):
        out = places(df, values, [], inside).crossJoin(F.broadcast(held))
        return out.withColumns({"z": z(values), "rank": F.col("upto") / of(values, "n_fit")}).drop("_p", "below", "upto")
    cells = df.select(key, inside.alias("_fit"), *[F.col(c).cast("double").alias(c) for c in columns]).unpivot([key, "_fit"], columns, "feature", "v").where("v IS NOT NULL")
    ranked = places(cells, "v", ["feature"], F.col("_fit")).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("feature", "upto"))).alias("_r"))
    out = df.join(ranked, key, "left").crossJoin(F.broadcast(held))
    made = {f"{c}_train_z": z(c) for c in columns} | {f"{c}_train_rank": F.col("_r")[c] / of(c, "n_fit") for c in columns}
    return out.withColumns(made).drop("_p", "_r")
