"""Exact quantiles of many columns and groups without a sort of their rows.

One aggregation takes a mergeable quantile sketch of every column and group, whose rank error is bounded. It gives two
values that enclose each wanted place for certain. A second aggregation counts the rows below the first value exactly and the
distinct values in between, which are a small share of the rows (a few times the sketch's error), and only those counts are
put in order. A group with few rows is enclosed by its least and largest value. Should a sketch ever miss (its counts
would tell), the least and largest value enclose the place in a second try.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.operators.staging import materialise, running_sum

#: A sketch's rank error is one in so many; a place is enclosed with twice that on either side.
ACCURACY = 1000
#: Columns that one aggregation sketches (a sketch buffers up to 50,000 values a group and task).
COLUMNS_AT_ONCE = 50


def same(left: str, right: str, by: Sequence[str]) -> Column:
    """Groups match null-safely: null is a group."""
    out = F.lit(True)
    for c in by:
        out = out & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return out


def _enclosed(df: DataFrame, columns: Sequence[str], by: Sequence[str], shares: Sequence[float], accuracy: int) -> DataFrame:
    """by, feature, n, lo and hi (arrays, an item for each share)."""
    edges = [min(1.0, max(0.0, s + d * 2 / accuracy)) for s in shares for d in (-1, 1)]
    sketch = lambda c: F.percentile_approx(c, F.array(*map(F.lit, edges)), F.lit(accuracy))
    one = lambda c: F.struct(F.lit(c).alias("feature"), F.count(c).alias("n"), F.min(c).alias("least"), F.max(c).alias("most"), sketch(c).alias("e"))
    got = df.groupBy(*by).agg(F.array(*map(one, columns)).alias("_s")).select(*by, F.inline("_s"))
    few = F.col("n") <= 4 * accuracy
    side = lambda d, end: F.array(*[F.when(few, F.col(end)).otherwise(F.get("e", F.lit(2 * i + d))) for i in range(len(shares))])
    return got.select(*by, "feature", "n", side(0, "least").alias("lo"), side(1, "most").alias("hi"))


def _selected(df: DataFrame, columns: Sequence[str], by: Sequence[str], shares: Sequence[float], edges: DataFrame) -> DataFrame:
    """by, feature, n and q (an array, an item for each share; null where the edges don't enclose the place)."""
    wide = edges.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("lo", "hi")))).alias("_edges"))
    met = df.alias("l").join(F.broadcast(wide.alias("r")) if not by else wide.alias("r"), same("l", "r", by), "left").select(*[F.col(f"l.{c}") for c in dict.fromkeys([*by, *columns])], "r._edges")
    edge = lambda c, side, i: F.get(F.col("_edges")[c][side], F.lit(i))
    parts = [(c, i) for c in columns for i in range(len(shares))]
    below = met.groupBy(*by).agg(F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(i).alias("i"), F.count_if(F.col(c) < edge(c, "lo", i)).alias("start")) for c, i in parts]).alias("_s")).select(*by, F.inline("_s"))
    inside = [F.when(F.col(c).between(edge(c, "lo", i), edge(c, "hi", i)), F.struct(F.lit(c).alias("feature"), F.lit(i).alias("i"), F.col(c).alias("v"))) for c, i in parts]
    counts = met.select(*by, F.inline(F.array_compact(F.array(*inside)))).groupBy(*by, "feature", "i", "v").agg(F.count("*").alias("c"))
    keys = [*by, "feature", "i"]
    placed = running_sum(counts, keys, [F.col("v")], F.col("c"), "before")
    at = F.element_at(F.array(*map(F.lit, map(float, shares))), F.col("i") + 1) * (F.col("n") - 1)
    rows = placed.alias("l").join(below.alias("r"), same("l", "r", keys)).select("l.*", "r.start")
    rows = rows.alias("l").join(edges.select(*by, "feature", "n").alias("r"), same("l", "r", [*by, "feature"])).select("l.*", "r.n")
    first = F.col("start") + F.col("before")
    holds = lambda k: F.max(F.when((first <= k) & (k < first + F.col("c")), F.col("v")))
    one = rows.groupBy(*keys).agg(holds(F.floor(at)).alias("a"), holds(F.ceil(at)).alias("b"), F.max(at - F.floor(at)).alias("w"), F.max("n").alias("n"))
    value = F.col("a") + (F.col("b") - F.col("a")) * F.col("w")
    pick = lambda i: F.max(F.when(F.col("i") == i, value))
    return one.groupBy(*by, "feature").agg(F.max("n").alias("n"), F.array(*[pick(i) for i in range(len(shares))]).alias("q"))


def column_quantiles(df: DataFrame, columns: Sequence[str], by: Sequence[str], shares: dict[str, float], accuracy: int = ACCURACY) -> DataFrame:
    """by, feature, n (values) and a column for each named share: exact quantiles by linear interpolation, as ``percentile`` gives them.

    Nulls are left out; a column without a value in a group has no row there. Columns are doubles (or numbers that cast to them).
    """
    out, ps = None, list(shares.values())
    typed = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns])
    for lo in range(0, len(columns), COLUMNS_AT_ONCE):
        some = columns[lo : lo + COLUMNS_AT_ONCE]
        edges = materialise(_enclosed(typed, some, by, ps, accuracy).where("n > 0"), "quantile-edges")
        found = edges.select(*by, "feature", "n").alias("l").join(_selected(typed, some, by, ps, edges).alias("r"), same("l", "r", [*by, "feature"]), "left")
        none = F.array_repeat(F.lit(None).cast("double"), len(ps))
        got = materialise(found.select(*[f"l.{c}" for c in (*by, "feature", "n")], F.coalesce("r.q", none).alias("q")), "quantiles")
        missed = [r.feature for r in got.where(F.exists("q", lambda x: x.isNull())).select("feature").distinct().collect()]  # column names
        if missed:
            ends = typed.groupBy(*by).agg(F.array(*[F.struct(F.lit(c).alias("feature"), F.min(c).alias("a"), F.max(c).alias("b"), F.count(c).alias("n")) for c in missed]).alias("_s")).select(*by, F.inline("_s")).where("n > 0")
            whole = ends.select(*by, "feature", "n", F.array_repeat("a", len(ps)).alias("lo"), F.array_repeat("b", len(ps)).alias("hi"))
            got = got.where(~F.col("feature").isin(missed)).unionByName(_selected(typed, missed, by, ps, whole))
        out = got if out is None else out.unionByName(got)
    return out.select(*by, "feature", "n", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(shares)])
