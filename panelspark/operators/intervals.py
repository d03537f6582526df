"""What lies inside many overlapping intervals, by prefix states: work grows with ticks plus intervals, not with their pairs.

Per key, ticks and interval ends stand in one order. A running sum up to an interval's end less the one before its start is
its sum; sums are whole numbers or decimals, so the difference is exact. The last tick up to the end belongs to the
interval if it isn't before the start, and the first one from the start on if it isn't after the end. A key's time is cut into
buckets; one row with the states of all buckets before (and one with those after) goes into each bucket that has an
interval's end, so a busy key is many small groups and no tick meets an interval.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ten digits after the point, and room for 10^18 rows of a million.
EXACT = "decimal(28,10)"
#: Order of rows at one instant: states of earlier buckets, points before ticks, ticks, points after ticks, states of later buckets.
EARLIER, BEFORE, TICK, AFTER, LATER = -2, -1, 0, 1, 2


def exact(c: Column) -> Column:
    """A double as a decimal whose running sums lose nothing."""
    return c.cast(EXACT)


def inside_intervals(
    ticks: DataFrame, requests: DataFrame, on: Sequence[str], ts: str, ids: Sequence[str], sums: dict[str, Column],
    last: Column | None = None, first: Column | None = None, closed_end: bool = True, bucket_seconds: int = 3600,
) -> DataFrame:
    """ids, one column for each of ``sums`` (0 without a tick), and _last and _first (structs or null), one row for each request.

    ``requests``: ids (a request's name), on, start_ts, end_ts; a start counts, an end if ``closed_end``. ``sums`` are whole
    numbers or decimals of a tick. ``last`` and ``first`` are structs of a tick that begin with its time, or null where the
    tick doesn't count; ties go to the largest (last) or smallest (first) struct. Null keys and times match nothing;
    an interval that ends before it starts holds nothing.
    """
    bucket = lambda c: F.floor(F.unix_timestamp(c) / bucket_seconds)
    known = F.lit(True)
    for c in (*on, ts):
        known = known & F.col(c).isNotNull()
    none = F.lit(None)
    held = {"_last": last, "_first": first}
    states = {k: F.max(k) if k == "_last" else F.min(k) for k, c in held.items() if c is not None}
    adds = [F.coalesce(c, F.lit(0)).alias(n) for n, c in sums.items()]
    t = ticks.where(known).select(*on, F.col(ts).alias("_ts"), bucket(ts).alias("_b"), F.lit(TICK).alias("_side"), *adds, *[held[k].alias(k) for k in states])
    kind = {f.name: f.dataType for f in t.schema}

    ends = [F.struct(F.lit(BEFORE).alias("_side"), F.col("start_ts").alias("_ts")), F.struct(F.lit(AFTER if closed_end else BEFORE).alias("_side"), F.col("end_ts").alias("_ts"))]
    asked = requests.select(*on, F.struct(*ids).alias("_id"), *[e.alias(n) for e, n in zip(ends, ("_s", "_e"), strict=True)])
    points = asked.select(*on, "_id", F.inline(F.array(*[F.struct(F.lit(i == 1).alias("_is_end"), F.col(f"{n}._ts").alias("_ts"), F.col(f"{n}._side").alias("_side")) for i, n in enumerate(("_s", "_e"))])))
    there = F.col("_ts").isNotNull()
    for c in on:
        there = there & F.col(c).isNotNull()
    points = points.where(there).withColumn("_b", bucket("_ts"))

    # states of whole buckets, handed on to the buckets that have points
    totals = t.groupBy(*on, "_b").agg(*[F.sum(n).alias(n) for n in sums], *[s.alias(k) for k, s in states.items()])
    wanted = points.select(*on, "_b").distinct().withColumn("_wanted", F.lit(True))
    cells = totals.unionByName(wanted, allowMissingColumns=True).groupBy(*on, "_b").agg(
        *[F.coalesce(F.max(n), F.lit(0)).alias(n) for n in sums], *[F.max(k).alias(k) for k in states], F.max("_wanted").alias("_wanted")
    )
    earlier = Window.partitionBy(*on).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*on).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    at = lambda n: F.timestamp_seconds(F.col("_b") * bucket_seconds + n)
    carried = cells.select(*on, "_b", "_wanted", *[F.sum(n).over(earlier).alias(n) for n in sums], *[s.over(later if k == "_first" else earlier).alias(k) for k, s in states.items()])
    carried = carried.where("_wanted")
    rows = t.select(*on, "_ts", "_b", "_side", *sums, *states, none.cast("boolean").alias("_is_end"), none.cast(points.schema["_id"].dataType).alias("_id"))
    blank = lambda df, side, ts_, own: df.select(
        *on, ts_.alias("_ts"), "_b", F.lit(side).alias("_side"), *[own.get(n, F.lit(0).cast(kind[n])).alias(n) for n in sums],
        *[own.get(k, none.cast(kind[k])).alias(k) for k in states], none.cast("boolean").alias("_is_end"), none.cast(points.schema["_id"].dataType).alias("_id"),
    )
    # sums of decimals are wider than what is added; a carried sum keeps its own column
    wide = {n: carried.schema[n].dataType for n in sums}
    rows = rows.select(*[F.col(n).cast(wide[n]).alias(n) if n in sums else F.col(n) for n in rows.columns])
    kind |= wide
    zero = {n: F.coalesce(F.col(n), F.lit(0)).cast(wide[n]) for n in sums}
    rows = rows.unionByName(blank(carried, EARLIER, at(0), zero | ({"_last": F.col("_last")} if "_last" in states else {})))
    if "_first" in states:
        rows = rows.unionByName(blank(carried, LATER, at(bucket_seconds), {"_first": F.col("_first")}))
    marks = points.select(*on, "_ts", "_b", "_side", *[F.lit(0).cast(wide[n]).alias(n) for n in sums], *[none.cast(kind[k]).alias(k) for k in states], "_is_end", "_id")
    rows = rows.unionByName(marks)

    up = Window.partitionBy(*on, "_b").orderBy("_ts", "_side").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*on, "_b").orderBy(F.desc("_ts"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, 0)
    run = rows.select("_id", "_is_end", "_ts", *[F.sum(n).over(up).alias(n) for n in sums], *[s.over(down if k == "_first" else up).alias(k) for k, s in states.items()]).where("_id IS NOT NULL")
    side = lambda n, end: F.max(F.when(F.col("_is_end") == end, F.col(n)))
    # two digits of room, so that the difference keeps all digits after the point
    room = lambda n, c: c.cast(f"decimal({wide[n].precision - 2},{wide[n].scale})") if wide[n].typeName() == "decimal" else c
    got = run.groupBy("_id").agg(
        side("_ts", False).alias("_from"), side("_ts", True).alias("_to"), *[(room(n, side(n, True)) - room(n, side(n, False))).alias(n) for n in sums],
        *[(side(k, True) if k == "_last" else F.min(F.when(~F.col("_is_end"), F.col(k)))).alias(k) for k in states],
    )
    whole = F.col("_from") <= F.col("_to") if closed_end else F.col("_from") < F.col("_to")
    time_of = lambda k: F.col(f"{k}.{kind[k].fieldNames()[0]}")
    fits = {"_last": lambda: time_of("_last") >= F.col("_from"), "_first": lambda: (time_of("_first") <= F.col("_to")) if closed_end else (time_of("_first") < F.col("_to"))}
    return got.select("_id.*", *[F.coalesce(F.when(whole, F.col(n)), F.lit(0)).alias(n) for n in sums], *[F.when(whole & fits[k](), F.col(k)).alias(k) for k in states])
