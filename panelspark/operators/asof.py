"""As-of, interval and window joins without look-ahead.

Both sides of a join are united and sorted inside (key, time bucket), and one row carries what earlier buckets hand on, so
that a hot key is many groups and work is linear in the rows of both sides (``asof_backward``, ``intervals``). Only
``within_windows``, whose result is the pairs themselves, joins ticks to windows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.numbers import number
from panelspark.operators.intervals import exact, inside_intervals


def asof_backward(left: DataFrame, right: DataFrame, on: Sequence[str], left_ts: str, right_ts: str, values: Sequence[str], strict: bool | Column = False, max_lag_days: int | None = None, bucket_days: int = 90) -> DataFrame:
    """``left`` with ``values`` of the latest ``right`` row at or before (``strict``: before) its time, or nulls.

    ``strict`` may be a condition on the left row. Both sides are shuffled once by (key, time bucket) and sorted inside; what
    earlier buckets hand on is one more row of the right side in each bucket that the left has, and comes from that
    side's last row of every bucket. Work is linear in the rows. Of right rows with one key and time the one with the
    largest values counts.
    """
    bucket = lambda ts: F.floor(F.unix_timestamp(F.col(ts).cast("timestamp")) / (86400 * bucket_days))
    value = F.struct(F.col(right_ts).alias("_at"), F.struct(*values).alias("_v"))
    own = right.where(F.col(right_ts).isNotNull()).select(*on, bucket(right_ts).alias("_b"), value.alias("_p"))
    rows = left.select(*on, F.col(left_ts).alias("_ts"), bucket(left_ts).alias("_b"), F.struct(*left.columns).alias("_row"), (strict if isinstance(strict, Column) else F.lit(strict)).alias("_strict"))
    # the last row of all earlier buckets, for each bucket that the left side has
    ends = own.groupBy(*on, "_b").agg(F.max("_p").alias("_p")).withColumn("_asked", F.lit(False))
    asked = rows.select(*on, "_b").distinct().select(*on, "_b", F.lit(None).cast(own.schema["_p"].dataType).alias("_p"), F.lit(True).alias("_asked"))
    cells = ends.unionByName(asked).groupBy(*on, "_b").agg(F.max("_p").alias("_p"), F.max("_asked").alias("_asked"))
    earlier = Window.partitionBy(*on).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = cells.select(*on, "_b", F.max("_p").over(earlier).alias("_p"), "_asked").where("_asked AND _p IS NOT NULL").drop("_asked")
    none = F.lit(None).cast(rows.schema["_row"].dataType)
    r = own.unionByName(carried).select(*on, F.col("_p._at").alias("_ts"), "_b", F.lit(1).alias("_side"), "_p", none.alias("_row"))
    side = F.when(F.coalesce("_strict", F.lit(True)), 0).otherwise(2)
    l_ = rows.select(*on, "_ts", "_b", side.alias("_side"), F.lit(None).cast(own.schema["_p"].dataType).alias("_p"), "_row")
    inside = Window.partitionBy(*on, "_b").orderBy("_ts", "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = r.unionByName(l_).withColumn("_hit", F.max("_p").over(inside)).where(F.col("_row").isNotNull())
    if max_lag_days is not None:
        out = out.withColumn("_hit", F.when(F.datediff("_ts", "_hit._at") <= max_lag_days, F.col("_hit")))
    return out.select("_row.*", *[F.col(f"_hit._v.{v}").alias(v) for v in values], F.col("_hit._at").alias(f"matched_{right_ts}"))


def gated_latest(left: DataFrame, right: DataFrame, on: Sequence[str], left_ts: str, accepted: str, filed: str, order: Sequence[str], value: str) -> DataFrame:
    """Adds latest and previous: the last two values that were known at the left row's time, and known_at of the latest.

    A right row with an ``accepted`` instant is known from then on; one without is known from the day after its ``filed``
    date, so a row filed on the same day isn't. Rows come in the order of acceptance (or of the filed date), then of
    ``order``. Two as-of joins, one for each kind of row, bring two candidates each; no event meets all rows of its key.
    """
    rows = right.where(F.col(value).isNotNull()).withColumn("_sort", F.coalesce(F.col(accepted), F.col(filed).cast("timestamp")))
    out, n = left, 0
    for test, known in ((F.col(accepted).isNotNull(), F.col(accepted)), (F.col(accepted).isNull(), F.date_add(filed, 1).cast("timestamp"))):
        item = F.struct("_sort", *order, F.col(value).alias("_value"))
        w = Window.partitionBy(*on).orderBy("_sort", *order, value)
        states = rows.where(test).select(*on, known.alias("_known"), item.alias("_now"), F.lag(item).over(w).alias("_last"))
        # rows known at one instant: the last of them in the order, with the one before
        out = asof_backward(out, states, on, left_ts, "_known", ["_now", "_last"]).drop("matched__known")
        out = out.withColumnsRenamed({"_now": f"_now{n}", "_last": f"_last{n}"})
        n += 1
    best = F.reverse(F.array_sort(F.array_compact(F.array("_now0", "_last0", "_now1", "_last1"))))
    out = out.withColumn("_best", best)
    return out.select(*left.columns, F.get("_best", F.lit(0))["_value"].alias("latest"), F.get("_best", F.lit(1))["_value"].alias("previous"), F.get("_best", F.lit(0))["_sort"].alias("known_at"))


def window_requests(events: DataFrame, key: str, windows: dict[str, tuple[Column, Column]], keep: Sequence[str]) -> DataFrame:
    """Each event once per named window, with its start and end."""
    made = F.array(*[F.struct(F.lit(n).alias("window"), a.alias("start_ts"), b.alias("end_ts")) for n, (a, b) in windows.items()])
    return events.select(key, *keep, F.inline(made))


def within_windows(ticks: DataFrame, requests: DataFrame, on: Sequence[str], ts: str, closed_end: bool = True) -> DataFrame:
    """Every tick with every request that it lies in, where those pairs are the result (``intervals`` sums them without making
    them). Both sides are cut into hours, so a busy key is many small join keys."""
    hour = lambda c: F.floor(F.unix_timestamp(c) / 3600)
    asked = requests.withColumn("_h", F.explode(F.sequence(hour("start_ts"), hour("end_ts"))))
    met = ticks.withColumn("_h", hour(ts)).join(asked, [*on, "_h"])
    end = F.col(ts) <= F.col("end_ts") if closed_end else F.col(ts) < F.col("end_ts")
    return met.where((F.col(ts) >= F.col("start_ts")) & end)


def interval_latest(ticks: DataFrame, requests: DataFrame, on: Sequence[str], ts: str, value: str, valid: Column, ids: Sequence[str], tie: str, stale_seconds: int = 60) -> DataFrame:
    """Per request: ticks, valid ticks, the last valid one with its age at the end, and a status."""
    rows = ticks.select(*on, F.col(ts).alias("_at"), F.col(tie).alias("_tie"), F.col(value).alias("_value"), valid.alias("_valid"))
    sums = {"tick_count": F.lit(1), "valid_count": F.when(F.col("_valid"), 1).otherwise(0)}
    found = inside_intervals(rows, requests, on, "_at", ids, {n: c.cast("long") for n, c in sums.items()}, last=F.when(F.col("_valid"), F.struct("_at", "_tie", "_value")))
    out = requests.join(found, list(ids), "left").withColumns({"mark": F.col("_last._value"), "mark_ts": F.col("_last._at")})
    out = out.withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in sums})
    age = F.unix_timestamp("end_ts") - F.unix_timestamp("mark_ts")
    status = F.when(F.col("tick_count") == 0, "missing").when(F.col("valid_count") == 0, "invalid").when(age > stale_seconds, "stale").otherwise("ok")
    return out.select(*requests.columns, "tick_count", "valid_count", "mark", "mark_ts", age.alias("age_seconds"), status.alias("status"))


def _count(transactions: str | None) -> Column:
    return (F.coalesce(F.col(transactions), F.lit(0)) if transactions else F.lit(0)).cast("long")


def interval_vwap(ticks: DataFrame, requests: DataFrame, on: Sequence[str], ts: str, price: str, volume: str, ids: Sequence[str], closed_end: bool = True, transactions: str | None = None) -> DataFrame:
    """Per request the volume-weighted mean price of its ticks with positive price and volume, and how old the last is at the end.

    Price times volume and volume count to ten digits after the point. A window that doesn't end after it starts is an error.
    """
    kept = ticks.select(*on, F.col(ts).alias("_at"), number(price).alias("_p"), number(volume).alias("_v"), _count(transactions).alias("_n")).where("_p > 0 AND _v > 0")
    sound = F.when(F.col("end_ts") > F.col("start_ts"), F.col("end_ts")).when(F.col("end_ts").isNotNull() & F.col("start_ts").isNotNull(), F.raise_error(F.lit("a window must end after its start")).cast("timestamp"))
    asked = requests.withColumn("end_ts", sound)
    sums = {"_pv": exact(F.col("_p") * F.col("_v")), "_volume": exact(F.col("_v")), "_transactions": F.col("_n"), "_rows": F.lit(1).cast("long")}
    found = inside_intervals(kept, asked, on, "_at", ids, sums, last=F.struct("_at"), closed_end=closed_end)
    out = asked.join(found, list(ids), "left")
    zero = lambda c: F.coalesce(F.col(f"_{c}"), F.lit(0)).cast("long").alias(c)
    age = (F.unix_micros("end_ts") - F.unix_micros("_last._at")) / 1e6
    vwap = F.when(F.col("_rows") > 0, F.col("_pv").cast("double") / F.col("_volume").cast("double"))
    status = F.when(F.col("_rows") > 0, "ok").otherwise("no_trade_in_cutoff_window")
    return out.select(*requests.columns, vwap.alias("vwap"), F.col("_last._at").alias("last_ts"), age.alias("age_seconds"), zero("volume"), zero("transactions"), zero("rows"), status.alias("status"))


def first_last(ticks: DataFrame, requests: DataFrame, on: Sequence[str], ts: str, price: str, volume: str, ids: Sequence[str], transactions: str | None = None) -> DataFrame:
    """Per request the first and last price inside it, the return between them, and sums of volume and transactions."""
    rows = ticks.select(*on, F.col(ts).alias("_at"), number(price).alias("_p"), number(volume).alias("_v"), _count(transactions).alias("_n")).where("_p > 0")
    one = F.struct("_at", "_p")
    sums = {"_volume": exact(F.coalesce("_v", F.lit(0.0))), "_transactions": F.col("_n"), "_rows": F.lit(1).cast("long")}
    found = inside_intervals(rows, requests, on, "_at", ids, sums, last=one, first=one)
    some = F.col("_rows") > 0
    found = found.select(
        *ids, F.col("_first._p").alias("first_close"), F.col("_last._p").alias("last_close"), F.col("_last._at").alias("last_ts"), F.when(some, F.col("_volume").cast("double")).alias("volume"),
        F.when(some, F.col("_transactions")).alias("transactions"), F.when(some, F.col("_rows")).alias("rows"),
    )
    out = requests.join(found, list(ids), "left")
    return out.withColumns({"window_return": F.col("last_close") / F.col("first_close") - 1, "status": F.when(F.col("rows") > 0, "ok").otherwise("missing")})


def before_cutoff(bars: DataFrame, cutoffs: DataFrame, on: Sequence[str], ts: str, cutoff: str, buffer_minutes: int) -> DataFrame:
    """Bars from ``buffer_minutes`` before their cutoff up to it, both ends included."""
    start = F.col(cutoff) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(buffer_minutes))
    asked = cutoffs.select(*on, F.col(cutoff), start.alias("start_ts"), F.col(cutoff).alias("end_ts"))
    return within_windows(bars, asked, on, ts).drop("start_ts", "end_ts", "_h")
