"""Hand-checked cases of sequence plans, defeat tables and casebooks."""

import datetime as dt

from pyspark.sql import functions as F

from panelspark.operators import calendar, comparison


def day(n):
    return dt.date(2024, 1, n)


def test_sequence_plan_is_right_aligned(spark):
    dates = spark.createDataFrame([(day(n),) for n in (2, 3, 5, 5, 9)] + [(None,)], "date date")
    events = spark.createDataFrame([("before", day(1)), ("gap", day(4)), ("on", day(5)), ("after", day(20)), ("none", None)], "event string, entry date")
    got = {(r["event"], r["source_date"], r["seq_index"]) for r in calendar.sequence_plan(events, dates, "entry", "date", 3).collect()}
    assert got == {("gap", day(2), 1), ("gap", day(3), 2), ("on", day(2), 0), ("on", day(3), 1), ("on", day(5), 2), ("after", day(3), 0), ("after", day(5), 1), ("after", day(9), 2)}
    assert calendar.sequence_plan(events.limit(0), dates, "entry", "date").count() == 0
    assert calendar.sequence_plan(events, dates.limit(0), "entry", "date").count() == 0


def test_coverage_needs_enough_and_recent_days(spark):
    steps = spark.createDataFrame([("a", i, i < 12) for i in range(20)] + [("b", i, i < 11 or i == 19) for i in range(20)] + [("c", 19, None)], "event string, seq_index int, valid boolean")
    cover = calendar.sequence_coverage(steps, "event", "valid")
    assert {tuple(r) for r in cover.collect()} == {("a", 12, 0, False), ("b", 12, 1, True), ("c", 0, 0, False)}
    report = calendar.coverage_report(cover).head()
    assert (report["events"], report["at_least_12"], report["at_least_16"], report["at_risk"]) == (3, 2, 0, True)


def test_defeats_and_casebook(spark):
    rows = [(1, 3.0, 4.0, 2.0), (2, 3.0, 1.0, 2.0), (3, 1.0, 4.0, 2.0), (4, 3.0, 1.0, 2.0), (5, None, 1.0, 2.0), (6, float("nan"), 1.0, 2.0), (7, 2.5, 2.0, 2.0)]
    out = comparison.defeat_events(spark.createDataFrame(rows, "id int, f double, y double, b double"), "f", "y", "b").withColumn("m", F.lit("x"))
    assert {r["id"]: (r["false_positive"], r["false_negative"], r["model_corrected_market"], r["market_right_model_wrong"]) for r in out.collect()} == {
        1: (False, False, True, False), 2: (True, False, False, True), 3: (False, True, False, True), 4: (True, False, False, True), 7: (True, False, False, True)
    }
    cases = comparison.casebook(out, ["m"], ["id"], F.col("id") == 7, 2).select("case_type", "id", "rank").collect()
    assert {tuple(c) for c in cases if c[0] == "false_positive"} == {("false_positive", 2, 1), ("false_positive", 4, 2)}
    assert {tuple(c) for c in cases if c[0] == "execution_fragile"} == {("execution_fragile", 7, 1)}
    assert comparison.defeat_summary(out, ["m"]).head()["n"] == 5
    assert comparison.casebook(out.limit(0), ["m"], ["id"]).count() == 0
