"""The registry of queries and their SQL, and the stand-in tables that they share.

The driver's tables stand in for the panel's: lineitem for daily bars (l_partkey the ticker), orders for events
(o_custkey the ticker), events for second bars and quote ticks (user_id the contract), documents for filings.
Floats are rounded alike on both sides; both sides order ties by a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.sources import tables

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def load(spark: SparkSession, sf: str, name: str, where: Column | None = None) -> DataFrame:
    return tables.read_table(spark, f"{sf}/{name}.parquet", where=where)


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    return df.select(*[F.round(f.name, places).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name).cast("long").alias(f.name) if f.dataType.simpleString() == "int" else F.col(f.name) for f in df.schema])


def bars(spark, sf) -> DataFrame:
    b = load(spark, sf, "lineitem")
    return b.select(F.col("l_partkey").alias("ticker"), F.to_date("l_shipdate").alias("date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("volume"), F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("line"))


def day_bars(spark, sf) -> DataFrame:
    """One row per ticker and day: open, close (by order key and line), volume."""
    o = F.struct("orderkey", "line")
    return bars(spark, sf).groupBy("ticker", "date").agg(F.min_by("price", o).alias("open"), F.max_by("price", o).alias("close"), F.sum("volume").alias("volume"))


def order_events(spark, sf) -> DataFrame:
    o = load(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("ticker"), F.to_date("o_orderdate").alias("event_date"), F.col("o_totalprice").alias("value"), F.when(F.col("o_orderpriority").startswith("1"), "BMO").when(F.col("o_orderpriority").startswith("2"), "AMC").when(F.col("o_orderpriority").startswith("3"), "DMH").otherwise("UNKNOWN").alias("timing"), "o_orderstatus", "o_orderpriority")


def ticks(spark, sf) -> DataFrame:
    e = load(spark, sf, "events")
    return e.select("event_id", F.col("user_id").alias("contract"), "ts", "value", (F.get_json_object("props", "$.k").cast("long") + 1).alias("volume"), "event_type")


BARS = "bars AS (SELECT l_partkey AS ticker, l_shipdate::DATE AS date, l_extendedprice / l_quantity AS price, l_quantity AS volume, l_orderkey AS orderkey, l_linenumber AS line FROM lineitem)"
DAYS = BARS + ", days AS (SELECT ticker, date, arg_min(price, {'o': orderkey, 'l': line}) AS open, arg_max(price, {'o': orderkey, 'l': line}) AS close, sum(volume) AS volume FROM bars GROUP BY 1, 2)"
EV = "ev AS (SELECT o_orderkey AS event_id, o_custkey AS ticker, o_orderdate::DATE AS event_date, o_totalprice AS value, CASE left(o_orderpriority, 1) WHEN '1' THEN 'BMO' WHEN '2' THEN 'AMC' WHEN '3' THEN 'DMH' ELSE 'UNKNOWN' END AS timing, o_orderstatus, o_orderpriority FROM orders)"
TICKS = "ticks AS (SELECT event_id, user_id AS contract, ts, value, json_extract_string(props, '$.k')::BIGINT + 1 AS volume, event_type FROM events)"
LIQ = "liq AS (SELECT date_trunc('month', date)::DATE AS month, ticker, sum(price * volume * 100) AS liquidity, count(*) AS row_count FROM bars GROUP BY 1, 2)"
UNI = LIQ + """, months AS (SELECT DISTINCT (month + to_months(k))::DATE AS universe_month FROM liq, range(1, 7) t(k)), span AS (SELECT min(month) a, max(month) b FROM liq),
uni AS (SELECT universe_month, ticker, sum(liquidity) AS trailing_liquidity FROM months, span, liq WHERE liq.month >= universe_month - INTERVAL 6 MONTH AND liq.month < universe_month AND universe_month <= b + INTERVAL 1 MONTH GROUP BY 1, 2),
top AS (SELECT *, row_number() OVER (PARTITION BY universe_month ORDER BY round(trailing_liquidity, 4) DESC, ticker) AS rank FROM uni QUALIFY rank <= 50)"""
