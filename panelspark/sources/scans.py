"""Scans with pushed filters, day files to date partitions, and normalisers of bars."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.functions.numbers import finite
from panelspark.sources.tables import cleaned, parse_option_symbol, write_partitions

#: Lists of tickers up to this long are written into the filter; longer ones are joined.
MOST_LISTED = 1000


def scan_tickers(spark: SparkSession, path: str, tickers: Sequence[str], columns: Sequence[str] | None = None, ticker: str = "ticker") -> DataFrame:
    """Rows of these tickers with these columns: the filter and the columns reach the Parquet scan."""
    df = cleaned(spark.read.parquet(path).select(*(dict.fromkeys([ticker, *columns]) if columns else ["*"])))
    if len(tickers) <= MOST_LISTED:
        return df.where(F.col(ticker).isin(*tickers))
    asked = spark.createDataFrame([(t,) for t in dict.fromkeys(tickers)], f"`{ticker}` {df.schema[ticker].dataType.simpleString()}")
    return df.join(asked, ticker, "left_semi")


def scan_index_options(options: DataFrame, symbols: Sequence[str], symbol: str = "ticker") -> DataFrame:
    """Rows of option symbols of these roots. Prefix tests reach the scan; the pattern settles what they let through."""
    starts = F.lit(False)
    for s in symbols:
        starts = starts | F.col(symbol).startswith(f"O:{s}")
    return options.where(starts & F.col(symbol).rlike(rf"^O:(?:{'|'.join(map(re.escape, symbols))})\d{{6}}[CP]\d{{8}}$"))


def list_dates(df: DataFrame, date: str = "date") -> DataFrame:
    """The dates that a partitioned table holds, in order."""
    return df.select(F.col(date).cast("date").alias("date")).where("date IS NOT NULL").distinct().orderBy("date")


def between_dates(df: DataFrame, start: str, end: str, date: str = "date") -> DataFrame:
    """Rows of a span of dates; partitions outside it aren't read."""
    return df.where(F.col(date).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


DAY_FILE = "ticker string, volume string, open string, close string, high string, low string, vwap string, window_start bigint, transactions string"


def normalised_days(raw: DataFrame, dataset: str) -> DataFrame:
    """Day bars with typed numbers (texts that are none become null), their date in New York and where they came from."""
    kinds = {"volume": "double", "open": "double", "close": "double", "high": "double", "low": "double", "vwap": "double", "transactions": "bigint"}
    out = raw.withColumns({c: finite(F.col(c).try_cast("double")).cast(k) for c, k in kinds.items() if c in raw.columns})
    return out.withColumns({"date": F.to_date(F.from_utc_timestamp(F.timestamp_micros(F.floor(F.col("window_start") / 1000).cast("bigint")), "America/New_York")), "source_dataset": F.lit(dataset)})


def ingest_day_files(spark: SparkSession, paths: Sequence[str], folder: str, dataset: str) -> DataFrame:
    """Day files (CSV, gzipped or not, header) into a table partitioned by date; a rerun replaces just the dates that it brings."""
    raw = spark.read.csv(list(paths), header=True, schema=DAY_FILE).withColumn("source_key", F.input_file_name())
    days = normalised_days(raw, dataset).where("date IS NOT NULL")
    write_partitions(days.repartition("date").sortWithinPartitions("date", "ticker"), folder)  # the writer wants them by date
    return spark.read.schema(days.schema).parquet(folder)


def option_days(raw: DataFrame, strict: bool = False) -> DataFrame:
    """Option day bars with their symbol taken apart and days to expiry; symbols that don't parse are left out, or (strict) an error."""
    out = parse_option_symbol(raw.withColumnRenamed("ticker", "options_ticker"), "options_ticker")
    parsed = F.col("expiration").isNotNull()
    if strict:
        parsed = F.when(parsed, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no option symbol: "), F.coalesce("options_ticker", F.lit("null")))).cast("boolean"))
    return out.where(parsed).withColumn("dte", F.datediff("expiration", "date")).withColumnRenamed("underlying", "ticker")


def underlying_days(raw: DataFrame) -> DataFrame:
    """ticker, date, open, high, low, close, volume of underlyings' day bars."""
    return raw.select(F.upper("ticker").alias("ticker"), "date", *[finite(F.col(c).try_cast("double")).alias(c) for c in ("open", "high", "low", "close")], F.coalesce(F.col("volume").try_cast("double"), F.lit(0.0)).cast("long").alias("volume"))


def second_bars(raw: DataFrame, name: str, prefix: str = "option") -> DataFrame:
    """Second bars from raw fields (t in ms, o, h, l, c, vw, v, n): ts, prices under ``prefix``, volume and transactions (missing: 0)."""
    price = {"o": "open", "h": "high", "l": "low", "c": "close", "vw": "vwap"}
    count = lambda c, to: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).cast("long").alias(to)
    return raw.select(name, F.timestamp_millis(F.col("t").cast("long")).alias("ts"), *[finite(F.col(c).try_cast("double")).alias(f"{prefix}_{n}") for c, n in price.items()], count("v", "volume"), count("n", "transactions"))


def event_bars(bars: DataFrame, events: DataFrame, ticker: str = "ticker", dates: Sequence[str] = ("entry_date", "exit_date")) -> DataFrame:
    """Bars of the tickers and days that events ask for; on a table partitioned by date the asked dates prune partitions when it runs."""
    asked = events.select(ticker, F.explode(F.array(*dates)).alias("date")).where("date IS NOT NULL").distinct()
    return bars.join(asked, [ticker, "date"], "left_semi")


def contract_bars(bars: DataFrame, contracts: DataFrame, contract: str = "options_ticker", keep: Sequence[str] = ("expiration", "strike", "right")) -> DataFrame:
    """Second bars of events' contracts on their days, with what the contract is."""
    return bars.join(contracts.select(contract, "date", *keep).dropDuplicates([contract, "date"]), [contract, "date"])


def scan_quotes(quotes: DataFrame, requests: DataFrame, contract: str = "options_ticker") -> tuple[DataFrame, Observation, Observation]:
    """(quotes inside any request's window, rows scanned, rows matched): the pass that reads the quotes fills in both counts.

    ``requests``: contract, quote_date, window_start, window_end.
    """
    scanned, matched = Observation(), Observation()
    # windows of a contract's day that touch become one, and the day's windows one row: a quote meets one row at most
    w = Window.partitionBy("_c", "_d").orderBy("window_start", "window_end")
    asked = requests.select(F.col(contract).alias("_c"), F.col("quote_date").alias("_d"), "window_start", "window_end").where("window_start <= window_end").distinct()
    reach = asked.withColumn("_reach", F.max("window_end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    island = F.sum(F.when(F.col("window_start") <= F.col("_reach"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    merged = reach.withColumn("_i", island).groupBy("_c", "_d", "_i").agg(F.min("window_start").alias("a"), F.max("window_end").alias("b"))
    days = merged.groupBy("_c", "_d").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("_w"))
    same = (F.col(contract) == F.col("_c")) & (F.col("quote_date") == F.col("_d"))
    within = F.exists("_w", lambda x: (F.col("ts") >= x["a"]) & (F.col("ts") <= x["b"]))
    met = quotes.observe(scanned, F.count("*").alias("rows")).join(days, same).where(within).select(*[quotes[c] for c in quotes.columns])
    return met.observe(matched, F.count("*").alias("rows")), scanned, matched
