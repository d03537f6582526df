"""Readers, writers and normalisers: schema given or Parquet, timestamps without zone read as UTC, NaN as null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.functions.numbers import finite

#: Option symbols: O:ROOT, then yymmdd, C or P, strike in thousandths on eight digits.
OPTION_SYMBOL = r"^O:([A-Z.]+)(\d{2})(\d{2})(\d{2})([CP])(\d{8})$"


def read_table(spark: SparkSession, path: str, schema: str | None = None, where: Column | None = None) -> DataFrame:
    """Parquet or CSV by suffix; CSV needs its schema, so nothing is inferred by an extra pass.

    ``where`` is a filter on columns as they are stored: it reaches the scan, which one put on the cleaned columns can't (their
    cleaning stands in between). It is applied again afterwards, as NaN is above every number where it is stored.
    """
    csv = path.endswith((".csv", ".csv.gz"))
    raw = spark.read.csv(path, header=True, schema=schema) if csv else spark.read.parquet(path)
    return cleaned(raw) if where is None else cleaned(raw.where(where)).where(where)


def write_table(df: DataFrame, path: str) -> None:
    """Parquet or CSV (with a header) by suffix; the path is a folder of part files. In CSV an empty text is read back as null."""
    if path.endswith((".csv", ".csv.gz")):
        df.write.mode("overwrite").option("compression", "gzip" if path.endswith(".gz") else "none").csv(path, header=True)
    else:
        df.write.mode("overwrite").parquet(path)


def write_partitions(df: DataFrame, path: str, by: str = "date") -> None:
    """Overwrites just the partitions that ``df`` holds, so that a rerun of a day is idempotent."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def cleaned(df: DataFrame) -> DataFrame:
    """Timestamps without zone as UTC instants; NaN and infinities, which mean missing here, as null."""
    kind = lambda f: f.dataType.simpleString()
    made = lambda f: F.col(f.name).cast("timestamp") if kind(f) == "timestamp_ntz" else finite(F.col(f.name)) if kind(f) in ("double", "float") else F.col(f.name)
    return df.select(*[made(f).alias(f.name) for f in df.schema])


def first_of(df: DataFrame, *names: str) -> Column:
    """The first of these columns that the table has (aliases of one field)."""
    for n in names:
        if n in df.columns:
            return F.col(n)
    raise ValueError(f"none of {names} in {df.columns}")


def epoch_timestamp(c: Column) -> Column:
    """Timestamp of an epoch number whose unit (s, ms, us, ns) is told by its magnitude; digits below a microsecond go."""
    n = c.cast("long")
    micros = F.floor(n.cast("decimal(20,0)") / 1000).cast("long")
    return F.when(n > 10**17, F.timestamp_micros(micros)).when(n > 10**14, F.timestamp_micros(n)).when(n > 10**11, F.timestamp_millis(n)).otherwise(F.timestamp_seconds(c.cast("double")))


def parse_option_symbol(df: DataFrame, symbol: str) -> DataFrame:
    """Adds underlying, expiration, right and strike; rows that don't parse get nulls."""
    part = lambda i: F.nullif(F.regexp_extract(symbol, OPTION_SYMBOL, i), F.lit(""))
    day = F.concat_ws("-", F.concat(F.lit("20"), part(2)), part(3), part(4))
    return df.withColumns({"underlying": part(1), "expiration": F.when(part(2).isNotNull(), F.try_to_date(day, "yyyy-MM-dd")), "right": F.when(part(5) == "C", "call").when(part(5) == "P", "put"), "strike": part(6).cast("double") / 1000.0})


def normalise_quotes(quotes: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """options_ticker, quote_date (in New York), ts, bid, ask, mid, spread, spread_over_mid from raw quotes under any of their known names.

    A SIP instant is a whole number whose unit its magnitude tells, or a text. A spread over a mid of 0 is missing.
    """
    bid, ask = finite(first_of(quotes, "bid_price", "bid").try_cast("double")), finite(first_of(quotes, "ask_price", "ask").try_cast("double"))
    kind = dict(quotes.dtypes).get("sip_timestamp", "")
    raw = first_of(quotes, "sip_timestamp", "quote_timestamp", "timestamp", "quote_timestamp_et")
    at = epoch_timestamp(raw) if kind in ("int", "bigint", "double") else F.coalesce(epoch_timestamp(raw.try_cast("double")), F.try_to_timestamp(raw)) if kind == "string" else raw.cast("timestamp")
    mid = (bid + ask) / 2
    day = F.col("quote_date").cast("date") if "quote_date" in quotes.columns else F.to_date(F.from_utc_timestamp(at, "America/New_York"))
    return quotes.select(first_of(quotes, "ticker", "options_ticker").alias("options_ticker"), *keep, day.alias("quote_date"), at.alias("ts"), bid.alias("bid"), ask.alias("ask"), mid.alias("mid"), (ask - bid).alias("spread"), ((ask - bid) / F.nullif(mid, F.lit(0.0))).alias("spread_over_mid"))


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the last in ``order`` (which should be total)."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def union_sources(frames: Sequence[DataFrame], keys: Sequence[str], tie: Sequence[Column]) -> DataFrame:
    """Union by name, missing columns as null; of equal keys the row of the last frame stays."""
    out = None
    for i, f in enumerate(frames):
        f = f.withColumn("_source", F.lit(i))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return keep_last(out, keys, [F.desc("_source"), *tie]).drop("_source")


def explode_parallel(df: DataFrame, json_col: str, fields: dict[str, str], keep: Sequence[str]) -> DataFrame:
    """Rows of a JSON object of parallel arrays: one row per position."""
    schema = ", ".join(f"{n}: array<{t}>" for n, t in fields.items())
    parsed = df.select(*keep, F.from_json(json_col, f"struct<{schema}>").alias("_j"))
    return parsed.select(*keep, F.inline(F.arrays_zip(*[F.col(f"_j.{n}").alias(n) for n in fields])))
