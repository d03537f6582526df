"""Ids of events, contracts of sequences, and hashes of contents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.texts import stripped

# Where an event's date is looked for, first to last, and what a sequence's contract is told by.
DATE_ORDER = ("event_entry_timestamp", "entry_date", "event_date", "announcement_date")
CONTRACT = ("event_id", "ticker", "expiration", "strike", "right", "options_ticker", "option_multiplier")


def date_column(df: DataFrame) -> str:
    """The first of the known date columns that the table has."""
    for name in DATE_ORDER:
        if name in df.columns:
            return name
    raise ValueError(f"none of {DATE_ORDER} in {df.columns}")


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def announced_id(ticker: str = "ticker", date: str = "announcement_date", source: str = "source_id") -> Column:
    """TICKER_DATE_SOURCE, slashes of the source as underscores."""
    return F.concat_ws("_", _text(F.col(ticker)), _text(F.col(date)), F.replace(_text(F.col(source)), F.lit("/"), F.lit("_")))


def with_event_id(df: DataFrame, name: str = "event_id") -> DataFrame:
    """Adds the event's id where there is none: its ticker in capitals and its date (of the first known date column)."""
    if name in df.columns:
        return df
    return df.withColumn(name, F.concat_ws("_", F.upper(F.col("ticker").cast("string")), F.to_date(date_column(df)).cast("string")))


def checked_event_ids(df: DataFrame, name: str = "event_id") -> DataFrame:
    """Events with ids from their ticker and entry date, or their own if they have such a column; those must be there, not empty, and unique.

    Ids are counted in one aggregation, and each row checks its own count: the first bad row ends the job.
    """
    if name not in df.columns:
        return df.withColumn(name, F.concat_ws("_", F.upper(F.col("ticker").cast("string")), F.col("entry_date").cast("string")))
    own = F.coalesce(stripped(F.col(name).cast("string")), F.lit(""))
    twice = df.groupBy(F.col(name).cast("string").alias("_id")).agg(F.count("*").alias("_n")).where("_n > 1")
    met = df.join(twice, F.col(name).cast("string") == F.col("_id"), "left")
    wrong = F.when(own == "", F.raise_error(F.lit("event ids must be there and not empty"))).when(F.col("_n").isNotNull(), F.raise_error(F.concat(F.lit("event ids must be unique: "), own)))
    return met.withColumn(name, F.coalesce(wrong.cast("string"), F.col(name).cast("string"))).drop("_id", "_n")


def sequence_contracts(candidates: DataFrame, events: DataFrame, event: str = "event_id") -> DataFrame:
    """The distinct contracts that sequences of these events are made of: fit for quotes and of 3 to 21 days, where the table says so."""
    out = candidates.join(events.select(event).distinct(), event, "left_semi")
    for flag in ("eligible_for_quote_pool", "is_robustness_dte_3_21"):
        if flag in candidates.columns:
            out = out.where(F.coalesce(F.col(flag).cast("boolean"), F.lit(False)))
    return out.select(*[c for c in CONTRACT if c in candidates.columns]).distinct()


def content_hashes(files: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """path, bytes and the SHA-256 of each file's bytes (a table of files, as ``binaryFile`` reads them)."""
    return files.select(path, F.length(content).cast("long").alias("bytes"), F.sha2(F.col(content), 256).alias("sha256"))


def table_digest(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: rows, and a digest of their contents that no order or partitioning changes; repeated rows count.

    Each row's SHA-256 over its values (nulls apart from empty texts) is cut into eight numbers of 32 bits, and those are summed.
    """
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    part = lambda i: F.conv(F.substring(row, 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")
    sums = df.agg(F.count("*").alias("rows"), *[F.coalesce(F.sum(part(i)), F.lit(0)).alias(f"_{i}") for i in range(8)])
    return sums.select("rows", F.sha2(F.concat_ws(",", "rows", *[F.col(f"_{i}").cast("string") for i in range(8)]), 256).alias("digest"))


def same_parameters(a: Column, b: Column) -> Column:
    """Whether two JSON objects have the same keys (in any order) with the same values; what is no object is never the same."""
    kind = "map<string,string>"
    ordered = lambda c: F.array_sort(F.map_entries(F.from_json(c, kind)))
    return F.coalesce(ordered(a) == ordered(b), F.lit(False))
