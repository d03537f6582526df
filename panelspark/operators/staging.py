"""Intermediate tables in the folder that driver and executors share, and sums along an order over all partitions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset a temporary one, which only a local master can use."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="spark-"))
    return _own_folder[0]


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage is cut, and what several plans read runs once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts_for(spark: SparkSession, rows: int, most: int) -> int:
    """Into how many parts so many rows are dealt, for ``most`` in a part (if their keys allow it), and no fewer than Spark's own number."""
    return max(rows // most + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread_in_order(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``df`` range-partitioned by group and order, with _group (its group as one value, null being one) and _part.

    Partitions follow each other in the order, and rows keep theirs when they are read again, as it is written down.
    """
    own = F.struct(F.lit(0).alias("all"), *by)
    return materialise(df.withColumn("_group", own).repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), "in-order")


def running_sum(df: DataFrame, by: Sequence[str], order: Sequence[Column], add: Column, name: str, whole: dict[str, tuple[Callable, Column]] | None = None) -> DataFrame:
    """Adds ``name``: the sum of ``add`` over the rows of the same group that come before in the given total order.

    ``whole``: names and (function, column) pairs, sums, minima or maxima of the whole group, which are added too; they come
    with the partitions' sums, so no join gathers a group in a task.

    Sums inside a range partition are windows, and only one sum for each (group, partition) goes through a window over
    partitions. A group of any size spreads over many tasks. Rows are sorted by group and partition already, so starts are merged
    in; left alone, Spark broadcasts the rows where their file is small, as files of ordered rows are.
    """
    rows = spread_in_order(df.withColumn("_add", add), by, order)
    whole, group = whole or {}, Window.partitionBy("_group")
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("_group", "_part").agg(F.sum("_add").alias("_s"), *[f(c).alias(n) for n, (f, c) in whole.items()])
    starts = sums.select("_group", "_part", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_start"), *[f(n).over(group).alias(n) for n, (f, _) in whole.items()])
    inside = Window.partitionBy("_group", "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_in", F.coalesce(F.sum("_add").over(inside), F.lit(0))).join(starts.hint("merge"), ["_group", "_part"]).withColumn(name, F.col("_start") + F.col("_in")).drop("_group", "_part", "_start", "_in", "_add")
