"""What several operators share: intermediate tables, ranks over range partitions, and components."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.operators.staging import materialise, shared_folder  # noqa: F401  (the operators take them from here)

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash_buckets(rows: int, rows_per_bucket: int, least: int = 64) -> int:
    """Number of hash buckets so that each holds about ``rows_per_bucket`` rows, at any input size."""
    return max(least, math.ceil(rows / rows_per_bucket))


def ranked(df: DataFrame, order: Sequence[Column], name: str, tag: str) -> DataFrame:
    """Adds ``name``: the 0-based place of each row in the given total order.

    Rows are range-partitioned and ranked inside their partition; only one count per partition is summed
    across partitions, so no task sees all rows.
    """
    spread = materialise(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), tag)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = spread.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return spread.withColumn("_inside", inside).join(starts, "_part").withColumn(name, F.col("_start") + F.col("_inside")).drop("_part", "_start", "_inside")


def components(edges: DataFrame, tag: str) -> DataFrame:
    """Connected components of ``edges`` (a, b: long) as (node, root), one row per node with an edge.

    Each round every node moves to the neighbour (or itself) that a hash of the round ranks first, and the
    edges follow; a constant share of the nodes disappears each round, so rounds grow with the logarithm of
    the graph. Rounds' moves are tables, which the nodes follow one after another in the end; neither edges nor
    labels reach the driver.
    """
    edges = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{tag}-edges")
    turns: list[DataFrame] = []
    for turn in range(200):
        if edges.isEmpty():
            break
        ends = F.explode(F.array(F.struct(F.col("a").alias("at"), F.col("b").alias("to")), F.struct(F.col("b").alias("at"), F.col("a").alias("to")))).alias("e")
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("to"))
        both = edges.select(ends).select("e.*")
        moves = both.groupBy("at").agg(F.min(rank("to")).alias("n")).select("at", F.least("n", rank("at"))["to"].alias("to"))
        turns.append(materialise(moves, f"{tag}-moves"))
        by = lambda c: turns[-1].select(F.col("at").alias(c), F.col("to").alias(f"{c}2"))
        moved = edges.join(by("a"), "a").join(by("b"), "b").where("a2 <> b2")
        edges = materialise(moved.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), f"{tag}-edges")
    else:
        raise RuntimeError("components did not converge")
    if not turns:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    # from the last round back: where a node of that round ends up
    label = turns[-1]
    for moves in reversed(turns[:-1]):
        then = label.select(F.col("at").alias("to"), F.col("to").alias("end"))
        label = moves.join(then, "to", "left").select("at", F.coalesce("end", "to").alias("to"))
    return materialise(label.select(F.col("at").alias("node"), F.col("to").alias("root")), f"{tag}-roots")
