"""Sharding by a hierarchical weighted hash tree (region, rack, shard).

A row descends the tree; at each level every child draws ``-ln(u) / weight`` with u hashed from the row's key
and the child's name, and the smallest draw wins (weighted rendezvous). Raising a child's weight, or adding a
child, therefore moves rows only into that child, and no row between two others: movement is confined to the
subtree whose weight changed. ``grow`` adds capacity as a new region, so that the root is the only level where
weights change and every moved row ends in the new shard.

Law of the result: ``key`` (the key and the tree decide; texts play no part). Everything is Spark expressions;
no Python runs on executors.

Defined results: a null key draws by the names alone (all such rows share a shard); null and empty texts have
size 1 and crc32 0; equal rows share a shard and get different slots; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hash_buckets, table

#: region -> rack -> shard -> weight
Tree = dict[str, dict[str, dict[int, float]]]

EIGHT: Tree = {f"region{r}": {f"rack{r}{k}": {4 * r + 2 * k + s: 1.0 for s in range(2)} for k in range(2)} for r in range(2)}
ROWS_PER_BUCKET = 4000


def weight(node) -> float:
    return sum(map(weight, node.values())) if isinstance(node, dict) else float(node)


def grow(tree: Tree, shard: int, shard_weight: float = 1.0) -> Tree:
    """The tree with one more shard, in a region of its own."""
    return tree | {f"region+{shard}": {f"rack+{shard}": {shard: shard_weight}}}


def _draw(key: Column, name: str, w: float) -> Column:
    unit = (F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11).cast("double") + 0.5) / F.lit(float(2**53))
    return -F.ln(unit) / F.lit(w)


def descend(key: Column, node, path: str = "") -> Column:
    """The leaf that ``key`` reaches below ``node``."""
    if not isinstance(node, dict):
        return F.lit(int(path.rsplit("/", 1)[1]))
    names = [n for n in node if weight(node[n]) > 0]
    if not names:
        raise ValueError("a subtree without weight can't take rows")
    below = [descend(key, node[n], f"{path}/{n}") for n in names]
    if len(names) == 1:
        return below[0]
    draws = [F.struct(_draw(key, f"{path}/{n}", weight(node[n])).alias("draw"), F.lit(i).alias("i")) for i, n in enumerate(names)]
    won = F.array_min(F.array(*draws))["i"]
    return F.element_at(F.array(*below), won + 1)


def shard(docs: DataFrame, tree: Tree, grown: Tree, id_col: str = "doc_id", text_col: str = "text", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard; slots number each shard's rows from 0 without gaps.

    Slots come from counts per (shard, hash bucket) plus a rank inside the bucket: no task sorts a whole shard.
    """
    key, text = F.col(id_col), F.col(text_col)
    rows = docs.select(
        key.alias(id_col),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    n = hash_buckets(docs.count(), rows_per_bucket)
    placed = lambda df: df.withColumn("shard", descend(F.col(id_col), tree)).withColumn("_bucket", F.pmod(F.xxhash64(F.col(id_col), F.lit("slot")), F.lit(n)))
    counts = placed(docs.select(key.alias(id_col))).groupBy("shard", "_bucket").count()
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy(id_col, "text_crc32", "size"))
    return (
        placed(rows)
        .withColumn("_inside", inside)
        .join(starts, ["shard", "_bucket"])
        .select(id_col, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_start") + F.col("_inside") - 1).alias("slot"), descend(F.col(id_col), grown).alias("grown_shard"))
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), EIGHT, grow(EIGHT, 8))
