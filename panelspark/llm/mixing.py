"""Mixing sources to target weights by a low-discrepancy schedule.

Slots 0, 1, 2, ... are mapped by their golden-ratio points through the cumulative shares of the slots that each
source's target takes; a slot's rank among its source's slots names the equal-token block it takes of that
source's shuffled token stream (documents in hash order, end to end). A source's blocks are equal parts of it, of
at most the common block size, so that the smallest source has one, too. A source with more slots than blocks is
read again from its start, at most to the given number of passes. Every prefix of the schedule is thus near the
target mix, and all of it takes each source's target, rounded to a whole word.

Nothing here depends on how many documents or tokens a source holds: stream positions and slot ranks are sums
over hash buckets or slot chunks plus ranks inside them, points find their source through a grid of cells
(equi-join, then an exact range test), and blocks join slots on (source, block).

Defined results: null text and text of white space have size 0 and are never taken; null is a source of its
own, after all others; repeated rows are separate documents; sources whose texts are all empty have target 0;
an empty table gives no rows. Document ids may repeat or be null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hash_buckets, materialise, ranked, table

WORD = r"[^\x20\x09-\x0D]+"
GOLDEN = 0.6180339887498949
WEIGHTS = (5.0, 2.0, 1.0)
TOTAL_SHARE = 1.5
MOST_PASSES = 2
#: Least number of cells that points find their source through.
CELLS = 1 << 10
#: Least number of slots, and slots for each source on average at least; a block holds at most total / slots tokens.
SLOTS, SLOTS_PER_SOURCE = 1 << 18, 1 << 10
CHUNK = 1 << 11
ROWS_PER_BUCKET = 2000
#: Sources up to this many are broadcast to the rows.
FEW_SOURCES = 50_000


def targets(sizes: DataFrame, weights: Sequence[float], total_share: float, most_passes: int) -> DataFrame:
    """Per source (s_key, s_null): source_size, place, target and cum, the targets before it.

    Targets are shares of total_share x all sizes by weight, at most most_passes x the source's size; what is
    cut off is shared again among the others by weight. Each turn of the loop is one sum over the sources.
    """
    src = sizes.groupBy("s_key", "s_null").agg(F.sum("size").alias("source_size"))
    src = materialise(ranked(src, [F.col("s_null"), F.col("s_key")], "place", "mix-place"), "mix-sources")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    src, cap = src.withColumn("w", w), F.col("source_size") * float(most_passes)
    total = total_share * (src.agg(F.sum("source_size")).head()[0] or 0)
    level = 0.0
    while total:
        full = cap <= F.lit(level) * F.col("w")
        capped, rest = src.agg(F.sum(F.when(full, cap).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("w")))).head()
        if not rest or (total - capped) / rest <= level:
            break
        level = (total - capped) / rest
    src = src.withColumn("target", F.least(cap, F.lit(level) * F.col("w")))
    return materialise(running_sum(src, "target", "cum", 0.0), "mix-targets")


def running_sum(src: DataFrame, of: str, name: str, zero: float) -> DataFrame:
    """Adds ``name``: the sum of ``of`` over the sources before, in the order of place."""
    # running sums over chunks of places, then inside a chunk
    src = src.withColumn("_chunk", F.floor(F.col("place") / 10_000))
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = src.groupBy("_chunk").agg(F.sum(of).alias("t")).select("_chunk", F.coalesce(F.sum("t").over(before), F.lit(zero)).alias("_start"))
    inside = Window.partitionBy("_chunk").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    out = src.withColumn("_in", F.coalesce(F.sum(of).over(inside), F.lit(zero))).join(starts, "_chunk")
    return out.withColumn(name, F.col("_start") + F.col("_in")).drop("_start", "_in", "_chunk")


def own_block(block: int) -> Column:
    """Tokens in a block of a source: its size in equal parts of at most ``block`` tokens (1 for an empty source)."""
    return F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.ceil(F.col("source_size") / block))).cast("long")


def schedule(src: DataFrame, slots: int, _total: float, block: int, most_passes: int) -> DataFrame:
    """The slots: slot, place (of its source), rank, pass, block, lo, hi (stream positions it takes, from the pass's start).

    Each source gets as many slots as its target takes of its own blocks, and golden-ratio points fall to the sources
    in proportion to that. At least ``slots`` points are drawn; where they leave a source short of its slots (by few,
    as the points are spread evenly), the missing ones follow after the last point.
    """
    spark = src.sparkSession
    goal = F.least(F.round("target").cast("long"), F.col("source_size") * most_passes)
    size = F.col("source_size")
    src = src.select("place", "source_size", goal.alias("goal"), own_block(block).alias("own")).where("goal > 0").withColumn("blocks", F.ceil(size / F.col("own")))
    needed = F.floor(F.col("goal") / size) * F.col("blocks") + F.ceil((F.col("goal") % size) / F.col("own"))
    src = materialise(running_sum(src.withColumn("needed", needed), "needed", "cum", 0), "mix-needed")
    wanted = src.agg(F.sum("needed")).head()[0] or 0
    drawn = max(slots, wanted)
    share = src.select("place", (F.col("cum") / wanted).alias("lo_p"), ((F.col("cum") + F.col("needed")) / wanted).alias("hi_p"))
    # as many cells as sources at least, so that a cell meets few of them
    n_cells = max(CELLS, src.count())
    cells = share.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo_p") * n_cells), F.least(F.floor(F.col("hi_p") * n_cells), F.lit(n_cells - 1)))))
    x = F.col("slot") * GOLDEN + 0.5
    point = (x - F.floor(x)).alias("point")
    points = spark.range(drawn).select(F.col("id").alias("slot"), F.col("id")).select("slot", point).withColumn("cell", F.least(F.floor(F.col("point") * n_cells), F.lit(n_cells - 1)))
    # the last interval ends at 1 but for rounding
    own = points.join(cells, "cell").where((F.col("point") >= F.col("lo_p")) & (F.col("point") < F.col("hi_p"))).select("slot", "place")
    own = materialise(own.withColumn("chunk", F.floor(F.col("slot") / CHUNK)), "mix-slots")
    before = Window.partitionBy("place").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = own.groupBy("place", "chunk").count().select("place", "chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    met = own.withColumn("_in", F.row_number().over(Window.partitionBy("place", "chunk").orderBy("slot")) - 1).join(starts, ["place", "chunk"])
    met = met.select("slot", "place", (F.col("_start") + F.col("_in")).alias("rank"))
    short = src.join(own.groupBy("place").count(), "place", "left").withColumn("count", F.coalesce("count", F.lit(0))).where(F.col("count") < F.col("needed"))
    short = short.select("place", F.explode(F.sequence("count", F.col("needed") - 1)).alias("rank"))
    late = ranked(short, [F.col("rank"), F.col("place")], "late", "mix-late").select((F.col("late") + drawn).alias("slot"), "place", "rank")
    out = met.unionByName(late).join(src.select("place", "source_size", "goal", "own", "blocks", "needed"), "place").where(F.col("rank") < F.col("needed"))
    out = out.withColumn("pass", F.floor(F.col("rank") / F.col("blocks"))).withColumn("block", F.col("rank") % F.col("blocks"))
    lo = F.col("block") * F.col("own")
    out = out.withColumn("lo", lo).withColumn("hi", F.least(lo + F.col("own"), size, F.col("goal") - F.col("pass") * size))
    return out.where("hi > lo").select("slot", "place", "rank", "pass", "block", "lo", "hi")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, total_share: float = TOTAL_SHARE, most_passes: int = MOST_PASSES, seed: int = 17, least_slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces).

    documents: one row per input row: place, start (in its source's stream; with place the row's key where
    size > 0), id, size, source_size, target and the columns in ``keep``. pieces: place, start, pass, lo, hi:
    words [lo, hi) of that document that a slot takes.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    source = F.col(source_col).cast("string")
    order = F.xxhash64(F.col(id_col), F.lit(seed))
    rows = docs.select(F.col(id_col), size.alias("size"), F.coalesce(source, F.lit("")).alias("s_key"), source.isNull().alias("s_null"), order.alias("h"), *keep)
    rows = materialise(rows, "mix-sizes")
    src = targets(rows, weights, total_share, most_passes)
    total = float(src.agg(F.sum("target")).head()[0] or 0.0)
    n_rows, n_src = rows.count(), src.count()
    slots = max(least_slots, SLOTS_PER_SOURCE * n_src)
    block = max(1, -(-int(total) // slots))
    slots = -(-int(total) // block)

    small = src.select("s_key", "s_null", "place", "source_size", "target")
    rows = rows.join(F.broadcast(small) if n_src <= FEW_SOURCES else small, ["s_key", "s_null"]).drop("s_key", "s_null")
    rows = rows.withColumn("bucket", F.pmod(F.col("h"), F.lit(hash_buckets(n_rows, ROWS_PER_BUCKET))))
    before = Window.partitionBy("place").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("place", "bucket").agg(F.sum("size").alias("s")).select("place", "bucket", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("place", "bucket").orderBy("h", id_col, "size", *keep).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, ["place", "bucket"])
    rows = rows.withColumn("start", F.col("_start") + F.col("_in")).drop("_start", "_in", "bucket", "h")

    full = rows.where("size > 0").select("place", "start", "size", own_block(block).alias("own"))
    first, last = F.floor(F.col("start") / F.col("own")), F.floor((F.col("start") + F.col("size") - 1) / F.col("own"))
    parts = full.withColumn("block", F.explode(F.sequence(first, last)))
    met = parts.join(schedule(src, slots, total, block, most_passes), ["place", "block"])
    lo, hi = F.greatest("lo", "start") - F.col("start"), F.least(F.col("hi"), F.col("start") + F.col("size")) - F.col("start")
    pieces = met.select("place", "start", "pass", lo.alias("lo"), hi.alias("hi")).where("hi > lo")
    return rows, pieces


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, pieces = mix(table(spark, sf_dir, "documents"))
    taken = pieces.groupBy("place", "start").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken")).withColumn("has", F.lit(True))
    out = rows.withColumn("has", F.col("size") > 0).join(taken, ["place", "start", "has"], "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents themselves, with the columns of ``docs``: one row for each pass over a document.

    A pass that takes every word keeps the text as it is; one that takes some (at the cut at the end of a source's share)
    keeps those words, joined by spaces. n_chars, where there is such a column, follows. Documents without words are never
    taken; null is a source of its own; repeated rows are documents of their own; columns may have any names, as rows are
    carried whole; an empty table stays empty.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    # rows that agree in every column are one another's equals: each takes the passes of one of them
    keyed = packed.withColumn("same", F.md5(F.to_json("row").cast("binary")))
    rows, pieces = mix(keyed.select("same", "row.doc_id", "row.text", "row.source"), keep=["same"], **options)
    cuts = pieces.groupBy("place", "start", "pass").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    passes = rows.where("size > 0").join(cuts, ["place", "start"]).select("same", "size", "pass", "lo", "hi")
    mine = F.row_number().over(Window.partitionBy("same").orderBy("same"))
    theirs = F.row_number().over(Window.partitionBy("same", "pass").orderBy("lo", "hi"))
    met = keyed.withColumn("nth", mine).join(passes.withColumn("nth", theirs), ["same", "nth"])
    whole = (F.col("lo") == 0) & (F.col("hi") == F.col("size"))
    words = F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(WORD), F.lit(0)), (F.col("lo") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int")), " ")
    text = F.when(whole, F.col("row.text")).otherwise(words)
    changed = {"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return met.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
