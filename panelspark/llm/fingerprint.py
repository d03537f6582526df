"""Document fingerprints by a quartile bucket digest.

Every window of five bytes gives six byte triplets that hold the window's first byte; each is hashed into one
of 256 buckets and counted. The digest is: the length on a logarithmic scale, two ratios of the counts'
quartiles, and for each bucket the quartile that its count falls in (two bits), as hexadecimal text. Two digests
differ by a bounded score: the circular distance of lengths, of ratios, and per bucket 0, 1, 2 or 6 for quartiles
that are 0, 1, 2 or 3 apart; ``likeness`` maps it to 1 (same digest) down to 0.

``compare_with_next`` pairs every row with the next one by id without a window over all rows: rows are range-partitioned
and read in order, and each partition hands on its first and its last row, which meet in a join on the partition's number.
The whole text crosses one shuffle. Nothing about the ranges reaches the driver or the plan.

Defined results: null text is the empty text; texts of fewer than five bytes have no triplets and their digest
holds the length and bucket 0's quartile everywhere, so equal texts still agree and different short ones differ
by length only; rows of equal id are ordered by a hash of their text, null ids come first; a single row is its own next row; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

BUCKETS = 256
#: Of the six triplets in a window: the places of the other two bytes, and a salt each.
TRIPLETS = ((1, 2, 2), (1, 3, 3), (2, 3, 5), (2, 4, 7), (1, 4, 11), (3, 4, 13))
#: Differences at which likeness reaches 0; unrelated texts lie about here or beyond.
FAR = 300.0
ROWS_PER_RANGE = 4000
CHUNK = 1 << 20


def bucket_counts(data: bytes) -> np.ndarray:
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, max(0, len(data) - 4), CHUNK):
        x = np.frombuffer(data, np.uint8, min(CHUNK + 4, len(data) - at), at).astype(np.uint32)
        n = len(x) - 4
        for i, j, salt in TRIPLETS:
            h = (x[:n] + x[i : i + n] * np.uint32(257) + x[j : j + n] * np.uint32(65537) + np.uint32(salt)) * np.uint32(2654435761)
            counts += np.bincount(h >> np.uint32(24), minlength=BUCKETS)
    return counts


def fingerprint(data: bytes) -> str:
    counts = bucket_counts(data)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]].tolist()
    length = min(255, int(math.log(len(data) + 1) / math.log(1.1)))
    ratios = (q1 * 16 // max(q3, 1) % 16) << 4 | q2 * 16 // max(q3, 1) % 16
    quartiles = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    packed = quartiles[0::4] | quartiles[1::4] << 2 | quartiles[2::4] << 4 | quartiles[3::4] << 6
    return f"{length:02x}{ratios:02x}{packed.astype(np.uint8).tobytes().hex()}"


_COST = np.array([[sum((0, 1, 2, 6)[abs((a >> s & 3) - (b >> s & 3))] for s in (0, 2, 4, 6)) for b in range(256)] for a in range(256)], np.int64)


def difference(a: str, b: str) -> int:
    """The bounded difference score of two digests (0: the same)."""
    x, y = bytes.fromhex(a), bytes.fromhex(b)
    around = lambda p, q, n: min((p - q) % n, (q - p) % n)
    step = lambda d: d if d <= 1 else (d - 1) * 12
    score = min(step(around(x[0], y[0], 256)), 120) + step(around(x[1] >> 4, y[1] >> 4, 16)) + step(around(x[1] & 15, y[1] & 15, 16))
    return score + int(_COST[np.frombuffer(x, np.uint8, offset=2), np.frombuffer(y, np.uint8, offset=2)].sum())


def likeness(a: str, b: str) -> float:
    return max(0.0, 1.0 - difference(a, b) / FAR)


def edited(text: str, following: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _compared(i: int | None, text: str, own: str, following: str, other: str) -> tuple:
    """The result's row of a text (with its fingerprint) that is followed by another."""
    e = edited(text, following).encode("utf-8", "surrogatepass")
    changed = fingerprint(e)
    return i, len(text), hashlib.sha256(e).hexdigest(), own, changed, likeness(own, changed), likeness(own, other)


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
_SCHEMA = pa.schema([pa.field(n, t) for n, t in zip(_NAMES, _TYPES)])
_EDGES = pa.schema([*_SCHEMA, pa.field("part", pa.int32()), pa.field("side", pa.string()), pa.field("text", pa.string())])
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition's rows (part, id, text, in order) the results of all but the last; its first and last row with their texts."""
    held, part = None, None
    names = _EDGES.names
    for b in batches:
        out = []
        for part, i, text in zip(*(b.column(k).to_pylist() for k in range(3))):
            own = fingerprint(text.encode("utf-8", "surrogatepass"))
            if held:
                out.append((*_compared(*held, text, own), part, None, None))
            else:
                out.append((i, None, None, own, None, None, None, part, "first", text))
            held = (i, text, own)
        yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in out], schema=_EDGES)
    if held:
        i, text, own = held
        yield pa.RecordBatch.from_pylist([dict(zip(names, (i, None, None, own, None, None, None, part, "last", text)))], schema=_EDGES)


def _at_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, _compared(*r))) for r in zip(*(b.column(k).to_pylist() for k in range(5)))], schema=_SCHEMA)


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Per row: id, n_chars, the fingerprints of its text and its edited text, and how alike they and the next row's are."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    order = [F.col("id").asc_nulls_first(), F.col("tie")]
    parts = max(1, math.ceil(docs.count() / rows_per_range))
    spread = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order, "text").select(F.spark_partition_id().alias("part"), "id", "text")
    done = materialise(spread.mapInArrow(_in_order, f"{RESULT}, part int, side string, text string"), "fingerprints")
    # of each partition's two rows: the last is followed by the first of the next partition that has rows (after the last: the first)
    edge = lambda side: done.where(F.col("side") == side).select("part", F.col("doc_id").alias("id"), "text", F.col("fingerprint").alias("fp"))
    numbers = done.where("side = 'first'").select("part")  # a number for each partition
    following = F.coalesce(F.lead("part").over(Window.orderBy("part")), F.first("part").over(Window.orderBy("part")))
    nexts = numbers.select("part", following.alias("after"))
    firsts = edge("first").select(F.col("part").alias("after"), F.col("text").alias("following"), F.col("fp").alias("other"))
    last = edge("last").join(nexts, "part").join(firsts, "after").select("id", "text", "fp", "following", "other")
    names = [F.col(n).alias(id_col if n == "doc_id" else n) for n in _NAMES]
    return done.where("side IS NULL").select(*_NAMES).unionByName(last.mapInArrow(_at_edges, RESULT)).select(*names)


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))
