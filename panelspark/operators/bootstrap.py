"""Clustered bootstrap of ranking metrics: all draws in one pass over rows that are put in order once.

A draw takes as many clusters as there are, with replacement. How many fall into each bucket of clusters is one multinomial for
all buckets, and each bucket deals its share out among its own clusters, so the weights of a draw sum to the number of
clusters exactly and no task sees more than a bucket. A cluster's weights of all draws are one byte each in one binary value,
which travels with its rows.

Rows are dealt out by range of (group, score) and sorted. A task runs through them and adds up arrays (an item for
each draw): weights of hits and of misses, and of pairs of a hit above a miss. Scores that are equal count half, also where they
go on in the next range: a range hands on the sums of its first and last score apart. So neither draws nor ties
multiply rows, and a group gathers only as a few arrays for each range.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators.staging import materialise

BUCKET = 4096


def cluster_weights(clusters: DataFrame, key: str, draws: int, seed: int = 17, bucket: int = BUCKET) -> DataFrame:
    """key and w: how often each draw takes the cluster, a byte for each draw; over all clusters a draw's sum is their number."""
    keys = materialise(clusters.select(key).where(F.col(key).isNotNull()).distinct(), "clusters")
    n = keys.count()
    parts = max(1, math.ceil(n / bucket))
    placed = keys.withColumn("_b", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(parts)).cast("int"))
    sizes = {r["_b"]: r["count"] for r in placed.groupBy("_b").count().collect()}  # a row for each bucket
    each = np.array([sizes.get(b, 0) for b in range(parts)], float)
    shares = np.random.default_rng(seed).multinomial(n, each / max(1, n), size=draws) if n else np.zeros((draws, parts), int)

    def deal(key_: tuple, own: pa.Table) -> pa.Table:
        b = key_[0].as_py()
        rng = np.random.default_rng([seed, b])
        order = own[key].to_pandas().astype(str).argsort(kind="stable").to_numpy()
        w = rng.multinomial(shares[:, b], np.full(own.num_rows, 1 / own.num_rows)).T
        if w.max(initial=0) > 255:
            raise ValueError("a draw takes a cluster more than 255 times")
        return pa.table({key: own[key].take(pa.array(order)), "w": pa.array([x.astype("u1").tobytes() for x in w], pa.binary())})

    return placed.groupBy("_b").applyInArrow(deal, f"`{key}` {keys.schema[key].dataType.simpleString()}, w binary")


class _Sums:
    """Runs through rows in order of score: sums of a group's part that lie before, at and after its first and last score."""

    def __init__(self, draws: int):
        self.draws, self.parts = draws, []  # parts: (value, hits, misses) of the first and the current score
        self.inner = [np.zeros(draws) for _ in range(3)]  # hits, misses, pairs strictly between

    def add(self, values: np.ndarray, hit: np.ndarray, w: np.ndarray) -> None:
        cuts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
        hits, misses = np.add.reduceat(w * hit[:, None], cuts, 0), np.add.reduceat(w * ~hit[:, None], cuts, 0)
        firsts = values[cuts]
        lo = 0
        if self.parts and self.parts[-1][0] == firsts[0]:
            v, a, b = self.parts[-1]
            self.parts[-1] = (v, a + hits[0], b + misses[0])
            lo = 1
        if lo < len(cuts):
            if len(self.parts) == 2:
                self._close(self.parts.pop())
            if not self.parts:
                self.parts.append((firsts[lo], hits[lo], misses[lo]))
                lo += 1
        if lo < len(cuts):
            h, m = hits[lo:-1], misses[lo:-1]
            if len(h):
                below = self.inner[1] + np.cumsum(m, 0) - m / 2
                self.inner = [self.inner[0] + h.sum(0), self.inner[1] + m.sum(0), self.inner[2] + (h * below).sum(0)]
            self.parts.append((firsts[-1], hits[-1], misses[-1]))

    def _close(self, part: tuple) -> None:
        _, h, m = part
        self.inner = [self.inner[0] + h, self.inner[1] + m, self.inner[2] + h * (self.inner[1] + m / 2)]

    def rows(self) -> list[tuple]:
        """(place, value, hits, misses, pairs): the first score, what lies between, and the last score."""
        none = np.zeros(self.draws)
        out = [(0, *self.parts[0], none), (1, None, *self.inner)]
        return out + [(2, *self.parts[1], none)] if len(self.parts) == 2 else out[:1]


def weighted_auc(rows: DataFrame, by: Sequence[str], score: str, hit: str, w: str, draws: int) -> DataFrame:
    """by and auc: an array with the area under the ROC curve for each draw's weights (null where a class has none)."""
    known = rows.where(F.col(score).isNotNull() & F.col(hit).isNotNull()).select(F.struct(F.lit(0).alias("all"), *by).alias("g"), F.col(score).cast("double").alias("v"), (F.col(hit) > 0).alias("hit"), F.col(w).alias("w"))
    kind = known.schema["g"].dataType.simpleString()
    order = [F.col("g"), F.col("v")]
    spread = known.repartitionByRange(*order).withColumn("part", F.spark_partition_id()).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums, kept = None, None, None

        def out() -> pa.RecordBatch:
            group, part = kept
            own = sums.rows()
            arrays = [pa.array([x[i].tolist() for x in own], pa.list_(pa.float64())) for i in (2, 3, 4)]
            return pa.RecordBatch.from_arrays([pa.concat_arrays([group] * len(own)), pa.array([part] * len(own), pa.int32()), pa.array([x[0] for x in own], pa.int32()), pa.array([x[1] for x in own], pa.float64()), *arrays], ["g", "part", "place", "v", "hits", "misses", "pairs"])

        for b in batches:
            groups = b.column(0).to_pylist()
            starts = [0, *[i for i in range(1, len(groups)) if groups[i] != groups[i - 1]], len(groups)]
            weights = np.frombuffer(b"".join(b.column(3).to_pylist()), "u1").reshape(b.num_rows, draws).astype(float)
            values, hits = b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi in zip(starts, starts[1:]):  # noqa: B905
                if lo == hi:
                    continue
                if sums is None or groups[lo] != now:
                    if sums is not None:
                        yield out()
                    now, sums, kept = groups[lo], _Sums(draws), (b.column(0).slice(lo, 1), b.column(4)[lo].as_py())
                sums.add(values[lo:hi], hits[lo:hi], weights[lo:hi])
        if sums is not None:
            yield out()

    def join(key_: tuple, own: pa.Table) -> pa.Table:
        """A group's parts in order; equal scores at their ends are one score."""
        t = own.sort_by([("part", "ascending"), ("place", "ascending")])
        total_h, total_m, pairs, tie = np.zeros(draws), np.zeros(draws), np.zeros(draws), None
        for v, h, m, p in zip(t["v"].to_pylist(), *[map(np.array, t[c].to_pylist()) for c in ("hits", "misses", "pairs")], strict=True):
            if v is not None and tie is not None and tie[0] == v:
                tie = (v, tie[1] + h, tie[2] + m)
                continue
            if tie is not None:
                pairs, total_h, total_m, tie = pairs + tie[1] * (total_m + tie[2] / 2), total_h + tie[1], total_m + tie[2], None
            if v is None:
                pairs, total_h, total_m = pairs + p + h * total_m, total_h + h, total_m + m
            else:
                tie = (v, h, m)
        if tie is not None:
            pairs, total_h, total_m = pairs + tie[1] * (total_m + tie[2] / 2), total_h + tie[1], total_m + tie[2]
        auc = [x if a > 0 and b > 0 else None for x, a, b in zip((pairs / np.maximum(total_h * total_m, 1)).tolist(), total_h, total_m, strict=True)]
        return pa.table({"g": own["g"].slice(0, 1), "auc": pa.array([auc], pa.list_(pa.float64()))})

    sums = spread.select("g", "v", "hit", "w", "part").mapInArrow(run, f"g {kind}, part int, place int, v double, hits array<double>, misses array<double>, pairs array<double>")
    # an array of draws or two for each range of a group
    return sums.groupBy("g").applyInArrow(join, f"g {kind}, auc array<double>").select(*[F.col(f"g.{c}").alias(c) for c in by], "auc")
