"""Approximate nearest neighbours: a forest of random-projection trees with a shared priority queue.

Trees are grown on a bounded sample of distinct vectors: a node splits its points at the median of their
projections on the difference of two random points. Every distinct vector is then indexed in one leaf of each
tree. A query walks all trees with one priority queue, ordered by the smallest margin on the way, until it has
taken a number of leaves; the vectors of those leaves are ranked by exact distance. By default that number is the
share ``SHARE`` of one tree's leaves, so a query computes at most that share of the distances of an exact search
(some of them twice, where two trees bring the same vector), or as many leaves as hold ``TAKEN`` vectors, if that is more.
Vectors without clusters need a share as wide as this for a recall over 0.9 (figures in the README); a fixed number of
leaves makes the work linear.

Leaves are dealt out to groups of about GROUP rows; a leaf with more vectors or queries than MOST_IN_LEAF is cut into
parts, each part of its queries meeting each part of its vectors, so that no task holds more. A group returns the
best few of each of its queries only.

Equal vectors are one entry that carries its k + 1 smallest ids (exact for any query, as ties go to smaller
ids), so a vector that a third of the rows share is no hot leaf. The sample grows with the rows up to SAMPLE, and
leaves with it; with more rows leaves grow and are cut into parts.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, as query or
candidate, nor do vectors of another length than the most common; a row whose id is null takes no part;
repeated rows (id and vector) count once; fewer candidates than k give fewer rows; an empty table gives none.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

K, TREES, LEAF, SHARE, SAMPLE, SALTS = 10, 16, 32, 0.6, 1 << 15, 16
TAKEN, GROUP, MOST_IN_LEAF = 2000, 20_000, 4096


class Forest:
    def __init__(self, points: np.ndarray, trees: int, leaf: int, seed: int = 3):
        self.normal, self.cut, self.left, self.right, self.roots, self.leaves = [], [], [], [], [], 0
        rng = np.random.default_rng(seed)
        for _ in range(trees):
            self.roots.append(self._grow(points, np.arange(len(points)), leaf, rng))
        self.normal, self.cut = np.array(self.normal).reshape(len(self.cut), points.shape[1] if points.ndim == 2 else 0), np.array(self.cut)
        self.left, self.right = np.array(self.left, np.int64), np.array(self.right, np.int64)

    def _grow(self, points, own, leaf, rng) -> int:
        """The node's number; leaves are numbered below zero."""
        if len(own) > leaf:
            for _ in range(5):
                a, b = points[rng.choice(own, 2, replace=False)]
                normal = (a - b) / (np.linalg.norm(a - b) or 1.0)
                at = points[own] @ normal
                cut = float(np.median(at))
                right = at > cut
                if 0 < right.sum() < len(own):
                    node = len(self.cut)
                    self.normal.append(normal), self.cut.append(cut), self.left.append(0), self.right.append(0)
                    self.left[node] = self._grow(points, own[~right], leaf, rng)
                    self.right[node] = self._grow(points, own[right], leaf, rng)
                    return node
        self.leaves += 1
        return -self.leaves

    def place(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point in each tree."""
        out = np.empty((len(points), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            at = np.full(len(points), root, np.int64)
            while (open_ := np.flatnonzero(at >= 0)).size:
                node = at[open_]
                right = np.einsum("ij,ij->i", points[open_], self.normal[node]) > self.cut[node]
                at[open_] = np.where(right, self.right[node], self.left[node])
            out[:, t] = at
        return out

    def search(self, point: np.ndarray, leaves: int) -> list[int]:
        """The first leaves that a queue shared by all trees comes to."""
        margin = self.normal @ point - self.cut if len(self.cut) else np.zeros(0)
        queue, out = [(0.0, i, root) for i, root in enumerate(self.roots)], []
        heapq.heapify(queue)
        order = len(queue)
        while queue and len(out) < leaves:
            far, _, node = heapq.heappop(queue)
            while node >= 0:
                m = margin[node]
                near, other = (self.right[node], self.left[node]) if m > 0 else (self.left[node], self.right[node])
                heapq.heappush(queue, (max(far, abs(m)), order, int(other)))
                order += 1
                node = int(near)
            out.append(node)
        return out


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v (doubles) of the rows that take part."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    ok = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(F.coalesce(ok, F.lit(False)))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").head()
    return rows.where(F.size("v") == (common["n"] if common else 0))


def distinct_vectors(rows: DataFrame, ids: int) -> DataFrame:
    """cid (the smallest id), v, ids (the smallest, at most ``ids``): equal vectors as one, thinned in two steps."""
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS))
    some = rows.distinct().withColumn("salt", salt).withColumn("r", F.row_number().over(Window.partitionBy("v", "salt").orderBy("id"))).where(F.col("r") <= ids)
    one = some.groupBy("v").agg(F.slice(F.sort_array(F.collect_list("id")), 1, ids).alias("ids"))
    return one.select(F.col("ids")[0].alias("cid"), "v", "ids")


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(rows, -1) if rows else np.zeros((0, 1))


def sample_of(entries: DataFrame, n: int, sample: int) -> np.ndarray:
    """At most about ``sample`` of the distinct vectors, in the order of their smallest ids."""
    unit = F.shiftrightunsigned(F.xxhash64("cid", F.lit(9)), 11) / float(2**53)
    part = entries.where(unit <= min(1.0, sample / max(1, n))).select("cid", "v").limit(2 * sample).toPandas().sort_values("cid")
    return np.array(part["v"].tolist(), np.float64) if len(part) else np.zeros((0, 1))


def grown(points: np.ndarray, n: int, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE) -> tuple[Forest, int]:
    """The forest for ``n`` distinct vectors, and how many of its leaves a query takes."""
    forest = Forest(points, trees, max(4, round(leaf * min(1.0, sample / max(1, n)))))
    in_leaf = max(1.0, n * trees / forest.leaves)
    return forest, min(forest.leaves, max(round(SHARE * forest.leaves / trees), math.ceil(TAKEN / in_leaf)))


def search(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = TREES, leaf: int = LEAF, leaves: int | None = None, sample: int = SAMPLE, most_in_leaf: int = MOST_IN_LEAF) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found to each row for which ``is_query`` (of id) holds."""
    rows = materialise(valid(vectors, id_col, vector_col), "ann-rows")
    entries = materialise(distinct_vectors(rows, k + 1), "ann-entries")
    n = entries.count()
    spark = vectors.sparkSession
    made, taken = grown(sample_of(entries, n, sample), n, trees, leaf, sample)
    taken = leaves or taken
    forest = spark.sparkContext.broadcast(made)  # grown on the sample, so as large as that at most

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = forest.value.place(_matrix(b.column(1), b.num_rows))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(at), pa.list_(pa.int64()))], names=["cid", "v", "leaves"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [forest.value.search(p, taken) for p in _matrix(b.column(1), b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at, pa.list_(pa.int64()))], names=["cid", "v", "leaves"])

    schema = "cid long, v array<double>, leaves array<long>"
    queries = rows.where(is_query).select("id", "v").distinct()
    asked = materialise(queries.join(entries.select("v", "cid"), "v").select(F.col("id").alias("query_id"), "cid"), "ann-queries")
    asking = entries.join(asked.select("cid").distinct(), "cid", "left_semi").select("cid", "v")
    in_leaf, per_tree = n * len(made.roots) / max(1, made.leaves), taken / max(1, made.leaves)
    c_parts, q_parts = max(1, math.ceil(in_leaf / most_in_leaf)), max(1, math.ceil(asking.count() * per_tree / most_in_leaf))
    groups = max(1, math.ceil(n * len(made.roots) * q_parts / GROUP))

    def dealt(df: DataFrame, c_part: Column, q_part: Column) -> DataFrame:
        """A row for each leaf and part, with its slot (the same for vectors and queries that are to meet) and group."""
        # vectors travel in the type that they came in, which is exact
        flat = df.select("cid", F.col("v").cast(vectors.schema[vector_col].dataType).alias("v"), F.explode("leaves").alias("leaf"))
        placed = flat.select("cid", "v", "leaf", c_part.alias("cp")).select("cid", "v", "leaf", "cp", q_part.alias("qp"))
        return placed.select("cid", "v", F.xxhash64("leaf", "cp", "qp").alias("slot")).withColumn("group", F.pmod("slot", F.lit(groups)))

    part = lambda seed, parts: F.pmod(F.xxhash64("cid", F.lit(seed)), F.lit(parts))
    every = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))

    def rank(key, q: pa.Table, c: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int64)
        ids, found, far = [none], [none], [np.zeros(0)]
        if q.num_rows and c.num_rows:
            qv, cv = _matrix(q["v"], q.num_rows), _matrix(c["v"], c.num_rows)
            qid, cid, qs, cs = (x.to_numpy() for x in (q["cid"], c["cid"], q["slot"], c["slot"]))
            q_order, c_order = np.argsort(qs, kind="stable"), np.argsort(cs, kind="stable")
            both = np.intersect1d(qs, cs)
            at = lambda x, order: (np.searchsorted(x, both, side, order) for side in ("left", "right"))
            for q1, q2, c1, c2 in zip(*at(qs, q_order), *at(cs, c_order)):
                mine, own = q_order[q1:q2], c_order[c1:c2]
                for i in mine:
                    d = np.sqrt(((cv[own] - qv[i]) ** 2).sum(axis=1))
                    best = np.lexsort((cid[own], d))[: k + 1]
                    ids.append(np.full(len(best), qid[i])), found.append(cid[own[best]]), far.append(d[best])
        a, b, d = np.concatenate(ids), np.concatenate(found), np.concatenate(far)
        # of each query the nearest of all leaves of the group, a vector once
        o = np.lexsort((b, d, a))
        a, b, d = a[o], b[o], d[o]
        once = np.ones(len(a), bool)
        once[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        a, b, d = a[once], b[once], d[once]
        start = np.r_[0, np.flatnonzero(a[1:] != a[:-1]) + 1] if len(a) else np.zeros(0, int)
        place = np.arange(len(a)) - np.repeat(start, np.diff(np.r_[start, len(a)])) if len(a) else np.zeros(0, int)
        near = place <= k
        return pa.table({"q": pa.array(a[near], pa.int64()), "c": pa.array(b[near], pa.int64()), "d": pa.array(d[near], pa.float64())})

    asks = dealt(asking.mapInArrow(ask, schema), every(c_parts), part(1, q_parts))
    holds = dealt(entries.select("cid", "v").mapInArrow(index, schema), part(2, c_parts), every(q_parts))
    met = asks.groupBy("group").cogroup(holds.groupBy("group")).applyInArrow(rank, "q long, c long, d double")
    found = met.groupBy("q", "c").agg(F.min("d").alias("score"))
    # k + 1 entries a query hold its k nearest rows besides itself
    near = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("score", "c"))).where(F.col("r") <= k + 1)
    each = near.join(entries.select(F.col("cid").alias("c"), "ids"), "c").select("q", "score", F.explode("ids").alias("vec_id"))
    pairs = asked.join(each, asked["cid"] == each["q"]).where("query_id <> vec_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return pairs.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)
