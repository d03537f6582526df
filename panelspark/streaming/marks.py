"""Incremental quote-window marks and prices: files arrive, and what each request knows so far is kept in a table.

The latest of ticks is associative and idempotent, so late files need no watermark. Sums aren't idempotent, so a batch's
result is made from the state before it, never from its own: a batch that runs again writes the same files again.

The state lies in hash buckets of contracts. A batch rewrites only the buckets that its ticks touch, under its own number, and
its manifest says for every bucket which batch wrote it last. The manifest is written last, so a batch that was killed
before is not seen; what neither the newest manifest nor the one before it names is removed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.operators.intervals import exact, inside_intervals

#: Buckets of the state: contracts of one bucket are rewritten together.
BUCKETS = 64
MARKS = "request_id long, ts timestamp, value double"
SUMS = "request_id long, pv decimal(38,10), volume decimal(38,10), last_ts timestamp, rows long"


def _asked(ticks: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests of the batch's contracts whose window reaches into the time of that contract's ticks."""
    spans = ticks.groupBy("contract").agg(F.min("ts").alias("_a"), F.max("ts").alias("_b"))
    return requests.join(spans, "contract").where("start_ts <= _b AND end_ts >= _a").drop("_a", "_b")


def batch_marks(ticks: DataFrame, requests: DataFrame) -> DataFrame:
    """contract, request_id, ts, value of the latest tick in each window. ticks: contract, ts, value; requests: request_id, contract, start_ts, end_ts."""
    asked = _asked(ticks, requests)
    met = inside_intervals(ticks.where("value > 0"), asked, ["contract"], "ts", ["contract", "request_id"], {}, last=F.struct("ts", "value"))
    return met.where("_last IS NOT NULL").select("contract", "request_id", "_last.ts", "_last.value")


def merged_marks(a: DataFrame, b: DataFrame) -> DataFrame:
    best = F.max(F.struct("ts", "value")).alias("m")
    return a.unionByName(b).groupBy("contract", "request_id").agg(best).select("contract", "request_id", "m.ts", "m.value")


def batch_sums(ticks: DataFrame, requests: DataFrame) -> DataFrame:
    """contract, request_id with the sums that a window's price is made of (to ten digits after the point). ticks also have volume."""
    sums = {"pv": exact(F.col("value") * F.col("volume")), "volume": exact(F.col("volume").cast("double")), "rows": F.lit(1).cast("long")}
    met = inside_intervals(ticks.where("value > 0 AND volume > 0"), _asked(ticks, requests), ["contract"], "ts", ["contract", "request_id"], sums, last=F.struct("ts"))
    return met.where("rows > 0").select("contract", "request_id", *[F.col(c).cast("decimal(38,10)").alias(c) for c in ("pv", "volume")], F.col("_last.ts").alias("last_ts"), "rows")


def merged_sums(a: DataFrame, b: DataFrame) -> DataFrame:
    sums = [F.sum("pv").alias("pv"), F.sum("volume").alias("volume"), F.max("last_ts").alias("last_ts"), F.sum("rows").alias("rows")]
    return a.unionByName(b).groupBy("contract", "request_id").agg(*sums)


class State:
    """Rows by bucket of their contract in ``folder``: data/version-<batch>/bucket=<b>, and manifest/version-<batch>."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.schema, self.buckets = spark, folder.rstrip("/"), schema, buckets
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path = self._path(f"{self.folder}/{folder}")
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def manifests(self) -> list[int]:
        """The batches whose manifest is written whole, by the file system's own list (the folder is small)."""
        done = [n for n in self._names("manifest") if n.startswith("version-") and self._fs.exists(self._path(f"{self.folder}/manifest/{n}/_SUCCESS"))]
        return sorted(int(n.removeprefix("version-")) for n in done)

    def manifest(self, batch: int | None) -> dict[int, int]:
        """Which batch wrote each bucket, as ``batch`` left it."""
        if batch is None:
            return {}
        return {r.bucket: r.version for r in self.spark.read.schema("bucket int, version long").parquet(f"{self.folder}/manifest/version-{batch}").collect()}  # a row a bucket

    def read(self, held: dict[int, int]) -> DataFrame:
        paths = [f"{self.folder}/data/version-{v}/bucket={b}" for b, v in sorted(held.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def latest(self) -> DataFrame:
        known = self.manifests()
        return self.read(self.manifest(known[-1] if known else None))

    def merge(self, new: DataFrame, batch: int, merged: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Merges a batch's rows into the buckets of their contracts; the same batch again gives the same state."""
        bucket = F.pmod(F.xxhash64("contract"), F.lit(self.buckets)).cast("int")
        new = new.persist()
        touched = [r[0] for r in new.select(bucket).distinct().collect()]  # at most all buckets
        earlier = [v for v in self.manifests() if v < batch]
        held = self.manifest(earlier[-1] if earlier else None)
        out = merged(new, self.read({b: v for b, v in held.items() if b in touched}))
        out.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/data/version-{batch}")
        now = held | dict.fromkeys(touched, batch)
        self.spark.createDataFrame(sorted(now.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/version-{batch}")
        new.unpersist()
        self._tidy(batch, earlier, [held, now])

    def _tidy(self, batch: int, earlier: list[int], kept: list[dict[int, int]]) -> None:
        needed = {(b, v) for m in kept for b, v in m.items()}
        for name in self._names("data"):
            version = int(name.removeprefix("version-"))
            own = [n for n in self._names(f"data/{name}") if n.startswith("bucket=")]
            old = [n for n in own if (int(n.removeprefix("bucket=")), version) not in needed]
            for n in old if len(old) < len(own) else [""] if version < batch else []:
                self._fs.delete(self._path(f"{self.folder}/data/{name}/{n}".rstrip("/")), True)
        for v in earlier[:-1]:
            self._fs.delete(self._path(f"{self.folder}/manifest/version-{v}"), True)


def run(spark: SparkSession, source: str, schema: str, folder: str, state: State, batch: Callable[[DataFrame], DataFrame], merged: Callable[[DataFrame, DataFrame], DataFrame], files_a_batch: int = 4) -> DataFrame:
    """Processes all files that have landed in ``source`` since the last run and returns what is known now.

    A run without new files, the first one included, returns the last state, or no rows.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(source)
    work = stream.writeStream.foreachBatch(lambda ticks, number: state.merge(batch(ticks), number, merged))
    work.option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start().awaitTermination()
    return state.latest()


def _state(spark: SparkSession, requests: DataFrame, folder: str, columns: str, buckets: int) -> State:
    return State(spark, f"{folder}/state", f"contract {requests.schema['contract'].dataType.simpleString()}, {columns}", buckets)


def run_marks(spark: SparkSession, source: str, schema: str, requests: DataFrame, folder: str, buckets: int = BUCKETS) -> DataFrame:
    state = _state(spark, requests, folder, MARKS, buckets)
    return run(spark, source, schema, folder, state, lambda t: batch_marks(t, requests), merged_marks).drop("contract")


def run_vwap(spark: SparkSession, source: str, schema: str, requests: DataFrame, folder: str, buckets: int = BUCKETS) -> DataFrame:
    """request_id, vwap, volume, last_ts, rows of all ticks that have arrived."""
    state = _state(spark, requests, folder, SUMS, buckets)
    known = run(spark, source, schema, folder, state, lambda t: batch_sums(t, requests), merged_sums)
    value = F.col("pv").cast("double") / F.col("volume").cast("double")
    return known.select("request_id", value.alias("vwap"), F.col("volume").cast("double").alias("volume"), "last_ts", "rows")
