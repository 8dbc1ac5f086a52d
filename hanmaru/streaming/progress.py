"""Streams of events: keyed progress with expiry, and counts per window with late events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hanmaru.operators.rows import latest_by_key, replace_keys


def windowed_counts(events: DataFrame, time: str, key: str, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Events per window and key; events later than the watermark are dropped by the engine. Works on a stream and on
    a table alike."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count(F.lit(1)).alias("events")).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), key, "events"
    )


class LatestStore:
    """The latest row of every key over a stream, in a folder of versions; rows older than `ttl_seconds` before the newest are evicted.

    Every micro-batch is reduced to its latest row per key, merged with the stored state and written as a new version; a
    marker file names the version that counts, so a batch that is repeated after a failure gives the same state.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], time: str, ttl_seconds: int) -> None:
        self.spark, self.path, self.keys, self.time, self.ttl = spark, path.rstrip("/"), keys, time, ttl_seconds

    def _marker(self):  # noqa: ANN202
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/CURRENT")
        return jvm, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def version(self) -> int:
        """The batch whose state counts, -1 before the first."""
        jvm, fs, path = self._marker()
        if not fs.exists(path):
            return -1
        stream = fs.open(path)
        try:
            return int(str(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")).strip())
        finally:
            stream.close()

    def read(self) -> DataFrame | None:
        """The state, or None before the first batch."""
        v = self.version()
        return self.spark.read.parquet(f"{self.path}/v={v}") if v >= 0 else None

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """The handler for foreachBatch."""
        if batch_id <= self.version():
            return
        state, new = self.read(), latest_by_key(batch, self.keys, self.time)
        if state is not None:
            new = latest_by_key(state.unionByName(new), self.keys, self.time)
        newest = new.agg(F.max(self.time).alias("__newest"))  # one row
        fresh = new.join(F.broadcast(newest), F.col(self.time) > F.col("__newest") - F.make_interval(secs=F.lit(self.ttl))).drop("__newest")
        fresh.write.mode("overwrite").parquet(f"{self.path}/v={batch_id}")
        _, fs, path = self._marker()
        out = fs.create(path, True)
        out.write(bytearray(str(batch_id).encode()))
        out.close()

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_vectors(state: DataFrame, changed: DataFrame) -> DataFrame:
    """Index maintenance for (owner, item, weight): the rows of changed owners are replaced by their new ones."""
    return replace_keys(state, changed, ["owner"])


def merge_frequencies(frequencies: DataFrame, state: DataFrame, changed: DataFrame) -> DataFrame:
    """(item, df) after the same change: only the items of changed owners gain or lose, each an owner; items of none go."""
    old = state.join(changed.select("owner").distinct(), "owner", "left_semi").select("item", F.lit(-1).alias("n"))
    moved = old.unionByName(changed.select("item", F.lit(1).alias("n"))).groupBy("item").agg(F.sum("n").alias("n"))
    out = frequencies.join(moved, "item", "full_outer").select("item", (F.coalesce("df", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("df"))
    return out.where("df > 0")
