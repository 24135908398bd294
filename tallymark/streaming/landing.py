"""Incremental runs: new chunks are read as a stream, judged batch by batch, and appended with their state.

The stream's checkpoint is the resume point: a batch that was lost is done again, and its rows replace those of
the earlier attempt, because every batch owns one partition folder of the sink.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.filings import landing_latest
from ..storage import cut


def landed(spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files as they land; files_per_batch is the budget of a batch."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def append_batches(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Apply work to each batch and write it to out, once per batch, until nothing new is left."""

    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Snapshot:
    """The newest entry per key of a landing folder (key, fetched_at, data), kept up to date by reading new files alone.

    Every update streams the files that landed since the last one, merges their newest entries into the buckets that they touch, and writes those buckets under
    the batch's number; `current` takes each bucket from the last batch that wrote it.  An update that was lost is done again under the same number.
    """

    BUCKETS = 64

    def __init__(self, spark: SparkSession, source: str, path: str, schema: str = "key string, fetched_at double, data string") -> None:
        self.spark, self.source, self.path, self.schema = spark, source, path.rstrip("/"), schema
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{self.path}/entries/batch=-1/bucket=-1")

    def current(self) -> DataFrame:
        rows = self._entries()
        return rows.join(self._last(rows), ["batch", "bucket"]).drop("batch", "bucket")

    def _entries(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, batch long, bucket int").parquet(f"{self.path}/entries").where("bucket >= 0")

    @staticmethod
    def _last(rows: DataFrame) -> DataFrame:
        return rows.groupBy("bucket").agg(F.max("batch").alias("batch"))

    def update(self) -> StreamingQuery:
        """Read what has landed since the last update, then stop."""

        def merge(batch: DataFrame, number: int) -> None:
            new = landing_latest(batch, 0, None).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(self.BUCKETS)).cast("int"))
            new = cut(new, "landed")
            held = self._entries().where(F.col("batch") < number)  # a lost attempt of this batch does not count
            last = self._last(held).join(new.select("bucket").distinct(), "bucket")
            old = held.join(last, ["batch", "bucket"]).drop("batch")
            merged = new.unionByName(old).groupBy("bucket", "key").agg(F.max(F.struct("fetched_at", "data")).alias("x")).select("bucket", "key", "x.fetched_at", "x.data")
            merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/entries/batch={number}")

        stream = landed(self.spark, self.source, self.schema)
        return stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True).start()
