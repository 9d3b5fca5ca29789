"""Structured Streaming: deduplicating ingest, running exposure, event windows (an extension)."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork.runtime import scratch_path


def drain(stream: DataFrame, label: str, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Run a stream over all that is available, to a table in ``folder``, and read it back.

    The query's checkpoint lies in the same folder: called again with it, the stream goes on where it stopped,
    without loss or repeats. Without a folder every call is a stream of its own, in the scratch folder.
    """
    spark = stream.sparkSession
    base = folder.rstrip("/") if folder else scratch_path(spark, f"stream-{label}")
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder as a file stream with the table's own schema."""
    path = os.path.join(sf_dir, f"{name}.parquet")
    schema = spark.read.parquet(path).schema
    if os.path.isdir(os.path.realpath(path)):
        return spark.readStream.schema(schema).parquet(path)
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def deduplicated(stream: DataFrame, key: str, time: str | None = None, within: str | None = None) -> DataFrame:
    """Each key once, over all micro-batches (state is keyed, and partitioned like a shuffle).

    With ``time`` and ``within`` repeats are caught if they come within that delay, and older keys leave the
    state: for streams without an end. Without them every key is remembered, for streams that are drained.
    """
    keyed = stream.where(F.col(key).isNotNull())
    if time is None or within is None:
        return keyed.dropDuplicates([key])
    return keyed.withColumn("_at", F.col(time).cast("timestamp")).where("_at IS NOT NULL").withWatermark("_at", within).dropDuplicatesWithinWatermark([key]).drop("_at")


def event_windows(stream: DataFrame, time: str, width: str, lateness: str) -> DataFrame:
    """Counts and sums per tumbling window and type, final once the watermark passes."""
    timed = stream.withColumn("_at", F.col(time).cast("timestamp")).where("_at IS NOT NULL").withWatermark("_at", lateness)
    return timed.groupBy(F.window("_at", width), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total"))


def periodically(stream: DataFrame, label: str, every: int, run: Callable[[DataFrame, int], None], folder: str | None = None) -> None:
    """Drain a stream, calling ``run(batch, number)`` on every ``every``-th micro-batch.

    The engine's checkpoint in ``folder`` keeps the batch numbers, so a call with the same folder goes on where
    the last one stopped.
    """

    def each(batch: DataFrame, number: int) -> None:
        if number % every == 0:
            run(batch, number)

    base = folder.rstrip("/") if folder else scratch_path(stream.sparkSession, f"stream-{label}")
    stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
