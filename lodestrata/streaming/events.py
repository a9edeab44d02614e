"""Streams: error windows with a watermark, duplicates within a window, and idempotent batches into stored tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import deliveries, errors


def read_files(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A stream over the Parquet files of a folder; the checkpoint of the query that reads it remembers what is done."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def error_windows(stream: DataFrame, time: str = "ts", late: str = "10 minutes", minutes: int = 5) -> DataFrame:
    """operators.errors.windows on a stream; windows leave when the watermark passes their end."""
    return errors.windows(stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late), time=time, minutes=minutes)


def distinct_messages(stream: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """Messages without repetitions of their keys within the watermark's delay."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def run_available(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hand everything that is there to ``batch``, in micro-batches, and stop."""
    q = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def collect_deliveries(stream: DataFrame, log: deliveries.DeliveryLog, checkpoint: str, compact_after: int = 8) -> None:
    """Upsert a stream of deliveries into a log; a micro-batch that is replayed after a failure, by this process or by another one that has
    opened the log, changes nothing. Runs are merged after every ``compact_after`` of them."""

    def batch(df: DataFrame, n: int) -> None:
        rows = deliveries.with_identity(df.filter(F.col("delivery_id").isNotNull()))
        log.upsert(rows.select(*deliveries.IDENTITY, "received_at", "delivery_id"), f"{checkpoint}#{n}")
        if log.runs >= compact_after:
            log.compact()

    run_available(stream, batch, checkpoint)
