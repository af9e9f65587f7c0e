"""The same pipelines over arriving data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def arriving_images(spark: SparkSession, folder: str) -> DataFrame:
    """Image files of a folder as they arrive."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").load(folder)
    return files.select(F.xxhash64("path").alias("image_id"), "path", "content")


def write_once(read: Callable[[DataFrame], DataFrame], target: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each batch's rows in a partition of their own, so a batch that is run again replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        read(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return write


def read_pages(pages: DataFrame, readtext: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch of images through a reader, its lines in a partition of a table."""
    return pages.writeStream.foreachBatch(write_once(readtext, target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_rates(events: DataFrame, ts: str, key: str, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Counts and means of ``value`` per key and window; rows later than ``late`` are left to the watermark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window), key).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
