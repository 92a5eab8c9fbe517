"""The feed as Structured Streaming; in available-now runs it equals the batch feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.functions import tables as T


def event_stream(spark: SparkSession, folder: str, schema, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def matched_only(events: DataFrame, status: str = "status") -> DataFrame:
    """Only matches are recorded, nothing from a failure path."""
    return events.where(F.col(status) == "matched")


def recent(events: DataFrame, key: str, ts: str = "ts", days: int = T.RETENTION_DAYS) -> DataFrame:
    """(key, last): newest event of each key; state is one row a key, bounded by the watermark in update mode."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, f"{days} days").groupBy(key).agg(F.max(ts).alias("last"))


def windowed(events: DataFrame, size: str, ts: str = "ts", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts by tumbling or sliding windows; rows later than ``late`` are dropped."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, size, slide) if slide else F.window(ts, size), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total"))


def once_each(events: DataFrame, key: str, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def drain(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there into a memory table (small results, tests) and return it."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def drain_to(stream: DataFrame, path: str, checkpoint: str, partition_by: list[str] | None = None) -> None:
    """Append a stream's rows to Parquet files; the sink commits each file once."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).trigger(availableNow=True).start().awaitTermination()
