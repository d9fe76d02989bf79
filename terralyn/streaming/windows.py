"""A streaming form of the mean by zone and date; the batch operators need no stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """New event files of a folder, with a time that can carry a watermark."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def daily_means(events: DataFrame, late: str = "2 days") -> DataFrame:
    """day, event_type, mean, n: a day is closed once events later than it by the allowed lateness have come."""
    days = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
    return days.select(F.col("window.start").alias("day"), "event_type", "mean", "n")


def follow(acquisitions: DataFrame, replay, checkpoint: str):
    """Hands every micro-batch of a stream of acquisitions to a replay.Replay, once each; starts the query.

    A batch that was committed before a failure is known by its number and not applied again. Late dates need no
    watermark here, since a batch is replayed whatever its dates.
    """
    return acquisitions.writeStream.foreachBatch(lambda rows, batch: replay.replay(rows, batch=batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
