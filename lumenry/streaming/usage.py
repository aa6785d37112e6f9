"""Usage events as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Event files that arrive in a folder, a fixed number per trigger."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 16).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def daily_usage_stream(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Requests and summed value per user and day, each event once; events later than the watermark are dropped.

    State is bounded by the watermark: repeats are remembered and days stay open that long.
    """
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy(F.window("ts", "1 day").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("requests"), F.sum("value").alias("total")).select("user_id", F.col("w.start").cast("date").alias("day"), "requests", "total")


def run_daily_usage(spark: SparkSession, source: str, target: str, checkpoint: str) -> None:
    """Reads what is there, adds finished days to Parquet files, and stops; a restart goes on where it ended."""
    query = daily_usage_stream(event_stream(spark, source)).writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
