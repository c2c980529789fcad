"""Events as a stream: windowed counts and scores with late data, against a fixed calibration table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New Parquet files of a folder, with the schema of those there now."""
    return spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_scores(events: DataFrame, calibration: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Per window and category: events, mean and largest standardised value; rows later than ``late`` are left out.
    ``calibration(cat, center, scale)`` has a row a category."""
    z = events.withWatermark("ts", late).join(calibration, events["event_type"] == calibration["cat"])
    z = z.withColumn("z", (F.col("value") - F.col("center")) / F.col("scale"))
    out = z.groupBy(F.window("ts", size), "cat").agg(F.count("*").alias("n"), F.avg("z").alias("mean_z"), F.max("z").alias("max_z"))
    return out.select(F.col("window.start").alias("start"), "cat", "n", "mean_z", "max_z")


def run_once(out: DataFrame, path: str, checkpoint: str) -> None:
    """Everything that has come so far, appended as Parquet."""
    out.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
