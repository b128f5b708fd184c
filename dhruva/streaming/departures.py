"""Departure counts as a stream: the same result as the batch query, with state bounded by a watermark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dhruva.session import checkpoint_dir


def hourly_counts(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events and their value per hour and type; later rows than the watermark allows are dropped from a stream."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    w = rows.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value"))
    return w.select(F.col("w.start").alias("hour"), "event_type", "events", "value")


def run_available(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Runs the stream over the files that are there now and returns the latest counts of each hour.

    Every trigger writes the hours it changed as one folder of the shared directory; a rerun of a batch overwrites its
    own folder, so the sink is idempotent.
    """
    schema = spark.read.option("pathGlobFilter", pattern).parquet(path).select("ts", "event_type", "value").schema
    zoned = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", 8).parquet(path)
    stream = hourly_counts(zoned.withColumn("ts", F.col("ts").cast("timestamp")))
    root = f"{checkpoint_dir(spark).rstrip('/')}/hourly-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{root}/out")
    last = rows.groupBy("hour", "event_type").agg(F.max_by(F.struct("events", "value"), "batch").alias("v"))
    return last.select("hour", "event_type", "v.events", "v.value")
