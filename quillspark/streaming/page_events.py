"""Structured Streaming over viewer-like events (beyond what batch operators need)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.scratch import new_path


def windowed_counts(events: DataFrame, *, lateness: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """window_start, event_type, n: tumbling windows under a watermark."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", lateness)
    return timed.groupBy(F.window("at", window), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "event_type", "n")


def replay(spark: SparkSession, path: str, files: str, transform=windowed_counts) -> DataFrame:
    """Run ``transform`` over ``files`` (a pattern) as a stream until all is read, and return the final result.

    ``path`` gives the schema. The stream's state and output are in the shared folder, so a run that is cut off goes on from its checkpoint.
    """
    batch = spark.read.parquet(path)
    stream = spark.readStream.schema(batch.schema).parquet(files)
    out, state = new_path(spark, "stream-out"), new_path(spark, "stream-state")
    keep = lambda df, _: df.write.mode("overwrite").parquet(out)
    query = transform(stream).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)
