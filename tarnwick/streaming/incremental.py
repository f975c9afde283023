"""Evaluation as a stream: an extension of the batch operators, which have no streaming form of their own.

New record files are scored as they come; records whose key and signature have come before are left
out by the query's own state, so a restart or a repeated file changes nothing and no batch reads
what earlier ones wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarnwick.operators.records import totals


def run(spark: SparkSession, source: str, store: str, checkpoint: str, schema: str, keys: list[str]) -> StreamingQuery:
    """A query that adds scored records of new JSON files to a Parquet store, a folder for each batch, and ends when all are taken.

    The state holds the keys and signatures seen; a batch that runs again replaces its own folder.
    """
    fresh = totals(spark.readStream.schema(schema).json(source)).dropDuplicates([*keys, "signature"])

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/batch={number}")

    return fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts and sums by event type in tumbling windows of event time, for batch and stream alike."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
