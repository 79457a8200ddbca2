"""Filings as they arrive: a file stream, parsed and validated by micro-batch. An addition; batch use needs none of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import instance


def arriving(spark: SparkSession, folder: str, at_once: int = 1000) -> DataFrame:
    """Documents of a folder as a stream (doc_id, text)."""
    stream = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", at_once).load(folder)
    return stream.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def parsed(stream: DataFrame) -> DataFrame:
    return instance.parse(stream)


def validated_into(stream: DataFrame, path: str, checkpoint: str, validate):
    """Each batch of filings through ``validate`` (tables to violations), appended to a table once a batch."""

    def batch(df: DataFrame, number: int):
        found = validate(instance.tables(instance.parse(df)))
        found.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def event_windows(events: DataFrame, minutes: int = 60, late: str = "2 hours") -> DataFrame:
    """Tumbling windows with a watermark for late events; the same code for batch and stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", f"{minutes} minutes"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
