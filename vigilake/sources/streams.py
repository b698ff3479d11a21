"""Streaming sources over files of one message per row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def messages(spark: SparkSession, path: str, schema: str, files_per_batch: int = 16, fmt: str = "json") -> DataFrame:
    """A stream of a folder's files, a bounded number a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)


def track_messages(spark: SparkSession, path: str, **options) -> DataFrame:
    """Track messages with an event time; empty lists stay, as they clear state."""
    return messages(spark, path, schemas.TRACK_STREAM, **options).withColumn("ts", F.timestamp_micros("timestamp_us"))


def frames(spark: SparkSession, path: str, **options) -> DataFrame:
    return messages(spark, path, "camera_id long, sequence long, timestamp_us long, width int, height int", **options)


def detections(stream: DataFrame) -> DataFrame:
    """One row per detection of a message (camera_id, sequence, timestamp_us, detections)."""
    return stream.select("camera_id", "sequence", "timestamp_us", F.posexplode_outer("detections").alias("place", "d")).select("camera_id", "sequence", "timestamp_us", "place", "d.*")


def latest_frames(batch: DataFrame) -> DataFrame:
    """The newest waiting frame of each camera and how many it replaces; the longest waiting camera first."""
    rows = batch.groupBy("camera_id").agg(F.max("sequence").alias("sequence"), F.min("timestamp_us").alias("waiting_us"), (F.count("*") - 1).alias("missed"))
    return rows.orderBy("waiting_us", "camera_id")
