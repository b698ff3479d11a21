"""Sinks: idempotent appends, merges by key, routing, change-only publishing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.payload import event_key
from ..functions.vectors import added


def keyed_events(events: DataFrame) -> DataFrame:
    """Events with the key that makes a repeated insert the same row."""
    return events.withColumn("event_key", event_key(F.col("camera_id"), F.col("track_id"), F.col("kind"), F.get_json_object("payload", "$.zone_id"), F.col("at_us")))


def append_new(spark: SparkSession, rows: DataFrame, path: str, key: str) -> None:
    """Append the rows whose key the table lacks. One writer at a time; a repeated batch adds nothing."""
    own = rows.dropDuplicates([key])
    try:
        known = spark.read.parquet(path).select(key)
    except Exception as e:  # the first batch finds no table
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = None
    (own if known is None else own.join(known, key, "left_anti").select(own.columns)).write.mode("append").parquet(path)


def foreach_append(path: str, key: str) -> Callable[[DataFrame, int], None]:
    """For writeStream.foreachBatch: exactly-once rows by their key."""

    def write(batch: DataFrame, _: int) -> None:
        append_new(batch.sparkSession, batch, path, key)

    return write


def merged(table: DataFrame, changes: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """`table` after an upsert; of several changes of a key the last in `order` counts."""
    if order is not None:
        by = Window.partitionBy(*keys).orderBy(F.col(order).desc())
        changes = changes.withColumn("_n", F.row_number().over(by)).filter("_n = 1").drop("_n")
    return table.join(changes.select(*keys), keys, "left_anti").unionByName(changes.select(table.columns))


def rewrite(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Replace a table; with a partition column only the partitions that appear."""
    w = df.write.mode("overwrite")
    (w.option("partitionOverwriteMode", "dynamic").partitionBy(partition) if partition else w).parquet(path)


def heat_merged(table: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Daily arrays with a batch's counts added cell by cell."""
    b = batch.select(*keys, F.col("cells").alias("_b"))
    got = table.select(*keys, F.col("cells").alias("_a")).join(b, keys, "full")
    return got.select(*keys, F.when(F.col("_a").isNull(), F.col("_b")).when(F.col("_b").isNull(), F.col("_a")).otherwise(added(F.col("_a"), F.col("_b"))).alias("cells"))


def routed(events: DataFrame, cameras: DataFrame, place_kinds: tuple[str, ...] = ("place_filled", "place_released")) -> DataFrame:
    """Events with their camera and the subject they go to: bell, place or event."""
    subject = F.when(F.col("kind") == "doorbell", "bell").when(F.col("kind").isin(*place_kinds), "place").otherwise("event")
    return events.join(cameras.select("camera_id", "slug"), "camera_id", "left").withColumn("subject", subject)


def changed_states(now: DataFrame, before: DataFrame, key: str = "camera_id") -> DataFrame:
    """Rows of `now` whose body differs from what was published; a camera with nothing publishes an empty body."""
    b = before.select(key, F.col("body").alias("_body"))
    return now.withColumn("body", F.coalesce("body", F.lit("{}"))).join(b, key, "left").filter(~F.col("body").eqNullSafe(F.col("_body"))).drop("_body")


def keep_newest(queue: DataFrame, keys: list[str], order: str, most: int = 64) -> DataFrame:
    """What a slow reader still gets: the newest rows of its queue."""
    by = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return queue.withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= most).drop("_n")
