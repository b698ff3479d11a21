"""Batch sources: logical tables, filtered scans, visible tracks, segment folders, telemetry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import times as T

LOGICAL = {
    "events": schemas.EVENTS,
    "cameras": schemas.CAMERAS,
    "tracks": schemas.TRACKS,
    "samples": schemas.SAMPLES,
    "recordings": schemas.RECORDINGS,
    "zones": schemas.ZONES,
    "occupancy": schemas.OCCUPANCY,
    "presence": schemas.PRESENCE,
    "plate_reads": schemas.PLATE_READS,
    "telemetry": schemas.TELEMETRY,
}


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A logical table with its fixed schema; columns that the files lack are null."""
    return spark.read.schema(LOGICAL[name]).parquet(f"{root}/{name}")


def scan(df: DataFrame, conditions: Sequence[Column | None] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """Only the rows and columns asked for; both reach the Parquet reader."""
    for c in conditions:
        if c is not None:
            df = df.filter(c)
    return df if columns is None else df.select(*columns)


def visible(tracks: DataFrame, name: str | None = None) -> DataFrame:
    """Tracks that no filter hides; also as a temporary view where a name is given."""
    out = tracks.filter(F.col("suppressed_reason").isNull())
    if name:
        out.createOrReplaceTempView(name)
    return out


def suppressed(tracks: DataFrame, limit: int) -> DataFrame:
    return tracks.filter(F.col("suppressed_reason").isNotNull()).orderBy(F.col("started_us").desc(), F.col("track_id").desc()).limit(limit)


def segment_files(spark: SparkSession, root: str) -> DataFrame:
    """path, camera, started_us, size_bytes of the recording files below root/<camera>/; other names are left out.

    Reads the files' metadata, not their content.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size_bytes"))
    parts = F.split("path", "/")
    return files.select("path", F.element_at(parts, -2).alias("camera"), T.segment_start(F.col("path")).alias("started_us"), "size_bytes").filter(F.col("started_us").isNotNull())


def new_segments(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files that no recording row names yet."""
    return files.join(known.select("path"), "path", "left_anti")


def telemetry_rows(messages: DataFrame) -> DataFrame:
    """Telemetry messages (subject, payload, at_us) as rows; a subject is telemetry.<source>.<camera>, others are left out."""
    parts = F.split("subject", r"\.")
    good = (F.size(parts) >= 3) & (F.element_at(parts, -3) == "telemetry")
    return messages.filter(good).select("at_us", F.element_at(parts, -1).alias("camera"), F.element_at(parts, -2).alias("source"), "payload")


def doorbell_events(presses: DataFrame) -> DataFrame:
    """Presses (camera_id, at_us) as event rows."""
    from ..functions.payload import event_key

    return presses.select(event_key(F.col("camera_id"), F.lit("doorbell"), F.col("at_us")).alias("event_key"), "camera_id", F.lit("doorbell").alias("kind"), "at_us", F.lit("{}").alias("payload"))


def changes(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The change feed between two readings of a table: the rows that came, went or changed, with `change`.

    insert and update rows are those of `after`, delete rows those of `before`. Keys name a row; a null key equals
    a null. Every other column counts, also where it turns null. To apply a feed is one merge by the keys.
    """
    others = [c for c in after.columns if c not in keys]
    a = after.select(F.struct(*keys).alias("_key"), F.struct(*others).alias("_new"), F.lit(True).alias("_now"))
    b = before.select(F.struct(*keys).alias("_key"), F.struct(*others).alias("_old"), F.lit(True).alias("_then"))
    both = a.join(b, "_key", "full_outer")
    kind = F.when(F.col("_then").isNull(), "insert").when(F.col("_now").isNull(), "delete").when(~F.col("_new").eqNullSafe(F.col("_old")), "update")
    row = F.when(F.col("_now").isNull(), F.col("_old")).otherwise(F.col("_new"))
    return both.select(F.col("_key.*"), row.alias("_row"), kind.alias("change")).filter("change IS NOT NULL").select(*keys, "_row.*", "change")
