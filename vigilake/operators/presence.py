"""Presence episodes of persons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import times as T


def opened(verdicts: DataFrame, sustained_us: int = 20 * T.SECOND, ttl_us: int = 60 * T.SECOND) -> DataFrame:
    """global_id, camera_id, present_us, confirmed_us, evidence, n of verdicts that lasted.

    Verdicts farther apart than the time to live begin anew; body evidence must last, a face opens at once.
    The start is the first verdict; a face is never downgraded to a body.
    """
    by = Window.partitionBy("global_id", "camera_id").orderBy("at_us")
    fresh = F.when(F.lag("at_us").over(by).isNull() | (F.col("at_us") - F.lag("at_us").over(by) > ttl_us), 1).otherwise(0)
    runs = verdicts.withColumn("_f", fresh).withColumn("_run", F.sum("_f").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = runs.groupBy("global_id", "camera_id", "_run").agg(F.min("at_us").alias("present_us"), F.max("at_us").alias("confirmed_us"), F.max(F.col("source") == "face").alias("_face"), F.count("*").alias("n"))
    lasts = F.col("_face") | (F.col("confirmed_us") - F.col("present_us") >= sustained_us)
    return rows.filter(lasts).select("global_id", "camera_id", "present_us", "confirmed_us", F.when(F.col("_face"), "face").otherwise("body").alias("evidence"), "n")


def close_reasons(open_: DataFrame, empty_cameras: DataFrame, vehicle_departures: DataFrame, now_us: int, elsewhere_us: int, absence_us: int, vehicle_us: int, margin_us: int, stale_us: int) -> DataFrame:
    """episode_id, closed_by, departed_us of open episodes that end: elsewhere, absence, vehicle, stale, in this order.

    Each rule sees only what the earlier ones left; the end is always the last confirmation.
    empty_cameras (camera_id) report and see nobody; vehicle_departures (global_id, left_us) are cars of a person.
    """
    newest = Window.partitionBy("global_id")
    rows = open_.withColumn("_newest", F.max("confirmed_us").over(newest))
    rows = rows.join(empty_cameras.select("camera_id", F.lit(True).alias("_empty")).distinct(), "camera_id", "left")
    recent = vehicle_departures.filter(F.col("left_us") > now_us - vehicle_us).groupBy("global_id").agg(F.max("left_us").alias("_left"))
    rows = rows.join(recent, "global_id", "left")
    quiet = lambda us: F.col("confirmed_us") < now_us - us
    reason = (
        F.when(quiet(elsewhere_us) & (F.col("_newest") > F.col("confirmed_us")), "elsewhere")
        .when(quiet(absence_us) & F.col("_empty"), "absence")
        .when(F.col("confirmed_us") < F.col("_left") + margin_us, "vehicle")
        .when(quiet(stale_us), "stale")
    )
    return rows.select("episode_id", reason.alias("closed_by"), F.col("confirmed_us").alias("departed_us")).filter(F.col("closed_by").isNotNull())


def seen_elsewhere(open_: DataFrame) -> DataFrame:
    """Open episodes of whom another open one was confirmed later."""
    return open_.withColumn("_newest", F.max("confirmed_us").over(Window.partitionBy("global_id"))).filter(F.col("_newest") > F.col("confirmed_us")).drop("_newest")


def listing(episodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Episodes with names; an open one lasts until its last confirmation."""
    until: Column = F.coalesce("departed_us", "confirmed_us")
    return episodes.join(labels.select("global_id", "name"), "global_id", "left").select("episode_id", "global_id", "name", "camera_id", "present_us", T.seconds_between(F.col("present_us"), until).alias("lasted_s"), F.col("departed_us").isNull().alias("open"))


def left_by_vehicle(departures: DataFrame, within_us: int = 5 * T.MINUTE) -> DataFrame:
    """One event per departure of a person by a car: later ones within the time of the first are the same."""
    from . import islands

    runs = islands.stitched(departures, ["person_gid", "vehicle_gid"], F.col("at_us"), F.col("at_us"), within_us, "episode_id")
    return runs.groupBy("person_gid", "vehicle_gid", "run").agg(F.min("at_us").alias("at_us")).drop("run")
