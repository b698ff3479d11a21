"""Notification rules, deliveries, limits, layered settings, audits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import times as T
from . import islands, ranked


def dispatched(events: DataFrame, rules: DataFrame) -> DataFrame:
    """event_id, rule_id, channel_id for every event that a rule (kinds, camera_ids, class_ids, channel_ids) wants.

    A null list wants all; an event without class fails a rule with classes. Rules are dealt by kind.
    """
    any_kind = rules.filter(F.col("kinds").isNull())
    by_kind = rules.filter(F.col("kinds").isNotNull()).withColumn("kind", F.explode(F.array_distinct("kinds")))
    every = any_kind.join(events.select("kind").distinct().select(F.col("kind").alias("_k")), F.lit(True)).withColumnRenamed("_k", "kind")
    met = events.join(by_kind.unionByName(every), "kind")
    wanted = (F.col("camera_ids").isNull() | F.array_contains("camera_ids", F.col("camera_id"))) & (F.col("class_ids").isNull() | F.coalesce(F.array_contains("class_ids", F.col("class_id")), F.lit(False)))
    return met.filter(wanted).select("event_id", "rule_id", "at_us", F.explode("channel_ids").alias("channel_id"))


def rate_limited(deliveries: DataFrame, per_minute: int) -> DataFrame:
    """`deliveries` with allowed, by a token bucket of each channel: capacity and refill a minute's worth.

    An ordered fold whose state is two numbers; it reads sorted rows batch by batch. After a pause of more than a minute
    the bucket is full whatever came before, so the stretches between pauses are dealt to tasks one by one.
    A delivery without a time is neither limited nor counted: allowed is null.
    """
    timed = deliveries.filter(F.col("at_us").isNotNull())
    rows = islands.in_order(timed, ["channel_id"], "at_us", "event_id", T.MINUTE)

    def bucket(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, last = float(per_minute), 0
        for frame in frames:
            out = []
            for at, opening in zip(frame.at_us, frame._opens, strict=True):
                tokens = float(per_minute) if opening else min(float(per_minute), tokens + (at - last) * per_minute / T.MINUTE)
                last = at
                out.append(tokens >= 1 - 1e-9)
                tokens -= 1.0 if out[-1] else 0.0
            yield frame.drop(columns="_opens").assign(allowed=out)

    schema = ", ".join(f"`{c}` {t}" for c, t in deliveries.dtypes) + ", allowed boolean"
    done = rows.mapInPandas(bucket, schema)
    return done.unionByName(deliveries.filter(F.col("at_us").isNull()).withColumn("allowed", F.lit(None).cast("boolean")))


def timeline(log: DataFrame, users: DataFrame, before_us: int | None, limit: int, extra: Column | None = None) -> DataFrame:
    """Newest first page of a log with the users' names, from a cursor on."""
    rows = log if before_us is None else log.filter(F.col("at_us") < before_us)
    if extra is not None:
        rows = rows.filter(extra)
    top = rows.orderBy(F.col("at_us").desc(), F.col("log_id").desc()).limit(limit)
    return top.join(users, "user_id", "left")


def layered(wanted: DataFrame, camera: DataFrame, shared: DataFrame, default: float, low: float, high: float) -> DataFrame:
    """`wanted` (camera_id, name) with value: the camera's, else the shared, else the default; within bounds, numbers only."""
    c = camera.select("camera_id", "name", F.col("value").cast("string").try_cast("double").alias("_c"))
    g = shared.select("name", F.col("value").cast("string").try_cast("double").alias("_g"))
    got = wanted.join(c, ["camera_id", "name"], "left").join(g, "name", "left")
    return got.select("camera_id", "name", F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce("_c", "_g", F.lit(default)))).alias("value"))


def synced(rules: DataFrame, snapshot: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rules as the snapshot has them, keys to delete because it has them not)."""
    return snapshot, rules.join(snapshot.select(*keys), keys, "left_anti").select(*keys)


def snapshot(rules: DataFrame) -> DataFrame:
    """One value per camera with all its rules in order of class."""
    names = [c for c in rules.columns if c not in ("camera_id", "class_id")]
    return rules.groupBy("camera_id").agg(F.sort_array(F.collect_list(F.struct("class_id", *names))).alias("rules"))


def reverted(journal: DataFrame) -> DataFrame:
    """incident_id, before: the newest journalled state to go back to."""
    return ranked.keep_latest(journal, ["incident_id"], "at_us", "entry_id").select("incident_id", "before")


def upserted(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """`table` with rows of the same keys replaced by the changes' and new ones added; the changes' keys are unique."""
    return table.join(changes.select(*keys), keys, "left_anti").unionByName(changes)


def roster(cameras: DataFrame, zones: DataFrame, regions: DataFrame) -> DataFrame:
    """One nested row per camera: its zones and regions in order, empty lists rather than none."""
    z = zones.groupBy("camera_id").agg(F.sort_array(F.collect_list(F.struct("zone_id", "kind"))).alias("zones"))
    r = regions.groupBy("camera_id").agg(F.sort_array(F.collect_list(F.struct("region_id", "place"))).alias("regions"))
    got = cameras.join(z, "camera_id", "left").join(r, "camera_id", "left")
    return got.withColumn("zones", F.coalesce("zones", F.array().cast("array<struct<zone_id:bigint,kind:string>>"))).withColumn("regions", F.coalesce("regions", F.array().cast("array<struct<region_id:bigint,place:string>>")))


def work_list(items: DataFrame, done: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The newest items never asked before."""
    return items.join(done.select(key).distinct(), key, "left_anti").orderBy(F.col(order).desc(), key).limit(n)


def retry_list(items: DataFrame, attempts: DataFrame, key: str, now_us: int, interval_us: int) -> DataFrame:
    """Items never tried or last tried long enough ago."""
    last = attempts.groupBy(key).agg(F.max("at_us").alias("_last"))
    return items.join(last, key, "left").filter(F.col("_last").isNull() | (F.col("_last") <= now_us - interval_us)).drop("_last")
