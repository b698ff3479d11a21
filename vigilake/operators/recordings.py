"""Recording segments: cover, coverage, pins, pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import times as T
from . import asof, islands, rangejoin, ranked

FAR_US = 253_402_300_799_000_000


def coverage(recordings: DataFrame, gap_us: int = 2 * T.SECOND) -> DataFrame:
    """camera_id, started_us, ended_us, pieces: stretches without a longer gap; an open segment counts a minute."""
    return islands.merged(recordings, ["camera_id"], F.col("started_us"), T.covers_until(F.col("started_us"), F.col("ended_us"), T.OPEN_COVERAGE_US), gap_us, "recording_id")


def covering_segment(points: DataFrame, recordings: DataFrame, at: str, payload: list[str], prefix: str = "", width_us: int | None = 30 * T.DAY) -> DataFrame:
    """`points` with the newest segment that covers `at`; an open one covers two minutes. A camera is cut by `width_us`."""
    r = recordings.withColumn("until_us", T.covers_until(F.col("started_us"), F.col("ended_us")))
    return asof.cover(points, r, ["camera_id"], at, "started_us", "until_us", payload, "recording_id", prefix, width_us)


def covering_or_middle(spans: DataFrame, recordings: DataFrame, start: str, end: str) -> DataFrame:
    """The segment at a span's start, else the one at its middle: recording_id.

    Both moments of a span go through one join. Equal rows are one while they are matched and come back as often as they were.
    """
    moments = F.array(F.struct(F.lit(0).alias("n"), F.col(start).cast("long").alias("at")), F.struct(F.lit(1).alias("n"), T.midpoint(F.col(start), F.col(end)).cast("long").alias("at")))
    points = spans.select(F.struct(*spans.columns).alias("_span"), "camera_id", F.explode(moments).alias("_m")).select("_span", "camera_id", F.col("_m.n").alias("_n"), F.col("_m.at").alias("_at"))
    met = covering_segment(points, recordings, "_at", ["recording_id"])
    first = F.min_by("recording_id", F.when(F.col("recording_id").isNotNull(), F.col("_n")))
    rows = met.groupBy("_span").agg(first.alias("recording_id"), F.count_if(F.col("_n") == 0).cast("int").alias("_copies"))
    return rows.select(F.explode(F.array_repeat("_span", F.col("_copies"))).alias("_span"), "recording_id").select(*(F.col(f"_span.`{c}`").alias(c) for c in spans.columns), "recording_id")


def in_window(recordings: DataFrame, since_us: int, until_us: int) -> DataFrame:
    return recordings.filter((T.covers_until(F.col("started_us"), F.col("ended_us")) >= since_us) & (F.col("started_us") <= until_us))


def closed(recordings: DataFrame) -> DataFrame:
    """Open segments end where the next of their camera begins and take the codec of the newest before them."""
    by = Window.partitionBy("camera_id").orderBy("started_us", "recording_id")
    codec = F.last("codec", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return recordings.withColumn("ended_us", F.coalesce("ended_us", F.lead("started_us").over(by))).withColumn("codec", codec)


def pins(recordings: DataFrame, tracks: DataFrame, roll_us: int, keep_until: Column, width_us: int = 30 * T.DAY) -> DataFrame:
    """recording_id, retain_until_us: the longest wish of the tracks that overlap a segment, with room before and after.

    An open segment reaches as far as time, which here is the last track. Of the tracks kept for the same time after
    their end, those that begin before a segment's end matter by the latest end alone: it is a running maximum, and no
    segment meets a track row by row. A segment is repeated for each length of time that its camera's tracks are kept.
    """
    last = tracks.agg(F.max("ended_us").alias("_last"))
    r = recordings.crossJoin(F.broadcast(last)).select("camera_id", "recording_id", F.col("started_us").alias("_s"), F.coalesce("ended_us", F.greatest(F.col("_last"), F.col("started_us"))).alias("_e"))  # one row
    stay = F.struct((keep_until - F.col("ended_us")).alias("us")).alias("_stay")
    t = tracks.withColumn("_stay", stay).select("camera_id", "_stay", (F.col("started_us") - roll_us).alias("_ts"), (F.col("ended_us") + roll_us).alias("_te"))
    asked = r.join(t.groupBy("camera_id").agg(F.collect_set("_stay").alias("_stays")), "camera_id").withColumn("_stay", F.explode("_stays")).drop("_stays")
    met = asof.highest(asked, t, ["camera_id", "_stay"], "_e", "_ts", "_te", width_us, "_till").filter(F.col("_till") >= F.col("_s"))
    return met.groupBy("recording_id").agg(F.max(F.col("_till") - roll_us + F.col("_stay.us")).alias("retain_until_us"))


def idle(recordings: DataFrame, tracks: DataFrame, roll_us: int, bucket_us: int = T.HOUR) -> DataFrame:
    """Closed segments that no track comes near."""
    r = recordings.filter(F.col("ended_us").isNotNull())
    t = tracks.select("camera_id", F.col("started_us").alias("_ts"), F.col("ended_us").alias("_te"))
    return rangejoin.semi(r, t, "recording_id", ["camera_id"], (F.col("started_us"), F.col("ended_us")), (F.col("_ts") - roll_us, F.col("_te") + roll_us), bucket_us, anti=True)


def prune(recordings: DataFrame, needed_bytes: int, now_us: int, most_share: float = 1.0) -> DataFrame:
    """Oldest closed segments without a live pin until so many bytes are free; none if that takes more than a share of all.

    The running total is over one order of all segments; it sums bytes a day first so that only the day
    in which the target falls is summed row by row.
    """
    able = recordings.filter(F.col("ended_us").isNotNull() & (F.col("retain_until_us").isNull() | (F.col("retain_until_us") <= now_us)))
    able = able.withColumn("_day", F.floor(F.col("started_us") / T.DAY).cast("long"))
    days = able.groupBy("_day").agg(F.sum("size_bytes").alias("_bytes"))
    before = days.withColumn("_earlier", F.coalesce(F.sum("_bytes").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = able.join(before.filter(F.col("_earlier") < needed_bytes).select("_day", "_earlier"), "_day")
    chosen = ranked.until_total(rows, ["_day"], [F.col("started_us"), F.col("recording_id")], "size_bytes", F.lit(needed_bytes) - F.col("_earlier"))
    if most_share < 1:
        total = recordings.agg((F.count("*") * most_share).alias("_most"))
        n = chosen.agg(F.count("*").alias("_n")).crossJoin(total)  # one row each
        chosen = chosen.crossJoin(F.broadcast(n.filter(F.col("_n") <= F.col("_most")).select("_n")))
    return chosen.select(recordings.columns)
