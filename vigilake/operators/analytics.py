"""Counts over time, by camera and by kind; heat maps; dashboards; facets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import times as T


def where(df: DataFrame, conditions: Sequence[Column | None]) -> DataFrame:
    """All conditions that are given; Catalyst pushes what it can into the scan."""
    for c in conditions:
        if c is not None:
            df = df.filter(c)
    return df


def in_window(at: Column, since_us: int | None, until_us: int | None) -> Column | None:
    """since <= at < until."""
    parts = [at >= since_us] * (since_us is not None) + [at < until_us] * (until_us is not None)
    return parts[0] if len(parts) == 1 else parts[0] & parts[1] if parts else None


def overlaps_window(start: Column, end: Column, since_us: int, until_us: int) -> Column:
    return (end >= since_us) & (start < until_us)


def wanted_kinds(kind: Column, asked: str | None) -> Column:
    """The kind asked for; all but the bookkeeping one otherwise."""
    return kind == asked if asked else kind != "track_finalized"


def events_by_hour(events: DataFrame, since_us: int | None = None, until_us: int | None = None) -> DataFrame:
    rows = where(events, [in_window(F.col("at_us"), since_us, until_us)])
    return rows.groupBy(T.floor_to(F.col("at_us"), T.HOUR).alias("hour_us")).agg(F.count("*").alias("n"))


def dense_hours(counts: DataFrame, since_us: int, until_us: int) -> DataFrame:
    """Every hour of the window, with 0 where nothing happened."""
    hours = counts.sparkSession.range(since_us, until_us, T.HOUR).select(F.col("id").alias("hour_us"))
    return hours.join(counts, "hour_us", "left").select("hour_us", F.coalesce("n", F.lit(0)).alias("n"))


def hour_summary(dense: DataFrame) -> DataFrame:
    return dense.agg(F.avg("n").alias("average"), F.max("n").alias("peak"))


def per_camera(cameras: DataFrame, rows: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """Every camera with the measures of its rows, 0 without any. Rows are summed before they meet the cameras."""
    sums = rows.groupBy("camera_id").agg(*(c.alias(n) for n, c in measures.items()))
    return cameras.join(sums, "camera_id", "left").fillna(0, list(measures))


def by_kind(events: DataFrame) -> DataFrame:
    return events.groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "kind")


def dashboard(events: DataFrame, recordings: DataFrame, now_us: int) -> DataFrame:
    """One row of totals, each table read once."""
    day = F.col("at_us") >= now_us - T.DAY
    e = events.agg(
        F.count("*").alias("events"),
        F.count_if(day).alias("events_day"),
        F.count_distinct("kind").alias("kinds"),
        F.count_distinct(F.when(day, F.col("camera_id"))).alias("active_cameras"),
    )
    r = recordings.agg(F.count("*").alias("segments"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))
    return e.crossJoin(r)  # one row each


def heat_cells(points: DataFrame, columns: int = 32, rows: int = 18) -> DataFrame:
    """camera_id, day, heat_group, cell, n of normalised foot points (x, y)."""
    cell = G.heat_cell(F.col("x"), F.col("y"), columns, rows)
    return points.withColumn("cell", cell).filter(F.col("cell").isNotNull()).groupBy("camera_id", "day", "heat_group", "cell").agg(F.count("*").alias("n"))


def heat_arrays(cells: DataFrame, columns: int = 32, rows: int = 18) -> DataFrame:
    """A dense array of counts for each camera, day and group; cells with a number are at most columns * rows."""
    by = cells.groupBy("camera_id", "day", "heat_group").agg(F.map_from_entries(F.collect_list(F.struct("cell", "n"))).alias("m"))
    places = F.sequence(F.lit(0), F.lit(columns * rows - 1))
    return by.select("camera_id", "day", "heat_group", F.transform(places, lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0))).alias("cells"))


def heat_sum(arrays: DataFrame, keys: list[str]) -> DataFrame:
    """keys, cells: element-wise sums; arrays that are not of the commonest size of their keys are left out."""
    from . import ranked

    sized = arrays.withColumn("_size", F.size("cells"))
    common = ranked.best(sized.groupBy(*keys, "_size").count(), keys, [F.col("count").desc(), F.col("_size").desc()]).select(*keys, "_size")
    parts = sized.join(common, [*keys, "_size"]).select(*keys, F.posexplode("cells").alias("_i", "_v"))
    sums = parts.groupBy(*keys, "_i").agg(F.sum("_v").alias("_v"))
    return sums.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_v"))), lambda x: x["_v"]).alias("cells"))


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the sorted distinct values of each column; for columns of few values."""
    return df.agg(*(F.sort_array(F.collect_set(c)).alias(c) for c in columns))


def dominant(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    from . import ranked

    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return ranked.best(counts, keys, [F.col("n").desc(), F.col(value)])


def freshness(cameras: DataFrame, recordings: DataFrame, now_us: int, stale_us: int) -> DataFrame:
    """Age of each camera's newest recording in seconds and whether it is stale; none at all is stale."""
    newest = recordings.groupBy("camera_id").agg(F.max("started_us").alias("newest_us"))
    age = (F.lit(now_us) - F.col("newest_us")) / float(T.SECOND)
    return cameras.join(newest, "camera_id", "left").select("camera_id", age.alias("age_s"), (F.col("newest_us").isNull() | (now_us - F.col("newest_us") > stale_us)).alias("stale"))


def rates(samples: DataFrame, keys: list[str], at: str, counter: str) -> DataFrame:
    """Rate of a counter between its readings; null at the first and after a reset."""
    by = Window.partitionBy(*keys).orderBy(at)
    step, gap = F.col(counter) - F.lag(counter).over(by), (F.col(at) - F.lag(at).over(by)) / float(T.SECOND)
    return samples.withColumn("rate", F.when((gap > 0) & (step >= 0), step / gap))


def minute_collapse(passes: DataFrame) -> DataFrame:
    """Zone passes of one camera and zone within a minute as one."""
    minute = T.floor_to(F.col("at_us"), T.MINUTE).alias("minute_us")
    return passes.groupBy("camera_id", "kind", minute).agg(F.min("at_us").alias("first_us"), F.max("at_us").alias("last_us"), F.count("*").alias("n"))


def palette(df: DataFrame, order: list[str], colours: int = 12) -> DataFrame:
    """A colour number for every row, in turn; for small dimension tables such as cameras."""
    by = Window.orderBy(*order)
    return df.withColumn("colour", ((F.row_number().over(by) - 1) % colours).cast("int"))


def first_free_colour(used: DataFrame, colours: int = 12) -> DataFrame:
    """The least colour no camera has; their count modulo the palette when all are taken."""
    every = used.sparkSession.range(colours).select(F.col("id").cast("int").alias("colour"))
    free = every.join(used.select("colour").distinct(), "colour", "left_anti").agg(F.min("colour").alias("free"))
    n = used.agg((F.count("*") % colours).cast("int").alias("n"))
    return free.crossJoin(n).select(F.coalesce("free", "n").alias("colour"))


def confidence_vote(samples: DataFrame, keys: list[str], order: str, cap: float = 300.0) -> DataFrame:
    """keys, class_id, weight: the class with the largest sum of confidences; a person (class 0) wins at once.

    Whenever the running weights pass `cap` in total they are scaled back to it, so old votes fade. From the first
    time on the total is `cap` before each vote, so each later vote w scales by cap / (cap + w): a vote's final
    weight is its confidence times the factors from its own on, a running sum of logarithms. Of equal weights
    the class that voted first wins. Rows without class or confidence do not vote.
    """
    by = Window.partitionBy(*keys).orderBy(order, "class_id", "confidence")
    w = F.col("confidence").cast("double")
    rows = samples.select(*keys, order, "class_id", "confidence").filter(F.col("class_id").isNotNull() & F.col("confidence").isNotNull())
    rows = rows.withColumn("_sum", F.sum(w).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    factor = F.when(F.col("_sum") <= cap, 1.0).when(F.col("_sum") - w <= cap, cap / F.col("_sum")).otherwise(cap / (cap + w))
    fade = F.sum(F.log(factor)).over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    votes = rows.withColumn("_w", w * F.exp(fade)).groupBy(*keys, "class_id").agg(F.sum("_w").alias("weight"), F.min(order).alias("_first"), F.min_by("confidence", F.struct(F.col(order), F.col("confidence"))).alias("_opening"))
    person = F.col("class_id") == 0
    rank = F.struct(F.when(person, 0).otherwise(1), F.when(person, 0.0).otherwise(-F.col("weight")), F.col("_first"), F.col("class_id"))
    best = votes.groupBy(*keys).agg(F.min_by(F.struct("class_id", F.when(person, F.col("_opening").cast("double")).otherwise(F.col("weight")).alias("weight")), rank).alias("_best"))
    return best.select(*keys, F.col("_best.class_id").cast("int").alias("class_id"), F.col("_best.weight").alias("weight"))


def extents(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Least and largest centres, how far they are apart, and the last box's diagonal."""
    cx, cy = (F.col("box.x1") + F.col("box.x2")) / 2, (F.col("box.y1") + F.col("box.y2")) / 2
    out = samples.groupBy(*keys).agg(F.min(cx).alias("min_x"), F.max(cx).alias("max_x"), F.min(cy).alias("min_y"), F.max(cy).alias("max_y"), F.max_by("box", "at_us").alias("last_box"))
    w, h = F.col("last_box.x2") - F.col("last_box.x1"), F.col("last_box.y2") - F.col("last_box.y1")
    return out.withColumn("travel", F.hypot(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"))).withColumn("diagonal", F.hypot(w, h))


def finalizer_lag(events: DataFrame, finalized: DataFrame, most_us: int) -> DataFrame:
    """One row: newest event, newest finalized one, and whether the latter lags by more; null without any."""
    a, b = events.agg(F.max("at_us").alias("newest_us")), finalized.agg(F.max("at_us").alias("finalized_us"))
    return a.crossJoin(b).withColumn("lagging", F.col("newest_us") - F.col("finalized_us") > most_us)  # one row each
