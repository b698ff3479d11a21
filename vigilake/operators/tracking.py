"""What a tracker publishes of its tracks, and what an embedder takes of them, as tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import times as T
from . import islands


def born(detections: DataFrame, keys: list[str], at: str, tie: str, eligible: Column) -> DataFrame:
    """Detections of tracks from the first eligible one on, however weak later ones are; earlier ones are not published."""
    by = Window.partitionBy(*keys).orderBy(at, tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return detections.withColumn("_born", F.max(F.coalesce(eligible, F.lit(False))).over(by)).filter("_born").drop("_born")


def held_boxes(detections: DataFrame, keys: list[str], at: str, tie: str, forget_us: int = T.MINUTE) -> DataFrame:
    """`detections` (box, confidence, motion_state) with held_box, held_confidence: of a track at rest the most
    confident box since it came to rest, the earlier of equals; an active track's own.

    Motion and a silence of more than forget_us end the hold. A null state is at rest, a null confidence the least.
    """
    order = Window.partitionBy(*keys).orderBy(at, tie)
    moves = F.coalesce(F.col("motion_state") == "active", F.lit(False))
    quiet = F.col(at) - F.lag(at).over(order) > forget_us
    rows = detections.withColumn("_moves", moves).withColumn("_n", F.row_number().over(order))
    fresh = F.col("_moves") | F.coalesce(F.lag("_moves").over(order), F.lit(True)) | F.coalesce(quiet, F.lit(False))
    grow = (Window.unboundedPreceding, Window.currentRow)
    runs = rows.withColumn("_fresh", F.when(fresh, 1).otherwise(0)).withColumn("_rest", F.sum("_fresh").over(order.rowsBetween(*grow)))
    best = F.max(F.struct("confidence", -F.col("_n"), "box")).over(Window.partitionBy(*keys, "_rest").orderBy("_n").rowsBetween(*grow))
    return runs.withColumn("_best", best).select(*detections.columns, F.col("_best.box").alias("held_box"), F.col("_best.confidence").alias("held_confidence"))


def due_for_embedding(detections: DataFrame, keys: list[str], at: str, tie: str, least: float = 0.30, active_us: int = T.SECOND // 2, rest_us: int = 5 * T.MINUTE) -> DataFrame:
    """Detections (confidence, motion_state) to embed: a track's first, then each that comes an interval after the last one taken.

    The interval is the short one in motion and the long one at rest (also without a state). Weak detections, and those
    without a confidence or a time, neither count nor come out. An ordered fold with one number as its state.
    """
    longest = max(active_us, rest_us)
    able = detections.filter((F.col("confidence") >= least) & F.col(at).isNotNull())
    wait = F.when(F.col("motion_state") == "active", active_us).otherwise(rest_us).cast("long")
    rows = islands.in_order(able.withColumn("_wait", wait), keys, at, tie, longest - 1)

    def take(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = 0
        for frame in frames:
            due = np.zeros(len(frame), bool)
            for i, (now, opens, interval) in enumerate(zip(frame[at].tolist(), frame._opens.tolist(), frame._wait.tolist(), strict=True)):
                if opens or now - last >= interval:
                    due[i], last = True, now
            yield frame[due].drop(columns=["_opens", "_wait"])

    return rows.mapInPandas(take, detections.schema)


def _extent(points: Column) -> Column:
    side = lambda k: F.array_max(F.transform(points, lambda p: p[k])) - F.array_min(F.transform(points, lambda p: p[k]))
    return F.hypot(side("x"), side("y"))


def displacement(detections: DataFrame, keys: list[str], at: str, tie: str, x: Column, y: Column, window_us: int = 8 * T.SECOND, threshold: float = 0.0) -> DataFrame:
    """`detections` with displacement and off_streak: the extent of a track's way over the last window_us, and the number
    of points in a row that lie more than twice `threshold` from the window's median.

    Of five points or more the one farthest from the median, the earliest of equals, may be left out: one wild box is no
    movement. The median is the upper one. Points that share a time see each other.
    """
    order = Window.partitionBy(*keys).orderBy(at, tie)
    near = Window.partitionBy(*keys).orderBy(at).rangeBetween(-window_us, Window.currentRow)
    point = F.struct(F.col(at).alias("at"), F.col(tie).alias("tie"), x.cast("double").alias("x"), y.cast("double").alias("y"))
    rows = detections.withColumn("_p", F.array_sort(F.collect_list(point).over(near)))
    middle = lambda k: F.element_at(F.array_sort(F.transform("_p", lambda p: p[k])), (F.floor(F.size("_p") / 2) + 1).cast("int"))
    rows = rows.withColumn("_m", F.struct(middle("x").alias("x"), middle("y").alias("y")))
    off = lambda p: (p["x"] - F.col("_m.x")) * (p["x"] - F.col("_m.x")) + (p["y"] - F.col("_m.y")) * (p["y"] - F.col("_m.y"))
    gaps = rows.withColumn("_g", F.transform("_p", off))
    worst = F.array_position("_g", F.array_max("_g"))
    trimmed = F.filter("_p", lambda p, i: i + 1 != worst)
    full = F.when(F.size("_p") < 2, 0.0).otherwise(_extent(F.col("_p")))
    away = F.hypot(x - F.col("_m.x"), y - F.col("_m.y")) > 2 * threshold
    got = gaps.withColumn("displacement", F.when(F.size("_p") < 5, full).otherwise(F.least(full, _extent(trimmed)))).withColumn("_away", away)
    back = F.sum(F.when(F.col("_away"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    streak = F.sum(F.when(F.col("_away"), 1).otherwise(0)).over(Window.partitionBy(*keys, "_back").orderBy(at, tie).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return got.withColumn("_back", back).withColumn("off_streak", streak).select(*detections.columns, "displacement", "off_streak")


#: Classes that count as vehicle and as animal for a camera's live state, and the kinds by weight.
LIVE_VEHICLES = (1, 2, 3, 5, 7)
LIVE_ANIMALS = tuple(range(14, 24))
LIVE_KINDS = ("person", "vehicle", "animal", "other")


def live_states(tracks: DataFrame, hold_us: int = T.MINUTE) -> DataFrame:
    """camera_id, at_us, motion, person_count, object_class: a camera's state at each message that changes it.

    `tracks` (camera_id, at_us, class_id, motion_state, ever_active) has a row for each track of a message, and one
    without a class for a message without tracks. Only tracks that were ever active count; without a state they move.
    motion stays true until hold_us after the last message with a moving track; object_class is the weightiest kind.
    """
    real = F.coalesce("ever_active", F.lit(False)) & F.col("class_id").isNotNull()
    c = F.col("class_id")
    rank = F.when(c == 0, 0).when(c.isin(*LIVE_VEHICLES), 1).when(c.isin(*LIVE_ANIMALS), 2).otherwise(3)
    moves = real & (F.lower(F.coalesce("motion_state", F.lit("active"))) == "active")
    seen = tracks.groupBy("camera_id", "at_us").agg(
        F.max(F.when(moves, F.col("at_us"))).alias("_moved"),
        F.sum(F.when(real & (c == 0), 1).otherwise(0)).alias("person_count"),
        F.min(F.when(real, rank)).alias("_rank"),
    )
    order = Window.partitionBy("camera_id").orderBy("at_us")
    last = F.max("_moved").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    moving = F.coalesce((F.col("at_us") == last) | (F.col("at_us") < last + hold_us), F.lit(False))
    kind = F.when(F.col("_rank").isNull(), "none").otherwise(F.element_at(F.array(*map(F.lit, LIVE_KINDS)), (F.col("_rank") + 1).cast("int")))
    body = F.struct(moving.alias("motion"), F.col("person_count"), kind.alias("object_class"))
    states = seen.select("camera_id", "at_us", body.alias("_s"))
    return states.withColumn("_b", F.lag("_s").over(order)).filter(~F.col("_s").eqNullSafe(F.col("_b"))).select("camera_id", "at_us", "_s.*")


def embedded(rows: DataFrame, item: str, make: Callable[[], Callable[[list], np.ndarray]], name: str = "embedding") -> DataFrame:
    """`rows` with `name`: the vector of `item`, null where it is null.

    `make` runs once in each task and returns the backend: a list of n items to an array of n vectors. A batch of rows,
    as Arrow cuts it, is one call.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = make()
        for frame in frames:
            known = frame[item].notna().to_numpy()
            got = iter(np.asarray(backend(frame[item][known].tolist()), "float32") if known.any() else ())
            yield frame.assign(**{name: [next(got) if k else None for k in known]})

    kept = [c for c in rows.columns if c != name]
    fields = ", ".join(f"`{c}` {t}" for c, t in rows.select(kept).dtypes)
    return rows.select(kept).mapInPandas(run, f"{fields}, `{name}` array<float>")
