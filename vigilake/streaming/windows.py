"""Stateless streaming: minute buckets, sessions, presence and states of scenes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The largest slack used online; later rows are dropped.
WATERMARK = "2 minutes"


def minute_buckets(rows: DataFrame, keys: list[str], **measures) -> DataFrame:
    """Sums in tumbling minutes of event time `ts`."""
    return rows.withWatermark("ts", WATERMARK).groupBy(F.window("ts", "1 minute"), *keys).agg(F.count("*").alias("n"), *(c.alias(n) for n, c in measures.items()))


def sessions(rows: DataFrame, keys: list[str], gap: str = "5 seconds") -> DataFrame:
    """Sessions of a key that end after a silence."""
    out = rows.withWatermark("ts", WATERMARK).groupBy(F.session_window("ts", gap), *keys).agg(F.count("*").alias("n"))
    return out.select(*keys, F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "n")


def once(rows: DataFrame, key: str) -> DataFrame:
    """Rows without repeats of a key inside the watermark."""
    return rows.withWatermark("ts", WATERMARK).dropDuplicatesWithinWatermark([key])


def scene_states(readings: DataFrame, n: int) -> DataFrame:
    """region_id, at_us, state: a region's published state whenever n equal readings in a row change it."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, count, shown = state.get if state.exists else (None, 0, None)
        out = []
        for frame in [pd.concat(list(frames))]:
            for at, label in frame.sort_values("at_us")[["at_us", "label"]].itertuples(index=False):
                last, count = label, count + 1 if label == last else 1
                if count >= n and label != shown:
                    shown = label
                    out.append((key[0], at, label))
        state.update((last, count, shown))
        yield pd.DataFrame(out, columns=["region_id", "at_us", "state"])

    return readings.select("region_id", "at_us", "label").groupBy("region_id").applyInPandasWithState(run, "region_id long, at_us long, state string", "last string, count int, shown string", "append", GroupStateTimeout.NoTimeout)


def activity(counts: DataFrame, ticks: int = 2) -> DataFrame:
    """camera_id, at_us, active: a camera's verdict changes after so many equal ticks (a batch form of the same rule)."""
    from ..operators.telemetry import debounced

    return debounced(counts.withColumn("_on", F.col("n") > 0), ["camera_id"], "at_us", "_on", ticks).select("camera_id", "at_us", F.col("published").alias("active"))
