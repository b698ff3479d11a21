"""Visits and the feed that is built from them."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import times as T
from . import asof, islands, rangejoin, ranked

GAP_US = 2 * T.MINUTE
BOOKEND_US, SPLIT_US, DEPARTURE_US, ARRIVAL_US = 40 * T.SECOND, 150 * T.SECOND, 600 * T.SECOND, 2 * T.MINUTE
UNSEEN_US = 60 * T.SECOND
VEHICLE_NAMES = ("car", "motorcycle", "bus", "truck")


def is_vehicle(class_name: Column) -> Column:
    return class_name.isin(*VEHICLE_NAMES)


def visits(tracks: DataFrame, group: str = "reid_group", gap_us: int = GAP_US) -> DataFrame:
    """One row per visit: tracks of a camera and class group, joined over short gaps.

    The longest track gives the picture, the majority of tracks the class, the first plate read the plate,
    the named identity with most observations the name; ties go to the earlier track.
    """
    runs = islands.stitched(tracks, ["camera_id", group], F.col("started_us"), F.col("ended_us"), gap_us, "track_id")
    keys = ["camera_id", group, "run"]
    length = F.col("ended_us") - F.col("started_us")
    early = F.struct(-F.col("started_us"), -F.col("track_id"))
    rows = runs.groupBy(*keys).agg(
        F.min("started_us").alias("started_us"),
        F.max("ended_us").alias("ended_us"),
        F.count("*").alias("n_tracks"),
        F.sum("n_observations").alias("n_observations"),
        F.max_by("thumbnail", F.struct(length, early)).alias("thumbnail"),
        F.min_by("thumbnail", F.struct("started_us", "track_id")).alias("arrival_thumbnail"),
        F.max_by("thumbnail", F.struct("ended_us", "track_id")).alias("departure_thumbnail"),
        F.min_by("plate_text", F.when(F.col("plate_text").isNotNull(), F.struct("started_us", "track_id"))).alias("plate_text"),
        F.max_by("identity_name", F.when(F.col("identity_name").isNotNull(), F.struct(F.col("n_observations"), early))).alias("identity_name"),
        F.max_by("global_id", F.when(F.col("identity_name").isNotNull(), F.struct(F.col("n_observations"), early))).alias("global_id"),
        F.bool_or(F.coalesce("face_verified", F.lit(False))).alias("face_verified"),
        F.array_sort(F.collect_list("track_id")).alias("track_ids"),
    )
    classes = ranked.majority(runs, keys, "class_name", "started_us").drop("votes")
    return rows.join(classes, keys).withColumn("visit_id", F.concat_ws(":", F.lit("sighting"), F.col("camera_id"), F.coalesce("global_id", F.lit("anon")), F.floor(F.col("started_us") / T.SECOND).cast("long")))


def _episodes(departures: DataFrame) -> DataFrame:
    """Closed stays with all columns that a departure may tell; those the caller's table lacks are null.

    Beside place, occupied_us, released_us, cameras: name and global_id of who stood there, by_plate where only a plate
    tells so, from_us where the clip begins, witness (the camera that watched it go).
    """
    more = {"name": "string", "global_id": "string", "by_plate": "boolean", "from_us": "long", "witness": departures.schema["cameras"].dataType.elementType}
    d = departures.filter(F.col("released_us").isNotNull())
    return d.select("place", "occupied_us", "released_us", "cameras", *((F.col(c) if c in departures.columns else F.lit(None)).cast(t).alias(c) for c, t in more.items()))


def expanded(rows: DataFrame, departures: DataFrame) -> DataFrame:
    """Visits of vehicles that stood long become an arrival and a departure row; others stay one.

    `departures` (see `_episodes`) corroborate: the first one of a camera from the visit's start to ten minutes after its
    end. Without it the visit stays whole. Both rows bear the name of who stood there, where the departure tells it; a
    name known by a plate is no verified face.
    """
    told = F.struct(F.col("occupied_us").alias("_since"), F.col("released_us").alias("_left"), "name", "global_id", "by_plate", "from_us")
    d = _episodes(departures).select(F.explode("cameras").alias("camera_id"), F.col("released_us").alias("_left"), (-F.col("occupied_us")).alias("_tie"), told.alias("_d"))
    near = asof.asof(rows, d, ["camera_id"], "started_us", "_left", ["_d"], "_tie", "forward")
    fits = is_vehicle(F.col("class_name")) & (F.col("ended_us") - F.col("started_us") > SPLIT_US) & (F.col("_d._left") <= F.col("ended_us") + DEPARTURE_US)
    got = near.withColumn("_d", F.when(fits, F.col("_d")))
    split = F.col("_d").isNotNull()
    named = F.col("_d.name").isNotNull()
    stood = F.when(split, T.seconds_between(F.col("_d._since"), F.col("_d._left")))
    whole = F.struct(F.lit("visit").alias("kind"), F.lit("").alias("suffix"), F.col("started_us").alias("s"), F.col("ended_us").alias("e"), F.col("thumbnail").alias("pic"))
    arrives = F.struct(F.lit("arrival").alias("kind"), F.lit(":arr").alias("suffix"), F.col("started_us").alias("s"), (F.col("started_us") + BOOKEND_US).alias("e"), F.col("arrival_thumbnail").alias("pic"))
    leaves = F.struct(F.lit("departure").alias("kind"), F.lit(":dep").alias("suffix"), F.coalesce("_d.from_us", F.col("_d._left") - BOOKEND_US).alias("s"), F.col("_d._left").alias("e"), F.col("departure_thumbnail").alias("pic"))
    out = got.withColumn("_row", F.explode(F.when(split, F.array(arrives, leaves)).otherwise(F.array(whole))))
    taken = {
        "identity_name": F.when(named, F.col("_d.name")).otherwise(F.col("identity_name")),
        "global_id": F.when(named, F.col("_d.global_id")).otherwise(F.col("global_id")),
        "face_verified": F.col("face_verified") & ~F.coalesce(named & F.col("_d.by_plate"), F.lit(False)),
    }
    keep = [taken[c].alias(c) if c in taken else F.col(c) for c in rows.columns if c not in ("visit_id", "started_us", "ended_us", "thumbnail")]
    return out.select(
        F.concat("visit_id", "_row.suffix").alias("visit_id"),
        *keep,
        F.col("_row.kind").alias("kind"),
        F.col("_row.s").alias("started_us"),
        F.col("_row.e").alias("ended_us"),
        F.col("_row.pic").alias("thumbnail"),
        F.coalesce(stood, T.seconds_between(F.col("started_us"), F.col("ended_us"))).alias("visit_s"),
    )


def claimed(feed: DataFrame, departures: DataFrame, slack_us: int = DEPARTURE_US) -> DataFrame:
    """The feed with claimed_place, claimed_us: the departure nearest to a vehicle row's end on a camera that watches.

    A whole visit that claims becomes a departure: it lasted as long as the place was taken, and bears the name and id of
    who stood there, where the departure tells a name. Of departures as near the earlier, then the smaller place.
    """
    told = F.struct(F.col("place").alias("place"), F.col("released_us").alias("us"), F.col("occupied_us").alias("since"), "name", "global_id")
    d = _episodes(departures).select(F.explode("cameras").alias("camera_id"), "released_us", told.alias("_d"))
    d = d.groupBy("camera_id", "released_us").agg(F.min("_d").alias("_d")).withColumn("_tie", F.lit(0))
    # both directions have the same keys: one shuffle serves the two
    both = asof.asof(feed, d, ["camera_id"], "ended_us", "released_us", ["_d"], "_tie", "backward", "_b")
    both = asof.asof(both, d, ["camera_id"], "ended_us", "released_us", ["_d"], "_tie", "forward", "_f")
    able = F.col("kind").isin("departure", "visit") & is_vehicle(F.col("class_name"))
    near = lambda c: F.struct(F.abs(F.col(f"{c}.us") - F.col("ended_us")).alias("gap"), F.col(f"{c}.us").alias("us"), F.col(c).alias("d"))
    found = F.array_min(F.filter(F.array(near("_b_d"), near("_f_d")), lambda x: x["gap"] <= slack_us))
    got = both.withColumn("_n", F.when(able, found)["d"])
    turns = (F.col("kind") == "visit") & F.col("_n.place").isNotNull()
    named = turns & F.col("_n.name").isNotNull()
    taken = {
        "kind": F.when(turns, "departure").otherwise(F.col("kind")),
        "visit_s": F.when(turns, T.seconds_between(F.col("_n.since"), F.col("_n.us"))).otherwise(F.col("visit_s")),
        "identity_name": F.when(named, F.col("_n.name")).otherwise(F.col("identity_name")),
        "global_id": F.when(named, F.col("_n.global_id")).otherwise(F.col("global_id")),
    }
    return got.select(*(taken[c].alias(c) if c in taken else F.col(c) for c in feed.columns), F.col("_n.place").alias("claimed_place"), F.col("_n.us").alias("claimed_us"))


def unclaimed(departures: DataFrame, feed: DataFrame) -> DataFrame:
    """Departures that no row of the feed claims."""
    taken = feed.filter(F.col("claimed_place").isNotNull()).select(F.col("claimed_place").alias("place"), F.col("claimed_us").alias("released_us")).distinct()
    return departures.join(taken, ["place", "released_us"], "left_anti")


def departure_rows(departures: DataFrame, like: DataFrame, camera_id: int | None = None) -> DataFrame:
    """Rows in the columns of the feed `like` for departures that no track saw.

    Shown from the camera asked for, else the witness, else the first that watches; without a camera that watches
    the place there is no row. They begin where the departure says, else a minute before it.
    """
    wanted = F.coalesce(F.lit(camera_id), F.col("witness"))
    shown = F.when(wanted.isNull(), F.get("cameras", F.lit(0))).when(F.array_contains("cameras", wanted), wanted)
    rows = _episodes(departures).withColumn("camera_id", shown).filter(F.col("camera_id").isNotNull())
    rows = rows.select(
        F.concat_ws(":", F.lit("dep"), "place", F.floor(F.col("released_us") / T.SECOND).cast("long").cast("string")).alias("visit_id"),
        "camera_id",
        F.lit("car").alias("class_name"),
        F.lit("departure").alias("kind"),
        F.coalesce("from_us", F.col("released_us") - UNSEEN_US).alias("started_us"),
        F.col("released_us").alias("ended_us"),
        F.col("name").alias("identity_name"),
        "global_id",
        T.seconds_between(F.col("occupied_us"), F.col("released_us")).alias("visit_s"),
    )
    return _shaped(rows, like)


def _shaped(rows: DataFrame, like: DataFrame) -> DataFrame:
    """`rows` in the columns of a feed: counts 0, not verified, no tracks, null what they do not have."""
    none = {"n_tracks": F.lit(0), "n_observations": F.lit(0), "face_verified": F.lit(False), "track_ids": F.array()}
    return rows.select(*((F.col(f.name) if f.name in rows.columns else none.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in like.schema))


def _dealt(rows: DataFrame, gap_us: int) -> DataFrame:
    """`rows` with `_pack`: those of a camera that can meet within the gap have one number; islands share it up to a few thousand rows."""
    start, end = F.col("started_us"), F.col("ended_us")
    return islands.packed(islands.stitched(rows, ["camera_id"], start, end, gap_us, "visit_id", "_span"), ["camera_id"], start, "visit_id", "_span", name="_pack").drop("_span")


def left_with_vehicle(feed: DataFrame, walks: DataFrame) -> DataFrame:
    """Persons who left by car ride on the car's row: its span covers both, `left_with` names the last one merged.

    `walks` (walk_id, camera_id, started_us, ended_us, name), merged one after another in the order of walk_id. A walk
    takes the first vehicle row that overlaps it as the earlier walks left it, visits before departures without a
    witness; a walk without one becomes a row of its own.
    """
    out = feed.withColumn("left_with", F.lit(None).cast("string"))
    w = walks.select(
        F.concat_ws(":", F.lit("lwv"), F.col("walk_id").cast("string")).alias("visit_id"),
        "camera_id",
        F.lit("person").alias("class_name"),
        F.lit("left_with_vehicle").alias("kind"),
        "started_us",
        "ended_us",
        F.col("name").alias("identity_name"),
        T.seconds_between(F.col("started_us"), F.col("ended_us")).alias("visit_s"),
        F.col("walk_id").alias("_walk"),
    )
    vehicle = F.coalesce(is_vehicle(F.col("class_name")), F.lit(False))
    cars = out.filter(vehicle).withColumn("_walk", F.lit(None).cast(w.schema["_walk"].dataType))
    both = cars.unionByName(_shaped(w.withColumn("left_with", F.col("identity_name")), cars))
    dealt = _dealt(both, 0)

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        walking = frame._walk.notna().to_numpy()
        frame = frame.assign(_unseen=frame.visit_id.str.startswith("dep:")).reset_index(drop=True)
        cars = frame[~walking].sort_values(["_unseen", "started_us", "visit_id"]).index.to_numpy()
        start, end, name, gone = frame.started_us.to_numpy(copy=True), frame.ended_us.to_numpy(copy=True), frame.left_with.tolist(), np.zeros(len(frame), bool)
        for i in frame[walking].sort_values(["_walk", "visit_id"]).index.tolist():
            met = cars[(start[cars] <= end[i]) & (end[cars] >= start[i])]
            if len(met):
                h = met[0]
                start[h], end[h], gone[i] = min(start[h], start[i]), max(end[h], end[i]), True
                name[h] = name[i] if name[i] is not None else name[h]
        name = [None if w else x for x, w in zip(name, walking.tolist(), strict=True)]
        return frame.assign(started_us=start, ended_us=end, left_with=pd.Series(name, dtype=object)).drop(columns="_unseen")[~gone]

    merged = dealt.groupBy("camera_id", "_pack").applyInPandas(merge, dealt.schema).select(out.columns)
    return out.filter(~vehicle).unionByName(merged)


def arrival_fold(feed: DataFrame, settle_us: int = ARRIVAL_US) -> DataFrame:
    """Vehicle rows take in the persons who follow within the settle time; persons inside a vehicle's row go.

    An ordered fold of the rows of a camera between which something can happen: a row that starts more than the
    settle time after all earlier ones of its camera have ended neither takes in nor is taken in by any of them.
    """

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["started_us", "visit_id"], kind="stable").reset_index(drop=True)
        start, end = frame.started_us.tolist(), frame.ended_us.tolist()
        person = np.flatnonzero(frame.class_name.to_numpy() == "person")
        cars = np.flatnonzero(frame.class_name.isin(VEHICLE_NAMES).to_numpy())
        taking = frame.kind.isin(["arrival", "visit"]).to_numpy()
        starts, gone = frame.started_us.to_numpy()[person], np.zeros(len(frame), bool)
        for i in cars[taking[cars]].tolist():
            for p in person[np.searchsorted(starts, start[i]) :].tolist():
                if start[p] - end[i] > settle_us:
                    break
                if not gone[p]:
                    end[i], gone[p] = max(end[i], end[p]), True
        for i in cars.tolist():
            for p in person[np.searchsorted(starts, start[i]) : np.searchsorted(starts, end[i], "right")].tolist():
                gone[p] |= end[p] <= end[i]
        return frame.assign(ended_us=end)[~gone]

    names = feed.columns
    dealt = _dealt(feed, max(settle_us, 0))
    return dealt.groupBy("camera_id", "_pack").applyInPandas(fold, dealt.schema).select(names)


@dataclass(frozen=True)
class Asked:
    """What a reader of the feed asks for; None asks for all."""

    camera_id: int | None = None
    since_us: int | None = None
    until_us: int | None = None
    class_name: str | None = None
    global_id: str | None = None

    def _where(self, df: DataFrame, **tests: Callable) -> DataFrame:
        for name, test in tests.items():
            if (value := getattr(self, name)) is not None:
                df = df.filter(test(F.lit(value)))
        return df

    def tracks(self, tracks: DataFrame) -> DataFrame:
        """Tracks not over before the window nor begun after it, of the camera, class and identity."""
        c = F.col
        return self._where(tracks, camera_id=lambda v: c("camera_id") == v, since_us=lambda v: c("ended_us") >= v, until_us=lambda v: c("started_us") < v, class_name=lambda v: c("class_name") == v, global_id=lambda v: c("global_id") == v)

    def departures(self, departures: DataFrame) -> DataFrame:
        """Departures since the window's start; they may be claimed whatever else is asked."""
        return self._where(departures, since_us=lambda v: F.col("released_us") >= v)

    def unseen(self, departures: DataFrame) -> DataFrame:
        """Of departures nobody claims, those a row may tell: a vehicle, before the window's end, on the camera, of the identity."""
        if self.class_name is not None and self.class_name not in VEHICLE_NAMES:
            return departures.limit(0)
        known = F.col("global_id") if "global_id" in departures.columns else F.lit(None)
        return self._where(departures, until_us=lambda v: F.col("released_us") < v, camera_id=lambda v: F.array_contains("cameras", v), global_id=lambda v: known == v)

    def walks(self, walks: DataFrame) -> DataFrame:
        """Walks that end in the window, on the camera, of the identity (all have none where the table has no global_id)."""
        known = F.col("global_id") if "global_id" in walks.columns else F.lit(None)
        return self._where(walks, camera_id=lambda v: F.col("camera_id") == v, since_us=lambda v: F.col("ended_us") >= v, until_us=lambda v: F.col("ended_us") < v, global_id=lambda v: known == v)


def feed(tracks: DataFrame, departures: DataFrame, limit: int | None = None, fetch: int | None = None, walks: DataFrame | None = None, asked: Asked = Asked()) -> DataFrame:
    """Tracks to feed rows: filter, cluster, expand, claim, add what left unclaimed, merge walks to a car, fold, newest first.

    `fetch` clusters only so many newest tracks, as a paging reader would; the default takes all.
    """
    rows = asked.tracks(tracks)
    rows = rows if fetch is None else rows.orderBy(F.col("started_us").desc(), F.col("track_id").desc()).limit(fetch)
    gone = asked.departures(departures)
    # both are read several times below; a lost part of the cache is computed again
    seen = claimed(expanded(visits(rows), gone), gone).persist()
    out = seen.unionByName(departure_rows(asked.unseen(unclaimed(gone, seen)), seen, asked.camera_id)).persist()
    if walks is not None:
        out = left_with_vehicle(out, asked.walks(walks))
    out = arrival_fold(out)
    out = out.orderBy(F.col("started_us").desc(), "visit_id")
    return out if limit is None else out.limit(limit)


def playable(feed: DataFrame, segments: DataFrame) -> DataFrame:
    """The feed with recording_id and seek_s: the segment at a row's start, else at its middle, and a second of lead."""
    from . import recordings

    spans = feed.select("visit_id", "camera_id", "started_us", "ended_us").distinct()
    met = recordings.covering_or_middle(spans, segments, "started_us", "ended_us").join(segments.select("recording_id", F.col("started_us").alias("_from")), "recording_id", "left")
    keys = ["visit_id", "camera_id", "started_us", "ended_us"]
    seek = F.greatest(F.lit(0.0), T.seconds_between(F.col("_from"), F.col("started_us")) - 1)
    found = met.select(*(F.col(k).alias(f"_{i}") for i, k in enumerate(keys)), "recording_id", F.when(F.col("_from").isNotNull(), seek).alias("seek_s"))
    same = [feed[k].eqNullSafe(found[f"_{i}"]) for i, k in enumerate(keys)]
    return feed.join(found, same, "left").drop(*(f"_{i}" for i in range(len(keys))))



def zone_dwell(events: DataFrame, enter: str = "zone_enter", leave: str = "zone_exit") -> DataFrame:
    """track_id, zone, dwell_s, n: enter to exit summed; entering again while inside and an open end add nothing."""
    rows = events.filter(F.col("kind").isin(enter, leave)).select("track_id", "zone", "at_us", F.when(F.col("kind") == enter, 1).otherwise(0).alias("inside"), "event_id")
    by = Window.partitionBy("track_id", "zone").orderBy("at_us", "event_id")
    edge = rows.withColumn("_was", F.coalesce(F.lag("inside").over(by), F.lit(0))).filter(F.col("inside") != F.col("_was"))
    spans = edge.withColumn("_next", F.lead("at_us").over(by)).filter("inside = 1")
    return spans.groupBy("track_id", "zone").agg(F.coalesce(F.sum(F.col("_next") - F.col("at_us")), F.lit(0)).alias("dwell_us"), F.count("*").alias("n"))


def pass_spans(events: DataFrame, tracks: DataFrame, cap_us: int, enter: str = "zone_enter", leave: str = "zone_exit") -> DataFrame:
    """track_id, zone, enter_us, exit_us: the first enter of a stay wins; a span is capped, an open one ends with its track."""
    rows = events.filter(F.col("kind").isin(enter, leave)).select("track_id", "zone", "at_us", F.when(F.col("kind") == enter, 1).otherwise(0).alias("inside"), "event_id")
    by = Window.partitionBy("track_id", "zone").orderBy("at_us", "event_id")
    edge = rows.withColumn("_was", F.coalesce(F.lag("inside").over(by), F.lit(0))).filter(F.col("inside") != F.col("_was"))
    spans = edge.withColumn("_next", F.lead("at_us").over(by)).filter("inside = 1").join(tracks.select("track_id", "ended_us"), "track_id", "left")
    return spans.select("track_id", "zone", F.col("at_us").alias("enter_us"), F.least(F.coalesce("_next", "ended_us", "at_us"), F.col("at_us") + cap_us).alias("exit_us"))


def walk_to_drive_off(departures: DataFrame, unparked: DataFrame, persons: DataFrame, horizon_us: int = 10 * T.MINUTE, gap_us: int = 30 * T.SECOND, fallback_us: int = BOOKEND_US) -> DataFrame:
    """departure_id, opens_us, closes_us: from the unbroken run of persons before a car moved until it cleared.

    departures (departure_id, camera_id, closes_us), unparked (camera_id, at_us), persons (track_id, camera_id, started_us, ended_us).
    """
    u = unparked.select("camera_id", F.col("at_us").alias("_o"), F.struct(F.lit(0).alias("n")).alias("_tie"), F.struct("at_us").alias("_pay"))
    moved = rangejoin.closest(departures.select("departure_id", "camera_id", "closes_us"), u, ["camera_id"], F.col("closes_us"), horizon_us - 1, 0)
    d = departures.join(moved.groupBy("departure_id").agg(F.max("_found._pay.at_us").alias("_u")), "departure_id", "left").withColumn("moves_us", F.coalesce("_u", F.col("closes_us") - fallback_us)).drop("_u")
    first = _first_of_walk(d, persons, horizon_us, gap_us)
    return d.join(first, "departure_id", "left").select("departure_id", F.least(F.coalesce(F.least("_first", "moves_us"), "moves_us"), F.col("closes_us") - fallback_us).alias("opens_us"), "closes_us")


def _first_of_walk(d: DataFrame, persons: DataFrame, horizon_us: int, gap_us: int) -> DataFrame:
    """departure_id, _first: where the walk begins that leads to moves_us.

    Of the persons who left within the horizon, from the one who came last backwards: a person joins who left no more than the gap
    before the next one came. Time is cut into buckets that also have the persons of the horizon before them; a bucket
    is folded in order of time with those persons, and the breaks between them, in order of arrival.
    """
    width = max(2 * horizon_us, 1)
    at = lambda df, c: df.filter(F.col("camera_id").isNotNull() & F.col(c).isNotNull())
    own = at(d, "moves_us").select("camera_id", F.floor(F.col("moves_us") / width).cast("long").alias("_bucket"), F.col("moves_us").alias("_at"), F.lit(1).alias("_side"), "departure_id")
    reach = F.sequence(F.floor(F.col("ended_us") / width).cast("long"), F.floor((F.col("ended_us") + horizon_us - 1) / width).cast("long"))
    p = at(persons, "ended_us").filter(F.col("started_us").isNotNull()).select("camera_id", F.explode(reach).alias("_bucket"), F.col("ended_us").alias("_at"), F.lit(0).alias("_side"), F.col("started_us").alias("_s"), F.col("track_id").alias("_p"))
    rows = own.unionByName(p, allowMissingColumns=True).repartition("camera_id", "_bucket").sortWithinPartitions("camera_id", "_bucket", "_at", "_side")
    kind = dict(d.dtypes)["departure_id"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n = None, 0
        held: list[tuple] = []  # (start, person, number, end) by arrival
        breaks: list[tuple] = []  # those before whom the walk breaks off
        leaving: deque[tuple] = deque()
        torn = lambda i: 0 < i < len(held) and held[i][0] - held[i - 1][3] > gap_us
        for batch in batches:
            ids, firsts = [], []
            columns = (batch.column(c).to_pylist() for c in ("camera_id", "_bucket", "_at", "_side", "_s", "_p", "departure_id"))
            for camera, bucket, at, side, start, person, departure in zip(*columns, strict=True):
                if (camera, bucket) != key:
                    key, held, breaks, leaving = (camera, bucket), [], [], deque()
                while leaving and leaving[0][3] <= at - horizon_us:
                    x = leaving.popleft()
                    i = bisect_left(held, x)
                    for k in (i, i + 1):
                        if torn(k):
                            del breaks[bisect_left(breaks, held[k])]
                    del held[i]
                    if torn(i):
                        insort(breaks, held[i])
                if side == 0:
                    n += 1
                    x = (start, person, n, at)
                    i = bisect_left(held, x)
                    if torn(i):
                        del breaks[bisect_left(breaks, held[i])]
                    held.insert(i, x)
                    leaving.append(x)
                    for k in (i, i + 1):
                        if torn(k):
                            insort(breaks, held[k])
                elif held:
                    ids.append(departure)
                    firsts.append(breaks[-1][0] if breaks else held[0][0])
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("departure_id").type), pa.array(firsts, pa.int64())], names=["departure_id", "_first"])

    return rows.mapInArrow(fold, f"departure_id {kind}, _first long").groupBy("departure_id").agg(F.min("_first").alias("_first"))


def evidence_end(samples: DataFrame, keys: list[str]) -> DataFrame:
    """keys, evidence_us: the last time at which the confidence was not a mere repeat."""
    by = Window.partitionBy(*keys).orderBy("at_us", "sample_id")
    changed = samples.withColumn("_c", ~F.col("confidence").eqNullSafe(F.lag("confidence").over(by)) | (F.row_number().over(by) == 1))
    return changed.filter("_c").groupBy(*keys).agg(F.max("at_us").alias("evidence_us"))


def lost_tracks(samples: DataFrame, tracks: DataFrame, keys: list[str], gap_us: int, least_n: int, least_us: int, slack_us: int) -> DataFrame:
    """Runs of samples that no track covers within the slack: keys, started_us, ended_us, n."""
    runs = islands.stitched(samples, keys, F.col("at_us"), F.col("at_us"), gap_us, "sample_id")
    rows = runs.groupBy(*keys, "run").agg(F.min("at_us").alias("started_us"), F.max("at_us").alias("ended_us"), F.count("*").alias("n"))
    rows = rows.filter((F.col("n") >= least_n) & (F.col("ended_us") - F.col("started_us") >= least_us)).withColumn("_id", F.xxhash64(*keys, "run"))
    t = tracks.select(*keys, F.col("started_us").alias("_s"), F.col("ended_us").alias("_e"))
    return rangejoin.semi(rows, t, "_id", keys, (F.col("started_us") - slack_us, F.col("ended_us") + slack_us), (F.col("_s"), F.col("_e")), T.HOUR, anti=True).drop("_id", "run")


def members(tracks: DataFrame, asked: DataFrame, ids: str) -> DataFrame:
    """Tracks whose id lies in one of the arrays `ids` of `asked`; each once."""
    return tracks.join(asked.select(F.explode(ids).alias("track_id")).distinct(), "track_id", "left_semi")


def zone_passes(rows: DataFrame, events: DataFrame) -> DataFrame:
    """visit_id, kind, n, first_us: the events of a visit's tracks (`track_ids`), by kind."""
    ids = rows.select("visit_id", F.explode(F.array_distinct("track_ids")).alias("track_id"))
    return ids.join(events.select("track_id", "kind", "at_us"), "track_id").groupBy("visit_id", "kind").agg(F.count("*").alias("n"), F.min("at_us").alias("first_us"))


def event_list(events: DataFrame, tracks: DataFrame, segments: DataFrame, camera: Column) -> DataFrame:
    """Events with their track's class and the recording of `camera` that covers them."""
    from . import recordings

    named = events.join(tracks.select("track_id", "class_name"), "track_id", "left").withColumn("_own", F.col("camera_id")).withColumn("camera_id", camera)
    return recordings.covering_segment(named, segments, "at_us", ["recording_id"]).withColumn("camera_id", F.col("_own")).drop("_own")
