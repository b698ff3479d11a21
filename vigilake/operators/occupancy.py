"""Parking places: fills, releases, names, histories."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import times as T
from . import rangejoin, ranked


def _served(reads: DataFrame) -> DataFrame:
    return reads.filter(~F.coalesce("departing", F.lit(False))).select("place", "read_id", "read_us", "readings", F.when(F.col("global_id").isNotNull(), 0).otherwise(1).alias("unmatched"))


def best_read(fills: DataFrame, reads: DataFrame, before_us: int = 5 * T.MINUTE, after_us: int = T.MINUTE) -> DataFrame:
    """fill_id, read_id: each fill's best read, matched first, then newest, then of most readings; a read may serve several.

    fills (fill_id, place, filled_us), reads (read_id, place, read_us, readings, global_id, departing).
    """
    r = _served(reads).select("place", "unmatched", F.col("read_us").alias("_o"), F.struct((-F.col("readings")).alias("most"), "read_id").alias("_tie"), F.struct("read_id").alias("_pay"))
    either = fills.select("fill_id", "place", (F.col("filled_us") + after_us).alias("_at"), F.explode(F.array(F.lit(0), F.lit(1))).alias("unmatched"))
    met = rangejoin.closest(either, r, ["place", "unmatched"], F.col("_at"), before_us + after_us, 0)
    # ends of fills that share an id differ, so the time itself decides
    best = met.groupBy("fill_id").agg(F.min_by("_found._pay.read_id", F.struct("unmatched", F.col("_found.gap_us") - F.col("_at"), "_found._tie")).alias("read_id"))
    return best.select("fill_id", "read_id")


def assigned_reads(fills: DataFrame, reads: DataFrame, before_us: int = 5 * T.MINUTE, after_us: int = T.MINUTE) -> DataFrame:
    """The same one to one: fills in order of time take the best read left. An ordered fold of a place's fills and reads.

    Reads come in as fills reach them, so the newest lie last in a list of matched and one of unmatched reads and are
    taken from there; where even the last is too old, all are.
    """
    f = fills.select("place", (F.col("filled_us") + after_us).alias("_at"), F.lit(1).alias("_side"), "fill_id")
    r = _served(reads).select("place", F.col("read_us").alias("_at"), F.lit(0).alias("_side"), "readings", "read_id", "unmatched")
    rows = f.unionByName(r, allowMissingColumns=True).filter(F.col("place").isNotNull() & F.col("_at").isNotNull())
    rows = rows.repartition("place").sortWithinPartitions("place", "_at", "_side", F.col("readings").asc_nulls_first(), F.col("read_id").desc(), "fill_id")
    kinds, span = dict(rows.dtypes), before_us + after_us

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, lists, taken, served = None, ([], []), set(), set()
        for batch in batches:
            out: list[tuple] = []
            columns = (batch.column(c).to_pylist() for c in ("place", "_at", "_side", "fill_id", "read_id", "unmatched"))
            for own, at, side, fill, read, unmatched in zip(*columns, strict=True):
                if own != place:
                    place, lists, taken, served = own, ([], []), set(), set()
                if side == 0:
                    lists[unmatched].append((at, read))
                    continue
                if fill in served:
                    continue
                for have in lists:
                    while have and have[-1][1] in taken:
                        have.pop()
                    if have and have[-1][0] < at - span:
                        have.clear()
                    if have:
                        out.append((fill, have[-1][1]))
                        taken.add(have.pop()[1])
                        served.add(fill)
                        break
            schema = [batch.schema.field("fill_id").type, batch.schema.field("read_id").type]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], schema[k]) for k in (0, 1)], names=["fill_id", "read_id"])

    return rows.mapInArrow(fold, f"fill_id {kinds['fill_id']}, read_id {kinds['read_id']}")


def departure_names(episodes: DataFrame, reads: DataFrame, used: DataFrame, slack_us: int = 3 * T.MINUTE) -> DataFrame:
    """episode_id, global_id: released, unnamed places named by the nearest read that no arrival used; matched first."""
    open_ = episodes.filter(F.col("released_us").isNotNull() & F.col("global_id").isNull()).select("episode_id", "place", "released_us", F.explode(F.array(F.lit(0), F.lit(1))).alias("_none"))
    free = reads.join(used.select("read_id").distinct(), "read_id", "left_anti")
    tie = F.struct(F.col("readings").isNull().alias("no"), (-F.col("readings")).alias("most"), "read_id")
    r = free.select("place", F.col("global_id").isNull().cast("int").alias("_none"), F.col("read_us").alias("_o"), tie.alias("_tie"), F.struct("global_id", "read_id").alias("_pay"))
    met = rangejoin.closest(open_, r, ["place", "_none"], F.col("released_us"), slack_us, slack_us)
    best = met.groupBy("episode_id").agg(F.min_by("_found._pay", F.struct("_none", "_found.gap_us", "_found._tie")).alias("_pay"))
    return best.select("episode_id", "_pay.global_id", "_pay.read_id")


def place_votes(verdicts: DataFrame) -> DataFrame:
    """place, present, empty from the regions that watch it."""
    return verdicts.groupBy("place").agg(F.bool_or(F.col("state") == "present").alias("present"), F.bool_or(F.col("state") == "empty").alias("empty"))


def reconciled(open_places: DataFrame, votes: DataFrame, now_us: int) -> DataFrame:
    """Claims and releases: a place is released on some `empty` and no `present`; all abstaining holds it."""
    got = votes.join(open_places.select("place", "occupied_us"), "place", "full")
    action = F.when(F.col("occupied_us").isNull() & F.col("present"), "claim").when(F.col("occupied_us").isNotNull() & F.coalesce("empty", F.lit(False)) & ~F.coalesce("present", F.lit(False)), "release").otherwise("hold")
    return got.select("place", action.alias("action"), F.when(action != "hold", F.lit(now_us)).alias("at_us"))


def rivals_demoted(open_places: DataFrame) -> DataFrame:
    """Of one vehicle's open places the best evidence, then the newest, keeps the name; the others lose it."""
    strength = F.when(F.col("evidence") == "plate", 0).when(F.col("evidence") == "face", 1).otherwise(2)
    by = Window.partitionBy("global_id").orderBy(strength, F.col("occupied_us").desc(), "place")
    return open_places.withColumn("_n", F.row_number().over(by)).withColumn("global_id", F.when(F.col("_n") == 1, F.col("global_id"))).drop("_n")


def announcements(episodes: DataFrame, announced: DataFrame, now_us: int, grace_us: int = 10 * T.MINUTE) -> DataFrame:
    """Released episodes not told yet, once named or after the grace time."""
    due = episodes.filter(F.col("released_us").isNotNull() & (F.col("global_id").isNotNull() | (F.col("released_us") <= now_us - grace_us)))
    return due.join(announced.select("episode_id").distinct(), "episode_id", "left_anti")


def departure_windows(episodes: DataFrame, persons: DataFrame, look_us: int = 120 * T.SECOND, bookend_us: int = 60 * T.SECOND) -> DataFrame:
    """episode_id, from_us, released_us: from the earliest person track just before, at least the bookend."""
    e = episodes.filter(F.col("released_us").isNotNull()).select("episode_id", F.explode("cameras").alias("camera_id"), "released_us")
    p = persons.select("camera_id", F.col("started_us").alias("_s"))
    met = rangejoin.overlapping(e, p, ["camera_id"], (F.col("released_us") - look_us, F.col("released_us")), (F.col("_s"), F.col("_s")), look_us)
    first = met.groupBy("episode_id").agg(F.min("_s").alias("_first"))
    rows = e.select("episode_id", "released_us").distinct()
    return rows.join(first, "episode_id", "left").select("episode_id", F.least(F.coalesce("_first", "released_us"), F.col("released_us") - bookend_us).alias("from_us"), "released_us")


def witness(episodes: DataFrame, cameras: DataFrame, plate_cameras: DataFrame) -> DataFrame:
    """episode_id, camera_id: the camera that read the plate, else the first by slug that watches."""
    e = episodes.select("episode_id", F.explode("cameras").alias("camera_id")).join(cameras.select("camera_id", "slug"), "camera_id")
    got = e.join(plate_cameras.select("episode_id", "camera_id", F.lit(True).alias("_read")), ["episode_id", "camera_id"], "left")
    return ranked.best(got, ["episode_id"], [F.col("_read").isNull(), F.col("slug")]).select("episode_id", "camera_id")


def vehicle_behind(fills: DataFrame, tracks: DataFrame, regions: DataFrame, before_us: int, after_us: int) -> DataFrame:
    """Fills at whose time a vehicle's track was near on a camera with a view of the place."""
    seen = regions.select("camera_id", "place").distinct()
    t = tracks.select("camera_id", F.col("started_us").alias("_s"), F.col("ended_us").alias("_e")).join(seen, "camera_id").drop("camera_id")
    return rangejoin.semi(fills, t, "fill_id", ["place"], (F.col("filled_us") - before_us, F.col("filled_us") + after_us), (F.col("_s"), F.col("_e")), T.HOUR)


def history(episodes: DataFrame, labels: DataFrame, since_us: int, until_us: int, now_us: int) -> DataFrame:
    """Places open or touched in a window, with the label's name or the plate, and how long."""
    rows = episodes.filter((F.col("occupied_us") < until_us) & (F.col("released_us").isNull() | (F.col("released_us") >= since_us)))
    got = rows.join(labels.select("global_id", "name", "plate"), "global_id", "left")
    return got.select("place", "occupied_us", "released_us", F.coalesce("name", "plate", "global_id").alias("name"), T.seconds_between(F.col("occupied_us"), F.coalesce("released_us", F.lit(now_us))).alias("stood_s"))


def one_open_each(episodes: DataFrame) -> DataFrame:
    """Violations of the rules of the table: two open rows of a place, two open places of a vehicle, a read used twice."""
    open_ = episodes.filter(F.col("released_us").isNull())
    twice = lambda df, key, rule: df.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("key")).count().filter("count > 1").select(F.lit(rule).alias("rule"), "key")
    return twice(open_, "place", "place").union(twice(open_, "global_id", "vehicle")).union(twice(episodes, "plate_read_id", "read"))


def grouped_cameras(open_places: DataFrame) -> DataFrame:
    return open_places.select("place", F.explode("cameras").alias("camera_id")).groupBy("place").agg(F.array_sort(F.collect_set("camera_id")).alias("cameras"))


def host_row(rows: DataFrame, feed: DataFrame, key: str, vehicle: Column) -> DataFrame:
    """key, host: the first vehicle row of the same camera that overlaps a row."""
    f = feed.filter(vehicle).select("camera_id", F.col("visit_id").alias("host"), F.col("started_us").alias("_s"), F.col("ended_us").alias("_e"))
    met = rangejoin.overlapping(rows, f, ["camera_id"], (F.col("started_us"), F.col("ended_us")), (F.col("_s"), F.col("_e")), T.HOUR)
    return ranked.best(met, [key], [F.col("_s"), F.col("host")]).select(key, "host")


def siblings(tracks: DataFrame, slack_us: int = 45 * T.SECOND, most: int = 4, bucket_us: int = 6 * T.HOUR) -> DataFrame:
    """track_id, sibling: vehicle tracks of other cameras near in time, the nearest few.

    Each bucket of time is one walk through its tracks in order of start: the next few that start and the last few that
    started and go on. A pair belongs to the bucket in which both have begun, so the few of all buckets hold the nearest few.
    """
    bucket = lambda t: F.floor(t / bucket_us).cast("long")
    low, high = F.col("started_us") - slack_us, F.col("ended_us") + slack_us
    rows = tracks.filter((low <= high) & F.col("camera_id").isNotNull()).select("track_id", "camera_id", "started_us", "ended_us", F.explode(F.sequence(bucket(low), bucket(high))).alias("_bucket"))
    rows = rows.repartition("_bucket").sortWithinPartitions("_bucket", "started_us", "track_id")
    kind = dict(tracks.dtypes)["track_id"]

    def of_bucket(number: int, own: list[tuple]) -> Iterator[tuple]:
        """(track, sibling, how far apart) of the tracks (start, id, end, camera), which are in order."""
        begin, end = number * bucket_us, (number + 1) * bucket_us
        going: list[tuple] = []  # started before the present row, in order of start, later ids first; those that ended go in bulk
        ends: list[int] = []
        ended, at = 0, 0
        inside = next((i for i, x in enumerate(own) if x[0] >= begin), len(own))  # none before it starts in this bucket
        for i, (start, track, until, camera) in enumerate(own):
            first = start - slack_us
            while own[at][0] < start:
                stop = at
                while stop < len(own) and own[stop][0] == own[at][0]:
                    stop += 1
                for x in reversed(own[at:stop]):
                    going.append(x)
                    heappush(ends, x[2])
                at = stop
            while ends and ends[0] < first:
                heappop(ends)
                ended += 1
            if 2 * ended > len(going):
                going, ended = [x for x in going if x[2] >= first], 0
            found = 0
            # what started before is met in this bucket only where this track, with its slack, begins here
            if begin <= first < end:
                for x in reversed(going):
                    if first <= x[2] and x[0] < end and x[3] != camera:
                        yield track, x[1], start - x[0]
                        found += 1
                        if found == most:
                            break
            elif first < begin <= start:  # but those that start here, after the slack began
                for x in reversed(going):
                    if x[0] < begin:
                        break
                    if first <= x[2] and x[0] < end and x[3] != camera:
                        yield track, x[1], start - x[0]
                        found += 1
                        if found == most:
                            break
            found = 0
            for x in _from(own, at if first >= begin else max(at, inside)):
                if x[0] > until + slack_us or x[0] >= end or found == most:
                    break
                if x[3] != camera and x[2] >= first:
                    yield track, x[1], x[0] - start
                    found += 1

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, own = None, []

        def told(rows: Iterator[tuple]) -> pa.RecordBatch:
            got = list(rows)
            kinds = (id_type, id_type, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in got], t) for k, t in enumerate(kinds)], names=["track_id", "sibling", "apart"])

        for batch in batches:
            id_type = batch.schema.field("track_id").type
            for x in zip(*(batch.column(c).to_pylist() for c in ("_bucket", "started_us", "track_id", "ended_us", "camera_id")), strict=True):
                if x[0] != number:
                    if own:
                        yield told(of_bucket(number, own))
                    number, own = x[0], []
                own.append(x[1:])
        if own:
            yield told(of_bucket(number, own))

    found = rows.mapInArrow(fold, f"track_id {kind}, sibling {kind}, apart long")
    return ranked.best(found, ["track_id"], [F.col("apart"), F.col("sibling")], most).select("track_id", "sibling")


def _from(items: list, at: int) -> Iterator:
    return (items[i] for i in range(at, len(items)))
