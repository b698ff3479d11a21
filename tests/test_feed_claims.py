"""What a departure tells the feed's rows, and what a reader asks for, against plain Python over single-track visits."""

from __future__ import annotations

import random

import pytest

from vigilake.functions import times as T
from vigilake.operators import visits
from vigilake.operators.visits import Asked

S = T.SECOND
TRACKS = "track_id long, camera_id long, reid_group string, class_name string, started_us long, ended_us long, n_observations long, global_id string, identity_name string, plate_text string, face_verified boolean, suppressed_reason string, thumbnail string"
DEPARTURES = "place string, occupied_us long, released_us long, cameras array<long>, name string, global_id string, by_plate boolean, from_us long, witness long"
WALKS = "walk_id long, camera_id long, started_us long, ended_us long, name string, global_id string"
SHOWN = ["visit_id", "camera_id", "class_name", "kind", "started_us", "ended_us", "visit_s", "identity_name", "global_id", "face_verified"]


def scene(seed=4):
    rng, tracks, departures = random.Random(seed), [], []
    for i in range(60):  # an hour apart on each camera, so that each track is a visit
        at, cam = (i // 3) * 3600 * S + rng.randint(0, 500) * S, i % 3
        name = rng.choice(["car", "car", "truck", "dog"])
        end = at + rng.choice([rng.randint(20, 120), rng.randint(200, 900)]) * S
        tracks.append((i, cam, {"dog": "pet"}.get(name, "vehicle"), name, at, end, 5, f"g{i}", rng.choice([None, f"n{i}"]), None, rng.random() < 0.5, None, f"p/{i}"))
        if rng.random() < 0.6:
            left = end + rng.randint(-400, 900) * S
            own = rng.choice([None, "Ana", "Bo"])
            departures.append((f"P{i % 5}", left - rng.randint(100, 9000) * S, left, rng.choice([[cam], [cam, (cam + 1) % 3], [(cam + 1) % 3], []]), own, own and rng.choice([None, "g3", "g9"]), rng.random() < 0.5, rng.choice([None, left - 90 * S]), rng.choice([None, cam, 2])))
    return tracks, departures + [("P9", 5, None, [0], None, None, None, None, None)]


def plain(tracks, departures, a):
    out, taken = [], set()
    gone = sorted((d for d in departures if d[2] is not None and (a.since_us is None or d[2] >= a.since_us)), key=lambda d: (d[2], d[0], d[1]))
    for i, cam, _, name, start, end, _, gid, own, _, face, _, _ in tracks:
        if (a.camera_id is not None and cam != a.camera_id) or (a.since_us is not None and end < a.since_us) or (a.until_us is not None and start >= a.until_us) or (a.class_name or name) != name or (a.global_id or gid) != gid:
            continue
        vehicle, base = name in visits.VEHICLE_NAMES, f"sighting:{cam}:{gid if own else 'anon'}:{start // S}"
        row = dict(visit_id=base, camera_id=cam, class_name=name, kind="visit", started_us=start, ended_us=end, visit_s=(end - start) / S, identity_name=own, global_id=gid if own else None, face_verified=face)
        watched = [d for d in gone if cam in d[3]]
        first = next((d for d in watched if d[2] >= start), None)
        rows = [row]
        if vehicle and end - start > visits.SPLIT_US and first and first[2] <= end + visits.DEPARTURE_US:
            told = dict(visit_s=(first[2] - first[1]) / S)
            if first[4]:
                told |= dict(identity_name=first[4], global_id=first[5], face_verified=face and not first[6])
            rows = [row | told | dict(visit_id=base + ":arr", kind="arrival", ended_us=start + visits.BOOKEND_US)]
            rows.append(row | told | dict(visit_id=base + ":dep", kind="departure", started_us=first[7] or first[2] - visits.BOOKEND_US, ended_us=first[2]))
        for r in rows:
            near = min(((abs(d[2] - r["ended_us"]), n, d) for n, d in enumerate(watched) if abs(d[2] - r["ended_us"]) <= visits.DEPARTURE_US), default=None)
            if vehicle and near and r["kind"] != "arrival":
                d = near[2]
                taken.add((d[0], d[2]))
                if r["kind"] == "visit":
                    r |= dict(kind="departure", visit_s=(d[2] - d[1]) / S)
                    if d[4]:
                        r |= dict(identity_name=d[4], global_id=d[5])
            out.append(r)
    for d in gone:
        cam = a.camera_id if a.camera_id is not None else d[8]
        cam = (d[3] or [None])[0] if cam is None else cam
        if (d[0], d[2]) in taken or cam not in d[3] or (a.until_us is not None and d[2] >= a.until_us) or (a.global_id is not None and d[5] != a.global_id) or a.class_name not in (None, *visits.VEHICLE_NAMES):
            continue
        out.append(dict(visit_id=f"dep:{d[0]}:{d[2] // S}", camera_id=cam, class_name="car", kind="departure", started_us=d[7] or d[2] - 60 * S, ended_us=d[2], visit_s=(d[2] - d[1]) / S, identity_name=d[4], global_id=d[5], face_verified=False))
    return sorted((tuple(r[c] for c in SHOWN) for r in out), key=repr)


MID = 10 * 3600 * S


@pytest.mark.parametrize("asked", [Asked(), Asked(camera_id=1), Asked(since_us=MID), Asked(until_us=MID), Asked(class_name="car"), Asked(class_name="dog"), Asked(global_id="g3"), Asked(camera_id=2, since_us=MID // 2, until_us=MID, class_name="car")])
def test_feed_tells_what_departures_know_and_obeys_its_reader(spark, asked):
    tracks, departures = scene()
    got = visits.feed(spark.createDataFrame(tracks, TRACKS), spark.createDataFrame(departures, DEPARTURES), asked=asked)
    want = plain(tracks, departures, asked)
    assert sorted(map(tuple, got.select(SHOWN).collect()), key=repr) == want
    if asked == Asked():
        assert {r[3] for r in want} == {"visit", "arrival", "departure"} and sum(r[7] in ("Ana", "Bo") for r in want) > 8 and sum(r[0].startswith("dep:") for r in want) > 3


def test_walks_obey_the_reader_and_a_table_without_ids_has_none_of_an_identity(spark):
    w = spark.createDataFrame([(1, 1, 0, 10, "Ana", "a"), (2, 2, 5, 20, "Bo", "b"), (3, 1, 30, 40, None, None)], WALKS)
    ids = lambda asked, rows=w: sorted(r.walk_id for r in asked.walks(rows).collect())
    assert ids(Asked()) == [1, 2, 3] and ids(Asked(camera_id=1)) == [1, 3] and ids(Asked(until_us=20)) == [1] and ids(Asked(since_us=20)) == [2, 3]
    assert ids(Asked(global_id="b")) == [2] and ids(Asked(global_id="b"), w.drop("global_id")) == []


def test_rows_are_played_from_their_start_or_their_middle(spark):
    rows = spark.createDataFrame([("a", 1, 10 * S, 20 * S), ("b", 1, 100 * S, 200 * S), ("c", 1, 900 * S, 901 * S), ("a", 1, 10 * S, 20 * S)], "visit_id string, camera_id long, started_us long, ended_us long")
    segments = spark.createDataFrame([(7, 1, 5 * S, 15 * S), (8, 1, 140 * S, 160 * S)], "recording_id long, camera_id long, started_us long, ended_us long")
    got = visits.playable(rows, segments)
    assert got.columns == [*rows.columns, "recording_id", "seek_s"]
    assert sorted((r.visit_id, r.recording_id, r.seek_s) for r in got.collect()) == [("a", 7, 4.0), ("a", 7, 4.0), ("b", 8, 0.0), ("c", None, None)]
    assert visits.playable(rows.limit(0), segments).count() == 0
