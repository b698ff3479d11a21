"""Lives of tracks: scenes with known outcomes, and streams cut in several ways."""

from __future__ import annotations

import json
import os
import random

import pytest

from vigilake.streaming.lifecycle import MESSAGE, Rules, Zone, finished, stream_transitions, transitions
from vigilake.streaming.ordered import STATE_STORE

S = 1_000_000
CAR = 2
RIGHT = ((500.0, 0.0), (1000.0, 0.0), (1000.0, 1000.0), (500.0, 1000.0))
OUT, IN = 200, 700


def track(i, x, cls=0, conf=0.9, motion="active", **more):
    return {"track_id": i, "x1": x, "y1": 400.0, "x2": x + 100, "y2": 650.0, "class_id": cls, "confidence": conf, "motion_state": motion, **more}


def messages(ticks, camera=1, epoch=1):
    """One message a second from second 1; a tick is a list of tracks, or (epoch, tracks)."""
    return [(camera, i, i * S, t[0] if isinstance(t, tuple) else epoch, 1000, 1000, json.dumps(t[1] if isinstance(t, tuple) else t)) for i, t in enumerate(ticks, 1)]


def events(spark, rows, rules):
    got = transitions(spark.createDataFrame(rows, MESSAGE), rules).collect()
    return [(r.kind, r.zone, r.track_id, r.at_us / S) for r in sorted(got, key=lambda r: (r.at_us, r.track_id, r.kind))], got


def test_a_walk_through_a_zone(spark):
    ticks = [[track(1, OUT)]] * 2 + [[track(1, IN)]] * 5 + [[track(1, OUT)]]
    got, rows = events(spark, messages(ticks), Rules({1: (Zone("porch", RIGHT),)}, dwell_us=3 * S))
    assert got == [("zone_enter", "porch", 1, 3), ("zone_dwell", "porch", 1, 6), ("finalized", None, 1, 8), ("zone_exit", "porch", 1, 8)]
    assert [(r.n, r.started_us, r.ended_us) for r in rows if r.kind == "finalized"] == [(8, S, 8 * S)]


def test_a_zone_admits_by_class_confidence_and_dwell_and_keeps_its_cooldown(spark):
    porch = Zone("porch", RIGHT, min_dwell_us=2 * S, classes=(0,), min_confidence=0.5)
    first = [track(1, IN), track(2, IN, cls=CAR), track(3, IN, conf=0.4)]
    ticks = [first] * 3 + [[track(1, IN)], [track(1, OUT)]] + [[track(1, IN)]] * 3 + [[track(4, IN)], [track(4, OUT)]]
    got, _ = events(spark, messages(ticks), Rules({1: (porch,)}, dwell_us=3 * S, cooldown_us=60 * S))
    spoken = [e for e in got if e[0].startswith("zone")]
    assert spoken[:3] == [("zone_enter", "porch", 1, 3), ("zone_dwell", "porch", 1, 4), ("zone_exit", "porch", 1, 5)]
    assert all(e[0] == "zone_exit" and e[2] == 1 for e in spoken[3:])  # the end of track 1 leaves its zone


def test_a_parking_zone_hears_only_moving_vehicles(spark):
    ticks = [
        [track(1, OUT, CAR), track(2, IN, CAR, motion="parked"), track(3, OUT), track(4, OUT, CAR)],
        [track(1, IN, CAR, motion="parked"), track(2, IN, CAR, motion="parked"), track(3, IN, motion="parked"), track(4, IN, CAR)],
    ]
    got, _ = events(spark, messages(ticks), Rules({1: (Zone("park", RIGHT, moving_only=True),)}))
    assert [e[:3] for e in got if e[0] == "zone_enter"] == [("zone_enter", "park", 3), ("zone_enter", "park", 4)]


def test_rest_is_told_once_and_files_a_vehicles_visit_a_departure_is_a_new_one(spark):
    ticks = [
        [track(1, 300, CAR)], [track(1, 320, CAR, motion="stationary")], [track(1, 320, CAR, motion="parked")], [track(1, 340, CAR)],
        [track(2, 0, CAR)], [track(2, 0, CAR, motion="stationary")],
        [track(3, 500, CAR, motion="parked")], [track(3, 500, CAR, motion="parked")], [track(3, 520, CAR)], [track(3, 520, CAR, motion="stationary")],
        [track(4, 700, CAR, motion="stationary")], [track(4, 700, CAR, motion="parked")],
    ]
    got, rows = events(spark, messages(ticks), Rules())
    assert [e[:3] for e in got if e[0].endswith("parked")] == [("parked", None, 1), ("unparked", None, 1), ("unparked", None, 3), ("parked", None, 3)]
    visits = sorted((r.track_id, r.started_us // S, r.ended_us // S, r.n, r.came_to_rest) for r in finished(transitions(spark.createDataFrame(messages(ticks), MESSAGE), Rules())).collect())
    assert visits == [(1, 1, 2, 2, True), (1, 4, 4, 1, False), (2, 5, 6, 2, True), (3, 7, 10, 4, True), (4, 11, 12, 2, True)]


def test_a_continuation_carries_the_visit_and_absorbs_a_young_record(spark):
    ticks = [[track(1, IN, first_seen_us=-5 * S)], [track(1, IN)], [track(2, IN, continues_track_id=1)], [track(3, IN, first_seen_us=-3600 * S)], [track(3, IN, CAR, continues_track_id=2)]]
    got, rows = events(spark, messages(ticks), Rules({1: (Zone("porch", RIGHT),)}, dwell_us=4 * S, back_date_us=60 * S))
    assert [e for e in got if e[0].startswith("zone_e") and e[0] != "zone_exit"] == [("zone_enter", "porch", 1, 1), ("zone_enter", "porch", 3, 4)]
    assert [(r.track_id, r.n, r.class_id, r.started_us) for r in rows if r.kind == "finalized"] == [(3, 5, 0, -5 * S)]
    young = [r for r in rows if r.kind == "zone_enter" and r.track_id == 3]
    assert young[0].started_us == 4 * S - 60 * S  # back-dated so far at most


def test_a_new_generation_retires_records_and_an_old_one_is_not_heard(spark):
    ticks = [[track(1, IN), track(2, IN, CAR)], (2, [track(1, IN)]), (1, [track(7, IN)]), (2, [track(1, IN)])]
    _, rows = events(spark, messages(ticks), Rules())
    assert sorted((r.epoch, r.track_id, r.n) for r in rows) == [(1, 1, 1), (1, 2, 1), (2, 1, 2)]


def test_silence_ends_a_track_at_its_last_evidence(spark):
    ticks = [[track(1, OUT, last_matched_us=S)]] + [[]] * 5 + [[track(1, OUT)]] + [[]] * 8 + [[track(1, OUT)]]
    _, rows = events(spark, messages(ticks), Rules(silence_us=5 * S))
    assert sorted((r.started_us // S, r.ended_us // S, r.n) for r in rows) == [(1, 1, 1), (7, 7, 1), (16, 16, 1)]
    assert transitions(spark.createDataFrame([], MESSAGE), Rules()).collect() == []


def traffic(seed, n=240):
    rnd, rows = random.Random(seed), []
    for camera in (1, 2):
        at, epoch, alive, serial = 0, 1, {}, 0
        for i in range(n // 2):
            at += rnd.choice([S // 2, S, S, 2 * S, 4 * S]) if rnd.random() > 0.03 else rnd.choice([7 * S, 70 * S])
            epoch += rnd.random() < 0.02
            if rnd.random() < 0.25 or not alive:
                serial += 1
                alive[serial] = (rnd.randrange(0, 900), rnd.choice([0, CAR]))
            tracks = []
            for k in list(alive):
                if rnd.random() < 0.12:
                    if rnd.random() < 0.4:
                        serial += 1
                        alive[serial] = alive[k]
                        tracks.append(track(serial, *alive[k], continues_track_id=k))
                    del alive[k]
                elif rnd.random() < 0.8:
                    alive[k] = (min(900, max(0, alive[k][0] + rnd.randrange(-200, 200))), alive[k][1])
                    tracks.append(track(k, *alive[k], motion=rnd.choice(["active", "active", "stationary", "parked"])))
            rows.append((camera, i, at, epoch - (rnd.random() < 0.03), 1000, 1000, json.dumps(tracks)))
    return rows


@pytest.mark.parametrize("size", [30, 240])
def test_a_stream_gives_the_rows_of_the_table_however_it_is_cut(spark, tmp_path, size):
    rules = Rules({1: (Zone("porch", RIGHT, min_dwell_us=S),), 2: (Zone("park", RIGHT, moving_only=True),)}, dwell_us=3 * S, cooldown_us=20 * S)
    rows = sorted(traffic(7), key=lambda r: (r[2], r[0]))
    want = sorted(map(tuple, transitions(spark.createDataFrame(rows, MESSAGE).repartition(3), rules).collect()), key=str)
    names = [c.split()[0] for c in MESSAGE.split(", ")]
    (tmp_path / "in").mkdir()
    parts = [rows[a : a + size] for a in range(0, len(rows), size)] + [[(9, 0, rows[-1][2] + 600 * S, 1, 1000, 1000, "[]")]]
    for i, part in enumerate(parts):
        file = tmp_path / "in" / f"{i:03}.json"
        file.write_text("".join(json.dumps(dict(zip(names, r))) + "\n" for r in part))
        os.utime(file, (1_700_000_000 + 10 * i,) * 2)
    old = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        query = stream_transitions(stream, rules).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert query.awaitTermination(240) and query.exception() is None
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=str) == want
    assert {"zone_enter", "zone_exit", "zone_dwell", "parked", "unparked", "finalized"} <= {r[3] for r in want}
