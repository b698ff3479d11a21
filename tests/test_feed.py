"""The feed's folds against the reference's order of doing things, in plain Python."""

from __future__ import annotations

import random

from vigilake.functions import times as T
from vigilake.operators import islands, visits

SPAN = 28 * T.DAY
FEED = "visit_id string, camera_id long, class_name string, kind string, started_us long, ended_us long"


def plain_fold(rows, settle):
    """fold_arrival_walk over the whole of each camera: no spans, no islands."""
    rows = sorted(map(dict, rows), key=lambda r: (r["started_us"], r["visit_id"]))
    people, gone = [r for r in rows if r["class_name"] == "person"], set()
    cars = [r for r in rows if r["class_name"] in visits.VEHICLE_NAMES]
    for v in (v for v in cars if v["kind"] in ("arrival", "visit")):
        for p in people:
            if p["visit_id"] in gone or p["camera_id"] != v["camera_id"] or p["started_us"] < v["started_us"] or p["started_us"] - v["ended_us"] > settle:
                continue
            v["ended_us"] = max(v["ended_us"], p["ended_us"])
            gone.add(p["visit_id"])
    for v in cars:
        gone |= {p["visit_id"] for p in people if p["camera_id"] == v["camera_id"] and v["started_us"] <= p["started_us"] and p["ended_us"] <= v["ended_us"]}
    return sorted(tuple(r.values()) for r in rows if r["visit_id"] not in gone)


def test_arrival_fold_does_not_cut_where_a_car_and_a_walk_meet(spark):
    rng, rows = random.Random(3), []
    for i in range(120):  # rows around three boundaries of the former spans, and far from them
        at = rng.choice([SPAN, 2 * SPAN, 3 * SPAN, 2 * SPAN + 5 * T.DAY]) + rng.randint(-1800, 1800) * T.SECOND
        rows.append((f"v{i:03}", i % 3, rng.choice(["person", "person", "car", "dog"]), rng.choice(["visit", "departure"]), at, at + rng.randint(5, 400) * T.SECOND))
    s, m = T.SECOND, 2 * SPAN  # a person after the boundary follows the car before it; another is inside a departure that crosses it
    rows += [("x1", 7, "car", "visit", m - 60 * s, m - 10 * s), ("x2", 7, "person", "visit", m + 20 * s, m + 50 * s)]
    rows += [("y1", 8, "car", "departure", m - 60 * s, m + 90 * s), ("y2", 8, "person", "visit", m + 20 * s, m + 50 * s)]
    names = [x.split()[0] for x in FEED.split(", ")]
    got = visits.arrival_fold(spark.createDataFrame(rows, FEED), 2 * T.MINUTE).collect()
    assert sorted(map(tuple, got)) == plain_fold([dict(zip(names, r, strict=True)) for r in rows], 2 * T.MINUTE)


def plain_feed(tracks, departures, walks):
    """list_sightings: departures without a claim after the sightings, then each walk onto the first row it meets, then the fold."""
    s, feed, taken = T.SECOND, [], set()
    for i, cam, name, a, z in sorted(tracks, key=lambda r: (r[3], r[0])):  # apart by more than the gap and short: each is a visit
        row = dict(visit_id=f"sighting:{cam}:anon:{a // s}", camera_id=cam, class_name=name, kind="visit", started_us=a, ended_us=z, left_with=None)
        near = sorted((abs(d[2] - z), d) for d in departures if cam in d[3] and abs(d[2] - z) <= 600 * s) if name == "car" else []
        if near:
            row["kind"] = "departure"
            taken.add(near[0][1][0])
        feed.append(row)
    for place, _, left, cams in departures:
        if place not in taken and cams:
            feed.append(dict(visit_id=f"dep:{place}:{left // s}", camera_id=cams[0], class_name="car", kind="departure", started_us=left - 60 * s, ended_us=left, left_with=None))
    for i, cam, a, z, name in sorted(walks):
        host = next((r for r in feed if r["camera_id"] == cam and r["class_name"] == "car" and r["started_us"] <= z and r["ended_us"] >= a), None)
        if host is None:
            feed.append(dict(visit_id=f"lwv:{i}", camera_id=cam, class_name="person", kind="left_with_vehicle", started_us=a, ended_us=z, left_with=None))
        else:
            host.update(started_us=min(host["started_us"], a), ended_us=max(host["ended_us"], z), left_with=name or host["left_with"])
    return plain_fold(feed, 2 * T.MINUTE)


def test_feed_matches_the_order_of_the_reference(spark):
    s, at = T.SECOND, 5 * SPAN + T.DAY
    tracks = [(1, 1, "car", at, at + 60 * s), (2, 1, "person", at + 90 * s, at + 120 * s), (3, 1, "car", at + 5000 * s, at + 5100 * s), (4, 2, "person", at, at + 30 * s)]
    tracks += [(5, 3, "person", at + 8010 * s, at + 8020 * s), (6, 1, "car", at + 20000 * s, at + 20050 * s), (7, 2, "dog", at, at + 30 * s)]
    departures = [("P1", at, at + 5130 * s, [1]), ("P2", at, at + 8030 * s, [3, 1]), ("P3", at, at + 9000 * s, [])]
    walks = [(1, 1, at + 4900 * s, at + 5050 * s, "Ana"), (2, 1, at + 4850 * s, at + 4910 * s, "Bo"), (3, 3, at + 7900 * s, at + 7990 * s, None), (4, 2, at + 9000 * s, at + 9050 * s, "Cy")]
    t = spark.createDataFrame(
        [(i, cam, {"car": "vehicle"}.get(name, name), name, a, z, 1, None, None, None, False, None, f"p/{i}") for i, cam, name, a, z in tracks],
        "track_id long, camera_id long, reid_group string, class_name string, started_us long, ended_us long, n_observations long, global_id string, identity_name string, plate_text string, face_verified boolean, suppressed_reason string, thumbnail string",
    )
    d = spark.createDataFrame(departures, "place string, occupied_us long, released_us long, cameras array<long>")
    w = spark.createDataFrame(walks, "walk_id long, camera_id long, started_us long, ended_us long, name string")
    got = visits.feed(t, d, walks=w).select("visit_id", "camera_id", "class_name", "kind", "started_us", "ended_us", "left_with").collect()
    want = plain_feed(tracks, departures, walks)
    assert {r[3] for r in want} == {"visit", "departure", "left_with_vehicle"} and {r[6] for r in want} == {None, "Bo"}
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_packs_hold_whole_runs_and_few_rows_more_than_asked(spark):
    rng, rows = random.Random(5), []
    for i in range(400):
        at = rng.randint(0, 4000)
        rows.append((i, i % 2, at, at + rng.randint(0, 12)))
    df = spark.createDataFrame(rows, "id long, camera_id long, s long, e long")
    start = df["s"]
    got = islands.packed(islands.stitched(df, ["camera_id"], start, df["e"], 3, "id"), ["camera_id"], start, "id", rows=10).collect()
    packs, runs = {}, {}
    for r in got:
        packs.setdefault((r.camera_id, r.pack), []).append(r)
        runs.setdefault((r.camera_id, r.run), []).append(r.pack)
    assert all(len(set(v)) == 1 for v in runs.values()) and 5 < len(packs) < len(runs)
    assert all(len(v) < 10 + max(map(len, runs.values())) for v in packs.values())
