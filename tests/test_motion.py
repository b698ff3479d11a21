"""The motion machine: scenes with known outcomes, a plain version over whole histories, and streams cut in three ways."""

from __future__ import annotations

import json
import os
import random
from math import hypot

import pytest

from vigilake.streaming import motion
from vigilake.streaming.ordered import STATE_STORE

S = 1_000_000
RULES = motion.Motion(park_us=30 * S)
SCHEMA = "camera_id long, at_us long, detection_id long, track_id long, class_name string, x1 double, y1 double, x2 double, y2 double, coasted boolean"


def run(rows, rules=RULES):
    """States by the fold alone; a row is (at, track, box) with class car, or has class and coasted too."""
    scene, out = motion.Scene(rules), []
    for i, (at, track, box, *more) in enumerate(rows):
        row = {"at_us": at, "detection_id": i, "track_id": track, "class_name": more[0] if more else "car", "coasted": len(more) > 1 and more[1]}
        scene.expire(at - 1)
        out += scene.take(row | dict(zip(("x1", "y1", "x2", "y2"), box, strict=True)))
    return out, scene


BOX = (100.0, 100.0, 200.0, 200.0)


def moved(box, dx, dy=0.0):
    return (box[0] + dx, box[1] + dy, box[2] + dx, box[3] + dy)


def test_still_then_parked_and_the_clock_counts_stillness():
    out, _ = run([(i * S, 1, BOX) for i in range(60)])
    states = [r[3] for r in out]
    assert states[:8] == ["active"] * 8 and states[8:38] == ["stationary"] * 30 and states[38:] == ["parked"] * 22
    assert out[-1][4] == 8 * S and not out[-1][5]


def test_one_stray_box_does_not_hold_stillness_up_and_a_flip_does_not_end_it():
    rows = [(i * S, 1, moved(BOX, 90) if i in (3, 20, 21) else BOX) for i in range(40)]
    assert run(rows)[0][11][3] == "stationary" and all(r[3] != "active" for r in run(rows)[0][12:])


def test_three_far_sightings_end_it_and_clear_every_spot_there():
    rows = [(i * S, 1, BOX) for i in range(20)]
    rows += [(20 * S + k, 10 + k, BOX) for k in range(3)]  # other tracks on the same spot, born parked
    rows += [((21 + i) * S, 1, moved(BOX, 90)) for i in range(3)] + [(25 * S, 99, BOX), (26 * S, 98, moved(BOX, 90))]
    out, scene = run(rows)
    assert [r[3] for r in out[20:23]] == ["parked"] * 3 and [r[3] for r in out[23:26]] == ["stationary", "stationary", "active"]
    # the spots under the box at the third far sighting go; those of other places stay
    assert "s/1" not in scene.entries and {"s/10", "s/11", "s/12"} <= scene.entries.keys()
    assert out[-2][3] == "parked" and out[-1][3] == "active"


def test_a_new_track_on_a_spot_carries_on_its_clock_until_the_spot_ends():
    still = [(i * S, 1, BOX) for i in range(20)]
    for pause, want in ((7200, ("parked", 8 * S)), (7201, ("active", 19 * S + 7201 * S))):
        out, _ = run([*still, (19 * S + pause * S, 2, moved(BOX, 10))])
        assert out[-1][3:5] == want
    assert run([*still, (30 * S, 2, BOX, "person")])[0][-1][3] == "active"  # another class


def test_travel_is_known_at_a_spot_and_only_own_travel_renews_it():
    walk = [(i * S, 1, moved(BOX, 40 * i)) for i in range(5)]
    rest = [((5 + i) * S, 1, moved(BOX, 160)) for i in range(20)]
    out, scene = run(walk + rest)
    assert out[-1][3] == "stationary" and out[-1][5] and out[-1][6]
    earned = scene.entries["t/1"]["travelled"]
    heirs, t, track = [], 60 * S, 2
    while t < earned + 7400 * S:
        heirs.append((t, track, moved(BOX, 160)))
        t, track = t + 100 * S, track + 1
    out, _ = run(walk + rest + heirs)
    inherited = [(r[0], r[5], r[7]) for r in out[25:]]
    assert all(known == (at - earned < 7200 * S) and static != known for at, known, static in inherited)
    assert {known for _, known, _ in inherited} == {True, False}


def test_a_coasted_box_does_not_testify():
    rows = [(0, 1, BOX)] + [(i * S, 1, BOX, "car", True) for i in range(1, 50)] + [(50 * S, 7, BOX, "car", True)]
    out, scene = run(rows)
    assert {r[3:7] for r in out[:-1]} == {("active", 0, False, False)} and out[-1][3:5] == ("active", 0) and "t/7" not in scene.entries


def plain(rows, rules):
    """By definition, from whole lists: every sighting of a track since it began, every spot ever left."""
    tracks, spots, out = {}, [], []
    for row in sorted(rows, key=lambda r: (r["at_us"], r["detection_id"])):
        at, tid, kind = row["at_us"], row["track_id"], row["class_name"]
        box = [row[c] for c in ("x1", "y1", "x2", "y2")]
        x, y, size = (box[0] + box[2]) / 2, (box[1] + box[3]) / 2, hypot(box[2] - box[0], box[3] - box[1])
        live = [s for s in spots if s["kind"] == kind and at - s["seen"] <= rules.spot_us and motion.overlap(box, s["box"]) >= rules.overlap]
        top = min(live, key=lambda s: s["first"], default=None)
        knows = bool(top and top["earned"] and at - top["earned"] < rules.moved_us)
        t = tracks.get(tid)
        if t and at - t["all"][-1][0] > rules.lost_us:
            t = None
        if row["coasted"]:
            shown = t or {"state": "active", "since": 0, "moved": False, "arrived": False}
            out.append((row["camera_id"], at, row["detection_id"], tid, shown["state"], shown["since"], shown["moved"], shown["arrived"], top is not None and not knows))
            continue
        if t is None:
            t = tracks[tid] = {"state": "parked" if top else "active", "since": top["since"] if top else at, "all": [(at, x, y)], "moved": knows, "arrived": knows, "earned": top["earned"] if top else 0, "away": 0, "window": [(at, x, y)]}
        else:
            t["all"].append((at, x, y))
            xs, ys = [p[1] for p in t["all"]], [p[2] for p in t["all"]]
            way = hypot(max(xs) - min(xs), max(ys) - min(ys))
            if way >= size * rules.moved_share:
                t["moved"], t["earned"] = True, at
            t["arrived"] = t["arrived"] or way >= size * rules.arrived_share
            w = t["window"] = [*t["window"], (at, x, y)] if len(t["window"]) < 2 else [p for p in t["window"] if p[0] >= at - rules.window_us] + [(at, x, y)]
            mx, my = sorted(p[1] for p in w)[len(w) // 2], sorted(p[2] for p in w)[len(w) // 2]
            radius = max(rules.still_least, rules.still_share * size)
            t["away"] = t["away"] + 1 if hypot(x - mx, y - my) > 2 * radius else 0
            extents = [w] + ([[p for j, p in enumerate(w) if j != max(range(len(w)), key=lambda i: (w[i][1] - mx) ** 2 + (w[i][2] - my) ** 2)]] if len(w) > 4 else [])
            extent = min(hypot(max(p[1] for p in e) - min(p[1] for p in e), max(p[2] for p in e) - min(p[2] for p in e)) for e in extents)
            grown = at - t["all"][0][0] >= rules.window_us
            if t["state"] == "active" and grown and extent <= radius:
                t["state"], t["since"] = "stationary", at
            elif t["state"] != "active" and grown and t["away"] >= rules.departures:
                t["state"], t["since"] = "active", at
                spots = [s for s in spots if s not in live and s["by"] != tid]
            elif t["state"] == "stationary" and at - t["since"] >= rules.park_us and not (t["since"] == at):
                t["state"] = "parked"
        if t["state"] != "active":
            old = next((s for s in spots if s["by"] == tid and at - s["seen"] <= rules.spot_us), None)
            spots = [s for s in spots if s["by"] != tid] + [{"by": tid, "kind": kind, "box": box, "since": t["since"], "seen": at, "earned": t["earned"], "first": old["first"] if old else (at, row["detection_id"])}]
        out.append((row["camera_id"], at, row["detection_id"], tid, t["state"], t["since"], t["moved"], t["arrived"], top is not None and not knows))
    return out


def scenes(seed, n=900):
    """Two cameras: standing objects whose tracks break off and begin anew, jitter, walks, pauses of hours, equal times."""
    rnd, rows = random.Random(seed), []
    for camera in (1, 2):
        at, serial = 1_700_000_000 * S, 0
        things = [{"id": k, "box": moved(BOX, 150 * k, 40 * (k % 2)), "kind": "car" if k % 3 else "person"} for k in range(4)]
        for i in range(n // 2):
            at += rnd.choice([0, S, S, 2 * S, 9 * S]) if rnd.random() > 0.012 else rnd.choice([61 * S, 3600 * S, 7300 * S])
            thing = rnd.choice(things)
            if rnd.random() < 0.03:
                serial += 1
                thing["id"] = 100 * serial + thing["id"] % 100
            if rnd.random() < 0.05:
                thing["goal"] = rnd.choice([-60, 60, 120])
            step = rnd.uniform(-4, 4) + thing.get("goal", 0) * (rnd.random() < 0.5)
            thing["box"] = moved(thing["box"], step, rnd.uniform(-3, 3))
            if rnd.random() < 0.5:
                thing.pop("goal", None)
            rows.append({"camera_id": camera, "at_us": at, "detection_id": len(rows), "track_id": thing["id"], "class_name": thing["kind"], **dict(zip(("x1", "y1", "x2", "y2"), thing["box"], strict=True)), "coasted": rnd.random() < 0.1})
    return rows


def by_camera(rows, rules):
    return sorted(x for c in {r["camera_id"] for r in rows} for x in plain([r for r in rows if r["camera_id"] == c], rules))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_table_equals_the_plain_version(spark, seed):
    rows = scenes(seed)
    got = motion.motion_states(spark.createDataFrame(rows, SCHEMA).repartition(3), RULES)
    want = by_camera(rows, RULES)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert {r[4] for r in want} == {"active", "stationary", "parked"} and any(r[8] for r in want)


@pytest.mark.parametrize("size", [40, 130, 450])
def test_a_stream_gives_the_same_rows_however_it_is_cut(spark, tmp_path, size):
    rows = sorted(scenes(4, 450), key=lambda r: (r["at_us"], r["detection_id"]))
    end = {**rows[-1], "camera_id": 9, "at_us": rows[-1]["at_us"] + 3600 * S, "detection_id": -1}  # lets the watermark pass all others
    rnd, folder = random.Random(size), tmp_path / "in"
    folder.mkdir()
    for i, a in enumerate(range(0, len(rows), size)):
        part = rows[a : a + size]
        rnd.shuffle(part)
        (folder / f"{i:03}.json").write_text("".join(json.dumps(r) + "\n" for r in part))
        os.utime(folder / f"{i:03}.json", (1_700_000_000 + 10 * i,) * 2)
    (folder / "999.json").write_text(json.dumps(end) + "\n")
    os.utime(folder / "999.json", (1_700_100_000,) * 2)
    old = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder))
        query = motion.stream_motion_states(stream, RULES).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert query.awaitTermination(240) and query.exception() is None
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.camera_id != 9)
    assert got == by_camera(rows, RULES)


def test_rules_of_single_cameras_empty_tables_and_extra_columns(spark):
    rows = [{"camera_id": c, "at_us": i * S, "detection_id": i, "track_id": 1, "class_name": "car", "x1": 0.0, "y1": 0.0, "x2": 9.0, "y2": 9.0, "coasted": False} for c in (1, 2) for i in range(12)]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as motion_state", "1 as _run").drop("coasted")
    got = motion.motion_states(frame, RULES, {2: motion.Motion(window_us=2 * S)}).filter("motion_state <> 'active'").groupBy("camera_id").count()
    assert {tuple(r) for r in got.collect()} == {(1, 4), (2, 10)}
    assert motion.motion_states(spark.createDataFrame([], SCHEMA), RULES).collect() == []
