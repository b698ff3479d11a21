"""Association and birth spots: scenes with known outcomes, plain versions, and streams."""

from __future__ import annotations

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from vigilake.plans.catalog import QUERIES
from vigilake.streaming import association as A
from vigilake.streaming import birth_spots as B
from vigilake.streaming.motion import overlap
from vigilake.streaming.ordered import STATE_STORE

S = 1_000_000
BOX = (100.0, 100.0, 200.0, 200.0)


def moved(box, dx):
    return (box[0] + dx, box[1], box[2] + dx, box[3])


def tracked(frames, rules=A.Association()):
    """Names by frame; a frame is (second, [(box, look)])."""
    fold, out, n = A.Tracks(rules), [], 0
    for at, boxes in frames:
        ds = []
        for box, look in boxes:
            ds.append({"detection_id": n, "class_name": "car", "box": list(box), "look": look})
            n += 1
        out.append([r[2:] for r in fold.take({"at_us": int(at * S), "detections": json.dumps(ds)})])
    return out


def test_one_sighting_earns_no_name_the_second_does():
    got = tracked([(0, [(BOX, None)]), (1, [(BOX, None)]), (2, [(moved(BOX, 5), None)])])
    assert got == [[(None, False)], [(0, False)], [(0, False)]]


def test_tracks_cross_by_their_pace_and_ties_go_to_the_older():
    left, right = (0.0, 0.0, 40.0, 40.0), (200.0, 0.0, 240.0, 40.0)
    frames = [(i / 2, [(moved(left, 10 * i), None), (moved(right, -10 * i), None)]) for i in range(21)]
    got = tracked(frames)
    assert all(g == [(0, False), (1, False)] for g in got[1:])
    twins = tracked([(0, [(BOX, None), (BOX, None)]), (1, [(BOX, None), (BOX, None)]), (2, [(BOX, None)])])
    assert twins[1:] == [[(0, False), (1, False)], [(0, False)]]


def test_a_lost_track_is_regained_by_appearance_while_it_is_remembered():
    look, other = [1.0, 0.0], [0.0, 1.0]
    base = [(i, [(BOX, look)]) for i in range(5)]
    far = moved(BOX, 500)
    empty = [(4 + i, []) for i in range(1, 9)]
    assert tracked([*base, *empty, (13, [(far, look)]), (14, [(far, look)])])[-2:] == [[(None, False)], [(0, True)]]
    assert tracked([*base, *empty, (13, [(far, other)]), (14, [(far, other)])])[-1] == [(5, False)]
    long = [(4 + i, []) for i in range(1, 40)]
    assert tracked([*base, *long, (45, [(far, look)]), (46, [(far, look)])])[-1] == [(5, False)]


def test_one_step_takes_three_seconds_at_most_an_outage_ends_all():
    base = [(i, [(BOX, None)]) for i in range(6)]
    assert tracked([*base, (5 + 100, [(BOX, None)])])[-1] == [(0, False)]
    assert tracked([*base, (5 + 121, [(BOX, None)])])[-1] == [(None, False)]
    # a slow camera ends a track after the same time as a fast one
    assert tracked([*base, (8, []), (10, []), (11, [(BOX, None)])])[-1] == tracked([*base, *((5 + k / 4, []) for k in range(1, 21)), (11, [(BOX, None)])])[-1] == [(None, False)]


def plain(frames, r):
    """The same by whole lists of tracks; the cheapest pair is looked for again after every match."""
    tracks, last, out = [], None, []

    def take(pool, ds, free, now):
        got = []
        while True:
            best = None
            for t in pool:
                dt = (now - t["seen"]) / S
                box = [c + t["v"][i % 2] * dt for i, c in enumerate(t["box"])]
                for i in sorted(free):
                    cost = (1 - overlap(box, ds[i]["box"]), t["id"], i)
                    if ds[i]["class_name"] == t["cls"] and cost[0] < r.distance and (best is None or cost < best[0]):
                        best = (cost, t, i)
            if best is None:
                return got
            pool, free = [t for t in pool if t is not best[1]], free - {best[2]}
            got.append(best[1:])

    for now, ds in frames:
        if last is not None and now - last > r.outage_us:
            tracks, last = [], None
        step = 0 if last is None else min(now - last, r.longest_step_us)
        last = now
        for t in tracks:
            t["life"] -= step
        for t in tracks:
            if t["st"] == "named" and t["life"] < 0:
                t["st"], t["life"] = "lost", r.remembered_us
                t["fresh"] = True
        tracks = [t for t in tracks if t["life"] >= 0]
        free, names, new = set(range(len(ds))), {}, []
        for st in ("named", "young"):
            for t, i in take([t for t in tracks if t["st"] == st], ds, free, now):
                if now > t["seen"]:
                    dt, c = (now - t["seen"]) / S, lambda b: [(b[0] + b[2]) / 2, (b[1] + b[3]) / 2]
                    t["v"] = [(v + (q - p) / dt) / 2 for v, p, q in zip(t["v"], c(t["box"]), c(ds[i]["box"]))]
                t.update(box=ds[i]["box"], seen=now, look=ds[i]["look"] or t["look"], life=max(min(t["life"] + 2 * step, r.lost_us), r.least_us))
                free = free - {i}
                if st == "young":
                    new.append((t, i))
                else:
                    names[i] = (t["name"], False)
        lost = [t for t in tracks if t["st"] == "lost"]
        options = sorted((A.unlike(t["look"], o["look"]), t["id"], o["id"]) for t, _ in new for o in lost if t["cls"] == o["cls"])
        again = {}
        for d, a, b in options:
            if d < r.appearance and a not in again and b not in again.values():
                again[a] = b
        for t, i in new:
            t["st"] = "named"
            if t["id"] in again:
                o = next(x for x in lost if x["id"] == again[t["id"]])
                t["name"] = o["name"]
                tracks = [x for x in tracks if x is not o]
            names[i] = (t["name"], t["id"] in again)
        tracks += [{"id": ds[i]["detection_id"], "name": ds[i]["detection_id"], "st": "young", "cls": ds[i]["class_name"], "box": ds[i]["box"], "seen": now, "v": [0.0, 0.0], "look": ds[i]["look"], "life": max(step, r.least_us)} for i in sorted(free)]
        out += [(now, d["detection_id"], *names.get(i, (None, False))) for i, d in enumerate(ds)]
    return out


def scenes(seed, n=160):
    rnd, rows = random.Random(seed), []
    for camera in (1, 2):
        at, things = 0, [{"box": moved(BOX, 70 * k), "look": [float(k % 3), 1.0, float(k % 2)], "cls": "car" if k % 3 else "person"} for k in range(5)]
        for _ in range(n):
            at += rnd.choice([S // 4, S // 2, S, S, 3 * S, 5 * S]) if rnd.random() > 0.04 else rnd.choice([30 * S, 119 * S, 300 * S])
            for t in things:
                t["box"] = moved(t["box"], rnd.uniform(-12, 12) + (rnd.choice([-300, 300]) if rnd.random() < 0.02 else 0))
                if rnd.random() < 0.75:
                    rows.append((camera, at, len(rows), t["cls"], *t["box"], t["look"] if rnd.random() < 0.7 else None))
    return rows


SCHEMA = "camera_id long, at_us long, detection_id long, class_name string, x1 double, y1 double, x2 double, y2 double, embedding array<double>"


def plain_rows(rows, rules):
    out = []
    for camera in sorted({r[0] for r in rows}):
        frames = {}
        for r in sorted((r for r in rows if r[0] == camera), key=lambda r: (r[1], r[2])):
            frames.setdefault(r[1], []).append({"detection_id": r[2], "class_name": r[3], "box": [float(c) for c in r[4:8]], "look": r[8]})
        out += [(camera, *x) for x in plain(sorted(frames.items()), rules)]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_association_equals_the_plain_version(spark, seed):
    rows = scenes(seed)
    got = sorted(map(tuple, A.associated(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()), key=str)
    want = plain_rows(rows, A.Association())
    assert got == want and any(r[4] for r in want) and any(r[3] is None for r in want)
    assert A.associated(spark.createDataFrame([], SCHEMA)).collect() == []


def births(rows, r):
    """By definition over the whole past, spot by spot."""
    out = []
    for camera in sorted({x[0] for x in rows}):
        spots, tracks = [], {}
        for _, at, d, tid, cls, x1, y1, x2, y2, mv, conf in sorted((x for x in rows if x[0] == camera), key=lambda x: (x[1], x[2])):
            spots = [s for s in spots if at - s["last"] <= r.spot_us]
            t = tracks.get(tid)
            if t and (at - t["seen"] > r.lost_us or not any(s is t["spot"] for s in spots)):
                t = None
            if t is None:
                fx, fy = (x1 + x2) / 2, y2
                own = sorted((s for s in spots if s["cls"] == cls and s["box"][0] <= fx <= s["box"][2] and s["box"][1] <= fy <= s["box"][3]), key=lambda s: (-s["n"], s["first"], s["id"]))
                if own:
                    spot = own[0]
                else:
                    spot = {"id": d, "cls": cls, "box": (x1, y1, x2, y2), "n": 0, "m": 0, "first": at, "last": at}
                    ranked = sorted([*spots, spot], key=lambda s: (-s["n"], s["first"], s["id"]))
                    spots = ranked[: r.most_spots] + [s for s in ranked[r.most_spots :] if s is spot]
                spot["n"] += 1
                spot["last"] = at
                t = tracks[tid] = {"spot": spot, "banked": False, "sure": False}
            t["seen"], spot = at, t["spot"]
            if mv and not t["banked"]:
                t["banked"] = True
                spot["m"] += 1
            t["sure"] = t["sure"] or (not mv and conf >= r.confidence)
            bad = not spot["m"] and spot["n"] >= r.births and spot["last"] - spot["first"] >= r.span_us
            out.append((camera, at, d, tid, spot["id"], spot["n"], spot["m"], bad and not mv and not t["sure"]))
    return sorted(out)


BIRTH = "camera_id long, at_us long, detection_id long, track_id long, class_name string, x1 double, y1 double, x2 double, y2 double, moved boolean, confidence double"
RULES = B.Registry(births=4, span_us=60 * S, most_spots=3, spot_us=900 * S, lost_us=20 * S)


def born(seed, n=500):
    rnd, rows, at = random.Random(seed), [], 0
    for i in range(n):
        at += rnd.choice([0, S, 2 * S, 7 * S]) if rnd.random() > 0.02 else rnd.choice([30 * S, 1000 * S])
        k = rnd.choice([0, 0, 0, 1, 1, 2, 3, 4, 5])
        x = 100.0 * k + rnd.uniform(-20, 20)
        rows.append((rnd.choice([1, 2]), at, i, 10 * (i // 12) + k, "person" if k % 2 else "car", x, 0.0, x + 80, 90.0, k > 2 and rnd.random() < 0.3, rnd.choice([0.3, 0.5, 0.8]) if k else 0.4))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_birth_spots_equal_the_plain_version(spark, seed):
    """With eviction over the cap, pruning by age, movers counted once a track, and confident tracks."""
    rows = born(seed)
    got = sorted(map(tuple, B.birth_spots(spark.createDataFrame(rows, BIRTH).repartition(3), RULES).collect()))
    assert got == births(rows, RULES) and {True, False} == {r[7] for r in got} and max(r[6] for r in got) > 0
    assert B.birth_spots(spark.createDataFrame([], BIRTH), RULES).collect() == []


def test_the_new_spot_stays_over_the_cap():
    fold = B.Births(B.Registry(most_spots=2))
    for i, x in enumerate((0, 0, 300, 300, 600)):
        fold.take({"at_us": i, "detection_id": i, "track_id": i, "class_name": "car", "x1": float(x), "y1": 0.0, "x2": x + 9.0, "y2": 9.0, "moved": False, "confidence": 0.1})
    assert sorted(n for n in fold.entries if n[0] == "s") == ["s/0", "s/2", "s/4"]


def test_streams_give_the_rows_of_the_tables(spark, tmp_path):
    cases = {
        "births": (born(5, 300), BIRTH, B.stream_birth_spots, births(born(5, 300), RULES), RULES),
        "tracks": (scenes(5, 60), SCHEMA, A.stream_associated, plain_rows(scenes(5, 60), A.Association()), A.Association()),
    }
    old = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        for name, (rows, schema, stream, want, rules) in cases.items():
            df = spark.createDataFrame(rows, schema)
            if name == "tracks":
                df = A.frames(df)
            made = sorted((r.asDict() for r in df.collect()), key=lambda r: r["at_us"])
            folder = tmp_path / name
            (folder / "in").mkdir(parents=True)
            parts = [made[a : a + 70] for a in range(0, len(made), 70)] + [[{**made[-1], "camera_id": 9, "at_us": made[-1]["at_us"] + 7200 * S}]]
            for i, part in enumerate(parts):
                file = folder / "in" / f"{i:03}.json"
                file.write_text("".join(json.dumps(r) + "\n" for r in part))
                os.utime(file, (1_700_000_000 + 10 * i,) * 2)
            source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).json(str(folder / "in"))
            query = stream(source, rules).writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "cp")).trigger(availableNow=True).start()
            assert query.awaitTermination(240) and query.exception() is None
            got = sorted((tuple(r) for r in spark.read.parquet(str(folder / "out")).collect() if r.camera_id != 9), key=str)
            assert got == sorted(want, key=str)
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_queries_equal_the_plain_versions(spark):
    from unittest import mock

    root = "/root/testdata/sf0.001"
    for module, name, check in ((A, "associated", plain_rows), (B, "birth_spots", births)):
        seen = {}
        real = getattr(module, name)
        with mock.patch.object(module, name, lambda rows, rules, seen=seen, real=real: seen.update(rows=rows, rules=rules) or real(rows, rules)):
            got = sorted(map(tuple, QUERIES[name](spark, root).collect()), key=str)
        rows = [tuple(r) for r in seen["rows"].collect()]
        assert got == sorted(check(rows, seen["rules"]), key=str)
        assert len(rows) == spark.read.parquet(f"{root}/events.parquet").count()
    assert QUERIES["birth_spots"](spark, root).filter(F.col("births") > 1).count() > 0
