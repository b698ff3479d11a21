"""Many spots and many points of a track: a row measures few, and finds what a look at all of them finds."""

from __future__ import annotations

import random
from math import inf

import pytest

from vigilake.streaming import motion


def spot(i, box, kind="car"):
    return {"class": kind, "box": box, "since": 0, "seen": 1000, "travelled": 0, "first": [i, i]}


def counted(monkeypatch, name):
    calls = []
    monkeypatch.setattr(motion, name, lambda *a, real=getattr(motion, name): calls.append(1) or real(*a))
    return calls


def row(at, x, track=9000, step=60.0):
    return {"at_us": at, "detection_id": at, "track_id": track, "class_name": "car", "x1": x, "y1": 0.0, "x2": x + step, "y2": 80.0}


@pytest.mark.parametrize(("x", "state"), [(0.0, motion.ACTIVE), (50.0, motion.PARKED)])
def test_a_row_measures_few_of_the_spots_at_one_place(monkeypatch, x, state):
    """600 older spots lie near the box and do not fit it, or lie under it."""
    calls = counted(monkeypatch, "overlap")
    scene = motion.Scene(motion.Motion(), {f"s/{i}": spot(i, [40.0 + i % 5, 0.0, 100.0 + i % 5, 80.0]) for i in range(600)})
    assert scene.take(row(1001, x))[0][3] == state and len(calls) < 20


def test_a_move_measures_few_spots(monkeypatch):
    calls = counted(monkeypatch, "overlap")
    rules = motion.Motion(window_us=10, park_us=10**9)
    entries = {f"s/{i}": spot(i, [40.0 + i % 5, 0.0, 100.0 + i % 5, 80.0]) for i in range(300)} | {f"s/{i}": spot(i, [200.0 + i % 3, 0.0, 260.0 + i % 3, 80.0]) for i in range(300, 400)}
    scene = motion.Scene(rules, entries)
    for i in range(12):
        scene.take(row(1001 + i, 500.0))
    for i in range(3):
        scene.take(row(1013 + i, 201.0))
    assert len([n for n in scene.entries if n[0] == "s"]) == 300 and len(calls) < 100


def some_box(rnd):
    w, h = rnd.choice([0.0, -4.0, 3.0, 40.0, 60.0, 64.0, 100.0, rnd.uniform(20, 90)]), rnd.choice([0.0, 5.0, 64.0, 80.0, rnd.uniform(40, 120)])
    x, y = rnd.choice([0.0, -32.0, rnd.uniform(-60, 60)]), rnd.choice([0.0, rnd.uniform(-40, 40), -64.0])
    return [x, y, x + w, y + h]


@pytest.mark.parametrize("least", [0.0, 0.3, 0.5, 1.0])
def test_spots_are_those_of_a_look_at_all(least):
    rnd = random.Random(round(10 * least))
    rules = motion.Motion(overlap=least, spot_us=500)
    entries = {f"s/{i}": spot(rnd.randrange(400), some_box(rnd), rnd.choice(["car", "person"])) | {"seen": rnd.randrange(1, 1000)} for i in range(700)}
    scene, several = motion.Scene(rules, entries), 0
    for _ in range(300):
        kind, box = rnd.choice(["car", "person"]), rnd.choice([some_box(rnd), rnd.choice(list(entries.values()))["box"]])
        want = {n for n, e in scene.entries.items() if e["class"] == kind and 1000 - e["seen"] <= 500 and motion.overlap(box, e["box"]) >= least}
        if box[2] > box[0] or least <= 0:
            assert sorted(scene._spots(kind, box, 1000)) == sorted(want)
            assert scene._oldest(kind, box, 1000) == min(want, key=lambda n: (scene.entries[n]["first"], n), default=None)
            several += len(want) > 5
        for n in rnd.sample(sorted(scene.entries), 2):
            scene._gone(n)
    assert (several > 20 or least == 1.0) and not any(n in scene.where for n in entries.keys() - scene.entries.keys())
    for n in list(scene.entries):
        scene._gone(n)
    assert not scene.places and not scene.where


def test_boxes_without_end_fit_nothing():
    scene = motion.Scene(motion.Motion(), {"s/1": spot(1, [0.0, 0.0, 60.0, inf]), "s/2": spot(2, [0.0, 0.0, inf, 80.0])})
    assert [scene.take(row(1001 + i, 0.0, i, step))[0][3] for i, step in enumerate((60.0, inf))] == [motion.ACTIVE] * 2


def test_a_long_window_is_not_gone_through_at_each_row(monkeypatch):
    calls = counted(monkeypatch, "spread_of")
    scene = motion.Scene(motion.Motion(window_us=500))
    for i in range(2000):
        scene.take(row(i, 20.0 * (i % 4)))
    own = scene.entries["t/9000"]["points"]
    assert len(own) == 501 and not calls
    assert scene.ascending["t/9000"] == (sorted(p[1] for p in own), sorted(p[2] for p in own))


def test_still_is_the_spread_against_the_radius():
    rnd, met = random.Random(3), set()
    for _ in range(4000):
        points = [[i, rnd.choice([0.0, 1.0, 2.0, 30.0 * (rnd.random() < 0.3)]), rnd.choice([0.0, 3.0, 9.0 * (rnd.random() < 0.2)])] for i in range(rnd.randrange(1, 9))]
        xs, ys = sorted(p[1] for p in points), sorted(p[2] for p in points)
        median, radius = (xs[len(xs) // 2], ys[len(ys) // 2]), rnd.choice([0.0, 1.0, 3.0, 10.0])
        want = motion.spread_of(points, median) <= radius
        assert motion.still(points, xs, ys, median, radius) == want
        met.add((want, len(points) > 4))
    assert len(met) == 4
