"""Near rows, running ends and walks against plain loops over all pairs, on crowded rows with many ties; no plan joins pair by pair."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from vigilake.operators import occupancy, rangejoin, recordings, visits


def _pairless(df) -> bool:
    return "Join Inner" not in df._jdf.queryExecution().optimizedPlan().toString()


def _crowd(seed, n, places=3, span=60):
    rng = random.Random(seed)
    return [(i, rng.choice([*range(places), None]), rng.choice([*range(span), None]) if i % 9 else rng.randrange(span), rng.choice([0, 1, 2, None]), rng.choice(["g", None])) for i in range(n)]


def test_nearest_row_of_a_crowd(spark):
    a, b = _crowd(1, 80), _crowd(2, 120)
    left, right = spark.createDataFrame([x[:3] for x in a], "i long, k long, at long"), spark.createDataFrame([x[:3] for x in b], "j long, k long, o long")
    got = rangejoin.nearest(left, right, ["k"], "i", "at", "o", 5, ["j"], "j")
    assert _pairless(got)
    want = {}
    for i, k, at, *_ in a:
        near = [(abs(y[2] - at), y[0]) for y in b if k is not None and y[1] == k and at is not None and y[2] is not None and abs(y[2] - at) <= 5]
        want[i] = min(near) if near else (None, None)
    assert {r.i: (r.gap_us, r.j) for r in got.collect()} == want


def _served(fills, reads, before, after):
    """fill: its candidates, the best first."""
    out = {}
    for f, place, at, *_ in fills:
        near = [r for r in reads if None not in (place, at, r[2]) and r[1] == place and at - before <= r[2] <= at + after]
        out[f] = sorted(near, key=lambda r: (r[4] is None, -r[2], r[3] is not None, -(r[3] or 0), r[0]))
    return out


def test_reads_of_fills(spark):
    fills, reads = _crowd(3, 70), _crowd(4, 90)
    f = spark.createDataFrame([x[:3] for x in fills], "fill_id long, place long, filled_us long")
    r = spark.createDataFrame([(*x, False) for x in reads], "read_id long, place long, read_us long, readings long, global_id string, departing boolean")
    best = occupancy.best_read(f, r, before_us=20, after_us=4)
    near = _served(fills, reads, 20, 4)
    assert _pairless(best)
    assert {x.fill_id: x.read_id for x in best.collect()} == {k: v[0][0] for k, v in near.items() if v}
    # one to one: nulls of readings last, as the fold has always had it
    own = occupancy.assigned_reads(f, r, before_us=20, after_us=4)
    assert _pairless(own)
    taken, want = set(), {}
    for k, place, at, *_ in sorted((x for x in fills if x[2] is not None and x[1] is not None), key=lambda x: (x[2], x[0])):
        left = [x for x in near[k] if x[0] not in taken]
        left.sort(key=lambda x: (x[4] is None, -x[2], x[3] is None, -(x[3] or 0), x[0]))
        if left:
            want[k] = left[0][0]
            taken.add(left[0][0])
    assert {x.fill_id: x.read_id for x in own.collect()} == want


def test_names_of_departures(spark):
    eps, reads = _crowd(5, 60), _crowd(6, 90)
    e = spark.createDataFrame([(*x[:3], None) for x in eps], "episode_id long, place long, released_us long, global_id string")
    r = spark.createDataFrame(reads, "read_id long, place long, read_us long, readings long, global_id string")
    got = occupancy.departure_names(e, r, r.filter("read_id % 10 = 0"), 6)
    want = {}
    for i, place, at, *_ in eps:
        near = [x for x in reads if None not in (place, at, x[2]) and x[0] % 10 and x[1] == place and abs(x[2] - at) <= 6]
        if near:
            x = min(near, key=lambda x: (x[4] is None, abs(x[2] - at), x[3] is None, -(x[3] or 0), x[0]))
            want[i] = (x[4], x[0])
    assert _pairless(got)
    assert {x.episode_id: (x.global_id, x.read_id) for x in got.collect()} == want


def test_pins_of_tracks_kept_unlike_long(spark):
    rng = random.Random(7)
    rec = [(i, i % 2, s := rng.randrange(300), None if i % 5 == 0 else s + rng.randrange(20)) for i in range(60)]
    tr = [(i % 2, s := rng.randrange(300), s + rng.randrange(30), rng.choice([5, 50, None])) for i in range(50)]
    r = spark.createDataFrame(rec, "recording_id long, camera_id long, started_us long, ended_us long")
    t = spark.createDataFrame(tr, "camera_id long, started_us long, ended_us long, stay long")
    got = recordings.pins(r, t, 2, F.col("ended_us") + F.col("stay"), 40)
    last, want = max(x[2] for x in tr), {}
    for i, cam, s, e in rec:
        met = [x for x in tr if x[0] == cam and s <= x[2] + 2 and (max(last, s) if e is None else e) >= x[1] - 2]
        if met:
            want[i] = max((x[2] + x[3] for x in met if x[3] is not None), default=None)
    assert {x.recording_id: x.retain_until_us for x in got.collect()} == want
    assert "_bucketed" not in dir(recordings) and "sequence" not in got._jdf.queryExecution().optimizedPlan().toString()  # an open segment is not repeated by the hour


def test_walks_and_siblings(spark):
    rng = random.Random(8)
    gone = [(i, i % 2, rng.randrange(400)) for i in range(60)]
    moved = [(rng.randrange(2), rng.randrange(400)) for _ in range(25)]
    people = [(i, rng.randrange(2), s := rng.randrange(400), s + rng.randrange(12)) for i in range(80)]
    d = spark.createDataFrame(gone, "departure_id long, camera_id long, closes_us long")
    u, p = spark.createDataFrame(moved, "camera_id long, at_us long"), spark.createDataFrame(people, "track_id long, camera_id long, started_us long, ended_us long")
    got = visits.walk_to_drive_off(d, u, p, 60, 7, 4)
    want = {}
    for i, cam, c in gone:
        mv = max((t for k, t in moved if k == cam and c - 60 < t <= c), default=c - 4)
        first = None
        for x in sorted((x for x in people if x[1] == cam and mv - 60 < x[3] <= mv), key=lambda x: (-x[2], -x[0])):
            if first is not None and first - x[3] > 7:
                break
            first = x[2]
        want[i] = min(mv if first is None else min(first, mv), c - 4)
    assert _pairless(got)
    assert {x.departure_id: x.opens_us for x in got.collect()} == want
    cars = [(i, rng.randrange(3), s := rng.randrange(300), s + rng.choice([3, 9, 40, 200])) for i in range(90)]
    t = spark.createDataFrame(cars, "track_id long, camera_id long, started_us long, ended_us long")
    pairs = {(a[0], b[0]) for a in cars for b in sorted((b for b in cars if b[1] != a[1] and b[2] <= a[3] + 5 and b[3] >= a[2] - 5), key=lambda b: (abs(b[2] - a[2]), b[0]))[:4]}
    for width in (7, 50, 1000):
        sib = occupancy.siblings(t, 5, 4, width)
        assert _pairless(sib)
        rows = [tuple(x) for x in sib.collect()]
        assert len(rows) == len(pairs) and set(rows) == pairs, width
