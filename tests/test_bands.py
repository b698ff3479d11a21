"""State machines as scans, against plain loops; the fading vote with its cap; the motion query against the plain machine."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from vigilake.operators import analytics, scan, telemetry
from vigilake.plans.catalog import QUERIES

HOUR = 3_600_000_000


@pytest.mark.parametrize(("width", "fan"), [(1000, 3), (50, 4), (10**9, 512)])
def test_scan_equals_a_loop(spark, width, fan):
    """Any machine, whatever the buckets; equal times go by the tie; a null key and a clashing column."""
    rnd, states = random.Random(width), 5
    rows = [(rnd.choice([1, 2, None]), rnd.randrange(-900, 2000), i, [rnd.randrange(states) for _ in range(states)] if i % 3 else list(range(states)), "x") for i in range(400)]
    want, now = {}, {}
    for key, at, tie, move, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        now[key] = want[tie] = move[now.get(key, 2)]
    df = spark.createDataFrame(rows, "k long, at long, tie long, m array<int>, item string").repartition(3)
    got = scan.scanned(df, ["k"], "at", "tie", F.col("m"), states, 2, width, "after", fan).collect()
    assert {r.tie: r.after for r in got} == want and {(r.k, r.at, r.tie, r.item) for r in got} == {(r[0], r[1], r[2], r[4]) for r in rows}
    assert scan.scanned(df.limit(0), ["k"], "at", "tie", F.col("m"), states, 2, width).collect() == []


EDGES = (40, 90, 150)


def means(luma, ir, band):
    if ir >= 0.5:
        return "ir"
    if luma < 0:
        return None
    plain = ["dark", "dim", "normal", "bright"][sum(luma >= e for e in EDGES)]
    if band in (None, "ir"):
        return plain
    i = ["dark", "dim", "normal", "bright"].index(band)
    low, high = (float("-inf"), *EDGES)[i], (*EDGES, float("inf"))[i]
    return band if low - 8 <= luma < high + 8 else plain


def readings(n):
    rnd, luma, out = random.Random(n), 100.0, []
    for i in range(n):
        luma = min(200.0, max(0.0, luma + rnd.uniform(-25, 25)))
        lit = rnd.choice([luma, luma, luma, rnd.choice([32.0, 48.0, 47.9, 82.0, 98.0, 142.0, 158.0, 31.9]), -1.0])
        out.append((rnd.choice([1, 2]), i * 700_000_000, i, lit, rnd.choice([0.1, 0.1, 0.1, 0.1, 0.5, -1.0]), rnd.random() < 0.2))
    return out


def test_bands_equal_a_loop(spark):
    rows = readings(600) + [(3, 5, 1000, None, None, False), (3, 6, 1001, None, 0.7, False), (3, 7, 1002, 10.0, None, False)]
    df = spark.createDataFrame(rows, "camera_id long, at_us long, id long, luma double, ir double, held boolean")
    held, switched, band, wait, force = {}, {}, {}, {}, {}
    for c, _, i, luma, ir, stays in rows:
        m = None if luma is None else means(luma, ir or 0.0, band.get(c))
        band[c] = held[i] = m or band.get(c)
        lit, infra = -1.0 if luma is None else luma, -1.0 if ir is None else ir
        if not (lit < 0 and infra < 0):
            m = means(lit, max(infra, 0.0), force.get(c))
            if m is None or m == force.get(c):
                wait.pop(c, None)
            elif wait.get(c) != m:
                wait[c] = m
            else:
                wait.pop(c)
                force[c] = force.get(c) if stays else m
        switched[i] = force.get(c)
    got = telemetry.held_light(df, ["camera_id"], "at_us", "id", F.col("luma"), F.col("ir"))
    assert {r.id: r.band for r in got.collect()} == held
    got = telemetry.switched_light(df, ["camera_id"], "at_us", "id", F.col("luma"), F.col("ir"), F.col("held"))
    assert {r.id: r.band for r in got.collect()} == switched
    assert len(set(held.values())) == 6 and len(set(switched.values())) == 6


def test_a_fading_vote_with_its_cap(spark):
    """Against the fold itself in plain form; a person's vote, if any, wins, and of equal weights the first."""
    rnd = random.Random(8)
    rows = [(k, i, rnd.choice([1, 2, 7]), rnd.choice([0.3, 0.5, 0.9])) for k in range(12) for i in range(60)]
    got = analytics.confidence_vote(spark.createDataFrame(rows, "k long, at long, class_id int, confidence double"), ["k"], "at", 5.0)
    want = {}
    for k in range(12):
        votes: dict[int, float] = {}
        for _, _, c, w in sorted(r for r in rows if r[0] == k):
            votes[c] = votes.get(c, 0.0) + w
            if (total := sum(votes.values())) > 5.0:
                votes = {x: v * 5.0 / total for x, v in votes.items()}
        best = max(votes, key=lambda x: votes[x])
        want[k] = (best, pytest.approx(votes[best]))
    assert {r.k: (r.class_id, r.weight) for r in got.collect()} == want
    with_person = spark.createDataFrame([(1, 1, 2, 9.0), (1, 2, 0, 0.2), (1, 3, 0, 0.9), (2, 1, 7, 0.5), (2, 2, 3, 0.5), (3, 1, None, 0.5)], "k long, at long, class_id int, confidence double")
    assert {tuple(r) for r in analytics.confidence_vote(with_person, ["k"], "at").collect()} == {(1, 0, 0.2), (2, 7, 0.5)}


def test_the_motion_query_equals_the_plain_machine(spark):
    from test_motion import by_camera
    from vigilake.plans.logical import Lake
    from vigilake.streaming import motion

    root, day = "/root/testdata/sf0.001", 24 * HOUR
    seen = {}
    real, motion.motion_states = motion.motion_states, lambda rows, rules: seen.update(rows=rows, rules=rules) or real(rows, rules)
    try:
        got = sorted(map(tuple, QUERIES["motion_states"](spark, root).collect()))
    finally:
        motion.motion_states = real
    rows = [r.asDict() for r in seen["rows"].collect()]
    assert len(rows) == Lake(spark, root).events().count() and seen["rules"].park_us == 4 * day
    assert got == by_camera(rows, seen["rules"]) and {"active", "stationary", "parked"} == {r[4] for r in got}
