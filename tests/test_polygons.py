"""Rings that cross themselves against results by hand and against counting how often they wind."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from vigilake.functions import polygons as P

BOW = [(0, 0), (2, 2), (2, 0), (0, 2)]


def test_results_by_hand():
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    assert P.repaired(square) == P.repaired(square[::-1]) == P.repaired([(1, 0), *square[1:], square[0], (1, 0)]) == [square]
    assert P.repaired(BOW) == [[(0, 0), (1, 1), (0, 2)], [(1, 1), (2, 0), (2, 2)]]
    assert P.repaired([(0, 0), (2, 0), (2, 2), (1, 2), (1, 5), (1, 2), (0, 2)]) == [square]  # a spike outwards
    assert P.repaired([(0, 0), (2, 0), (2, 2), (1, 2), (1, 1), (1, 2), (0, 2)]) == [square]  # and one inwards
    assert P.repaired([*square, *square]) == [square]  # walked twice
    assert P.repaired([(0, 0), (1, 1), (3, 3)]) == P.repaired([(0, 0), (1, 0), (2, 0), (1, 0)]) == []
    assert P.repaired([(1, 1)]) == P.repaired([]) == P.repaired(None) == P.repaired([(0, 0), (1, None), (1, 1)]) == P.repaired([(0, 0), (1, math.nan), (1, 1)]) == []
    # a moat walked in and out along one line leaves a hole, wound the other way
    moat = [(0, 0), (6, 0), (6, 6), (0, 6), (0, 0), (2, 2), (2, 4), (4, 4), (4, 2), (2, 2)]
    assert P.repaired(moat) == [[(0, 0), (6, 0), (6, 6), (0, 6)], [(2, 2), (2, 4), (4, 4), (4, 2)]]
    star = [(math.sin(4 * math.pi * i / 5), math.cos(4 * math.pi * i / 5)) for i in range(5)]
    assert [len(r) for r in P.repaired(star)] == [10]


def winds(ring, x, y):
    """By the angles the corners turn through."""
    turn = 0.0
    for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]], strict=True):
        d = math.atan2(by - y, bx - x) - math.atan2(ay - y, ax - x)
        turn += (d + math.pi) % (2 * math.pi) - math.pi
    return round(turn / (2 * math.pi))


def test_random_rings_hold_the_points_they_wind_around(spark):
    rng = random.Random(6)
    zones = [(i, [(rng.randint(0, 6), rng.randint(0, 6)) for _ in range(rng.randint(3, 12))]) for i in range(120)]
    zones += [(200, BOW), (201, [(0, 0), (3, 3), (6, 6)]), (202, None), (203, [])]
    df = spark.createDataFrame([(i, z and [{"x": float(x), "y": float(y)} for x, y in z]) for i, z in zones], "zone_id long, polygon array<struct<x: double, y: double>>")
    points = [(rng.randint(0, 60) / 10 + 0.0137, rng.randint(0, 60) / 10 + 0.0271) for _ in range(60)]
    at = spark.createDataFrame(points, "x double, y double")
    fixed = P.repaired_zones(df)
    assert {r.zone_id for r in fixed.collect()} >= {200} and fixed.filter("zone_id > 200").count() == 0
    got = {(r.zone_id, r.x, r.y) for r in fixed.crossJoin(F.broadcast(at)).filter(P.strictly_within(F.col("x"), F.col("y"), F.col("rings"))).collect()}
    want = {(i, x, y) for i, z in zones if z for x, y in points if winds(z, x, y) != 0}
    assert got == want and len(want) > 1000
    edges = fixed.filter("zone_id = 200").select(*(P.strictly_within(F.lit(x), F.lit(y), F.col("rings")).alias(n) for n, x, y in (("m", 1.0, 1.0), ("e", 0.5, 0.5), ("in", 0.25, 1.0), ("out", 1.0, 0.5))))
    assert tuple(edges.first()) == (False, False, True, False)
