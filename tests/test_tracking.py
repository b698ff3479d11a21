"""The embedder's cadence and backend, the box hold and the landmarks against plain Python."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from vigilake.functions import faces
from vigilake.operators import tracking

SECOND = 1_000_000


def _rows():
    rng, rows = random.Random(11), []
    for track in range(4):
        at = 0
        for i in range(120):
            at += rng.choice([0, 200_000, 300_000, 5 * SECOND, 40 * SECOND, 70 * SECOND, 301 * SECOND])
            rows.append((track, track * 1000 + i, at, rng.choice([0.2, 0.3, 0.5, 0.9, None]), rng.choice(["active", "parked", "parked", None]), i))
    return rows, "track_id long, sample_id long, at_us long, confidence double, motion_state string, box long"


def test_cadence_takes_what_a_plain_fold_takes(spark):
    rows, schema = _rows()
    want, last = set(), {}
    for k, i, at, c, state, _ in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        if c is not None and c >= 0.3 and (k not in last or at - last[k] >= (SECOND // 2 if state == "active" else 300 * SECOND)):
            last[k] = at
            want.add(i)
    got = tracking.due_for_embedding(spark.createDataFrame([*rows, (1, 9, None, 0.9, None, 0)], schema), ["track_id"], "at_us", "sample_id").collect()
    assert {r.sample_id for r in got} == want and len(got) == len(want) and 4 < len(want) < 300
    assert tracking.due_for_embedding(spark.createDataFrame([], schema), ["track_id"], "at_us", "sample_id").count() == 0


def test_a_box_is_held_while_at_rest(spark):
    rows, schema = _rows()
    want, held, seen = {}, {}, {}
    for k, i, at, c, state, box in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        if state == "active" or at - seen.get(k, at) > 60 * SECOND:
            held.pop(k, None)
        seen[k] = at
        if state == "active":
            want[i] = (box, c)
            continue
        if k not in held or (c is not None and (held[k][1] is None or c > held[k][1])):
            held[k] = (box, c)
        want[i] = held[k]
    got = tracking.held_boxes(spark.createDataFrame(rows, schema), ["track_id"], "at_us", "sample_id").collect()
    assert {r.sample_id: (r.held_box, r.held_confidence) for r in got} == want


def test_a_backend_embeds_what_is_not_null(spark):
    def make():
        return lambda items: np.array([[len(x), x.count("a")] for x in items])

    df = spark.createDataFrame([(1, "aab"), (2, None), (3, "")], "i int, crop string")
    assert {r.i: r.embedding for r in tracking.embedded(df, "crop", make).collect()} == {1: [3.0, 2.0], 2: None, 3: [0.0, 0.0]}


def test_landmarks(spark):
    turn = 0.6
    turned = [(3 * (u * np.cos(turn) - v * np.sin(turn)) + 9, 3 * (u * np.sin(turn) + v * np.cos(turn)) - 4) for u, v in faces.TEMPLATE]
    cases = {"template": faces.TEMPLATE, "turned": turned, "mirrored": [(112 - u, v) for u, v in faces.TEMPLATE], "one place": [(1.0, 1.0)] * 5, "four": faces.TEMPLATE[:4], "none": None}
    df = spark.createDataFrame([(n, None if p is None else [tuple(map(float, q)) for q in p]) for n, p in cases.items()], "n string, p array<struct<x:double,y:double>>")
    box = F.struct(*(F.lit(c).alias(n) for c, n in ((0.0, "x1"), (0.0, "y1"), (112.0, "x2"), (112.0, "y2"))))
    got = {r.n: (r.r, r.ok) for r in df.select("n", faces.residual(F.col("p")).alias("r"), faces.plausible(F.col("p"), box).alias("ok")).collect()}
    assert got["template"][0] < 1e-6 and got["template"][1] and got["turned"][0] < 1e-6
    assert got["mirrored"][0] > 0.05 and not got["mirrored"][1]
    assert got["one place"] == got["four"] == got["none"] == (None, False)


def test_displacement_leaves_out_one_wild_point(spark):
    rows = [(1, i, float(i % 2), 0.0) for i in range(5)] + [(1, 5, 90.0, 0.0), (1, 6, 0.0, 0.0), (2, 0, 0.0, 0.0), (2, 1, 30.0, 40.0)]
    table = spark.createDataFrame(rows, "track long, at long, x double, y double")
    got = {(r.track, r.at): (r.displacement, r.off_streak) for r in tracking.displacement(table, ["track"], "at", "at", F.col("x"), F.col("y"), 100, 5.0).collect()}
    assert got[1, 4] == (1.0, 0) and got[1, 5] == (1.0, 1) and got[1, 6] == (1.0, 0)
    assert got[2, 0] == (0.0, 0) and got[2, 1] == (50.0, 0)  # the median of two is the upper one
    assert tracking.displacement(table.limit(0), ["track"], "at", "at", F.col("x"), F.col("y")).count() == 0


def test_live_states_hold_motion_and_tell_changes_only(spark):
    rows = [(1, 0, 2, "active", True), (1, 5, 2, "parked", True), (1, 9, 2, "parked", True), (1, 12, 0, "Parked", True), (1, 13, 0, None, False), (1, 14, None, None, None)]
    got = tracking.live_states(spark.createDataFrame(rows, "camera_id long, at_us long, class_id int, motion_state string, ever_active boolean"), 9)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0, True, 0, "vehicle"), (1, 9, False, 0, "vehicle"), (1, 12, False, 1, "person"), (1, 13, False, 0, "none")]
    assert tracking.live_states(got.select("camera_id", "at_us").limit(0).selectExpr("*", "0 AS class_id", "'' AS motion_state", "true AS ever_active")).count() == 0
